"""Vintage providers: a protocol, a paged JSON client, a CSV batch client, the choice between them and a cache.

Transports are functions from a URL to bytes, so nothing here needs a network in tests.
"""

from __future__ import annotations

import csv
import io
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date
from pathlib import Path
from typing import Protocol

from pit_engine.sources.snapshots import atomic_write
from pit_engine.sources.vintage_zip import encode, read_cells, vintage_of

Cell = tuple[str, date, date, float | None]
Transport = Callable[[str], bytes]


class VintageProvider(Protocol):
    """What a provider of revision archives offers."""

    def vintages(self, series_id: str) -> list[date]: ...

    def cells(self, series_id: str, vintages: list[date]) -> Iterator[Cell]: ...


def http_get(url: str, timeout: float = 30.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310 - the caller names the URL
        return r.read()


def retried(get: Transport, attempts: int = 4, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Transport:
    """The transport with growing pauses between failed attempts; the last failure is raised."""

    def run(url: str) -> bytes:
        for k in range(attempts):
            try:
                return get(url)
            except OSError:
                if k == attempts - 1:
                    raise
                sleep(pause * 2**k)
        raise AssertionError

    return run


def chunks(items: list, size: int) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at : at + size]


class JsonClient:
    """A paged JSON interface: ``count``, ``offset``, ``limit`` and a list of observations."""

    def __init__(self, base: str, key: str, get: Transport = http_get, page: int = 1000, batch: int = 50):
        self.base, self.key, self.get, self.page, self.batch = base, key, retried(get), page, batch

    def _pages(self, path: str, field: str, **query) -> Iterator:
        offset = 0
        while True:
            q = urllib.parse.urlencode({**query, "api_key": self.key, "file_type": "json", "limit": self.page, "offset": offset})
            got = json.loads(self.get(f"{self.base}/{path}?{q}"))
            yield from got[field]
            offset += self.page
            if offset >= int(got.get("count", 0)):
                return

    def vintages(self, series_id: str) -> list[date]:
        return [date.fromisoformat(v) for v in self._pages("series/vintagedates", "vintage_dates", series_id=series_id)]

    def cells(self, series_id: str, vintages: list[date]) -> Iterator[Cell]:
        for part in chunks(sorted(vintages), self.batch):
            dates = ",".join(v.isoformat() for v in part)
            for row in self._pages("series/observations", "observations", series_id=series_id, vintage_dates=dates, output_type=2):
                for column, text in row.items():
                    if column != "date":
                        yield series_id, date.fromisoformat(row["date"]), vintage_of(column)[1], None if text in (".", "", None) else float(text)

    def first_releases(self, series_id: str) -> Iterator[tuple[date, date, float]]:
        """(reference, release, value) as the provider itself states first releases."""
        for row in self._pages("series/observations", "observations", series_id=series_id, output_type=4):
            if row["value"] != ".":
                yield date.fromisoformat(row["date"]), date.fromisoformat(row["realtime_start"]), float(row["value"])


def read_graph_csv(payload: bytes, series_id: str, requested: list[date]) -> Iterator[Cell]:
    """Cells of a batched CSV: the first column is a date, the others are vintages of the series."""
    rows = csv.reader(io.StringIO(payload.decode("utf-8-sig")))
    head = next(rows)
    columns = [vintage_of(c) for c in head[1:]]
    if any(s != series_id for s, _ in columns) or sorted(v for _, v in columns) != sorted(requested):
        raise ValueError("the response's vintages are not those asked for")
    for row in rows:
        for (_, v), text in zip(columns, row[1:], strict=True):
            yield series_id, date.fromisoformat(row[0]), v, None if text.strip() in (".", "") else float(text)


class CsvClient:
    """A keyless interface: one CSV with a column for each vintage, and an HTML page that lists vintages."""

    def __init__(self, base: str, get: Transport = http_get, batch: int = 12):
        self.base, self.get, self.batch = base, retried(get), batch

    def vintages(self, series_id: str) -> list[date]:
        import re

        page = self.get(f"{self.base}/vintages?{urllib.parse.urlencode({'id': series_id})}").decode()
        return sorted({date.fromisoformat(d) for d in re.findall(r'<option[^>]*value="(\d{4}-\d{2}-\d{2})"', page)})

    def cells(self, series_id: str, vintages: list[date]) -> Iterator[Cell]:
        for part in chunks(sorted(vintages), self.batch):
            q = urllib.parse.urlencode({"id": ",".join([series_id] * len(part)), "vintage_date": ",".join(v.isoformat() for v in part)})
            yield from read_graph_csv(self.get(f"{self.base}/graph.csv?{q}"), series_id, part)


def choose(provider: str, environ: dict[str, str], key_name: str, json_base: str, csv_base: str, get: Transport = http_get) -> VintageProvider:
    """"json", "csv" or "auto": the keyed interface if there is a key."""
    key = environ.get(key_name, "").strip()
    if provider == "auto":
        provider = "json" if key else "csv"
    if provider == "json":
        if not key:
            raise ValueError(f"{key_name} is not set")
        return JsonClient(json_base, key, get)
    if provider == "csv":
        return CsvClient(csv_base, get)
    raise ValueError(f"unknown provider: {provider}")


def download_or_load(client: VintageProvider, series_id: str, folder: Path, *, vintages: list[date] | None = None, refresh: bool = False) -> list[Cell]:
    """The series' archive from the cache, or downloaded whole and put there at once."""
    path = Path(folder) / f"{series_id}.zip"
    if path.exists() and not refresh:
        cells = list(read_cells(io.BytesIO(path.read_bytes()), series_id))
        if vintages is None or {c[2] for c in cells} >= set(vintages):
            return [c for c in cells if vintages is None or c[2] in set(vintages)]
    cells = list(client.cells(series_id, client.vintages(series_id) if vintages is None else vintages))
    atomic_write(path, encode(cells))
    return cells
