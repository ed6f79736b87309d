"""Vintage-matrix ZIP archives as long tables, and back.

An archive has one CSV member with an ``observation_date`` column and columns
``SERIES_YYYYMMDD``; a dot or a blank is a missing cell. ``register`` makes the
format available as ``spark.read.format("vintage_zip")``: one task per archive,
rows streamed from the member.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "series_id string, reference_date date, vintage_date date, value double"
_COLUMN = re.compile(r"([A-Za-z0-9.]+)_(\d{4})(\d{2})(\d{2})")


def vintage_of(column: str) -> tuple[str, date]:
    """The series and the vintage date that a column name states."""
    m = _COLUMN.fullmatch(column)
    if not m:
        raise ValueError(f"not a vintage column: {column!r}")
    return m[1], date(*map(int, m.group(2, 3, 4)))


def _cell(text: str) -> float | None:
    text = text.strip()
    if text in ("", ".", "NaN", "nan"):
        return None
    try:
        return float(text)
    except ValueError:
        return None


def read_cells(data, series_id: str | None = None) -> Iterator[tuple[str, date, date, float | None]]:
    """All cells of one archive (a path or a binary file object)."""
    with zipfile.ZipFile(data) as z:
        members = [n for n in z.namelist() if n.lower().endswith(".csv")]
        if len(members) != 1:
            raise ValueError(f"an archive holds one CSV member, not {len(members)}")
        with z.open(members[0]) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
            head = next(rows)
            if not head or head[0] != "observation_date":
                raise ValueError("the first column is observation_date")
            columns = [vintage_of(c) for c in head[1:]]
            if len(set(columns)) != len(columns):
                raise ValueError("a vintage occurs twice")
            if series_id is not None and any(s != series_id for s, _ in columns):
                raise ValueError(f"a column of another series than {series_id}")
            seen = set()
            for row in rows:
                day = date.fromisoformat(row[0])
                if day in seen:
                    raise ValueError(f"observation {day} occurs twice")
                seen.add(day)
                for (series, vintage), text in zip(columns, row[1:], strict=True):
                    yield series, day, vintage, _cell(text)


def encode(cells: list[tuple[str, date, date, float | None]]) -> bytes:
    """The ZIP bytes of one series' cells: the same cells always give the same bytes."""
    series = {c[0] for c in cells}
    if len(series) != 1:
        raise ValueError("an archive holds one series")
    name = series.pop()
    days, vintages = sorted({c[1] for c in cells}), sorted({c[2] for c in cells})
    at = {(c[1], c[2]): c[3] for c in cells}
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["observation_date", *(f"{name}_{v:%Y%m%d}" for v in vintages)])
    for d in days:
        w.writerow([d.isoformat(), *("." if (x := at.get((d, v))) is None else repr(x) for v in vintages)])
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(f"{name}.csv", (1980, 1, 1, 0, 0, 0)), out.getvalue())
    return data.getvalue()


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p.strip() for p in options.get("paths", options.get("path", "")).split(",") if p.strip()]
        self.series_id = options.get("series_id")
        if not self.paths:
            raise ValueError("option path or paths is needed")

    def partitions(self):
        return [_Archive(p) for p in self.paths]

    def read(self, partition):
        from pyarrow import fs

        path = partition.path if "://" in partition.path else f"file://{partition.path}"
        files, inner = fs.FileSystem.from_uri(path)
        with files.open_input_file(inner) as f:
            yield from read_cells(f, self.series_id)


class VintageZipSource(DataSource):
    """``spark.read.format("vintage_zip").option("paths", "a.zip,b.zip")``."""

    @classmethod
    def name(cls) -> str:
        return "vintage_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VintageZipSource)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """The same from ``binaryFile``: for any store that only Spark reads."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(list(read_cells(io.BytesIO(content))), columns=["series_id", "reference_date", "vintage_date", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)
