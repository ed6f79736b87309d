"""Write-once snapshots by content hash, receipts, manifests and strict configuration."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from datetime import datetime
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def atomic_write(path: Path, data: bytes) -> None:
    """A file appears whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, tmp = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


#: Names of query parameters that authenticate.
SECRET_KEYS = ("api_key", "apikey", "key", "token", "access_token")


class SnapshotStore:
    """Bytes under their SHA-256 with one JSON receipt for each capture."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def capture(self, content: bytes, *, provider_id: str, series_id: str, source_url: str, query: dict, retrieved_at: str, retrieval_status: str = "retrieved") -> dict:
        """Store the bytes once and return the receipt.

        The same capture twice is fine. Other bytes for one provider, series,
        URL, query and time are an error, and so are an empty name, a URL that
        is not absolute or carries a password, a query with a key of an API, and
        a time without its zone.
        """
        url, when = urlsplit(source_url), datetime.fromisoformat(retrieved_at)
        if not provider_id or not series_id or not url.scheme or url.password or (url.scheme != "file" and not url.netloc):
            raise ValueError("a capture needs a provider, a series and an absolute URL without a password")
        if any(k.lower() in SECRET_KEYS for k in query) or any(f"{k}=" in url.query.lower() for k in SECRET_KEYS):
            raise ValueError("a capture's query must not hold a key")
        if when.tzinfo is None:
            raise ValueError("retrieved_at needs a time zone")
        digest = hashlib.sha256(content).hexdigest()
        blob = self.root / "objects" / digest[:2] / digest
        if not blob.exists():
            atomic_write(blob, content)
        receipt = {"sha256": digest, "bytes": len(content), "provider_id": provider_id, "series_id": series_id, "source_url": source_url, "query": query, "retrieved_at": retrieved_at, "retrieval_status": retrieval_status}
        text = strict_json(receipt).encode()
        what = strict_json({k: receipt[k] for k in ("provider_id", "series_id", "source_url", "query", "retrieved_at")}).encode()
        place = self.root / "receipts" / f"{hashlib.sha256(what).hexdigest()}.json"
        if place.exists() and place.read_bytes() != text:
            raise ValueError(f"another capture of {series_id} at {retrieved_at} has other bytes or another status")
        if not place.exists():
            atomic_write(place, text)
        return receipt

    def read(self, receipt: dict) -> bytes:
        """The receipt's bytes; an error if they are missing or were changed."""
        digest = receipt["sha256"]
        content = (self.root / "objects" / digest[:2] / digest).read_bytes()
        if hashlib.sha256(content).hexdigest() != digest or len(content) != receipt["bytes"]:
            raise ValueError(f"snapshot {digest} was changed")
        return content


def strict_json(value) -> str:
    """JSON without NaN, keys sorted; NaN and infinities become null."""

    def safe(x):
        if isinstance(x, dict):
            return {str(k): safe(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [safe(v) for v in x]
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        return x

    return json.dumps(safe(value), sort_keys=True, ensure_ascii=False, allow_nan=False)


def manifest(root: str | Path, paths: list[str]) -> dict:
    """path, sha256 and size of each file, in order of path."""
    rows = []
    for p in sorted(paths):
        data = (Path(root) / p).read_bytes()
        rows.append({"path": p, "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)})
    return {"files": rows}


def verified_bytes(root: str | Path, path: str, files: dict) -> bytes:
    """A file's bytes, if they are the manifest's."""
    want = next((r for r in files["files"] if r["path"] == path), None)
    if want is None:
        raise KeyError(f"{path} is not in the manifest")
    data = (Path(root) / path).read_bytes()
    if hashlib.sha256(data).hexdigest() != want["sha256"]:
        raise ValueError(f"{path} was changed")
    return data


def verify_files(binary_files: DataFrame, receipts: DataFrame) -> DataFrame:
    """sha256, path, status (verified / unknown / missing) of stored files against receipts, hashed in the JVM."""
    f = binary_files.select(F.col("path"), F.sha2("content", 256).alias("sha256"))
    r = receipts.select("sha256", F.lit(1).alias("_r")).distinct()
    status = F.when(F.col("path").isNull(), "missing").when(F.col("_r").isNull(), "unknown").otherwise("verified")
    return f.join(r, "sha256", "full").select("sha256", "path", status.alias("status"))


def load_yaml(text: str, required: set[str], optional: set[str] = frozenset()) -> dict:
    """A mapping with exactly known keys; a repeated key anywhere is an error."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len(set(keys)) != len(keys):
            raise ValueError(f"a key occurs twice: {sorted(k for k in keys if keys.count(k) > 1)}")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    got = yaml.load(text, Loader)  # noqa: S506 - a safe loader
    if not isinstance(got, dict):
        raise ValueError("a mapping is needed")
    if missing := required - got.keys():
        raise ValueError(f"missing keys: {sorted(missing)}")
    if unknown := got.keys() - required - optional:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return got


def publish(root: str | Path, artifacts: dict[str, bytes], last: str | None = None) -> None:
    """Two-phase publication: all files are staged first, then replaced, ``last`` at the end."""
    root = Path(root)
    staged = []
    for name, data in artifacts.items():
        tmp = root / f".{name}.staged"
        atomic_write(tmp, data)
        staged.append((name, tmp))
    for name, tmp in sorted(staged, key=lambda x: x[0] == last):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        os.replace(tmp, root / name)


def write_table(df: DataFrame, path: str, form: str = "parquet", compression: str | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet, CSV, gzip CSV or JSON lines; NaN is written as null."""
    clean = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    w = clean.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("header", True).csv if form == "csv" else getattr(w, form))(path)
