"""WARC archives as streams of chunks: writing, revisits and a chunked record table.

The writer streams each payload to a gzip member of its own in chunks; the
reader yields (record, chunk number) rows with a digest carried from chunk to
chunk, so neither holds a second copy of an oversized record.

Archives lie in the folder that all executors share. A task writes under a name
of its own and its file counts only if the task's row is in the manifest, so a
lost executor or a second attempt leaves no half archive behind.

Defined cases
  null payload           empty payload
  null url               the record's own identifier is the target
  null page_id           written as a record without a number; never a reference
                         unless no equal payload has a number
  equal payloads         of at least ``min_revisit`` bytes: the smallest page_id is
                         the response; repeated rows of that page_id all are
  very long urls         whole; a header is held in memory, a payload never is twice
  empty table            no archive, no rows
  extra columns          not read
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pit_engine.llm.store import materialize, new_path

CHUNK_BYTES = 64 * 1024
ARCHIVE_BYTES = 64 * 1024 * 1024
MIN_REVISIT = 100
WARC_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:pit:page:"
MANIFEST = "path string, records bigint, bytes bigint"
CHUNKS = "record_id bigint, chunk_no int, record_type string, refers_to bigint, target_uri string, payload_bytes bigint, payload_digest string, chunk_bytes int, digest_so_far string, is_last boolean, data binary"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    large = F.col("payload_bytes") >= min_revisit
    first = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    # Written, so that its size is known when the join with the payloads is planned.
    first = materialize(first.where((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n"), "repeated")
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(first, "payload_digest", "left").select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"{URN}{'' if page_id is None else page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _head(page_id, url, size: int, digest: str, refers_to) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{name}>", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {_uri(url, page_id)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = len(http) + (size if refers_to is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def _writer(folder: str, chunk: int, archive: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        records = written = 0
        done: list[tuple[str, int, int]] = []

        def put(data: bytes) -> None:
            nonlocal written
            if data:
                out.write(data)
                written += len(data)

        for batch in batches:
            payloads = batch.column(2)
            for i, (page_id, url, size, digest, refers_to) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True)):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, inner = _open(folder)
                    fs.create_dir(inner, recursive=True)
                    out, records, written = fs.open_output_stream(f"{inner}/{path.rsplit('/', 1)[1]}", compression=None), 0, 0
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                head, http = _head(page_id, url, size, digest, refers_to)
                put(member.compress(head))
                put(member.compress(http))
                if refers_to is None:
                    payload = memoryview(payloads[i].as_buffer() or b"")
                    for at in range(0, len(payload), chunk):
                        put(member.compress(payload[at : at + chunk]))
                put(member.compress(b"\r\n\r\n"))
                put(member.flush())
                records += 1
                if written >= archive:
                    out.close()
                    done.append((path, records, written))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, written))
        if done:
            columns = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["path", "records", "bytes"])

    return run


def write_archives(records: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records to .warc.gz files; returns the manifest (path, records, bytes)."""
    folder = folder or new_path(records.sparkSession, "warc")
    return materialize(records.mapInArrow(_writer(folder, chunk_bytes, archive_bytes), MANIFEST), "manifest")


class _Stream:
    """The decompressed bytes of an archive, with no more than about a chunk held."""

    def __init__(self, raw, chunk: int):
        self.raw, self.chunk, self.buffer = raw, chunk, bytearray()
        self.member, self.rest, self.ended = zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        while not self.ended:
            data = self.rest or self.raw.read(self.chunk)
            self.rest = b""
            if not data:
                self.ended = True
                break
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            got = self.member.decompress(data, self.chunk)
            self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            self.buffer += got
            if got:
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``; empty at the end of the archive."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a header")
                return b""
        out = bytes(self.buffer[: found + len(mark)])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(URN)
    return int(digits) if digits else None


def _reader(chunk: int, with_data: bool):
    names = [c.strip().split(" ")[0] for c in CHUNKS.split(",")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.binary()]

    def records(path: str) -> Iterator[tuple]:
        fs, inner = _open(path)
        with fs.open_input_stream(inner, compression=None) as raw:
            stream = _Stream(raw, chunk)
            while head := stream.until(b"\r\n\r\n"):
                warc = _fields(head)
                http = stream.until(b"\r\n\r\n")
                size = int(_fields(http)["content-length"])
                kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:")
                who = (_number(warc["warc-record-id"]), kind, _number(warc.get("warc-refers-to")), warc["warc-target-uri"])
                left, state, k = int(warc["content-length"]) - len(http), hashlib.sha256(), 0
                while True:
                    data = stream.take(min(chunk, left))
                    left -= len(data)
                    state.update(data)
                    so_far = state.hexdigest() if kind == "response" else digest
                    if not left and so_far != digest:
                        raise ValueError(f"{path}: the payload of {who[0]} doesn't match its digest")
                    yield (who[0], k, kind, who[2], who[3], size, digest, len(data), so_far, not left, data if with_data else None)
                    k += 1
                    if not left:
                        break
                if stream.take(4) != b"\r\n\r\n":
                    raise ValueError(f"{path}: a record without an end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in records(path):
                    rows.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held >= 8 << 20:
                        held = 0
                        yield flush()
        if rows:
            yield flush()

    return run


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest.

    One row per (record_id, chunk_no): the chunk's bytes, the digest of the
    payload so far, and on the last chunk the digest that the header promised.
    An empty payload or a revisit has one chunk of no bytes. A payload that
    doesn't match its digest is an error.
    """
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(_reader(chunk_bytes, with_data), CHUNKS)
