"""SimHash near-duplicate detection by Golay-code fuzzy hashing.

Every bit of a 64-bit fingerprint is a majority vote over the hashes of a
text's word shingles. Two fingerprints that differ in at most 3 bits agree on
one of four 16-bit segments; the 48 bits besides it form two halves, one of
which differs in at most one bit. So a pair shares a key made of the exact
segment and a Golay codeword index of one half: the building side gives the
index of its own codeword, the probing side the one to six within 4 bits.

Whoever shares a key is in one bucket. First each member is verified against
the bucket's least member, the likeliest pairs before the others; then only
members that are not yet connected are verified against each other. So every pair of a bucket is either verified or
already connected, and a crowd of copies costs its size, not its square.

The corpus stage, ``drop_near_duplicates``, looks for a shingle similarity of
0.8, at which one pair in seven of all bits differs. It takes ``VIEWS``
independent fingerprints with one codeword index each as keys, and verifies
candidates by the exact Jaccard similarity of their shingle sets.

Defined cases
  null text, no words     fingerprint zero, linked like any other
  fewer words than a shingle   the whole sequence is the only shingle
  very long texts         whole, in blocks of shingles
  exact copies            one fingerprint, however many; copies meet only in sums
  null ids                fingerprinted and linked; never a component's name unless
                          all ids of the component are null (then it is null)
  repeated rows           one result row each
  empty table             no rows
  extra columns           not read
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pit_engine.llm import golay
from pit_engine.llm.components import components
from pit_engine.llm.store import discard, fresh_names, materialize

SEED, DISTANCE = 42, 3
#: Shingles whose hashes are held at once.
BLOCK = 1 << 15
#: Near-duplicate stages use five words; a contract may ask for another number.
SHINGLE_WORDS = 5


#: One bit of every byte of a 64-bit number; so many numbers may be added before a byte overflows.
_LANES, _LANE_SUM = np.uint64(0x0101010101010101), 255


def _remixed(hashes: np.ndarray, views: int) -> np.ndarray:
    """One row of hashes for each view: the hashes themselves, then independent bits from them by multiplication and shifts."""
    v = np.arange(1, views, dtype=np.uint64)[:, None]
    x = (hashes ^ v) * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2) * v)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.concatenate([hashes[None, :], x])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set in each row of hashes: rows x 64."""
    rows, n = hashes.shape
    blocks = -(-n // _LANE_SUM)
    padded = np.zeros((rows, blocks * _LANE_SUM), np.uint64)
    padded[:, :n] = hashes
    padded = padded.reshape(rows, blocks, _LANE_SUM)
    out = np.empty((rows, 8, 8), np.int64)
    for k in range(8):
        # Eight bits of each number are counted at once, one in each byte.
        sums = ((padded >> np.uint64(k)) & _LANES).sum(2, dtype=np.uint64)
        out[:, :, k] = sums.view(np.uint8).reshape(rows, blocks, 8).sum(1, dtype=np.int64)
    return out.reshape(rows, 64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _shingle_hashes(words: list[bytes], shingle_words: int, start: int, end: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(b" ".join(words[i : i + shingle_words]), SEED) for i in range(start, end)], np.uint64)


def fingerprint_views(text: str | None, shingle_words: int, views: int) -> list[int]:
    """SimHashes of a text: words lower-cased in A-Z, XXH64 of space-joined shingles, remixed for each further view."""
    words = _words(text)
    if not words:
        return [0] * views
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros((views, 64), np.int64)
    for at in range(0, n, BLOCK):
        ones += _ones(_remixed(_shingle_hashes(words, shingle_words, at, min(n, at + BLOCK)), views))
    return np.packbits((2 * ones > n).astype(np.uint8), axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    words = _words(text)
    return np.unique(_shingle_hashes(words, shingle_words, 0, max(1, len(words) - shingle_words + 1) if words else 0))


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The SimHash of a text."""
    return fingerprint_views(text, shingle_words, 1)[0]


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle_words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _halves(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the 8 tables: the exact part of the key and the 23 bits that are decoded."""
    sixteen = np.uint64(0xFFFF)
    segments = [(fps >> np.uint64(16 * s)) & sixteen for s in range(4)]
    for s in range(4):
        a, b, c = (segments[t] for t in range(4) if t != s)
        rest = a | b << np.uint64(16) | c << np.uint64(32)
        for half in range(2):
            table = np.uint64(2 * s + half)
            word = (rest >> np.uint64(24 * half)) & np.uint64((1 << golay.BITS) - 1)
            yield (table << np.uint64(16) | segments[s]) << np.uint64(golay.INDEX_BITS), word.astype(np.uint32)


def _member_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n for each fingerprint n: the keys of all codewords within 4 bits, its own among them."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for exact, word in _halves(fps):
            index, count = golay.near_indices(word)
            real = np.arange(golay.NEAR) < count[:, None]
            keys, owner = (exact[:, None] | index.astype(np.uint64))[real], np.broadcast_to(fps[:, None], real.shape)[real]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.ascontiguousarray(owner).view(np.int64))], ["key", "n"])


def _near(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_components(members: DataFrame, most: int, verify: Callable[[DataFrame], DataFrame] | None = None, early: Column | None = None) -> DataFrame:
    """node, root of all nodes with a link; the least node of a component is its root.

    members: key, n (node) and w (the bits by which pairs of a bucket are
    compared). Two members of a bucket link if their w differ in at most
    ``most`` bits and ``verify`` (pairs a, b to the pairs that hold) keeps them.
    ``early`` says which members (key, w, leader_w) are verified against their
    leader before all others, so that fewer pairs are left unconnected.
    """
    along = Window.partitionBy("key").orderBy("n")
    least = members.select("key", "n", "w", F.first("n").over(along).alias("leader"), F.first("w").over(along).alias("leader_w"), F.lead("n").over(along).alias("next"))
    # Buckets of one member, nearly all of them, are gone from here on.
    crowded = materialize(least.where("n <> leader or next is not null").select("key", "n", "w", "leader", "leader_w"), "buckets")
    tried: DataFrame | None = None
    edges: DataFrame | None = None

    def connect(pairs: DataFrame, now: DataFrame | None = None) -> DataFrame:
        """The components with the links among further pairs; ``now`` again if there are none."""
        nonlocal tried, edges
        pairs = _both(pairs)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        found = materialize(verify(pairs), "edges") if verify else pairs
        if now is not None and found.isEmpty():
            discard(pairs)
            return now
        tried = pairs if tried is None else tried.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        return materialize(components(edges), "components")

    star = crowded.where((F.col("n") != F.col("leader")) & _near("w", "leader_w", most))
    if early is not None:
        first = connect(star.where(early).select(F.col("leader").alias("a"), F.col("n").alias("b")))
        of_leader, of_member = (first.select(F.col("node").alias(x), F.col("root").alias(y)) for x, y in (("leader", "lc"), ("n", "nc")))
        apart = star.join(of_leader, "leader", "left").join(of_member, "n", "left")
        star = apart.where(F.coalesce("lc", "leader") != F.coalesce("nc", "n"))
    now = connect(star.select(F.col("leader").alias("a"), F.col("n").alias("b")))

    named = crowded.join(now, crowded["n"] == now["node"], "left").select("key", "n", "w", F.coalesce("root", "n").alias("c"))
    groups = named.groupBy("key", "c").agg(F.count("*").alias("size"))
    mixed = groups.groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("largest"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    mixed = materialize(named.join(mixed, "key"), "mixed")
    # The largest component's members have nothing to say to each other: the others meet everyone.
    others = mixed.where("c <> largest").select("key", F.col("n").alias("a"), F.col("w").alias("aw"), F.col("c").alias("ac"))
    meet = others.join(mixed.select("key", F.col("n").alias("b"), F.col("w").alias("bw"), F.col("c").alias("bc")), "key")
    done = connect(meet.where((F.col("ac") != F.col("bc")) & _near("aw", "bw", most)).select("a", "b"), now)
    discard(crowded, tried, edges, mixed)
    return done


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """node, root: components of distinct fingerprints (column fp) under links of at most 3 bits."""
    members = fps.select("fp").mapInArrow(_member_keys, "key bigint, n bigint").withColumn("w", F.col("n"))
    return linked_components(members, DISTANCE)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable by links), one row per document."""
    hashed = materialize(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    nodes = materialize(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = fingerprint_components(nodes)
    named = roots.join(nodes, roots["node"] == nodes["fp"]).groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = roots.join(named, "root").select(F.col("node").alias("fp"), "least_id")
    labels = nodes.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    # Written, so that both sides of the last join are dealt for it alone and a frequent fingerprint can be split.
    labels = materialize(labels, "labels")
    discard(nodes, roots)
    return hashed.join(labels, "fp").select("doc_id", "fp", "component_id")


#: The corpus stage: fingerprints of a text, least Jaccard similarity of two texts' shingles, and the shares of
#: differing bits, of one view and of all, up to which a pair of a bucket is verified. A similarity of 0.8 means
#: about 0.15 with a standard error of 0.045 in one view and 0.02 in all, none means 0.5.
VIEWS, SIMILARITY, WORTH, LIKELY = 16, 0.8, 15 / 64, 0.2
#: Views and differing bits of the pairs that are verified first.
EARLY_VIEWS, EARLY_WORTH = 2, 8


def _view_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n, w: for each view and table the key of the node's own codeword; w is the next view's fingerprint."""
    for batch in batches:
        nodes = batch.column(0)
        views = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns[1:]]
        for v, fps in enumerate(views):
            other = pa.array(views[(v + 1) % len(views)].view(np.int64))
            for exact, word in _halves(fps):
                keys = np.uint64(v) << np.uint64(40) | exact | golay.own_index(word).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), nodes, other], ["key", "n", "w"])


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (n, s: sorted 64-bit hashes) have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) if len(z.as_py()) else np.empty(0, np.uint64) for z in (x, y))
                least, most = sorted((len(x), len(y)))
                if least < similarity * most:
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if most else 0
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("n").alias(x), F.col("s").alias(y)) for x, y in (("a", "sa"), ("b", "sb")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", views: int = VIEWS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: its smallest id (null last).

    Texts are linked if their sets of shingles have a Jaccard similarity of at
    least ``similarity`` and any of ``views`` fingerprints makes them meet.
    Texts with equal fingerprints in all views count as one. Of rows with the
    smallest id and one text, one stays; with that id and several texts of the
    component, the text with the least hash. Helper columns have names that
    ``docs`` doesn't use.
    """
    # A row is known by its id and its text; neither is null below.
    i, t = fresh_names(docs, "_id", "_th")
    rows = docs.withColumns({i: F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))), t: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    names = [f"fp{v}" for v in range(views)]
    hashed = _views_of(rows.select(F.col(i).alias("i"), F.col(t).alias("t"), F.col(text_col).alias("text")), shingle_words, names)
    hashed = materialize(hashed.withColumn("n", F.xxhash64(*names)), "fingerprints")
    order = F.struct((F.col("i") == -(2**63)).alias("null"), F.col("i"), F.col("t"))
    nodes = materialize(hashed.groupBy("n").agg(*(F.any_value(x).alias(x) for x in names), F.min(order).alias("first"), F.count("*").alias("rows")), "nodes")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("n")).unionAll(pairs.select(F.col("b").alias("n"))).distinct()
        wanted = ends.join(nodes, "n").select("n", F.col("first.i").alias(i), F.col("first.t").alias(t))
        texts = rows.select(i, t, F.col(text_col).alias("text")).join(wanted, [i, t]).select("n", "text")
        return materialize(texts.mapInArrow(_sets(shingle_words), "n bigint, s binary").dropDuplicates(["n"]), "shingles")

    made: list[DataFrame] = []
    bits = materialize(nodes.select("n", F.array(*names).alias("fps")), "bits")

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = (bits.select(F.col("n").alias(x), F.col("fps").alias(y)) for x, y in (("a", "fa"), ("b", "fb")))
        apart = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
        pairs = materialize(pairs.join(one, "a").join(two, "b").where(apart <= int(LIKELY * 64 * views)).select("a", "b"), "likely")
        sets = sets_of(pairs)
        made.extend([pairs, sets])
        return _similar(pairs, sets, similarity)

    members = nodes.select("n", *names).mapInArrow(_view_keys, "key bigint, n bigint, w bigint")
    early = (F.shiftright("key", 40) < EARLY_VIEWS) & _near("w", "leader_w", EARLY_WORTH)
    roots = linked_components(members, int(64 * WORTH), verify, early)
    named = nodes.join(roots, nodes["n"] == roots["node"], "left").select("n", "first", "rows", F.coalesce("root", "n").alias("root"))
    stays = named.groupBy("root").agg(F.min("first").alias("stays"), F.sum("rows").alias("rows")).where("rows > 1").drop("rows")
    labels = materialize(named.join(stays, "root").select("n", "stays"), "labels")
    known = hashed.select("i", "t", "n").join(labels, "n").groupBy("i", "t").agg(F.count("*").alias("rows"), F.any_value((F.col("i") == F.col("stays.i")) & (F.col("t") == F.col("stays.t"))).alias("stays"))
    # Rows that go, and rows that stay but stand there several times.
    known = materialize(known.where("not stays or rows > 1").select(F.col("i").alias(i), F.col("t").alias(t), "stays"), "known")
    discard(nodes, bits, roots, labels, hashed, *made)
    alone = rows.join(known.select(i, t), [i, t], "left_anti")
    repeated = known.where("stays").select(i, t)
    if not repeated.isEmpty():
        alone = alone.unionByName(rows.join(repeated, [i, t], "left_semi").dropDuplicates([i, t]))
    return alone.select(*docs.columns)


def _sets(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle_words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["n", "s"])

    return run


def _views_of(rows: DataFrame, shingle_words: int, names: list[str]) -> DataFrame:
    """i, t and a column for each view, of rows i, t, text."""
    views = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_views(x.as_py(), shingle_words, views) for x in batch.column(2)], np.int64).reshape(-1, views)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(found[:, v])) for v in range(views))], ["i", "t", *names])

    return rows.mapInArrow(run, "i bigint, t bigint, " + ", ".join(f"{n} bigint" for n in names))
