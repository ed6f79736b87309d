"""Exact top-k inner products by the threshold algorithm over sorted lists.

Candidates are dealt into blocks of bounded size. In each block every dimension
has a list sorted by its component; a query walks the lists from the end that
is best for the sign of its own component, scores each vector it meets exactly,
and stops when the bound on anything not yet met, the sum over dimensions of
the product at the present depth, is below its kth score. The first block gives
every query a kth score to start the others with, so a block whose maxima can't
reach it is left at once. The best of the blocks are merged per query.

Defined cases
  null vectors, null or non-finite components   the row takes no part
  null ids                                      the row takes no part
  vectors of another length than the query's    not comparable: no pair
  repeated ids                                  rows with the query's id count as
                                                its own; other rows are kept each
  repeated query rows                           equal rows are one query; rows with one
                                                id and several vectors share one list
  very large components                         sums are exact; a score beyond 64 bits
                                                counts as the largest or smallest long
  extra columns                                 not read
  equal scores                                  the smaller vec_id comes first
  empty table or no query                       no rows
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pit_engine.llm.store import materialize

K = 5
#: Vectors in a block of candidates and queries in a block of queries, on average.
BLOCK, QUERY_BLOCK = 8192, 8192

RESULT = "query_id bigint, vec_id bigint, score bigint"
LONGS = -(2**63), 2**63 - 1


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: each component x as floor(scale * x), whole numbers as doubles; unusable rows are left out."""
    v = F.col("embedding")
    # From 2^52 on every double is whole, and floor() would end at 64 bits.
    scaled = lambda x: F.lit(scale).cast("double") * x.cast("double")
    whole = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < F.lit(2.0**52), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    )
    return vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


def _exact(x: np.ndarray, q: np.ndarray, kind) -> np.ndarray:
    """Inner products of rows and a query; Python's whole numbers, then limited to 64 bits, where no other type holds them."""
    if kind is not object:
        return x @ q
    least, most = LONGS
    return np.array([min(max(sum(a * b for a, b in zip(row, q, strict=True)), least), most) for row in x], object)


def threshold_search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: list | None = None):
    """(query_id, vec_id, score) of the k best rows of x for each query, by the threshold algorithm.

    x: rows of whole numbers. The sorted lists are the columns of ``order``;
    depth grows by doubling, and rows already met are never scored again. Rows
    with a score below a query's floor may be left out.
    """
    n, dims = x.shape
    order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
    lists = np.ascontiguousarray(np.sort(x, axis=0).T)
    largest = max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * dims
    kind = np.float64 if largest < 2**53 else np.int64 if largest < 2**63 else object
    whole = lambda a: np.vectorize(int, otypes=[object])(a) if kind is object else a.astype(kind)
    rows = whole(x) if x.size else x.astype(kind)
    met = np.zeros(n, bool)
    out = []
    for query_id, q, floor in zip(query_ids, queries, floors or [None] * len(queries), strict=True):
        used = np.flatnonzero(q)
        down, weights = q[used] > 0, whole(q[used]) if len(used) else np.empty(0, kind)
        exact_q = whole(q) if len(q) else q
        met[:] = False
        best_ids, best = np.empty(0, np.int64), np.empty(0, kind)
        depth, step = 0, max(k + 1, n // 16)
        bound = lambda at: sum((int(w) * int(a) for w, a in zip(weights, at, strict=True)), 0) if kind is object else (weights * at).sum()
        if floor is not None and n and len(used) and bound(np.where(down, lists[used, -1], lists[used, 0]).astype(kind)) < floor:
            continue
        while True:
            deeper = min(n, depth + step)
            for d, falls in zip(used, down, strict=True):
                met_now = order[d, n - deeper : n - depth] if falls else order[d, depth:deeper]
                met[met_now] = True
            depth, step = deeper, step * 2
            if depth == n or not len(used):
                met[:] = True
            if len(best_ids) == 0:
                new, known = np.flatnonzero(met), met.copy()
            else:
                new, known = np.flatnonzero(met & ~known), met.copy()
            new = new[ids[new] != query_id]
            found_ids = np.concatenate([best_ids, ids[new]])
            found = np.concatenate([best, _exact(rows[new], exact_q, kind)])
            if len(found) > k:
                kth = np.sort(found)[-k] if kind is object else np.partition(found, len(found) - k)[len(found) - k]
                near = np.flatnonzero(found >= kth)
                found_ids, found = found_ids[near], found[near]
            first = sorted(range(len(found)), key=lambda i: (-found[i], found_ids[i]))[:k]
            best_ids, best = found_ids[first], found[first]
            if met.all():
                break
            least = best[-1] if len(best) == k else None
            least = floor if least is None or floor is not None and floor > least else least
            # Equal scores may still win by a smaller id, so the bound has to be below.
            if least is not None and bound(np.where(down, lists[used, n - depth], lists[used, depth - 1]).astype(kind)) < least:
                break
        out += [(int(query_id), int(i), int(s)) for i, s in zip(best_ids, best, strict=True)]
    return out


def _vectors(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vector: places in the table, ids and the matrix of vectors."""
    lists = t["v"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes, ids = lists.value_lengths().to_numpy(zero_copy_only=False), t["vec_id"].to_numpy()
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = at, ids[at], flat[starts[at][:, None] + np.arange(d)]
    return out


def _search(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found, wanted = (_vectors(t) if t.num_rows else {} for t in (left, right))
        floors = right["floor"].to_pylist()
        out = []
        for d, (at, query_ids, q) in wanted.items():
            if d in found:
                _, ids, x = found[d]
                out += threshold_search(x, ids, q, query_ids, k, [floors[i] for i in at])
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, is_query, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query row.

    vectors: vec_id and v (array of whole numbers). is_query: a boolean column.
    Queries meet every block of candidates by an equi-join on block numbers;
    a task holds one block of either side, whatever the table's size.
    """
    rows = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v"), is_query.alias("is_query"))
    n, m = rows.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-(m or 0) // query_block))
    salt = F.xxhash64("vec_id")
    every = lambda first, count: F.explode(F.sequence(F.lit(first), F.lit(count - 1)))
    placed = rows.select("vec_id", "v", F.pmod(salt, F.lit(blocks)).cast("int").alias("b"))
    queries = rows.where("is_query").select("vec_id", "v").distinct().select("vec_id", "v", F.pmod(salt, F.lit(query_blocks)).cast("int").alias("qb"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))

    def against(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        # Renamed, as both sides come from one table.
        candidates, queries = candidates.toDF("vec_id", "v", "b", "qb"), queries.toDF("vec_id", "v", "qb", "b", "floor")
        return candidates.groupBy("b", "qb").cogroup(queries.groupBy("b", "qb")).applyInArrow(_search(k), RESULT)

    zero = F.lit(0).alias("b")
    seeds = against(queries.select("vec_id", "v", "qb", zero, F.lit(None).cast("bigint").alias("floor")), placed.where("b = 0").select("vec_id", "v", "b", every(0, query_blocks).alias("qb")))
    pairs = seeds
    if blocks > 1:
        seeds = materialize(seeds, "seeds")
        floors = seeds.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        rest = against(queries.join(floors, "vec_id", "left").select("vec_id", "v", "qb", every(1, blocks).alias("b"), "floor"), placed.where("b > 0").select("vec_id", "v", "b", every(0, query_blocks).alias("qb")))
        pairs = seeds.unionByName(rest)
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
