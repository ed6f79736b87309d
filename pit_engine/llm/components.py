"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pit_engine.llm.store import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them; edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge: root is the least node reachable.

    edges: columns a, b of one orderable type; loops, repeats and either
    direction are fine. Each round is written to the shared folder, so lineage
    stays short; the rounds grow with the logarithm of the nodes. Minima are
    aggregated before they are shuffled and joined back by sort-merge joins,
    whose large partitions can be split, so a hub is no task of its own.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    count = now.count()
    while count:
        then, before = now, count
        now = materialize(_small_star(_large_star(then)), "stars")
        count = now.count()
        # Both are sets of edges: equally many, and none of the old ones gone.
        same = count == before and then.join(now, ["a", "b"], "left_anti").isEmpty()
        discard(then)
        if same:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
