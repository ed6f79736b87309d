"""Inputs of the queries, derived from the driver's tables.

Money is summed in whole cents, so sums don't depend on the order of rows.
Each derivation has its SQL counterpart, used by the oracle queries.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pit_engine.operators import vintages as V


#: Tables that ``shared`` keeps.
_kept: list[DataFrame] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame) -> DataFrame:
    """A small derived table that a query reads several times: computed once, by lineage again if lost.

    Only for results bounded by the calendar (series x months x vintages), never
    for rows of data. ``release`` frees them.
    """
    kept = df.persist()
    _kept.append(kept)
    return kept


def settle(df: DataFrame) -> DataFrame:
    """A small derived table, checkpointed: what is built on it has a short plan.

    The folder is the session's ``spark.checkpoint.dir``; only on one machine,
    where that is unset, a folder of our own. Without any it is ``shared``.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            return shared(df)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def release() -> None:
    """Forget all derived tables that queries have kept so far."""
    while _kept:
        _kept.pop().unpersist()


def cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision archive: order months as references, ship months as vintages, value shipped so far."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_shipdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = li.join(o, "l_orderkey").where("l_shipdate >= o_orderdate")
    inc = rows.groupBy(
        F.col("l_returnflag").alias("series_id"),
        F.trunc("o_orderdate", "month").alias("reference_date"),
        F.add_months(F.trunc("l_shipdate", "month"), 1).alias("vintage_date"),
    ).agg(F.sum(cents("l_extendedprice")).alias("value"))
    return shared(V.densify(inc).withColumn("value", F.col("value").cast("double") / 100))


ARCHIVE = """
inc AS (
  SELECT l_returnflag AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS reference_date,
    CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS DATE) AS vintage_date,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY ALL),
archive AS (
  SELECT g.series_id, g.reference_date, g.vintage_date,
    CAST(sum(coalesce(inc.value, 0)) OVER (PARTITION BY g.series_id, g.reference_date ORDER BY g.vintage_date) AS DOUBLE) / 100 AS value
  FROM (SELECT f.series_id, f.reference_date, s.vintage_date
        FROM (SELECT series_id, reference_date, min(vintage_date) AS first FROM inc GROUP BY ALL) f
        JOIN (SELECT DISTINCT series_id, vintage_date FROM inc) s ON s.series_id = f.series_id AND s.vintage_date >= f.first) g
  LEFT JOIN inc USING (series_id, reference_date, vintage_date)),
first AS (
  SELECT series_id, reference_date, min(vintage_date) AS release_date, arg_min(value, vintage_date) AS value
  FROM archive WHERE value IS NOT NULL GROUP BY ALL),
features AS (
  SELECT *, CASE WHEN status = 'available' THEN t END AS transformed_value FROM (
    SELECT *, CASE WHEN release_lag_days < 0 THEN 'released_before_period_end' WHEN release_lag_days > 92 THEN 'released_too_late'
      WHEN previous_value IS NULL THEN 'missing_prior_level' WHEN t IS NULL THEN 'undefined_transform' ELSE 'available' END AS status FROM (
      SELECT f.series_id, f.reference_date, f.release_date, f.value AS current_value, p.value AS previous_value,
        date_diff('day', last_day(f.reference_date), f.release_date) AS release_lag_days,
        CASE WHEN f.value > 0 AND p.value > 0 THEN 100 * (ln(f.value) - ln(p.value)) END AS t
      FROM first f LEFT JOIN archive p ON p.series_id = f.series_id AND p.vintage_date = f.release_date
        AND p.reference_date = CAST(f.reference_date - INTERVAL 1 MONTH AS DATE))))
"""


#: Series of the monthly panel: five order priorities and three order states.
GROWTH = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
INFLATION = ["5-LOW", "F", "O", "P"]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, month, value: orders' value by month, for each priority and each state, on a gapless calendar."""
    from pit_engine.operators.calendar import gapless

    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice", F.trunc("o_orderdate", "month").alias("month"))
    both = o.select("month", "o_totalprice", F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("series_id"))
    sums = both.groupBy("series_id", "month").agg((F.sum(cents("o_totalprice")).cast("double") / 100).alias("value"))
    sums = shared(sums)
    return shared(gapless(sums, ["series_id"], "month").join(sums, ["series_id", "month"], "left"))


PANEL = """
sums AS (
  SELECT series_id, month, CAST(sum(c) AS DOUBLE) / 100 AS value FROM (
    SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders
    UNION ALL SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE), CAST(round(o_totalprice * 100) AS BIGINT) FROM orders) GROUP BY ALL),
panel AS (
  SELECT c.series_id, c.month, value FROM (
    SELECT series_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM sums GROUP BY series_id) c
  LEFT JOIN sums USING (series_id, month))
"""


def scores(spark: SparkSession, sf_dir: str, min_periods: int = 12) -> DataFrame:
    """month, z by series, growth_score, inflation_score, available_at: causal composites of the panel."""
    from pit_engine.operators.windows import composite, lagged_expanding_zscore

    z = lagged_expanding_zscore(panel(spark, sf_dir), ["series_id"], "month", "value", min_periods)
    names = {s: f"z{k + 1}" for k, s in enumerate(GROWTH + INFLATION)}
    wide = z.groupBy("month").pivot("series_id", list(names)).agg(F.first("z")).withColumnsRenamed(names)
    out = composite(composite(wide, ["z1", "z2", "z3", "z4"], "growth_score"), ["z5", "z6", "z7", "z8"], "inflation_score")
    return shared(out.withColumn("available_at", F.date_add(F.add_months("month", 1), 14)))


SCORES = PANEL + """,
moments AS (
  SELECT *, count(value) OVER w AS prior_n, avg(value) OVER w AS prior_mean, stddev_samp(value) OVER w AS prior_std
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
zs AS (SELECT series_id, month, CASE WHEN prior_n >= 12 AND prior_std > 0 THEN (value - prior_mean) / prior_std END AS z FROM moments),
wide AS (SELECT month, max(z) FILTER (series_id = '1-URGENT') AS z1, max(z) FILTER (series_id = '2-HIGH') AS z2, max(z) FILTER (series_id = '3-MEDIUM') AS z3,
  max(z) FILTER (series_id = '4-NOT SPECIFIED') AS z4, max(z) FILTER (series_id = '5-LOW') AS z5, max(z) FILTER (series_id = 'F') AS z6,
  max(z) FILTER (series_id = 'O') AS z7, max(z) FILTER (series_id = 'P') AS z8 FROM zs GROUP BY month),
scores AS (SELECT *, (z1 + z2 + z3 + z4) / 4 AS growth_score, (z5 + z6 + z7 + z8) / 4 AS inflation_score,
  CAST(month + INTERVAL 1 MONTH + INTERVAL 14 DAY AS DATE) AS available_at FROM wide),
regimes AS (SELECT month, growth_score, inflation_score, available_at, CASE WHEN growth_score IS NULL OR inflation_score IS NULL THEN NULL
  WHEN growth_score >= 0 AND inflation_score >= 0 THEN 'UU' WHEN growth_score < 0 AND inflation_score >= 0 THEN 'DU'
  WHEN growth_score >= 0 THEN 'UD' ELSE 'DD' END AS regime_id FROM scores)
"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, open, close: mean event value before noon and of the whole day, by event type."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.hour("ts").alias("h"), F.col("event_type").alias("ticker"), cents("value").alias("c"))
    day = e.groupBy("date", "ticker").agg(
        F.sum(F.when(F.col("h") < 12, F.col("c"))).alias("so"), F.count(F.when(F.col("h") < 12, 1)).alias("no"), F.sum("c").alias("sc"), F.count("*").alias("nc"))
    return shared(day.select("date", "ticker", (F.col("so").cast("double") / F.nullif(F.col("no"), F.lit(0)) / 100).alias("open"), (F.col("sc").cast("double") / F.col("nc") / 100).alias("close")))


PRICES = """
prices AS (
  SELECT date, ticker, CAST(so AS DOUBLE) / nullif(no, 0) / 100 AS open, CAST(sc AS DOUBLE) / nc / 100 AS close FROM (
    SELECT CAST(ts AS DATE) AS date, event_type AS ticker,
      sum(CAST(round(value * 100) AS BIGINT)) FILTER (hour(ts) < 12) AS so, count(*) FILTER (hour(ts) < 12) AS no,
      sum(CAST(round(value * 100) AS BIGINT)) AS sc, count(*) AS nc
    FROM events GROUP BY ALL))
"""
TICKERS = ["click", "error", "purchase", "signup", "view"]
