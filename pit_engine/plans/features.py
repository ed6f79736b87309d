"""Queries of ordered windows and causal features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pit_engine.operators import vintages as V
from pit_engine.operators import windows as W
from pit_engine.operators.calendar import gapless
from pit_engine.plans.inputs import ARCHIVE, PANEL, PRICES, SCORES, archive, cents, panel, prices, scores, table
from pit_engine.plans.registry import query


@query(f"""WITH {PANEL}, m AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS a, stddev_samp(value) OVER w AS s FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series_id, month, n AS prior_n, round(a, 2) AS prior_mean, round(s, 2) AS prior_std, round(CASE WHEN n >= 24 AND s > 0 THEN (value - a) / s END, 6) AS z FROM m""")
def lagged_expanding_z(spark, sf_dir):
    z = W.lagged_expanding_zscore(panel(spark, sf_dir), ["series_id"], "month", "value", 24)
    return z.select("series_id", "month", "prior_n", F.round("prior_mean", 2).alias("prior_mean"), F.round("prior_std", 2).alias("prior_std"), F.round("z", 6).alias("z"))


@query(f"""WITH {ARCHIVE}, a AS (SELECT * FROM features WHERE status = 'available'),
m AS (SELECT *, count(transformed_value) OVER w AS n, avg(transformed_value) OVER w AS a, stddev_samp(transformed_value) OVER w AS s FROM a
  WINDOW w AS (PARTITION BY series_id ORDER BY release_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT series_id, reference_date, release_date, round(transformed_value, 6) AS transformed_value, n AS prior_n,
  CASE WHEN n < 12 THEN 'warmup' WHEN coalesce(s, 0) <= 0 THEN 'unidentified' ELSE 'available' END AS status,
  round(CASE WHEN n >= 12 AND s > 0 THEN (transformed_value - a) / s END, 6) AS z FROM m""")
def group_causal_z(spark, sf_dir):
    f = V.first_release_features(archive(spark, sf_dir)).where("status = 'available'").drop("status")
    z = W.group_causal_zscore(f, ["series_id"], "release_date", "transformed_value", 12)
    return z.select("series_id", "reference_date", "release_date", F.round("transformed_value", 6).alias("transformed_value"), "prior_n", "status", F.round("z", 6).alias("z"))


_DAILY = """daily AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS d, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS level FROM events GROUP BY ALL)"""


def daily(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("d")).agg((F.sum(cents("value")).cast("double") / 100).alias("level"))


@query(f"""WITH {_DAILY}, y AS (SELECT *, ln(level) AS y, lag(ln(level)) OVER (PARTITION BY series_id ORDER BY d) AS x FROM daily),
f AS (SELECT *, count(CASE WHEN x IS NOT NULL THEN 1 END) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM y WINDOW w AS (PARTITION BY series_id ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
e AS (SELECT *, CASE WHEN n >= 8 THEN y - (a + b * x) END AS innovation FROM f),
s AS (SELECT *, count(innovation) OVER w AS k, avg(innovation) OVER w AS m, stddev_samp(innovation) OVER w AS sd FROM e WINDOW w AS (PARTITION BY series_id ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT series_id, d, n AS ar_n, round(innovation, 6) AS innovation, CASE WHEN x IS NULL OR n < 8 THEN 'ar_warmup' WHEN b IS NULL THEN 'ar_unidentified' WHEN k < 6 THEN 'standardization_warmup' WHEN coalesce(sd, 0) <= 0 THEN 'standardization_unidentified' ELSE 'available' END AS status,
  round(CASE WHEN k >= 6 AND sd > 0 AND n >= 8 THEN (innovation - m) / sd END, 5) AS z FROM s""")
def group_causal_ar1(spark, sf_dir):
    z = W.group_causal_ar1(daily(spark, sf_dir), ["series_id"], "d", "d", "level", 8, 6)
    return z.select("series_id", "d", "ar_n", F.round("innovation", 6).alias("innovation"), "status", F.round("z", 5).alias("z"))


@query(f"""WITH {PANEL} SELECT series_id, month, round(CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END, 2) AS trailing_mean FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def trailing_full_mean(spark, sf_dir):
    t = W.trailing_full_mean(panel(spark, sf_dir), ["series_id"], "month", "value", 3)
    return t.select("series_id", "month", F.round("trailing_mean", 2).alias("trailing_mean"))


@query(f"WITH {SCORES} SELECT month, round(growth_score, 6) AS growth_score, round(inflation_score, 6) AS inflation_score, available_at FROM scores")
def composite_score(spark, sf_dir):
    return scores(spark, sf_dir).select("month", F.round("growth_score", 6).alias("growth_score"), F.round("inflation_score", 6).alias("inflation_score"), "available_at")


@query(f"""WITH {SCORES} SELECT month, round(list_var_samp([z1, z2, z3, z4]) / 4, 6) AS growth_variance, round(list_var_samp([z5, z6, z7, z8]) / 4, 6) AS inflation_variance
FROM scores WHERE growth_score IS NOT NULL AND inflation_score IS NOT NULL""")
def jackknife_disagreement(spark, sf_dir):
    s = scores(spark, sf_dir).where("growth_score is not null and inflation_score is not null")
    g, i = (W.jackknife_variance([F.col(f"z{k}") for k in ks]) for ks in (range(1, 5), range(5, 9)))
    return s.select("month", F.round(g, 6).alias("growth_variance"), F.round(i, 6).alias("inflation_variance"))


@query(f"""WITH {SCORES}, n AS (SELECT month, growth_score AS g, inflation_score AS i, available_at AS a, lead(month) OVER w AS nm, lead(growth_score) OVER w AS ng, lead(inflation_score) OVER w AS ni, lead(available_at) OVER w AS na FROM scores WINDOW w AS (ORDER BY month))
SELECT month, nm AS next_month, CASE WHEN nm IS NULL THEN 'no_successor' WHEN nm <> CAST(month + INTERVAL 1 MONTH AS DATE) THEN 'calendar_gap' WHEN g IS NULL OR i IS NULL OR ng IS NULL OR ni IS NULL THEN 'missing_value' ELSE 'valid' END AS pair_status,
  CASE WHEN nm = CAST(month + INTERVAL 1 MONTH AS DATE) AND g + i + ng + ni IS NOT NULL THEN greatest(a, na) END AS pair_available_at FROM n""")
def var_pairs(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("model", F.lit("all"))
    p = W.successor_pairs(s, ["model"], "month", ["growth_score", "inflation_score"], "available_at")
    return p.select("month", "next_month", "pair_status", "pair_available_at")


@query(f"""WITH {PRICES}, r AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM prices)
SELECT ticker, date, round(r, 6) AS total_return, round(exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY ticker ORDER BY date)), 6) AS total_return_index FROM r""")
def total_return_panel(spark, sf_dir):
    p = prices(spark, sf_dir).withColumns({"cash": F.lit(None).cast("double"), "split": F.lit(None).cast("double")})
    t = W.total_returns(p, ["ticker"], "date", "close", "cash", "split")
    return t.select("ticker", "date", F.round("total_return", 6).alias("total_return"), F.round("total_return_index", 6).alias("total_return_index"))


@query(f"""WITH {PRICES}, r AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices), c AS (SELECT *, count(ret) OVER (PARTITION BY date) AS n FROM r)
SELECT ticker, date, round(ret, 6) AS ret FROM c WHERE n = 5""")
def daily_total_returns(spark, sf_dir):
    return W.complete_case_returns(prices(spark, sf_dir), "ticker", "date", "close", 5).select("ticker", "date", F.round("ret", 6).alias("ret"))


@query(f"""WITH {PRICES}, l AS (SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS period, arg_max(close, date) AS c, max(date) AS last_date FROM prices GROUP BY ALL)
SELECT ticker, period, last_date, round(c / lag(c) OVER (PARTITION BY ticker ORDER BY period) - 1, 6) AS period_return FROM l""")
def period_end_returns(spark, sf_dir):
    r = W.period_end_returns(prices(spark, sf_dir), "ticker", "date", "close", F.trunc("date", "week"))
    return r.select("ticker", "period", "last_date", F.round("period_return", 6).alias("period_return"))


@query("""WITH m AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders GROUP BY ALL)
SELECT series_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY series_id""")
def gapless_calendar(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("month"))
    return gapless(m, ["series_id"], "month")


@query("""WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY))::DATE AS s) SELECT s AS saturday FROM d WHERE dayofweek(s) = 6""")
def weekly_saturdays(spark, sf_dir):
    from pit_engine.operators.calendar import weekly_saturdays as saturdays

    days = saturdays(F.lit("2024-01-01").cast("date"), F.lit("2024-03-31").cast("date"))
    return spark.range(1).select(F.explode(days).alias("saturday"))


@query("""WITH b AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) SELECT d AS reference_date, 'weekend' AS feature_name, CASE WHEN isodow(d) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS feature_value, 'available' AS status FROM b""")
def binary_control_events(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("reference_date")).distinct()
    flag = F.when(F.weekday("reference_date") >= 5, 1.0).otherwise(0.0)
    return d.select("reference_date", F.lit("weekend").alias("feature_name"), flag.alias("feature_value"), F.lit("available").alias("status"))


_SIDES = f"""{ARCHIVE}, n AS (SELECT * FROM features WHERE series_id = 'R'), d AS (SELECT * FROM features WHERE series_id = 'A'),
both_ AS (SELECT n.reference_date, n.release_date, n.current_value AS n1, n.previous_value AS n0, d.current_value AS d1, d.previous_value AS d0 FROM n JOIN d ON n.reference_date = d.reference_date AND n.release_date = d.release_date)"""


@query(f"""WITH {_SIDES}, r AS (SELECT reference_date, release_date, 100 * (ln(n1 / d1) - ln(n0 / d0)) AS v FROM both_ WHERE n1 > 0 AND n0 > 0 AND d1 > 0 AND d0 > 0),
m AS (SELECT *, count(v) OVER w AS n, avg(v) OVER w AS a, stddev_samp(v) OVER w AS s FROM r WINDOW w AS (ORDER BY release_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT reference_date, release_date, round(v, 6) AS transformed_value, n AS prior_n, round(CASE WHEN n >= 12 AND s > 0 THEN (v - a) / s END, 6) AS z FROM m""")
def paired_ratio_events(spark, sf_dir):
    from pit_engine.operators.evidence import paired_ratio_events as paired

    e = paired(V.first_release_features(archive(spark, sf_dir)), "R", "A", "R/A", 12)
    return e.select("reference_date", "release_date", F.round("transformed_value", 6).alias("transformed_value"), "prior_n", F.round("z", 6).alias("z"))


@query(f"""WITH {_SIDES.replace("'R'", "'N'")} SELECT reference_date, release_date, round(n1 - d1, 2) AS current_value, round(n0 - d0, 2) AS previous_value, round(100 * (ln(n1 - d1) - ln(n0 - d0)), 6) AS transformed_value FROM both_ WHERE n1 - d1 > 0 AND n0 - d0 > 0""")
def disjoint_component(spark, sf_dir):
    from pit_engine.operators.evidence import disjoint_component as disjoint

    e = disjoint(V.first_release_features(archive(spark, sf_dir)), "N", "A", "N-A")
    return e.select("reference_date", "release_date", F.round("current_value", 2).alias("current_value"), F.round("previous_value", 2).alias("previous_value"), F.round("transformed_value", 6).alias("transformed_value"))
