"""Queries of forecast scores, corrections, dependence and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from pit_engine.operators import statistics as S
from pit_engine.plans.features import _DAILY, daily
from pit_engine.plans.inputs import PANEL, PRICES, panel, prices, table
from pit_engine.plans.registry import query

_CLASSES = ["a", "b", "c", "d"]
#: Forecasts in closed form of a document's length; the target is its (quality, toxic) cell.
_FORECAST = """f AS (SELECT doc_id, x / s AS a, y / s AS b, z / s AS c, w / s AS d, target FROM (SELECT *, x + y + z + w AS s FROM (
  SELECT doc_id, 1.0::DOUBLE + n_chars % 7 AS x, 1.0::DOUBLE + n_chars % 5 AS y, 1.0::DOUBLE + n_chars % 3 AS z, 1.0::DOUBLE + n_chars % 2 AS w,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'a' WHEN quality = 1 THEN 'b' WHEN toxic = 0 THEN 'c' ELSE 'd' END AS target FROM documents JOIN labels USING (doc_id))))"""


def forecasts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    w = {c: 1.0 + F.col("n_chars") % m for c, m in zip(_CLASSES, (7, 5, 3, 2), strict=True)}
    s = w["a"] + w["b"] + w["c"] + w["d"]
    target = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "a").when(F.col("quality") == 1, "b").when(F.col("toxic") == 0, "c").otherwise("d")
    return d.select("doc_id", *((v / s).alias(k) for k, v in w.items()), target.alias("target"))


_TOP = "CASE WHEN a = greatest(a, b, c, d) THEN 'a' WHEN b = greatest(a, b, c, d) THEN 'b' WHEN c = greatest(a, b, c, d) THEN 'c' ELSE 'd' END"


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"""WITH {_FORECAST} SELECT 'all' AS sample, count(*) AS n, round(avg(-ln(CASE target WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'c' THEN c ELSE d END)), 6) AS log_loss,
round(avg(pow(a - CAST(target = 'a' AS INT), 2) + pow(b - CAST(target = 'b' AS INT), 2) + pow(c - CAST(target = 'c' AS INT), 2) + pow(d - CAST(target = 'd' AS INT), 2)), 6) AS brier,
round(avg(CASE WHEN {_TOP} = target THEN 1.0::DOUBLE ELSE 0 END), 6) AS map_accuracy FROM f""")
def proper_scores(spark, sf_dir):
    return _r6(S.proper_scores(forecasts(spark, sf_dir).withColumn("sample", F.lit("all")), _CLASSES, "target", ["sample"]), "log_loss", "brier", "map_accuracy")


@query(f"""WITH {_FORECAST}, g AS (SELECT *, {_TOP} AS top FROM f), k AS (SELECT v.cls, (SELECT count(*) FROM g WHERE target = cls) AS support, (SELECT count(*) FROM g WHERE top = cls) AS predicted, (SELECT count(*) FROM g WHERE top = cls AND target = cls) AS tp FROM (VALUES ('a'), ('b'), ('c'), ('d')) v(cls))
SELECT round(avg(CASE WHEN support > 0 THEN tp / support END), 6) AS macro_recall, round(avg(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) END), 6) AS macro_f1 FROM k""")
def macro_f1(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    best = F.greatest(*_CLASSES)
    top = F.when(F.col("a") == best, "a").when(F.col("b") == best, "b").when(F.col("c") == best, "c").otherwise("d")
    return _r6(S.classification(f.withColumn("top", top), "target", "top"), "macro_recall", "macro_f1")


_BINS = f"""{_FORECAST}, g AS (SELECT greatest(a, b, c, d) AS p, CAST({_TOP} = target AS INT) AS hit FROM f),
bins AS (SELECT v.bin, count(p) AS n, avg(p) AS mean_probability, avg(hit) AS hit_rate FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) v LEFT JOIN g ON least(CAST(floor(p * 10) AS INTEGER), 9) = bin GROUP BY bin)"""


def _confidence(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    best = F.greatest(*_CLASSES)
    top = F.when(F.col("a") == best, "a").when(F.col("b") == best, "b").when(F.col("c") == best, "c").otherwise("d")
    return f.select(best.alias("p"), (top == F.col("target")).cast("int").alias("hit"))


@query(f"WITH {_BINS} SELECT bin, n, round(mean_probability, 6) AS mean_probability, round(hit_rate, 6) AS hit_rate FROM bins")
def calibration_bins(spark, sf_dir):
    return _r6(S.calibration_bins(_confidence(spark, sf_dir), [], "p", "hit", 10), "mean_probability", "hit_rate")


@query(f"WITH {_BINS} SELECT round(sum(n * abs(mean_probability - hit_rate)) / sum(n), 6) AS ece FROM bins")
def expected_calibration_error(spark, sf_dir):
    return _r6(S.expected_calibration_error(S.calibration_bins(_confidence(spark, sf_dir), [], "p", "hit", 10), []), "ece")


@query(f"""WITH {_FORECAST}, g AS (SELECT 'a' AS cls, a AS p, CAST(target = 'a' AS INT) AS hit FROM f UNION ALL SELECT 'b', b, CAST(target = 'b' AS INT) FROM f UNION ALL SELECT 'c', c, CAST(target = 'c' AS INT) FROM f UNION ALL SELECT 'd', d, CAST(target = 'd' AS INT) FROM f)
SELECT v.cls, v.bin, count(p) AS n, round(avg(p), 6) AS mean_probability, round(avg(hit), 6) AS hit_rate FROM (SELECT DISTINCT cls, bin FROM g, (SELECT CAST(unnest(range(5)) AS INTEGER) AS bin)) v LEFT JOIN g ON g.cls = v.cls AND least(CAST(floor(p * 5) AS INTEGER), 4) = v.bin GROUP BY ALL""")
def classwise_calibration(spark, sf_dir):
    long = S.long_probabilities(forecasts(spark, sf_dir), _CLASSES, ["doc_id"], "target")
    return _r6(S.calibration_bins(long, ["cls"], "p", "hit", 5), "mean_probability", "hit_rate")


@query(f"WITH {_FORECAST} SELECT round(avg(pow(a + b - CAST(target IN ('a', 'b') AS INT), 2)), 6) AS quality_brier, round(avg(pow(b + d - CAST(target IN ('b', 'd') AS INT), 2)), 6) AS toxic_brier FROM f")
def axis_brier(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    one = lambda p, classes: F.avg(F.pow(p - F.col("target").isin(classes).cast("int"), 2))
    return _r6(f.agg(one(F.col("a") + F.col("b"), ["a", "b"]).alias("quality_brier"), one(F.col("b") + F.col("d"), ["b", "d"]).alias("toxic_brier")), "quality_brier", "toxic_brier")


def pvalues(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("test"), F.col("c_mktsegment").alias("family")).agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("s"))
    return c.select("test", "family", ((F.abs("s") % 997 + 1) / 10000.0).alias("p"))


_PVALUES = "pv AS (SELECT c_nationkey AS test, c_mktsegment AS family, (abs(sum(CAST(round(c_acctbal * 100) AS BIGINT))) % 997 + 1)::DOUBLE / 10000.0::DOUBLE AS p FROM customer GROUP BY ALL)"


@query(f"WITH {_PVALUES}, s AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY family) - row_number() OVER w + 1) * p) AS s FROM pv WINDOW w AS (PARTITION BY family ORDER BY p, test)) SELECT test, family, round(p, 6) AS p, round(max(s) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING), 6) AS holm_p FROM s")
def holm(spark, sf_dir):
    return _r6(S.holm(pvalues(spark, sf_dir), ["family"], "p", "test"), "p", "holm_p")


@query(f"WITH {_PVALUES}, s AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY family) * p / row_number() OVER w AS s FROM pv WINDOW w AS (PARTITION BY family ORDER BY p, test)) SELECT test, family, round(p, 6) AS p, round(least(1.0::DOUBLE, min(s) OVER (PARTITION BY family ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS bh_q FROM s")
def benjamini_hochberg(spark, sf_dir):
    return _r6(S.benjamini_hochberg(pvalues(spark, sf_dir), ["family"], "p", "test"), "p", "bh_q")


@query(f"""WITH {_DAILY}, c AS (SELECT series_id, d, level - avg(level) OVER (PARTITION BY series_id) AS x FROM daily), l AS (SELECT *, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3 FROM c WINDOW w AS (PARTITION BY series_id ORDER BY d)),
s AS (SELECT series_id, count(*) AS n, sum(x*x) AS v, sum(x*l1) AS c1, sum(x*l2) AS c2, sum(x*l3) AS c3 FROM l GROUP BY series_id)
SELECT series_id, n, round(n * (n + 2) * (pow(c1/v, 2)/(n-1) + pow(c2/v, 2)/(n-2) + pow(c3/v, 2)/(n-3)), 6) AS q_statistic FROM s""")
def ljung_box(spark, sf_dir):
    return _r6(S.ljung_box(daily(spark, sf_dir), ["series_id"], "d", "level", 3), "q_statistic")


@query(f"WITH {_DAILY} SELECT x.series_id AS a, y.series_id AS b, k AS lag, count(*) AS n, round(corr(x.level, y.level), 6) AS correlation FROM daily x JOIN daily y ON x.series_id <> y.series_id CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE y.d = x.d + k GROUP BY ALL HAVING count(*) >= 10")
def lagged_correlation(spark, sf_dir):
    return _r6(S.lagged_correlation(daily(spark, sf_dir), "series_id", "d", "level", [0, 1, 2], 10), "correlation")


@query("WITH s AS (SELECT p_brand, p_size, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rx, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS ry FROM part) SELECT p_brand, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM s GROUP BY p_brand")
def spearman(spark, sf_dir):
    return _r6(S.spearman(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice"), "spearman")


_B, _NB = 12, 200
_STARTS = f"""st AS (SELECT r AS resample, k, CAST(floor(((x * x) % {S.MODULUS} * {S.MULTIPLIERS[1]} % {S.MODULUS}) * n / {S.MODULUS}::DOUBLE) AS BIGINT) AS start, n FROM (
  SELECT r, k, n, (1 + 7919 * r + 104729 * k) % {S.MODULUS} * {S.MULTIPLIERS[0]} % {S.MODULUS} AS x FROM range({_NB}) a(r), (SELECT count(*) AS n FROM d), range(1000) b(k) WHERE k * {_B} < n))"""
_PAIRED = f"""{_STARTS}, s AS (SELECT resample, (start + j) % n AS position FROM st, range({_B}) r(j) WHERE k * {_B} + j < n), m AS (SELECT resample, avg(d) AS m FROM s JOIN d USING (position) GROUP BY resample)"""


@query(f"""WITH {PANEL}, d AS (SELECT row_number() OVER (ORDER BY month) - 1 AS position, a.value / b.value - 1 AS d FROM (SELECT * FROM panel WHERE series_id = 'F') a JOIN (SELECT * FROM panel WHERE series_id = 'O') b USING (month)), {_PAIRED}
SELECT (SELECT count(*) FROM d) AS n, round((SELECT avg(d) FROM d), 6) AS mean_difference, round((SELECT avg(d) / stddev_samp(d) * sqrt(count(d)) FROM d), 6) AS naive_t, round((SELECT avg(d) / stddev_samp(d) * sqrt(12) FROM d), 6) AS information_ratio,
round(quantile_cont(m, 0.025), 6) AS ci_lower, round(quantile_cont(m, 0.975), 6) AS ci_upper, round(avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_positive FROM m""")
def paired_bootstrap(spark, sf_dir):
    from pyspark.sql import Window

    p = panel(spark, sf_dir)
    pair = p.where("series_id = 'F'").select("month", F.col("value").alias("a")).join(p.where("series_id = 'O'").select("month", F.col("value").alias("b")), "month")
    d = pair.select((F.row_number().over(Window.orderBy("month")) - 1).cast("bigint").alias("position"), (F.col("a") / F.col("b") - 1).alias("d"))
    out = S.paired_inference(d.withColumn("sample", F.lit("all")), ["sample"], _NB, _B, 12.0).drop("sample")
    return _r6(out, "mean_difference", "naive_t", "information_ratio", "ci_lower", "ci_upper", "share_positive")


_EVAL = f"{PANEL}, e AS (SELECT series_id, month, value / avg(value) OVER (PARTITION BY series_id) - 1 AS error FROM panel)"


def errors(spark, sf_dir):
    from pyspark.sql import Window

    return panel(spark, sf_dir).select("series_id", "month", (F.col("value") / F.avg("value").over(Window.partitionBy("series_id")) - 1).alias("error"))


@query(f"WITH {_EVAL} SELECT series_id, count(*) AS n, round(avg(error), 6) + 0 AS bias, round(sqrt(avg(error * error)), 6) AS rmse, round(quantile_cont(abs(error), 0.5), 6) AS median_abs_error, round(avg(error * error), 6) AS mean_score FROM e GROUP BY series_id")
def evaluation_summary(spark, sf_dir):
    e = errors(spark, sf_dir).withColumn("sq", F.col("error") * F.col("error"))
    out = _r6(S.evaluation_summary(e, ["series_id"], "error", "sq"), "bias", "rmse", "median_abs_error", "mean_score")
    return out.withColumn("bias", F.col("bias") + 0)


@query(f"WITH {_EVAL} SELECT v.series_id, count(*) AS n, round(avg(abs(v.error) - abs(b.error)), 6) AS mean_difference, round(avg(CASE WHEN abs(v.error) < abs(b.error) THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_share FROM e v JOIN e b ON b.series_id = 'F' AND b.month = v.month WHERE v.series_id <> 'F' AND v.error IS NOT NULL AND b.error IS NOT NULL GROUP BY v.series_id")
def paired_comparison(spark, sf_dir):
    e = errors(spark, sf_dir).withColumn("a", F.abs("error"))
    return _r6(S.paired_comparison(e, ["month"], "series_id", "F", "a"), "mean_difference", "win_share")


_SPANS = {"full": (None, None), "early": (None, "1997-01-01"), "middle": ("1996-01-01", "1999-01-01"), "late": ("1999-01-01", None)}


@query(f"WITH {_EVAL} SELECT p.period, count(*) AS n, round(avg(error), 6) + 0 AS bias, round(sqrt(avg(error * error)), 6) AS rmse, round(quantile_cont(abs(error), 0.5), 6) AS median_abs_error, round(avg(error * error), 6) AS mean_score FROM e JOIN (VALUES {', '.join(f"('{k}', DATE '{lo or '1900-01-01'}', DATE '{hi or '2100-01-01'}')" for k, (lo, hi) in _SPANS.items())}) p(period, lo, hi) ON month >= lo AND month < hi GROUP BY p.period")
def subperiod_summary(spark, sf_dir):
    e = S.in_subperiods(errors(spark, sf_dir).withColumn("sq", F.col("error") * F.col("error")), "month", _SPANS)
    return _r6(S.evaluation_summary(e, ["period"], "error", "sq"), "bias", "rmse", "median_abs_error", "mean_score").withColumn("bias", F.col("bias") + 0)


@query(f"""WITH {PANEL}, l AS (SELECT * FROM panel WHERE month < DATE '2001-01-01'), r AS (SELECT series_id, month, CASE WHEN month(month) = 6 THEN value + 1 ELSE value END AS value FROM panel WHERE month >= DATE '1995-03-01')
SELECT CASE WHEN r.series_id IS NULL THEN 'left_only' WHEN l.series_id IS NULL THEN 'right_only' WHEN l.value IS NOT DISTINCT FROM r.value THEN 'same' ELSE 'changed' END AS status, count(*) AS n FROM l FULL JOIN r ON l.series_id = r.series_id AND l.month = r.month GROUP BY ALL""")
def frame_invariance(spark, sf_dir):
    p = panel(spark, sf_dir)
    right = p.where("month >= date'1995-03-01'").withColumn("value", F.when(F.month("month") == 6, F.col("value") + 1).otherwise(F.col("value")))
    return S.invariance(p.where("month < date'2001-01-01'"), right, ["series_id", "month"], ["value"], 1e-6)


@query(f"""WITH {PRICES}, b AS (SELECT ticker, date, close, CASE WHEN day(date) = 15 THEN 1.0::DOUBLE ELSE 0 END AS cash, close * CASE WHEN day(date) > 20 THEN 1.01::DOUBLE ELSE 1 END AS adj FROM prices),
g AS (SELECT *, ((adj / lag(adj) OVER w - 1) - ((close + cash) / lag(close) OVER w - 1)) * 10000 AS gap FROM b WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, date, round(gap, 4) + 0 AS gap_bps, CASE WHEN gap IS NULL THEN 'no_prior_session' WHEN abs(gap) <= 0.5 THEN 'reconciled' ELSE 'mismatch' END AS status FROM g""")
def price_reconcile(spark, sf_dir):
    p = prices(spark, sf_dir)
    bars = p.select("ticker", "date", "close", F.when(F.day("date") == 15, 1.0).otherwise(0.0).alias("cash"), (F.col("close") * F.when(F.day("date") > 20, 1.01).otherwise(1.0)).alias("adjusted_close"))
    return S.reconcile_prices(bars, 0.5).select("ticker", "date", (F.round("gap_bps", 4) + 0).alias("gap_bps"), "status")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY o_orderpriority, o_orderstatus")
def status_counts(spark, sf_dir):
    return _r6(S.status_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus"), "share")


@query(f"""WITH {_FORECAST} SELECT doc_id, round(-(0.7 * ln(a) + 0.1 * ln(b) + 0.1 * ln(c) + 0.1 * ln(d)), 6) AS cross_entropy, round(pow(0.7 - a, 2) + pow(0.1 - b, 2) + pow(0.1 - c, 2) + pow(0.1 - d, 2), 6) AS brier,
round(0.7 * (ln(0.7::DOUBLE) - ln(a)) + 0.1 * (ln(0.1::DOUBLE) - ln(b)) + 0.1 * (ln(0.1::DOUBLE) - ln(c)) + 0.1 * (ln(0.1::DOUBLE) - ln(d)), 6) AS kl FROM f""")
def probability_distances(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    d = S.probability_distance([F.lit(x) for x in (0.7, 0.1, 0.1, 0.1)], [F.col(c) for c in _CLASSES])
    return f.select("doc_id", *(F.round(v, 6).alias(k) for k, v in d.items()))


@query("SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 10")
def top_rows(spark, sf_dir):
    """The ten largest rows of each group (a top-k report)."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(w).alias("rank")).where("rank <= 10")
