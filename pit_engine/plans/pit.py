"""Queries of point-in-time extraction and of joins over knowledge time."""

from __future__ import annotations

from pyspark.sql import functions as F

from pit_engine.operators import asof as A
from pit_engine.operators import vintages as V
from pit_engine.plans.inputs import ARCHIVE, PANEL, archive, panel, table
from pit_engine.plans.registry import query

R6 = lambda c, name=None: F.round(c, 6).alias(name or c)
CUTOFF = "2001-01-01"


@query(f"WITH {ARCHIVE} SELECT series_id, reference_date, vintage_date, value FROM archive")
def vintage_matrix_long(spark, sf_dir):
    return archive(spark, sf_dir)


@query(f"WITH {ARCHIVE} SELECT * FROM first")
def first_release(spark, sf_dir):
    return V.first_release(archive(spark, sf_dir))


@query(f"WITH {ARCHIVE} SELECT series_id, reference_date, release_date, current_value, previous_value, round(transformed_value, 6) AS transformed_value, release_lag_days, status FROM features")
def first_release_features(spark, sf_dir):
    f = V.first_release_features(archive(spark, sf_dir))
    return f.withColumn("transformed_value", F.round("transformed_value", 6))


@query(f"""WITH {ARCHIVE}, c AS (SELECT f.*, p.value AS previous_value FROM first f JOIN archive p ON p.series_id = f.series_id AND p.vintage_date = f.release_date
  AND p.reference_date = CAST(f.reference_date - INTERVAL 1 MONTH AS DATE) WHERE f.release_date - CAST(to_days(20) AS INTERVAL) BETWEEN f.reference_date AND last_day(f.reference_date))
SELECT series_id, reference_date, release_date, value AS current_value, previous_value, round(100 * (ln(value) - ln(previous_value)), 6) AS transformed_value FROM c WHERE value > 0 AND previous_value > 0""")
def contemporaneous_release(spark, sf_dir):
    # Vintages of the archive are stamped after their month; moved back by 20 days they may fall into the reference month.
    a = archive(spark, sf_dir).withColumn("vintage_date", F.date_sub("vintage_date", 20))
    f = V.contemporaneous_features(a)
    return f.withColumns({"release_date": F.date_add("release_date", 20), "transformed_value": F.round("transformed_value", 6)})


@query(f"WITH {ARCHIVE} SELECT series_id, reference_date, release_date, value, date_diff('day', last_day(reference_date), release_date) AS release_lag_days FROM first WHERE date_diff('day', last_day(reference_date), release_date) BETWEEN 0 AND 92")
def first_release_levels(spark, sf_dir):
    return V.first_release_levels(archive(spark, sf_dir))


@query(f"""WITH {ARCHIVE}, l AS (SELECT f.series_id, f.reference_date, k, f.release_date, f.value AS current_value, p.value AS previous_value
  FROM first f CROSS JOIN (VALUES (3), (12)) v(k) LEFT JOIN archive p ON p.series_id = f.series_id AND p.vintage_date = f.release_date AND p.reference_date = CAST(f.reference_date - to_months(k) AS DATE))
SELECT series_id, reference_date, k AS lag_months, round(100 * (ln(current_value) - ln(previous_value)), 6) AS change FROM l WHERE current_value > 0 AND previous_value > 0""")
def lagged_change_k(spark, sf_dir):
    a = archive(spark, sf_dir)
    first = V.first_release(a)
    parts = []
    for k in (3, 12):
        p = V.prior_in_vintage(a, first, k)
        change = V.apply_transform(F.col("value"), F.col("previous_value"), "log_difference")
        parts.append(p.select("series_id", "reference_date", F.lit(k).alias("lag_months"), F.round(change, 6).alias("change")).where("change is not null"))
    return parts[0].unionByName(parts[1])


def _two(spark, sf_dir, a, b):
    rows = archive(spark, sf_dir)
    return rows.where(F.col("series_id") == a), rows.where(F.col("series_id") == b)


@query(f"""WITH {ARCHIVE} SELECT 'R/A' AS series_id, r.reference_date, r.vintage_date, round(CASE WHEN r.value > 0 AND a.value > 0 THEN 100 * ln(r.value / a.value) END, 6) AS value
FROM archive r JOIN archive a USING (reference_date, vintage_date) WHERE r.series_id = 'R' AND a.series_id = 'A'""")
def same_vintage_ratio(spark, sf_dir):
    return V.combine_same_vintage(*_two(spark, sf_dir, "R", "A"), "R/A", "log_ratio").withColumn("value", F.round("value", 6))


@query(f"""WITH {ARCHIVE} SELECT 'R-A' AS series_id, r.reference_date, r.vintage_date, round(CASE WHEN r.value - a.value > 0 THEN r.value - a.value END, 2) AS value
FROM archive r JOIN archive a USING (reference_date, vintage_date) WHERE r.series_id = 'R' AND a.series_id = 'A'""")
def same_vintage_difference(spark, sf_dir):
    return V.combine_same_vintage(*_two(spark, sf_dir, "R", "A"), "R-A", "difference").withColumn("value", F.round("value", 2))


@query(f"""WITH {ARCHIVE}, d AS (SELECT DISTINCT vintage_date AS t FROM archive WHERE series_id IN ('R', 'N')),
line AS (SELECT t, (SELECT max(vintage_date) FROM archive WHERE series_id = 'R' AND vintage_date <= t) AS va, (SELECT max(vintage_date) FROM archive WHERE series_id = 'N' AND vintage_date <= t) AS vb FROM d)
SELECT t AS information_date, a.reference_date, a.value AS a_value, b.value AS b_value FROM line
JOIN archive a ON a.series_id = 'R' AND a.vintage_date = va JOIN archive b ON b.series_id = 'N' AND b.vintage_date = vb AND b.reference_date = a.reference_date""")
def asof_vintage_alignment(spark, sf_dir):
    return V.align_vintages(*_two(spark, sf_dir, "R", "N"))


@query(f"""WITH {ARCHIVE}, seen AS (SELECT * FROM archive WHERE vintage_date + INTERVAL 1 DAY < DATE '{CUTOFF}'),
cal AS (SELECT series_id, CAST(unnest(generate_series(min(reference_date), max(reference_date), INTERVAL 1 MONTH)) AS DATE) AS reference_date FROM archive GROUP BY series_id),
f AS (SELECT series_id, reference_date, min(vintage_date) AS release_date, arg_min(value, vintage_date) AS value FROM seen GROUP BY ALL),
l AS (SELECT c.*, release_date, value, date_diff('day', last_day(c.reference_date), release_date) AS release_lag_days FROM cal c LEFT JOIN f USING (series_id, reference_date))
SELECT series_id, reference_date, release_date, CASE WHEN release_lag_days BETWEEN 0 AND 92 THEN value END AS value, release_lag_days,
  CASE WHEN release_date IS NULL THEN 'not_released' WHEN release_lag_days < 0 THEN 'before_period_end' WHEN release_lag_days > 92 THEN 'too_late' ELSE 'available' END AS reason FROM l""")
def release_ledger(spark, sf_dir):
    # A vintage is public at local midnight after its date: five hours into the UTC day.
    return V.availability_ledger(archive(spark, sf_dir), F.lit(CUTOFF).cast("timestamp"))


_SCALES = """scales AS (SELECT series_id, reference_date, stddev_samp(transformed_value) OVER (PARTITION BY series_id ORDER BY release_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS scale FROM features WHERE status = 'available')"""
_ERRORS = f"""{_SCALES},
due AS (SELECT f.*, h AS horizon_months, CAST(release_date + to_months(h) AS DATE) AS mature_at FROM features f CROSS JOIN (VALUES (3), (12)) v(h) WHERE status = 'available'),
ok AS (SELECT d.*, (SELECT max(vintage_date) FROM archive a WHERE a.series_id = d.series_id AND a.vintage_date <= d.mature_at) AS snapshot FROM due d WHERE mature_at <= DATE '{CUTOFF}'),
full_ AS (SELECT o.*, s.scale, CASE WHEN c.value > 0 AND p.value > 0 THEN 100 * (ln(c.value) - ln(p.value)) END AS revised FROM ok o
  LEFT JOIN archive c ON c.series_id = o.series_id AND c.reference_date = o.reference_date AND c.vintage_date = o.snapshot
  LEFT JOIN archive p ON p.series_id = o.series_id AND p.reference_date = CAST(o.reference_date - INTERVAL 1 MONTH AS DATE) AND p.vintage_date = o.snapshot
  LEFT JOIN scales s ON s.series_id = o.series_id AND s.reference_date = o.reference_date),
errors AS (SELECT series_id, reference_date, horizon_months, mature_at, snapshot,
  CASE WHEN revised IS NULL OR scale IS NULL OR scale <= 0 THEN NULL ELSE (revised - transformed_value) / scale END AS revision_error,
  CASE WHEN revised IS NULL THEN 'missing_revised_value' WHEN scale IS NULL OR scale <= 0 THEN 'missing_scale' ELSE 'available' END AS status FROM full_)"""


def _errors(spark, sf_dir):
    from pyspark.sql import Window

    a = archive(spark, sf_dir)
    f = V.first_release_features(a)
    past = Window.partitionBy("series_id").orderBy(F.unix_date("release_date")).rangeBetween(Window.unboundedPreceding, -1)
    scales = f.where("status = 'available'").select("series_id", "reference_date", F.stddev_samp("transformed_value").over(past).alias("scale"))
    return V.revision_errors(a, f, scales, [3, 12], F.lit(CUTOFF).cast("date"))


@query(f"WITH {ARCHIVE}, {_ERRORS} SELECT series_id, reference_date, horizon_months, mature_at, snapshot, round(revision_error, 4) AS revision_error, status FROM errors")
def revision_errors(spark, sf_dir):
    return _errors(spark, sf_dir).withColumn("revision_error", F.round("revision_error", 4))


@query(f"WITH {ARCHIVE}, {_ERRORS} SELECT reference_date, horizon_months, count(revision_error) AS n_components, round(CASE WHEN count(revision_error) = 2 THEN avg(revision_error) END, 4) AS axis_error FROM errors WHERE series_id IN ('A', 'R') GROUP BY ALL")
def axis_revision_errors(spark, sf_dir):
    e = _errors(spark, sf_dir).where("series_id in ('A', 'R')")
    return V.axis_revision_errors(e, 2).withColumn("axis_error", F.round("axis_error", 4))


@query(f"""WITH {ARCHIVE}, k AS (SELECT reference_date, max(release_date) OVER (PARTITION BY series_id ORDER BY reference_date) AS known FROM first)
SELECT reference_date, count(known) AS n_components, CASE WHEN count(known) = 3 THEN max(known) END AS score_available_at FROM k GROUP BY reference_date""")
def score_availability(spark, sf_dir):
    return V.cumulative_availability(V.first_release(archive(spark, sf_dir)), 3)


@query(f"""WITH {ARCHIVE}, w AS (SELECT *, min(release_date) OVER (PARTITION BY series_id) AS f, max(reference_date) OVER (PARTITION BY series_id, release_date) AS l FROM first)
SELECT series_id, reference_date, release_date, value FROM w WHERE release_date > f OR reference_date = l""")
def archive_start_filter(spark, sf_dir):
    return V.drop_archive_start(V.first_release(archive(spark, sf_dir)))


@query(f"""WITH {ARCHIVE} SELECT series_id AS family, max(release_date) AS latest, count(*) AS n_rows, date_diff('day', max(release_date), DATE '2004-01-01') AS age_days,
CASE WHEN date_diff('day', max(release_date), DATE '2004-01-01') <= 900 THEN 'fresh' ELSE 'stale' END AS status FROM first GROUP BY series_id""")
def freshness_audit(spark, sf_dir):
    return V.freshness(V.first_release(archive(spark, sf_dir)), "series_id", "release_date", F.lit("2004-01-01").cast("date"), 900)


@query(f"WITH {ARCHIVE} SELECT series_id, max(release_date) AS latest FROM first GROUP BY series_id")
def cutoff_assertion(spark, sf_dir):
    rows = V.assert_cutoff(V.first_release(archive(spark, sf_dir)), ["release_date"], F.lit("2100-01-01").cast("date"))
    return rows.groupBy("series_id").agg(F.max("release_date").alias("latest"))


@query(f"""WITH {ARCHIVE}, e AS (SELECT series_id, m AS reference_date FROM (SELECT DISTINCT series_id FROM first) CROSS JOIN (SELECT DISTINCT reference_date AS m FROM first))
SELECT series_id, reference_date FROM e EXCEPT SELECT series_id, reference_date FROM features WHERE status = 'available'""")
def expected_missing(spark, sf_dir):
    a = archive(spark, sf_dir)
    f = V.first_release_features(a)
    return V.expected_missing(f, f.where("status = 'available'"))


_OBS = """ev AS (SELECT event_id, CAST(ts AS DATE) AS d, ts, user_id, event_type, value FROM events)"""


@query(f"""WITH {_OBS}, day AS (SELECT date_trunc('month', d) AS m, d, count(value) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS c FROM ev WHERE event_type = 'view' GROUP BY ALL),
asked AS (SELECT DISTINCT date_trunc('month', d) AS m, d FROM ev WHERE event_type = 'purchase'),
known AS (SELECT a.m, a.d, sum(n) AS n, sum(c) AS c FROM asked a JOIN day ON day.m = a.m AND day.d <= a.d GROUP BY ALL)
SELECT event_id, CAST(n AS BIGINT) AS n_observations, round(CAST(c AS DOUBLE) / CAST(n AS DOUBLE), 4) AS control_value FROM ev JOIN known USING (d) WHERE event_type = 'purchase'""")
def rate_control_avg(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    p = e.where("event_type = 'purchase'").select("event_id", F.col("d").alias("reference_date"), F.col("d").alias("release_date"))
    o = e.where("event_type = 'view'").select(F.col("d").alias("reference_date"), F.col("d").alias("available_at"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    return V.monthly_average_control(p, o).withColumn("control_value", F.round("control_value", 4))


@query(f"""WITH {_OBS}, day AS (SELECT event_type, d, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value FROM ev GROUP BY ALL)
SELECT r.d AS reference_date, r.value, c.value AS control_value FROM day r LEFT JOIN day c ON c.event_type = 'signup' AND c.d = r.d + 7 WHERE r.event_type = 'error'""")
def pair_same_day_plus7(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("reference_date")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value"))
    # Publications are stamped with the response's week, so both sides carry the same release.
    r = e.where("event_type = 'error'").select("reference_date", F.col("reference_date").alias("release_date"), "value")
    c = e.where("event_type = 'signup'").select("reference_date", F.date_sub("reference_date", 7).alias("release_date"), "value")
    return V.paired_release(r, c).select("reference_date", "value", "control_value")


def _clicks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.where("event_type = 'purchase'").select("event_id", "ts", "user_id"), e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))


@query("SELECT p.event_id, p.ts, p.user_id, c.event_id AS click_id, c.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON c.user_id = p.user_id AND p.ts > c.ts")
def asof_strict(spark, sf_dir):
    left, right = _clicks(spark, sf_dir)
    return A.asof_join(left, right, ["user_id"], "ts", "click_ts", ["click_id", "click_value"], strict=True)


@query("SELECT p.event_id, p.d, p.user_id, c.event_id AS click_id FROM (SELECT event_id, CAST(ts AS DATE) AS d, user_id FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS d, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) c ON c.user_id = p.user_id AND p.d >= c.d")
def asof_inclusive(spark, sf_dir):
    left, right = _clicks(spark, sf_dir)
    day = lambda df, c, to: df.withColumn(to, F.to_date(c))
    out = A.asof_join(day(left, "ts", "d").drop("ts"), day(right, "click_ts", "cd"), ["user_id"], "d", "cd", ["click_id"], strict=False, ties=["click_id"])
    return out.select("event_id", "d", "user_id", "click_id")


@query(f"""WITH {PANEL} SELECT p.series_id, p.month, p.value, q.value AS value_prior FROM panel p LEFT JOIN panel q ON q.series_id = p.series_id AND q.month = CAST(p.month - INTERVAL 12 MONTH AS DATE)""")
def lagged_self_join(spark, sf_dir):
    return A.lagged_self_join(panel(spark, sf_dir), ["series_id"], "month", 12, ["value"])


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_many_to_one(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "k")
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "k")
    return A.join_checked(n, r, ["k"], "inner", "many_to_one").select("n_nationkey", "n_name", "r_name")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'document_only' ELSE 'both' END AS side, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, 'label_only', quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def join_full_indicator(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("_d"))
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("_l"))
    side = F.when(F.col("_l").isNull(), "document_only").when(F.col("_d").isNull(), "label_only").otherwise("both")
    return d.join(l, "doc_id", "full").select("doc_id", side.alias("side"), "quality")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_anti")


@query("SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def unordered_pairs(spark, sf_dir):
    return A.unordered_pairs(table(spark, sf_dir, "region"), "r_regionkey", ["r_name"]).select(F.col("left_r_name").alias("left_name"), F.col("right_r_name").alias("right_name"))


@query(f"""WITH {ARCHIVE}, l AS (SELECT * FROM first WHERE series_id = 'A'), r AS (SELECT * FROM first WHERE series_id = 'R')
SELECT reference_date, l.value AS left_value, r.value AS right_value, CASE WHEN l.value IS NULL THEN 'added' WHEN r.value IS NULL THEN 'lost' WHEN abs(l.value - r.value) <= 100000 THEN 'same' ELSE 'changed' END AS status FROM l FULL JOIN r USING (reference_date)""")
def ledger_compare(spark, sf_dir):
    f = V.first_release(archive(spark, sf_dir))
    return A.compare_keyed(f.where("series_id = 'A'"), f.where("series_id = 'R'"), ["reference_date"], "value", 100000)
