"""Queries of ledgers, walk-forward inputs, block likelihoods and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pit_engine.operators import ledger as L
from pit_engine.operators import models as M
from pit_engine.operators import vintages as V
from pit_engine.operators import walkforward as K
from pit_engine.plans.inputs import ARCHIVE, GROWTH, INFLATION, PANEL, PRICES, SCORES, archive, cents, panel, prices, scores, table
from pit_engine.plans.regimes import _VAR, history, var_input
from pit_engine.plans.registry import query


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ------------------------------------------------------------------ ledgers and audits

_CELLS = """CASE WHEN month(reference_date) = 7 AND year(reference_date) % 2 = 0 THEN 'n/a' WHEN month(reference_date) = 3 AND year(reference_date) % 3 = 0 THEN '0'
  WHEN month(reference_date) = 10 AND year(reference_date) % 2 = 1 THEN NULL ELSE CAST(value AS {}) END"""


@query(f"""WITH {ARCHIVE}, visible AS (SELECT series_id, reference_date, vintage_date, {_CELLS.format('VARCHAR')} AS value FROM archive WHERE vintage_date <= DATE '1998-12-31'),
months AS (SELECT series_id, first_vintage, CAST(unnest(generate_series(DATE '1994-06-01', DATE '1999-08-01', INTERVAL 1 MONTH)) AS DATE) AS reference_date FROM (SELECT series_id, min(vintage_date) AS first_vintage FROM visible GROUP BY series_id)),
known AS (SELECT series_id, reference_date, min(vintage_date) FILTER (value IS NOT NULL) AS vintage_date, arg_min(value, vintage_date) FILTER (value IS NOT NULL) AS cell FROM visible GROUP BY ALL),
latest AS (SELECT series_id, vintage_date, max(reference_date) AS latest FROM visible WHERE value IS NOT NULL AND last_day(reference_date) <= vintage_date GROUP BY ALL),
j AS (SELECT m.*, k.series_id IS NOT NULL AS present, k.vintage_date, TRY_CAST(k.cell AS DOUBLE) AS now, q.series_id IS NOT NULL AS prior_listed, p.value AS prior_cell, TRY_CAST(p.value AS DOUBLE) AS before, l.latest, date_diff('day', last_day(m.reference_date), k.vintage_date) AS lag
  FROM months m LEFT JOIN known k ON k.series_id = m.series_id AND k.reference_date = m.reference_date
  LEFT JOIN known q ON q.series_id = m.series_id AND q.reference_date = CAST(m.reference_date - INTERVAL 1 MONTH AS DATE)
  LEFT JOIN visible p ON p.series_id = m.series_id AND p.reference_date = CAST(m.reference_date - INTERVAL 1 MONTH AS DATE) AND p.vintage_date = k.vintage_date
  LEFT JOIN latest l ON l.series_id = m.series_id AND l.vintage_date = m.first_vintage),
r AS (SELECT *, CASE WHEN reference_date > DATE '1999-06-01' THEN 'outside_active_support' WHEN reference_date > DATE '1999-01-01' THEN 'future_reference' WHEN NOT present THEN 'absent_reference' WHEN vintage_date IS NULL THEN 'unavailable_by_asof'
  WHEN now IS NULL THEN 'invalid_current_value' WHEN lag < 0 THEN 'negative_release_lag' WHEN vintage_date = first_vintage AND reference_date IS DISTINCT FROM latest THEN 'archive_bootstrap' WHEN lag > 92 THEN 'excessive_release_lag'
  WHEN NOT prior_listed THEN 'missing_prior_reference' WHEN prior_cell IS NULL THEN 'missing_prior_value' WHEN before IS NULL THEN 'invalid_prior_value' WHEN least(now, before) <= 0 THEN 'nonpositive_log_levels' ELSE 'retained' END AS reason FROM j)
SELECT series_id, reference_date, CASE WHEN reason = 'retained' THEN 'retained' ELSE 'excluded' END AS status, reason, CASE WHEN reason NOT IN ('outside_active_support', 'future_reference', 'absent_reference', 'unavailable_by_asof') THEN vintage_date END AS archive_vintage_date,
  CASE WHEN reason = 'retained' THEN round(100 * (ln(now) - ln(before)), 6) END AS transformed_value FROM r""")
def feature_ledger(spark, sf_dir):
    a = archive(spark, sf_dir).withColumn("value", F.expr(_CELLS.format("STRING")))
    out = L.feature_ledger(a, "1994-06-01", "1999-08-01", F.lit("1999-01-01 12:00:00").cast("timestamp"), active_end="1999-06-01")
    return out.select("series_id", "reference_date", "status", "reason", "archive_vintage_date", F.round("transformed_value", 6).alias("transformed_value"))


@query(f"""WITH {ARCHIVE}, a AS (SELECT * FROM features WHERE series_id = 'R' AND status = 'available'), b AS (SELECT * FROM features WHERE series_id = 'A' AND status = 'available')
SELECT count(*) FILTER (a.series_id IS NOT NULL AND b.series_id IS NOT NULL) AS common_months, count(*) FILTER (b.series_id IS NULL) AS old_only_months, count(*) FILTER (a.series_id IS NULL) AS new_only_months,
  round(avg(b.transformed_value - a.transformed_value), 6) AS mean_difference, round(max(abs(b.transformed_value - a.transformed_value)), 6) AS max_absolute_difference, 'descriptive_overlap' AS status FROM a FULL JOIN b USING (reference_date)""")
def splice_audit(spark, sf_dir):
    return _r(L.splice_audit(V.first_release_features(archive(spark, sf_dir)), "R", "A").drop("jointly_available_at"), "mean_difference", "max_absolute_difference")


@query(f"""WITH {PRICES}, o AS (SELECT ticker, date, close, lag(date) OVER w AS p, close / lag(close) OVER w - 1 AS r FROM prices WHERE day(date) <= 24 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
n AS (SELECT *, lag(date) OVER w AS p, close / lag(close) OVER w - 1 AS r FROM (SELECT ticker, date, CASE WHEN day(date) = 15 THEN close * 1.25::DOUBLE ELSE close END AS close FROM prices WHERE day(date) >= 5) WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, count(*) FILTER (o.date IS NOT NULL AND n.date IS NOT NULL) AS common_dates, count(*) FILTER (n.date IS NULL) AS old_only_dates, count(*) FILTER (o.date IS NULL) AS new_only_dates, count(*) FILTER (abs(o.close - n.close) > 1e-9) AS price_changes,
  count(*) FILTER (o.p = n.p) AS compared_intervals, count(*) FILTER (o.p = n.p AND abs(o.r - n.r) > 1e-9) AS return_changes, round(max(CASE WHEN o.p = n.p THEN abs(n.r - o.r) * 10000 END), 4) AS largest_return_change_bps, 'changed_common_support' AS status FROM o FULL JOIN n USING (ticker, date) GROUP BY ticker""")
def snapshot_diff(spark, sf_dir):
    p = prices(spark, sf_dir).select("ticker", "date", "close")
    new = p.where("day(date) >= 5").withColumn("close", F.when(F.day("date") == 15, F.col("close") * 1.25).otherwise(F.col("close")))
    return _r(L.snapshot_diff(p.where("day(date) <= 24"), new, 1e-9), "largest_return_change_bps", digits=4)


# ------------------------------------------------------------------ vectors and samples

_EV = """ev AS (SELECT strftime(release_date, '%Y-%m-%d') || '|' || strftime(reference_date, '%Y-%m') AS event_id, release_date, reference_date AS reference_month, 'f_' || series_id AS feature_name, transformed_value AS feature_value FROM features WHERE status = 'available')"""
_BLOCK = f"""WITH {ARCHIVE}, {_EV}, {SCORES},
vec AS (SELECT e.*, g.regime_id, CASE WHEN g.regime_id IS NOT NULL THEN greatest(release_date, g.available_at) END AS training_available_at, f_A IS NOT NULL AND f_R IS NOT NULL AS complete_vector FROM (
  SELECT event_id, release_date, reference_month, max(feature_value) FILTER (feature_name = 'f_A') AS f_A, max(feature_value) FILTER (feature_name = 'f_R') AS f_R FROM ev WHERE feature_name IN ('f_A', 'f_R') GROUP BY ALL) e LEFT JOIN regimes g ON g.month = e.reference_month),
cand AS (SELECT * FROM vec WHERE complete_vector AND regime_id IS NOT NULL)"""
_FEATURES = ["f_A", "f_R"]


def released(spark, sf_dir):
    f = V.first_release_features(archive(spark, sf_dir)).where("status = 'available'")
    day = F.date_format("release_date", "yyyy-MM-dd")
    return f.select(F.concat_ws("|", day, F.date_format("reference_date", "yyyy-MM")).alias("event_id"), day.alias("event_group_id"), F.lit("shipments").alias("release_block"), "release_date", F.col("reference_date").alias("reference_month"),
        F.concat(F.lit("f_"), "series_id").alias("feature_name"), F.col("transformed_value").alias("feature_value"), F.lit("available").alias("feature_status"))


def vectors(spark, sf_dir):
    return K.block_vectors(released(spark, sf_dir), history(spark, sf_dir), "shipments", _FEATURES)


@query(f"{_BLOCK} SELECT event_id, release_date, reference_month, round(f_A, 6) AS f_A, round(f_R, 6) AS f_R, regime_id, complete_vector, training_available_at, complete_vector AND regime_id IS NOT NULL AS training_candidate FROM vec")
def block_vectors(spark, sf_dir):
    return _r(vectors(spark, sf_dir), *_FEATURES).select("event_id", "release_date", "reference_month", *_FEATURES, "regime_id", "complete_vector", "training_available_at", "training_candidate")


_CUTOFFS = ["1997-06-01", "1998-06-01", "1999-06-01"]


@query(f"""{_BLOCK}, cuts AS (SELECT DISTINCT release_date AS t FROM vec WHERE release_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'),
n AS (SELECT t, (SELECT count(*) FROM cand WHERE training_available_at < t) AS training_count FROM cuts) SELECT 'shipments' AS release_block, CAST(training_count AS BIGINT) AS training_count, min(t) AS first_cutoff FROM n WHERE training_count >= 2 GROUP BY training_count""")
def training_samples(spark, sf_dir):
    return K.training_samples(vectors(spark, sf_dir), "1996-01-01", "1999-12-31", 2)


@query(f"""{_BLOCK}, cuts AS (SELECT * FROM (VALUES {', '.join(f"(DATE '{c}')" for c in _CUTOFFS)}) v(cutoff))
SELECT cutoff, sha256(coalesce(string_agg(event_id || chr(10), '' ORDER BY training_available_at, event_id), '')) AS signature, count(event_id) AS training_count, max(training_available_at) AS latest FROM cuts LEFT JOIN cand ON training_available_at < cutoff GROUP BY cutoff""")
def fit_signatures(spark, sf_dir):
    cuts = spark.createDataFrame([(c,) for c in _CUTOFFS], "cutoff string").select(F.col("cutoff").cast("date"))
    return K.fit_signature(vectors(spark, sf_dir).where("training_candidate"), cuts, "event_id")


_OBS = f"""WITH {ARCHIVE}, {_EV}, {SCORES}, base AS (SELECT reference_month, max(feature_value) FILTER (feature_name = 'f_A') AS f_A, max(feature_value) FILTER (feature_name = 'f_N') AS f_N, max(feature_value) FILTER (feature_name = 'f_R') AS f_R,
  max(release_date) FILTER (feature_name = 'f_A') AS da, max(release_date) FILTER (feature_name = 'f_N') AS dn, max(release_date) FILTER (feature_name = 'f_R') AS dr FROM ev GROUP BY reference_month),
full_ AS (SELECT b.*, s.growth_score, s.inflation_score, s.available_at, f_A IS NOT NULL AND f_R IS NOT NULL AS r, f_N IS NOT NULL AS c, growth_score IS NOT NULL AND inflation_score IS NOT NULL AS s FROM base b LEFT JOIN scores s ON s.month = b.reference_month),
training AS (SELECT *, greatest(da, dr, dn, available_at) AS training_available_at FROM full_ WHERE r AND c AND s)"""


def observed(spark, sf_dir):
    return K.observation_vectors(released(spark, sf_dir), scores(spark, sf_dir), "m1", ["f_A", "f_R"], ["f_N"])


@query(f"{_OBS} SELECT reference_month, round(f_A, 6) AS f_A, round(f_R, 6) AS f_R, round(f_N, 6) AS f_N, round(growth_score, 6) AS growth_score, round(inflation_score, 6) AS inflation_score, training_available_at FROM training")
def observation_training(spark, sf_dir):
    cols = ["f_A", "f_R", "f_N", "growth_score", "inflation_score"]
    return _r(observed(spark, sf_dir)["training"], *cols).select("reference_month", *cols, "training_available_at")


@query(f"{_OBS} SELECT 'm1' AS observation_model_id, count(*) FILTER (r AND c AND s) AS training_candidates, count(*) FILTER (NOT r) AS excluded_incomplete_response, count(*) FILTER (r AND NOT c) AS excluded_incomplete_control, count(*) FILTER (r AND c AND NOT s) AS excluded_score_unavailable FROM full_")
def observation_audit(spark, sf_dir):
    return observed(spark, sf_dir)["audit"]


@query(f"""WITH {ARCHIVE}, {_EV} SELECT event_id, release_date, reference_month, round(max(feature_value) FILTER (feature_name = 'f_A'), 6) AS f_A, round(max(feature_value) FILTER (feature_name = 'f_R'), 6) AS f_R, round(max(feature_value) FILTER (feature_name = 'f_N'), 6) AS f_N,
  count(*) FILTER (feature_name <> 'f_N') = 2 AS complete_response_vector FROM ev GROUP BY ALL HAVING count(*) FILTER (feature_name <> 'f_N') > 0""")
def live_event_vectors(spark, sf_dir):
    return _r(observed(spark, sf_dir)["live"], "f_A", "f_R", "f_N").drop("observation_model_id")


@query(f"{_OBS} SELECT reference_month, CASE WHEN f_A IS NULL OR f_R IS NULL OR growth_score IS NULL OR inflation_score IS NULL OR f_N IS NULL THEN 'incomplete_model_vector' WHEN greatest(da, dr, dn, available_at) < DATE '1999-01-01' THEN '' ELSE 'not_available_strictly_before_cutoff' END AS exclusion_reason FROM full_ WHERE r")
def emission_row_selection(spark, sf_dir):
    base = released(spark, sf_dir).groupBy("reference_month").pivot("feature_name", ["f_A", "f_N", "f_R"]).agg(F.first("feature_value").alias("v"), F.max("release_date").alias("d"))
    rows = base.select("reference_month", F.col("f_A_v").alias("f_A"), F.col("f_N_v").alias("f_N"), F.col("f_R_v").alias("f_R"), "f_A_d", "f_N_d", "f_R_d").where("f_A is not null and f_R is not null")
    rows = rows.join(scores(spark, sf_dir).select(F.col("month").alias("reference_month"), "growth_score", "inflation_score", "available_at"), "reference_month", "left").withColumn("known", F.greatest("f_A_d", "f_N_d", "f_R_d", "available_at"))
    return K.select_emission_rows(rows, ["f_A", "f_R", "growth_score", "inflation_score", "f_N"], "known", F.lit("1999-01-01").cast("date")).select("reference_month", "exclusion_reason")


@query(f"{_OBS}, k AS (SELECT * FROM training WHERE training_available_at < DATE '1998-01-01') SELECT 'f_N' AS control, count(*) AS n, max(f_N) - min(f_N) > 1e-12 AS active FROM k HAVING count(*) > 0 UNION ALL SELECT 'constant', count(*), false FROM k HAVING count(*) > 0")
def active_controls(spark, sf_dir):
    t = observed(spark, sf_dir)["training"].withColumn("constant", F.lit(1.0))
    return K.active_controls(t, ["f_N", "constant"], F.lit("1998-01-01").cast("date"))


@query(f"""{_VAR}, p AS (SELECT nm, CAST(nm + INTERVAL 1 MONTH + INTERVAL 14 DAY AS DATE) AS av FROM u), c AS (SELECT CAST(month + INTERVAL 3 MONTH AS DATE) AS candidate, available_at FROM scores WHERE growth_score IS NOT NULL AND inflation_score IS NOT NULL),
n AS (SELECT candidate, count(*) AS n_pairs FROM c JOIN p ON nm < candidate AND av <= candidate WHERE available_at < candidate AND candidate <= DATE '2005-01-01' GROUP BY candidate) SELECT candidate AS month, n_pairs FROM n WHERE n_pairs >= 12 ORDER BY candidate LIMIT 1""")
def earliest_start(spark, sf_dir):
    s = scores(spark, sf_dir).where("growth_score is not null and inflation_score is not null").select("month", "available_at")
    return K.earliest_start(s, var_input(spark, sf_dir).select("month", "pair_available_at"), 12, "2005-01-01")


@query(f"""WITH {SCORES}, t AS (SELECT month, CAST(month + to_months(k) AS DATE) AS date FROM scores CROSS JOIN (VALUES (1), (3)) v(k)), m AS (SELECT month, CAST(available_at + to_months(h) AS DATE) AS available_at, growth_score * (1 + h) AS noise FROM scores CROSS JOIN (VALUES (0), (1)) v(h) WHERE growth_score IS NOT NULL)
SELECT t.month, t.date, max(m.available_at) AS mapping_available_at, round(arg_max(m.noise, m.available_at), 6) AS noise FROM t LEFT JOIN m ON m.month = t.month AND m.available_at <= t.date GROUP BY ALL""")
def own_month_mapping(spark, sf_dir):
    s = scores(spark, sf_dir)
    t = s.select("month", F.explode(F.array(F.add_months("month", 1), F.add_months("month", 3))).alias("date"))
    m = s.where("growth_score is not null").select("month", F.explode(F.array(F.lit(0), F.lit(1))).alias("h"), "growth_score", "available_at").select("month", F.expr("add_months(available_at, h)").alias("available_at"), (F.col("growth_score") * (1 + F.col("h"))).alias("noise"))
    return _r(K.own_month_mapping(t, m, ["noise"]), "noise")


@query(f"""WITH {SCORES}, w AS (SELECT month, 1.0::DOUBLE + month(month) % 3 AS a, 1.0::DOUBLE + month(month) % 4 AS b, 1.0::DOUBLE + year(month) % 2 AS c, 1.0::DOUBLE AS d FROM regimes)
SELECT month AS holding_month, month AS signal_date, 'base|' || strftime(month, '%Y-%m') AS checkpoint_id, round(a/(a+b+c+d), 9) AS p_uu, round(b/(a+b+c+d), 9) AS p_du, round(c/(a+b+c+d), 9) AS p_ud, round(d/(a+b+c+d), 9) AS p_dd FROM w""")
def post_roll_signals(spark, sf_dir):
    m = scores(spark, sf_dir).select("month")
    weights = [1.0 + F.month("month") % 3, 1.0 + F.month("month") % 4, 1.0 + F.year("month") % 2, F.lit(1.0)]
    total = weights[0] + weights[1] + weights[2] + weights[3]
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("regime_id"), (w / total).alias("probability")) for r, w in zip(K.REGIMES, weights, strict=True)))).alias("x")
    spec = F.explode(F.array(F.lit("base"), F.lit("other"))).alias("specification_id")
    points = m.select(spec, "month").withColumn("checkpoint_id", F.concat_ws("|", "specification_id", F.date_format("month", "yyyy-MM")))
    checkpoints = points.select("specification_id", "checkpoint_id", F.col("month").alias("as_of_date"), F.col("month").alias("anchor_month"), F.explode(F.array(F.lit("post_month_roll"), F.lit("month_end"))).alias("checkpoint_type"))
    marginals = points.select("checkpoint_id", "month", F.explode(F.array(F.lit(-1), F.lit(0))).alias("relative_month")).select("checkpoint_id", "relative_month", F.lit("path").alias("marginal_type"), each).select("checkpoint_id", "relative_month", "marginal_type", "x.*")
    return _r(K.post_roll_signals(checkpoints, marginals, "base"), "p_uu", "p_du", "p_ud", "p_dd", digits=9)


# ------------------------------------------------------------------ block likelihood

_LIKELIHOOD = f"""WITH {SCORES}, vec AS (SELECT month, z1 AS f_A, z5 AS f_R, regimes.regime_id, regimes.available_at FROM scores JOIN regimes USING (month) WHERE regime_id IS NOT NULL),
t AS (SELECT regime_id, f_A AS x, f_R AS y FROM vec WHERE available_at < DATE '2000-01-01'),
own AS (SELECT v.r AS regime_id, count(t.x) AS n, coalesce(avg(x), 0) AS mx, coalesce(avg(y), 0) AS my FROM (VALUES ('UU'), ('DU'), ('UD'), ('DD')) v(r) LEFT JOIN t ON t.regime_id = r GROUP BY r),
means AS (SELECT regime_id, n, (n * mx + 5 * (SELECT avg(x) FROM t)) / (n + 5) AS mx, (n * my + 5 * (SELECT avg(y) FROM t)) / (n + 5) AS my FROM own),
e AS (SELECT x - mx AS u, y - my AS v FROM t JOIN means USING (regime_id)),
s AS (SELECT count(*) AS n, avg(u*u) AS a, avg(u*v) AS b, avg(v*v) AS d, avg(pow(u*u + v*v, 2)) AS q FROM e),
h AS (SELECT *, (a+d)/2 AS mu, (a*a + 2*b*b + d*d - 2*pow((a+d)/2, 2))/2 AS delta, (q - (a*a + 2*b*b + d*d))/(2*n) AS beta FROM s),
c AS (SELECT n, k, (1-k)*a + k*mu AS a, (1-k)*b AS b, (1-k)*d + k*mu AS d FROM (SELECT *, CASE WHEN delta <= 0 THEN 0 ELSE greatest(least(beta, delta), 0)/delta END AS k FROM h))"""


def labelled_scores(spark, sf_dir):
    s = scores(spark, sf_dir).select("month", F.col("z1").alias("f_A"), F.col("z5").alias("f_R"))
    return s.join(history(spark, sf_dir).where("regime_id is not null").select("month", "regime_id", "label_available_at"), "month")


def block_fit(spark, sf_dir, **options):
    return K.block_likelihood(labelled_scores(spark, sf_dir).where("label_available_at < date'2000-01-01'"), _FEATURES, **options)


@query(f"{_LIKELIHOOD} SELECT regime_id, n, round(mx, 6) AS m_f_A, round(my, 6) AS m_f_R FROM means")
def block_likelihood_means(spark, sf_dir):
    return _r(block_fit(spark, sf_dir)["means"], "m_f_A", "m_f_R")


@query(f"{_LIKELIHOOD} SELECT n, round(k, 6) AS shrinkage, round(a, 6) AS c11, round(b, 6) AS c12, round(d, 6) AS c22 FROM c")
def block_likelihood_covariance(spark, sf_dir):
    c = block_fit(spark, sf_dir)["covariance"]
    return c.select("n", F.round("shrinkage", 6).alias("shrinkage"), *(F.round(F.get("c", F.lit(i)), 6).alias(n) for i, n in ((0, "c11"), (1, "c12"), (3, "c22"))))


def _density(nu):
    det, factor = "(a*d - b*b)", 1.0 if nu is None else (nu - 2) / nu
    maha = f"((d*u*u - 2*b*u*v + a*v*v) / ({factor}::DOUBLE * {det}))"
    logdet = f"ln(pow({factor}::DOUBLE, 2) * {det})"
    if nu is None:
        return f"-0.5 * (2 * ln(2 * pi()) + {logdet} + {maha})"
    return f"lgamma({(nu + 2) / 2}::DOUBLE) - lgamma({nu / 2}::DOUBLE) - 0.5 * (2 * ln({nu}::DOUBLE * pi()) + {logdet}) - 0.5 * ({nu}::DOUBLE + 2) * ln(1 + {maha} / {nu}::DOUBLE)"


_LIVE = "o AS (SELECT month, m.regime_id, f_A - mx AS u, f_R - my AS v, c.* FROM vec, means m, c WHERE available_at >= DATE '2000-01-01')"


def _loglik(spark, sf_dir, nu):
    live = labelled_scores(spark, sf_dir).where("label_available_at >= date'2000-01-01'")
    return _r(K.log_likelihoods(live, ["month"], block_fit(spark, sf_dir), _FEATURES, nu), "loglik")


@query(f"{_LIKELIHOOD}, {_LIVE} SELECT month, regime_id, round({_density(7.0)}, 6) AS loglik FROM o")
def block_loglik_student_t(spark, sf_dir):
    return _loglik(spark, sf_dir, 7.0)


@query(f"{_LIKELIHOOD}, {_LIVE} SELECT month, regime_id, round({_density(None)}, 6) AS loglik FROM o")
def block_loglik_gaussian(spark, sf_dir):
    return _loglik(spark, sf_dir, None)


# ------------------------------------------------------------------ partial defining releases

_AXES = {f"z{k}": "growth" if k < 5 else "inflation" for k in range(1, 9)}


@query(f"""WITH {SCORES}, long AS (SELECT month, component, z FROM (SELECT month, z1, z2, z3, z4, z5, z6, z7, z8 FROM scores) UNPIVOT INCLUDE NULLS (z FOR component IN (z1, z2, z3, z4, z5, z6, z7, z8))),
rel AS (SELECT month, component, CASE WHEN month(month) = 9 AND component = 'z3' THEN NULL ELSE CAST(month + INTERVAL 1 MONTH + to_days(CAST(substr(component, 2) AS INTEGER) % 3) AS DATE) END AS release_date, CASE WHEN month(month) = 2 AND component = 'z5' THEN NULL ELSE 1.0::DOUBLE END AS tv, z FROM long),
st AS (SELECT *, CASE WHEN release_date IS NULL THEN 'invalid_date' WHEN tv IS NULL THEN 'invalid_transformed_value' WHEN z IS NULL THEN 'component_z_unavailable' ELSE 'available' END AS preparation_status, strftime(release_date, '%Y-%m-%d') || '|' || strftime(month, '%Y-%m') AS event_id FROM rel)
SELECT month, component, event_id, preparation_status, CASE WHEN component < 'z5' THEN 'growth' ELSE 'inflation' END AS axis, round(0.25::DOUBLE * z, 6) AS weighted_contribution, count(*) OVER w AS event_component_count, list_aggregate(list_sort(list(component) OVER w), 'string_agg', '+') AS event_components
FROM st WHERE preparation_status = 'available' WINDOW w AS (PARTITION BY event_id)""")
def partial_defining_events(spark, sf_dir):
    s = scores(spark, sf_dir)
    for k in range(1, 9):
        s = s.withColumnRenamed(f"z{k}", f"z_z{k}")
    names = F.explode(F.array(*(F.lit(c) for c in _AXES))).alias("component")
    r = s.select("month", names)
    date = F.date_add(F.add_months("month", 1), F.substring("component", 2, 1).cast("int") % 3)
    r = r.select("month", "component", F.when(~((F.month("month") == 9) & (F.col("component") == "z3")), date).alias("release_date"), F.when(~((F.month("month") == 2) & (F.col("component") == "z5")), 1.0).alias("transformed_value"))
    out = K.partial_defining(r, s, _AXES).where("preparation_status = 'available'")
    return _r(out, "weighted_contribution").select("month", "component", "event_id", "preparation_status", "axis", "weighted_contribution", "event_component_count", "event_components")


@query()
def var_weight_audit(spark, sf_dir):
    p, e = var_input(spark, sf_dir), {"huber": 1.345, "student_t": 7.0}
    return K.weight_audit(p, M.robust_var(p, e), e)


# ------------------------------------------------------------------ selections


@query("SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def intersect_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey")).intersect(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def largest_orders(spark, sf_dir):
    """The ten largest orders (a top-k report)."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT a, b, c, d, round(p, 9) AS p FROM (WITH " + SCORES + """, g AS (SELECT regime_id AS r, count(*) AS n FROM regimes WHERE regime_id IS NOT NULL GROUP BY ALL), q AS (SELECT v.r, (coalesce(n, 0) + 1.0::DOUBLE) / (sum(coalesce(n, 0)) OVER () + 4) AS p FROM (VALUES ('UU'), ('DU'), ('UD'), ('DD')) v(r) LEFT JOIN g USING (r))
SELECT x.r AS a, y.r AS b, z.r AS c, w.r AS d, x.p * y.p * z.p * w.p AS p FROM q x, q y, q z, q w ORDER BY p DESC, a, b, c, d LIMIT 10)""")
def top_paths(spark, sf_dir):
    """The ten most probable independent paths of four months (a top-k report)."""
    from pit_engine.operators.regimes import initial_path
    from pit_engine.plans.regimes import marginal

    m = marginal(spark, sf_dir)
    free = m.select(F.explode(F.array(*(F.lit(r) for r in K.REGIMES))).alias("source"), F.col("regime_id").alias("destination"), "p")
    path = initial_path(m, free)
    return _r(path.orderBy(F.desc("p"), "a", "b", "c", "d").limit(10), "p", digits=9)


@query("SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_regionkey, n_name, n_nationkey) AS INTEGER) AS place FROM nation")
def total_order(spark, sf_dir):
    """A stable order is an order by a total key: the unique tie-breaker comes last."""
    from pyspark.sql import Window

    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.row_number().over(Window.orderBy("n_regionkey", "n_name", "n_nationkey")).alias("place"))


@query(f"""WITH {ARCHIVE} SELECT f.series_id, f.reference_date, t AS transform, round(CASE t WHEN 'difference' THEN f.value - p.value WHEN 'negative_difference' THEN p.value - f.value WHEN 'level' THEN f.value ELSE CASE WHEN f.value > 0 AND p.value > 0 THEN 100 * (ln(f.value) - ln(p.value)) END END, 4) AS value
FROM first f JOIN archive p ON p.series_id = f.series_id AND p.vintage_date = f.release_date AND p.reference_date = CAST(f.reference_date - INTERVAL 1 MONTH AS DATE) CROSS JOIN (VALUES ('difference'), ('negative_difference'), ('log_difference'), ('level')) v(t)""")
def release_transforms(spark, sf_dir):
    a = archive(spark, sf_dir)
    p = V.prior_in_vintage(a, V.first_release(a)).where("previous_value is not null")
    names = ["difference", "negative_difference", "log_difference", "level"]
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("transform"), V.apply_transform(F.col("value"), F.col("previous_value"), t).alias("value")) for t in names))).alias("x")
    return p.select("series_id", "reference_date", each).select("series_id", "reference_date", "x.transform", F.round("x.value", 4).alias("value"))


@query("SELECT l_orderkey, count(*) AS n, coalesce(count(*) FILTER (l_returnflag = 'R'), 0) AS returned, list_aggregate(list_sort(list(DISTINCT l_returnflag)), 'string_agg', ',') AS flags FROM lineitem GROUP BY l_orderkey")
def flag_maps(spark, sf_dir):
    """Counts by flag as a map per order, read back by key."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    m = c.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return m.select("l_orderkey", total.alias("n"), F.coalesce(F.try_element_at("m", F.lit("R")), F.lit(0)).cast("bigint").alias("returned"), F.array_join(F.sort_array(F.map_keys("m")), ",").alias("flags"))


# ------------------------------------------------------------------ calendars, composites and weekly events


@query(f"""WITH {ARCHIVE}, k AS (SELECT series_id, reference_date, CASE series_id WHEN 'N' THEN 'open' ELSE 'closed' END AS axis, max(release_date) OVER (PARTITION BY series_id ORDER BY reference_date) AS known FROM first)
SELECT reference_date, axis, CASE WHEN count(known) = max(CASE axis WHEN 'open' THEN 1 ELSE 2 END) THEN max(known) END AS available_at FROM k GROUP BY ALL""")
def axis_availability(spark, sf_dir):
    return V.axis_availability(V.first_release(archive(spark, sf_dir)), {"A": "closed", "R": "closed", "N": "open"})


@query(f"""WITH {ARCHIVE}, {SCORES}, m AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1999-12-01', INTERVAL 1 MONTH)) AS DATE) AS m),
t AS (SELECT m AS date, 'month_start' AS kind FROM m UNION ALL SELECT last_day(m), 'month_end' FROM m UNION ALL SELECT release_date, 'event' FROM first UNION ALL SELECT available_at, 'score' FROM scores)
SELECT date, list_aggregate(list_sort(list(DISTINCT kind)), 'string_agg', '+') AS kinds FROM t WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY date""")
def event_timeline(spark, sf_dir):
    day = lambda d: F.lit(d).cast("date")
    return V.timeline({"event": V.first_release(archive(spark, sf_dir)).select("release_date"), "score": scores(spark, sf_dir).select("available_at")}, day("1996-01-01"), day("1999-12-31"))


_HOW = {s: "log_difference" for s in GROWTH} | {s: "difference" for s in INFLATION[:2]} | {s: "negative_difference" for s in INFLATION[2:]}


@query(f"""WITH {PANEL}, l AS (SELECT *, CASE WHEN lag(month) OVER w = CAST(month - INTERVAL 1 MONTH AS DATE) THEN lag(value) OVER w END AS p FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY month)),
t AS (SELECT *, CASE WHEN series_id IN ('{"', '".join(GROWTH)}') THEN CASE WHEN value > 0 AND p > 0 THEN 100 * (ln(value) - ln(p)) END WHEN series_id IN ('{"', '".join(INFLATION[:2])}') THEN value - p ELSE p - value END AS x FROM l),
z AS (SELECT *, CASE WHEN count(x) OVER w >= 12 AND stddev_samp(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END AS z FROM t WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT month, CASE WHEN series_id IN ('{"', '".join(GROWTH)}') THEN 'growth' ELSE 'inflation' END AS axis, CASE WHEN count(z) = 4 THEN avg(z) END AS score FROM z GROUP BY ALL)
SELECT month, axis, round(score, 6) + 0 AS score, round(CASE WHEN count(score) OVER w = 3 THEN avg(score) OVER w END, 6) + 0 AS smoothed FROM s WINDOW w AS (PARTITION BY axis ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def composite_features(spark, sf_dir):
    from pit_engine.operators.windows import composite_features as build

    axes = {s: "growth" for s in GROWTH} | {s: "inflation" for s in INFLATION}
    out = build(panel(spark, sf_dir), "series_id", "month", "value", _HOW, axes, 12, 3)
    return out.select("month", "axis", (F.round("score", 6) + 0).alias("score"), (F.round("smoothed", 6) + 0).alias("smoothed"))


@query("""WITH wk AS (SELECT o_orderstatus AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS d, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS level FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
chained AS (SELECT * FROM wk QUALIFY count(*) OVER (PARTITION BY series_id) = date_diff('day', min(d) OVER (PARTITION BY series_id), max(d) OVER (PARTITION BY series_id)) / 7 + 1),
y AS (SELECT *, ln(level) AS y, lag(ln(level)) OVER (PARTITION BY series_id ORDER BY d) AS x FROM chained),
f AS (SELECT *, count(CASE WHEN x IS NOT NULL THEN 1 END) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM y WINDOW w AS (PARTITION BY series_id ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
e AS (SELECT *, CASE WHEN n >= 52 THEN y - (a + b * x) END AS innovation FROM f),
s AS (SELECT *, count(innovation) OVER w AS k, avg(innovation) OVER w AS m, stddev_samp(innovation) OVER w AS sd FROM e WINDOW w AS (PARTITION BY series_id ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT 'weekly|' || series_id || '|' || strftime(d, '%Y-%m-%d') || '|' || strftime(d + INTERVAL 11 DAY, '%Y-%m-%d') AS event_id, d AS reference_date, CAST(d + INTERVAL 11 DAY AS DATE) AS release_date, 11 AS release_lag_days, round(innovation, 5) + 0 AS transformed_value,
  CASE WHEN x IS NULL OR n < 52 THEN 'ar_warmup' WHEN b IS NULL THEN 'ar_unidentified' WHEN k < 26 THEN 'standardization_warmup' WHEN coalesce(sd, 0) <= 0 THEN 'standardization_unidentified' ELSE 'available' END AS feature_status,
  round(CASE WHEN k >= 26 AND sd > 0 AND n >= 52 THEN (innovation - m) / sd END, 4) + 0 AS feature_value FROM s""")
def weekly_release_events(spark, sf_dir):
    """Weekly levels without a gap as events of standardised AR(1) innovations."""
    from pyspark.sql import Window

    from pit_engine.operators.evidence import validate_events, weekly_events

    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_orderstatus").alias("series_id"), F.to_date(F.trunc("o_orderdate", "week")).alias("reference_date")).agg((F.sum(cents("o_totalprice")).cast("double") / 100).alias("level"))
    own = Window.partitionBy("series_id")
    whole = F.count("*").over(own) == F.datediff(F.max("reference_date").over(own), F.min("reference_date").over(own)) / 7 + 1
    levels = o.withColumn("_whole", whole).where("_whole").drop("_whole").withColumn("release_date", F.date_add("reference_date", 11))
    e = validate_events(weekly_events(levels, "weekly", "innovation", 52, 26))
    return e.select("event_id", "reference_date", "release_date", "release_lag_days", (F.round("transformed_value", 5) + 0).alias("transformed_value"), "feature_status", (F.round("feature_value", 4) + 0).alias("feature_value"))
