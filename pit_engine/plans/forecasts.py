"""Queries of forecast targets, shared evaluation, residual chains, coverage and attribution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pit_engine.operators import forecasts as O
from pit_engine.operators import statistics as S
from pit_engine.plans.inputs import GROWTH, INFLATION, PANEL, SCORES, panel, scores, table
from pit_engine.plans.regimes import history
from pit_engine.plans.registry import query
from pit_engine.plans.statistics import _B, _EVAL, _NB, errors

CLASSES = ["UU", "DU", "UD", "DD"]


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


#: Forecasts in closed form of the month, at two checkpoints; some rows are improper on purpose.
_FORECASTS = """w AS (SELECT month, spec AS specification_id, cp AS checkpoint_type, CAST(month + to_months(CASE cp WHEN 'post_roll' THEN 0 ELSE 2 END) + INTERVAL 10 DAY AS DATE) AS checkpoint_date,
  1.0::DOUBLE + CASE spec WHEN 'evidence' THEN month(month) % 5 ELSE month(month) % 2 END AS a, 1.0::DOUBLE + month(month) % 3 AS b, 1.0::DOUBLE + year(month) % 2 AS c, 1.0::DOUBLE AS d, CASE WHEN spec = 'evidence' AND month(month) = 11 THEN 0.5::DOUBLE ELSE 0 END AS extra
  FROM scores CROSS JOIN (VALUES ('transition_only'), ('evidence')) s(spec) CROSS JOIN (VALUES ('post_roll'), ('late')) p(cp) WHERE NOT (spec = 'transition_only' AND month(month) = 4)),
fc AS (SELECT specification_id, checkpoint_type, checkpoint_date, month AS target_month, a/(a+b+c+d) + extra AS "UU", b/(a+b+c+d) AS "DU", c/(a+b+c+d) AS "UD", d/(a+b+c+d) AS "DD" FROM w),
att AS (SELECT fc.*, regime_id AS realized, available_at AS label_available_at, CASE WHEN regime_id IS NULL THEN 'unclassified_target' WHEN target_month < DATE '1997-01-01' THEN 'before_evaluation_start' WHEN NOT coalesce(checkpoint_date < available_at, false) THEN 'not_strictly_pre_confirmation'
  WHEN abs("UU" + "DU" + "UD" + "DD" - 1) > 1e-8 + 1e-5 THEN 'invalid_probabilities' ELSE 'eligible' END AS evaluation_status FROM fc LEFT JOIN regimes ON month = target_month)"""


def attached(spark, sf_dir):
    m = scores(spark, sf_dir).select("month", F.explode(F.array(F.lit("transition_only"), F.lit("evidence"))).alias("specification_id"))
    m = m.select("*", F.explode(F.array(F.lit("post_roll"), F.lit("late"))).alias("checkpoint_type")).where("not (specification_id = 'transition_only' and month(month) = 4)")
    w = [1.0 + F.when(F.col("specification_id") == "evidence", F.month("month") % 5).otherwise(F.month("month") % 2), 1.0 + F.month("month") % 3, 1.0 + F.year("month") % 2, F.lit(1.0)]
    total = w[0] + w[1] + w[2] + w[3]
    extra = F.when((F.col("specification_id") == "evidence") & (F.month("month") == 11), 0.5).otherwise(0.0)
    date = F.date_add(F.expr("add_months(month, if(checkpoint_type = 'post_roll', 0, 2))"), 10)
    f = m.select("specification_id", "checkpoint_type", date.alias("checkpoint_date"), F.col("month").alias("target_month"), *((x / total + (extra if c == "UU" else 0.0)).alias(c) for c, x in zip(CLASSES, w, strict=True)))
    return O.attach_targets(f, history(spark, sf_dir), CLASSES, F.lit("1997-01-01").cast("date"))


@query(f"WITH {SCORES}, {_FORECASTS} SELECT specification_id, checkpoint_type, checkpoint_date, target_month, realized, label_available_at, evaluation_status FROM att")
def forecast_targets(spark, sf_dir):
    return attached(spark, sf_dir).select("specification_id", "checkpoint_type", "checkpoint_date", "target_month", "realized", "label_available_at", "evaluation_status")


@query(f"""WITH {SCORES}, {_FORECASTS}, e AS (SELECT *, -ln(CASE realized WHEN 'UU' THEN "UU" WHEN 'DU' THEN "DU" WHEN 'UD' THEN "UD" ELSE "DD" END) AS loss,
  pow("UU" - CAST(realized = 'UU' AS INT), 2) + pow("DU" - CAST(realized = 'DU' AS INT), 2) + pow("UD" - CAST(realized = 'UD' AS INT), 2) + pow("DD" - CAST(realized = 'DD' AS INT), 2) AS brier FROM att WHERE evaluation_status = 'eligible')
SELECT x.specification_id, x.checkpoint_type, count(*) AS n, round(avg(x.loss), 6) AS log_loss, round(avg(x.brier), 6) AS brier, round(avg(b.loss), 6) AS baseline_log_loss, round(avg(b.brier), 6) AS baseline_brier, round(avg(x.loss) - avg(b.loss), 6) + 0 AS log_loss_difference,
  round(1 - avg(x.brier) / avg(b.brier), 6) + 0 AS brier_skill FROM e x JOIN e b ON b.specification_id = 'transition_only' AND b.checkpoint_type = x.checkpoint_type AND b.target_month = x.target_month GROUP BY ALL""")
def shared_evaluation(spark, sf_dir):
    m = O.shared_evaluation(attached(spark, sf_dir), CLASSES, ["checkpoint_type", "target_month"], ["checkpoint_type"], "transition_only")
    out = _r(m, "log_loss", "brier", "baseline_log_loss", "baseline_brier", "log_loss_difference", "brier_skill")
    return out.withColumns({c: F.col(c) + 0 for c in ("log_loss_difference", "brier_skill")})


# ------------------------------------------------------------------ residual chains

_RESIDUALS = f"""{_EVAL}, wk AS (SELECT 'web' AS block_id, 'events' AS model_id, event_type AS response_id, CAST(date_trunc('month', ts) AS DATE) AS reference_month, CAST(CAST(ts AS DATE) + INTERVAL 3 DAY AS DATE) AS available_at, CAST(ts AS DATE) AS observation_date, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 5000 - 1 AS residual FROM events GROUP BY ALL),
res AS (SELECT * FROM wk UNION ALL SELECT 'orders', 'panel', series_id, month, CAST(month + INTERVAL 40 DAY AS DATE), month, error FROM e WHERE error IS NOT NULL)"""


def residuals(spark, sf_dir):
    ev = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg((F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double") / F.count("*") / 5000 - 1).alias("residual"))
    weekly = ev.select(F.lit(" web ").alias("block_id"), F.lit("events").alias("model_id"), F.col("event_type").alias("response_id"), F.col("d").alias("reference_date"), F.date_add("d", 3).alias("available_at"), F.col("d").alias("observation_date"), "residual")
    e = errors(spark, sf_dir).where("error is not null")
    monthly = e.select(F.lit("orders").alias("block_id"), F.lit("panel").alias("model_id"), F.col("series_id").alias("response_id"), F.col("month").alias("reference_date"), F.date_add("month", 40).alias("available_at"), F.col("month").alias("observation_date"), F.col("error").alias("residual"))
    return weekly.unionByName(monthly)


_WEEKLY = ["CLICK", "error", "purchase", "signup", "view"]


@query(f"WITH {_RESIDUALS} SELECT block_id, model_id, response_id, reference_month, available_at, observation_date, round(residual, 6) AS residual FROM res")
def residual_rows(spark, sf_dir):
    return _r(O.normalize_residuals(residuals(spark, sf_dir)), "residual")


@query(f"WITH {_RESIDUALS} SELECT block_id, model_id, response_id, reference_month, round(avg(residual), 6) AS residual, max(available_at) AS available_at, count(*) AS source_rows, CASE model_id WHEN 'events' THEN 'weekly_aggregated' ELSE 'monthly' END AS source_frequency FROM res GROUP BY ALL")
def monthly_residuals(spark, sf_dir):
    return _r(O.monthly_residuals(residuals(spark, sf_dir), _WEEKLY), "residual")


@query(f"""WITH {_RESIDUALS}, b AS (SELECT available_at, x.residual AS x, y.residual AS y FROM (SELECT * FROM wk WHERE response_id = 'click') x JOIN (SELECT * FROM wk WHERE response_id = 'view') y USING (available_at)),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM b)
SELECT s AS statistic, round(CASE s WHEN 'pearson' THEN (SELECT corr(x, y) FROM r) ELSE (SELECT corr(rx, ry) FROM r) END, 6) AS correlation, (SELECT count(*) FROM r) AS n, (SELECT min(available_at) FROM r) AS first_date, (SELECT max(available_at) FROM r) AS last_date, 'ok' AS status FROM (VALUES ('pearson'), ('spearman')) v(s)""")
def same_publication_dependence(spark, sf_dir):
    return _r(O.same_publication(residuals(spark, sf_dir), ("events", "click"), ("events", "view")), "correlation")


_FOLDS = f"""{_EVAL}, folds AS (SELECT series_id AS profile_id, lam AS base_lambda, nu AS degrees_of_freedom, year(month) AS year, CASE WHEN count(error) >= 12 THEN 'scored' ELSE 'warmup' END AS status, count(error) AS n, sum(lam * abs(error) + (nu + 1) / 2 * ln(1 + error * error / nu)) AS total_nll
  FROM e CROSS JOIN (VALUES (0.01::DOUBLE), (0.1::DOUBLE)) a(lam) CROSS JOIN (VALUES (4.0::DOUBLE), (7.0::DOUBLE)) b(nu) GROUP BY ALL)"""


@query(f"""WITH {_FOLDS}, g AS (SELECT profile_id, base_lambda, degrees_of_freedom, count(DISTINCT year) AS folds, sum(n) AS observations, sum(total_nll) / sum(n) AS mean_nll FROM folds WHERE status = 'scored' GROUP BY ALL),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY profile_id, degrees_of_freedom ORDER BY mean_nll, base_lambda DESC) = 1), p AS (SELECT p AS profile_id, nu AS degrees_of_freedom FROM (VALUES ('F'), ('O'), ('none')) v(p) CROSS JOIN (VALUES (4.0::DOUBLE), (7.0::DOUBLE)) b(nu))
SELECT profile_id, degrees_of_freedom, base_lambda, coalesce(folds, 0) AS folds, CAST(coalesce(observations, 0) AS BIGINT) AS observations, round(mean_nll, 6) AS mean_nll, coalesce(abs(mean_nll - min(mean_nll) OVER (PARTITION BY profile_id)) <= 1e-8 + 1e-5 * abs(min(mean_nll) OVER (PARTITION BY profile_id)), false) AS best_tail,
  CASE WHEN mean_nll IS NULL THEN 'insufficient_history' ELSE 'evaluated' END AS status FROM p LEFT JOIN b USING (profile_id, degrees_of_freedom)""")
def tail_summary(spark, sf_dir):
    e = errors(spark, sf_dir)
    rows = e.select("*", F.explode(F.array(F.lit(0.01), F.lit(0.1))).alias("lam")).select("*", F.explode(F.array(F.lit(4.0), F.lit(7.0))).alias("nu"))
    nll = F.col("lam") * F.abs("error") + (F.col("nu") + 1) / 2 * F.ln(1 + F.col("error") * F.col("error") / F.col("nu"))
    f = rows.groupBy(F.col("series_id").alias("profile_id"), F.col("lam").alias("base_lambda"), F.col("nu").alias("degrees_of_freedom"), F.year("month").alias("year")).agg(F.count("error").alias("n"), F.sum(nll).alias("total_nll"))
    f = f.withColumn("status", F.when(F.col("n") >= 12, "scored").otherwise("warmup"))
    return _r(O.tail_summary(f, ["F", "O", "none"], [4.0, 7.0]), "mean_nll")


# ------------------------------------------------------------------ coverage and attribution

_GROUP = ", ".join(f"('{s}', '{b}')" for b, names in (("activity", GROWTH), ("prices", INFLATION)) for s in names)
_AUDIT = f"""{_EVAL}, block AS (SELECT * FROM (VALUES {_GROUP}) v(series_id, block_id)), audit AS (SELECT variant AS variant_id, e.series_id AS observation_model_id, block_id, month AS reference_month, CAST(month + INTERVAL 40 DAY AS DATE) AS release_date,
  CASE month(month) % 5 WHEN 0 THEN 'fit_error:singular' WHEN 1 THEN 'target_exact_predictive_only' WHEN 2 THEN NULL ELSE 'applied' END AS update_status, CASE variant WHEN 'base' THEN 1 ELSE 1 / (1 + error * error) END AS event_weight FROM e JOIN block USING (series_id) CROSS JOIN (VALUES ('base'), ('robust')) v(variant))"""
_COVERAGE = """count(*) AS audit_rows, count(*) FILTER (update_status = 'applied') AS applied_updates, count(DISTINCT reference_month) FILTER (update_status = 'applied') AS active_reference_months, count(*) FILTER (update_status LIKE 'fit_error:%') AS fit_error_rows, count(*) FILTER (update_status = 'target_exact_predictive_only') AS target_exact_rows,
  count(*) FILTER (update_status IS NULL) AS other_rows, min(release_date) FILTER (update_status = 'applied') AS first_applied_release, max(release_date) FILTER (update_status = 'applied') AS last_applied_release, round(median(event_weight) FILTER (update_status = 'applied'), 6) AS median_event_weight"""


def audit(spark, sf_dir):
    block = F.when(F.col("series_id").isin(GROWTH), "activity").otherwise("prices")
    status = F.when(F.month("month") % 5 == 0, "fit_error:singular").when(F.month("month") % 5 == 1, "target_exact_predictive_only").when(F.month("month") % 5 != 2, "applied")
    e = errors(spark, sf_dir).select("*", F.explode(F.array(F.lit("base"), F.lit("robust"))).alias("variant_id"))
    weight = F.when(F.col("variant_id") == "base", 1.0).otherwise(1 / (1 + F.col("error") * F.col("error")))
    return e.select("variant_id", F.col("series_id").alias("observation_model_id"), block.alias("block_id"), F.col("month").alias("reference_month"), F.date_add("month", 40).alias("release_date"), status.alias("update_status"), weight.alias("event_weight"))


@query(f"WITH {_AUDIT} SELECT variant_id, observation_model_id, {_COVERAGE} FROM audit GROUP BY ALL")
def profile_coverage(spark, sf_dir):
    return _r(O.update_coverage(audit(spark, sf_dir), ["variant_id", "observation_model_id"]), "median_event_weight")


@query(f"WITH {_AUDIT} SELECT block_id, {_COVERAGE} FROM audit WHERE variant_id = 'base' GROUP BY ALL")
def block_coverage(spark, sf_dir):
    return _r(O.update_coverage(audit(spark, sf_dir).where("variant_id = 'base'"), ["block_id"]), "median_event_weight")


_D = f"""{_AUDIT}, d0 AS (SELECT block_id, arm, metric, month, avg(CASE metric WHEN 'log_loss' THEN error ELSE error * error - 0.01::DOUBLE END * CASE arm WHEN 'add_one' THEN 1 ELSE -0.5::DOUBLE END) AS d FROM e JOIN block USING (series_id) CROSS JOIN (VALUES ('add_one'), ('leave_one_out')) a(arm) CROSS JOIN (VALUES ('log_loss'), ('brier')) b(metric) WHERE error IS NOT NULL GROUP BY ALL),
d AS (SELECT block_id, arm, metric, d, row_number() OVER (PARTITION BY block_id, arm, metric ORDER BY month) - 1 AS position FROM d0)"""
_STARTS_BY = f"""g AS (SELECT block_id, arm, metric, count(*) AS n FROM d GROUP BY ALL),
st AS (SELECT block_id, arm, metric, n, r AS resample, k, CAST(floor(((x * x) % {S.MODULUS} * {S.MULTIPLIERS[1]} % {S.MODULUS}) * n / {S.MODULUS}::DOUBLE) AS BIGINT) AS start FROM (
  SELECT *, (1 + 7919 * r + 104729 * k) % {S.MODULUS} * {S.MULTIPLIERS[0]} % {S.MODULUS} AS x FROM g, range({_NB}) a(r), range(1000) b(k) WHERE k * {_B} < n)),
m AS (SELECT st.block_id, st.arm, st.metric, resample, avg(d) AS m FROM st, range({_B}) r(j) JOIN d ON d.block_id = st.block_id AND d.arm = st.arm AND d.metric = st.metric AND d.position = (start + j) % n WHERE k * {_B} + j < n GROUP BY ALL),
inf AS (SELECT block_id, arm, metric, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper, avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share_positive FROM m GROUP BY ALL),
cmp AS (SELECT block_id, arm, metric, count(*) AS n, avg(d) AS benefit, stddev_samp(d) AS s FROM d GROUP BY ALL)"""


def benefits(spark, sf_dir):
    block = F.when(F.col("series_id").isin(GROWTH), "activity").otherwise("prices")
    e = errors(spark, sf_dir).where("error is not null").select(block.alias("block_id"), "month", "error", F.explode(F.array(F.lit("add_one"), F.lit("leave_one_out"))).alias("arm")).select("*", F.explode(F.array(F.lit("log_loss"), F.lit("brier"))).alias("metric"))
    value = F.when(F.col("metric") == "log_loss", F.col("error")).otherwise(F.col("error") * F.col("error") - 0.01) * F.when(F.col("arm") == "add_one", 1.0).otherwise(-0.5)
    d = e.groupBy("block_id", "arm", "metric", "month").agg(F.avg(value).alias("d"))
    w = Window.partitionBy("block_id", "arm", "metric").orderBy("month")
    return d.select("block_id", "arm", "metric", "d", (F.row_number().over(w) - 1).cast("bigint").alias("position"))


_KEYS = ["block_id", "arm", "metric"]


@query(f"WITH {_D}, {_STARTS_BY} SELECT block_id, arm, metric, n, round(benefit, 6) + 0 AS mean_difference, round(benefit / s * sqrt(n), 4) + 0 AS naive_t, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper, round(share_positive, 6) AS share_positive FROM cmp JOIN inf USING (block_id, arm, metric)")
def attribution_bootstrap(spark, sf_dir):
    out = S.paired_inference(benefits(spark, sf_dir), _KEYS, _NB, _B, 12.0).drop("information_ratio")
    out = _r(_r(out, "mean_difference", "ci_lower", "ci_upper", "share_positive"), "naive_t", digits=4)
    return out.withColumns({c: F.col(c) + 0 for c in ("mean_difference", "naive_t")})


def _cells(arms, metrics):
    pick = lambda a, m, c: f"round(max({c}) FILTER (arm = '{a}' AND metric = '{m}'), 6)"
    return ", ".join(f"{pick(a, m, c)} + 0 AS {a}_{x}_{m}" for a in arms for m in metrics for c, x in (("benefit", "benefit"), ("share_positive", "probability_beneficial")))


@query(f"WITH {_D}, {_STARTS_BY}, cov AS (SELECT block_id, {_COVERAGE} FROM audit WHERE variant_id = 'base' GROUP BY ALL), wide AS (SELECT block_id, {_cells(['add_one', 'leave_one_out'], ['log_loss', 'brier'])} FROM cmp JOIN inf USING (block_id, arm, metric) GROUP BY block_id) SELECT * FROM wide JOIN cov USING (block_id)")
def attribution_summary(spark, sf_dir):
    i = S.paired_inference(benefits(spark, sf_dir), _KEYS, _NB, _B, 12.0)
    coverage = O.update_coverage(audit(spark, sf_dir).where("variant_id = 'base'"), ["block_id"])
    out = O.attribution_summary(i.select(*_KEYS, F.col("mean_difference").alias("benefit")), i, coverage, ["add_one", "leave_one_out"], ["log_loss", "brier"])
    cells = [c for c in out.columns if "benefi" in c]
    return _r(out, *cells, "median_event_weight").withColumns({c: F.round(c, 6) + 0 for c in cells})
