"""Queries of regimes, transitions, path probabilities and causal moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from pit_engine.operators import regimes as G
from pit_engine.operators import windows as W
from pit_engine.plans.inputs import SCORES, scores
from pit_engine.plans.registry import query

_GRID = "(VALUES ('UU'), ('DU'), ('UD'), ('DD'))"
_PAIRS = """pairs AS (SELECT month, regime_id AS source, nr AS destination, greatest(available_at, na) AS available_at FROM (
  SELECT *, lead(month) OVER w AS nm, lead(regime_id) OVER w AS nr, lead(available_at) OVER w AS na FROM regimes WINDOW w AS (ORDER BY month))
  WHERE nm = CAST(month + INTERVAL 1 MONTH AS DATE) AND regime_id IS NOT NULL AND nr IS NOT NULL)"""
_CUTS = "cuts AS (SELECT * FROM (VALUES (DATE '1998-01-01'), (DATE '2000-01-01'), (DATE '2002-01-01')) v(cutoff))"
_MATRIX = f"""{_PAIRS}, {_CUTS},
cells AS (SELECT cutoff, s.r AS source, d.r AS destination, (SELECT count(*) FROM pairs p WHERE p.source = s.r AND p.destination = d.r AND p.available_at <= cutoff) AS n FROM cuts, {_GRID} s(r), {_GRID} d(r)),
matrix AS (SELECT *, n / nullif(sum(n) OVER w, 0) AS mle, (n + 0.5::DOUBLE) / (sum(n) OVER w + 2.0::DOUBLE) AS p FROM cells WINDOW w AS (PARTITION BY cutoff, source)),
a AS (SELECT source, destination, p FROM matrix WHERE cutoff = DATE '2002-01-01'),
pi AS (SELECT r AS regime_id, (count(g.regime_id) + 1.0::DOUBLE) / (sum(count(g.regime_id)) OVER () + 4.0::DOUBLE) AS p FROM {_GRID} v(r) LEFT JOIN regimes g ON g.regime_id = r GROUP BY r),
path AS (SELECT pi.regime_id AS a, x.destination AS b, y.destination AS c, z.destination AS d, pi.p * x.p * y.p * z.p AS p FROM pi JOIN a x ON x.source = pi.regime_id JOIN a y ON y.source = x.destination JOIN a z ON z.source = y.destination)"""


def history(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.select("month", "growth_score", "inflation_score", G.quadrant(F.col("growth_score"), F.col("inflation_score")).alias("regime_id"), F.col("available_at").alias("label_available_at"))


def cutoffs(spark):
    return spark.sql("SELECT explode(array(date'1998-01-01', date'2000-01-01', date'2002-01-01')) AS cutoff")


def matrix(spark, sf_dir):
    return G.transition_matrix(G.transition_pairs(history(spark, sf_dir)), cutoffs(spark))


def latest(spark, sf_dir):
    return matrix(spark, sf_dir).where("cutoff = date'2002-01-01'").select("source", "destination", "p")


def marginal(spark, sf_dir):
    counts = history(spark, sf_dir).where("regime_id is not null").groupBy("regime_id").agg(F.count("*").alias("n"))
    grid = spark.sql("SELECT explode(array('UU', 'DU', 'UD', 'DD')) AS regime_id").join(counts, "regime_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    from pyspark.sql import Window

    return grid.select("regime_id", ((F.col("n") + 1.0) / (F.sum("n").over(Window.partitionBy()) + 4.0)).alias("p"))


def path(spark, sf_dir):
    return G.initial_path(marginal(spark, sf_dir), latest(spark, sf_dir))


@query(f"WITH {SCORES} SELECT month, regime_id, available_at AS label_available_at FROM regimes")
def quadrant_regimes(spark, sf_dir):
    return history(spark, sf_dir).select("month", "regime_id", "label_available_at")


@query(f"WITH {SCORES}, {_PAIRS} SELECT * FROM pairs")
def transition_pairs(spark, sf_dir):
    return G.transition_pairs(history(spark, sf_dir))


@query(f"WITH {SCORES}, {_MATRIX} SELECT cutoff, source, destination, n, round(mle, 6) AS mle, round(p, 6) AS p FROM matrix")
def expanding_transitions(spark, sf_dir):
    return matrix(spark, sf_dir).withColumns({"mle": F.round("mle", 6), "p": F.round("p", 6)})


@query(f"WITH {SCORES}, {_MATRIX} SELECT source, destination, round(p, 6) AS p FROM a")
def transition_matrix(spark, sf_dir):
    return latest(spark, sf_dir).withColumn("p", F.round("p", 6))


@query(f"WITH {SCORES}, {_MATRIX} SELECT destination AS regime_id, round(sum(pi.p * a.p), 6) AS p FROM pi JOIN a ON a.source = pi.regime_id GROUP BY destination")
def propagate_marginal(spark, sf_dir):
    return G.propagate(marginal(spark, sf_dir), latest(spark, sf_dir)).withColumn("p", F.round("p", 6))


@query(f"WITH {SCORES}, {_MATRIX} SELECT a, b, c, d, round(p, 8) AS p FROM path")
def path_init(spark, sf_dir):
    return path(spark, sf_dir).select("a", "b", "c", "d", F.round("p", 8).alias("p"))


@query(f"WITH {SCORES}, {_MATRIX} SELECT k.b AS a, k.c AS b, k.d AS c, a.destination AS d, round(k.p * a.p, 8) AS p FROM (SELECT b, c, d, sum(p) AS p FROM path GROUP BY ALL) k JOIN a ON a.source = k.d")
def path_shift(spark, sf_dir):
    return G.shift_path(path(spark, sf_dir), latest(spark, sf_dir)).withColumn("p", F.round("p", 8))


@query(f"WITH {SCORES}, {_MATRIX} SELECT 0 AS position, a AS regime_id, round(sum(p), 8) AS p FROM path GROUP BY a UNION ALL SELECT 1, b, round(sum(p), 8) FROM path GROUP BY b UNION ALL SELECT 2, c, round(sum(p), 8) FROM path GROUP BY c UNION ALL SELECT 3, d, round(sum(p), 8) FROM path GROUP BY d")
def path_marginals(spark, sf_dir):
    return G.path_marginals(path(spark, sf_dir)).withColumn("p", F.round("p", 8))


@query(f"WITH {SCORES}, {_MATRIX} SELECT a, b, c, d, round(p / sum(p) OVER (), 8) AS p FROM path WHERE a = 'UU' AND c = 'DD'")
def path_condition(spark, sf_dir):
    return G.condition_path(path(spark, sf_dir), {"a": "UU", "c": "DD"}).select("a", "b", "c", "d", F.round("p", 8).alias("p"))


_LIKE = "(VALUES ('UU', -0.5::DOUBLE), ('DU', -1.5::DOUBLE), ('UD', -2.0::DOUBLE), ('DD', -0.25::DOUBLE))"


@query(f"WITH {SCORES}, {_MATRIX}, w AS (SELECT path.*, p * exp(x.l + y.l) AS w FROM path JOIN {_LIKE} x(r, l) ON x.r = d JOIN {_LIKE} y(r, l) ON y.r = c) SELECT a, b, c, d, round(w / sum(w) OVER (), 8) AS p FROM w")
def path_bayes_update(spark, sf_dir):
    like = spark.sql("SELECT * FROM VALUES ('UU', -0.5D), ('DU', -1.5D), ('UD', -2.0D), ('DD', -0.25D) AS v(regime_id, loglik)")
    return G.bayes_update(path(spark, sf_dir), [("d", like), ("c", like)]).withColumn("p", F.round("p", 8))


@query(f"""WITH {SCORES}, {_MATRIX}, q AS (SELECT destination AS r, sum(pi.p * a.p) AS q FROM pi JOIN a ON a.source = pi.regime_id GROUP BY destination)
SELECT round(-sum(q * ln(q)), 8) AS entropy, round(sum(q * (ln(q) - ln(p))), 8) AS kl FROM q JOIN pi ON pi.regime_id = r""")
def entropy_kl(spark, sf_dir):
    m = marginal(spark, sf_dir)
    both = G.propagate(m, latest(spark, sf_dir)).withColumnRenamed("p", "q").join(m, "regime_id")
    return both.agg(F.round(G.entropy(F.col("q")), 8).alias("entropy"), F.round(G.kl(F.col("q"), F.col("p")), 8).alias("kl"))


@query(f"""WITH {SCORES} SELECT month, CASE WHEN regime_id IS NULL THEN 'missing_regime' WHEN z1 IS NULL OR z2 IS NULL THEN 'incomplete_vector' WHEN greatest(regimes.available_at, month) >= DATE '1999-06-15' THEN 'not_available_by_cutoff' ELSE 'included' END AS reason FROM regimes JOIN scores USING (month)""")
def causal_training_selection(spark, sf_dir):
    h = history(spark, sf_dir).join(scores(spark, sf_dir).select("month", "z1", "z2"), "month").withColumn("release_date", F.col("month"))
    return G.select_training(h, F.lit("1999-06-15").cast("date"), ["z1", "z2"]).select("month", "reason")


_VAR = f"""WITH {SCORES}, v AS (SELECT growth_score AS x1, inflation_score AS x2, lead(growth_score) OVER w AS y1, lead(inflation_score) OVER w AS y2, lead(month) OVER w AS nm, month FROM scores WINDOW w AS (ORDER BY month)),
u AS (SELECT * FROM v WHERE nm = CAST(month + INTERVAL 1 MONTH AS DATE) AND x1 + x2 + y1 + y2 IS NOT NULL)"""


def var_input(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("_all", F.lit(1))
    p = W.successor_pairs(s, ["_all"], "month", ["growth_score", "inflation_score"], "available_at").where("pair_status = 'valid'")
    return p.select("month", "pair_available_at", F.col("growth_score").alias("x1"), F.col("inflation_score").alias("x2"), F.col("next_growth_score").alias("y1"), F.col("next_inflation_score").alias("y2"))


@query(f"""{_VAR}, m AS (SELECT *, avg(x1) OVER () AS m1, avg(x2) OVER () AS m2, avg(y1) OVER () AS n1, avg(y2) OVER () AS n2 FROM u),
s AS (SELECT count(*) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(n1) AS n1, any_value(n2) AS n2, sum((x1-m1)*(x1-m1)) AS a, sum((x1-m1)*(x2-m2)) AS b, sum((x2-m2)*(x2-m2)) AS d,
  sum((x1-m1)*(y1-n1)) AS p1, sum((x2-m2)*(y1-n1)) AS q1, sum((x1-m1)*(y2-n2)) AS p2, sum((x2-m2)*(y2-n2)) AS q2, sum((y1-n1)*(y1-n1)) AS e11, sum((y1-n1)*(y2-n2)) AS e12, sum((y2-n2)*(y2-n2)) AS e22 FROM m),
c AS (SELECT *, (d*p1-b*q1)/(a*d-b*b) AS y1_x1, (a*q1-b*p1)/(a*d-b*b) AS y1_x2, (d*p2-b*q2)/(a*d-b*b) AS y2_x1, (a*q2-b*p2)/(a*d-b*b) AS y2_x2 FROM s)
SELECT n, round(n1-y1_x1*m1-y1_x2*m2, 6) AS y1_const, round(y1_x1, 6) AS y1_x1, round(y1_x2, 6) AS y1_x2, round(n2-y2_x1*m1-y2_x2*m2, 6) AS y2_const, round(y2_x1, 6) AS y2_x1, round(y2_x2, 6) AS y2_x2,
  round((e11-y1_x1*p1-y1_x2*q1)/(n-3), 6) AS q11, round((e12-y1_x1*p2-y1_x2*q2)/(n-3), 6) AS q12, round((e22-y2_x1*p2-y2_x2*q2)/(n-3), 6) AS q22 FROM c""")
def var1_ols(spark, sf_dir):
    v = G.var1_solution(G.var1_normal_equations(var_input(spark, sf_dir).withColumn("k", F.lit(1)), ["k"]), ["k"]).drop("k")
    return v.select("n", *(F.round(c, 6).alias(c) for c in v.columns if c != "n"))


_FIT = """m AS (SELECT *, avg(x1) OVER w AS m1, avg(x2) OVER w AS m2, avg(y1) OVER w AS n1, avg(y2) OVER w AS n2 FROM known WINDOW w AS (PARTITION BY target)),
s AS (SELECT target, count(*) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(n1) AS n1, any_value(n2) AS n2, sum((x1-m1)*(x1-m1)) AS a, sum((x1-m1)*(x2-m2)) AS b, sum((x2-m2)*(x2-m2)) AS d,
  sum((x1-m1)*(y1-n1)) AS p1, sum((x2-m2)*(y1-n1)) AS q1, sum((x1-m1)*(y2-n2)) AS p2, sum((x2-m2)*(y2-n2)) AS q2, sum((y1-n1)*(y1-n1)) AS e11, sum((y1-n1)*(y2-n2)) AS e12, sum((y2-n2)*(y2-n2)) AS e22 FROM m GROUP BY target),
c AS (SELECT *, (d*p1-b*q1)/(a*d-b*b) AS y1_x1, (a*q1-b*p1)/(a*d-b*b) AS y1_x2, (d*p2-b*q2)/(a*d-b*b) AS y2_x1, (a*q2-b*p2)/(a*d-b*b) AS y2_x2 FROM s WHERE n >= 24),
fit AS (SELECT target, n, n1-y1_x1*m1-y1_x2*m2 AS y1_const, y1_x1, y1_x2, n2-y2_x1*m1-y2_x2*m2 AS y2_const, y2_x1, y2_x2, (e11-y1_x1*p1-y1_x2*q1)/(n-3) AS q11, (e12-y1_x1*p2-y1_x2*q2)/(n-3) AS q12, (e22-y2_x1*p2-y2_x2*q2)/(n-3) AS q22 FROM c)"""
_HISTORY = f"""{_VAR}, t AS (SELECT month AS target, available_at AS cutoff FROM scores WHERE growth_score IS NOT NULL AND inflation_score IS NOT NULL),
known AS (SELECT target, u.* FROM t JOIN (SELECT u.*, CAST(nm + INTERVAL 1 MONTH + INTERVAL 14 DAY AS DATE) AS av FROM u) u ON nm <= target AND av <= cutoff), {_FIT}"""
_COEFFICIENTS = ["y1_const", "y1_x1", "y1_x2", "y2_const", "y2_x1", "y2_x2", "q11", "q12", "q22"]


def causal_fits(spark, sf_dir):
    t = scores(spark, sf_dir).where("growth_score is not null and inflation_score is not null").select("month", F.col("available_at").alias("cutoff"))
    return G.causal_var1(var_input(spark, sf_dir), t, 24)


@query(f"""{_HISTORY} SELECT s.target AS month, s.n, CASE WHEN s.n < 24 THEN 'insufficient_pairs' ELSE 'available' END AS status, {', '.join(f'round({c}, 6) AS {c}' for c in _COEFFICIENTS)} FROM s LEFT JOIN fit USING (target)""")
def causal_var_history(spark, sf_dir):
    """A VAR(1) for each month, fitted on the pairs that were known when its own score was."""
    return causal_fits(spark, sf_dir).select("month", "n", "status", *(F.round(c, 6).alias(c) for c in _COEFFICIENTS))


@query(f"""{_HISTORY} SELECT f.target AS month, round(y1_const + y1_x1 * growth_score + y1_x2 * inflation_score, 6) AS growth_mean, round(y2_const + y2_x1 * growth_score + y2_x2 * inflation_score, 6) AS inflation_mean,
round(q11, 6) AS growth_variance, round(q12, 6) AS covariance, round(q22, 6) AS inflation_variance, round(q11 + 0.1::DOUBLE, 6) AS readout_growth_variance, round(q12, 6) AS readout_covariance, round(q22 + 0.1::DOUBLE, 6) AS readout_inflation_variance FROM fit f JOIN scores ON month = f.target""")
def var_prior_next_month(spark, sf_dir):
    """Next month's prior from each exact score; the map's noise counts at readout only."""
    s = scores(spark, sf_dir).select("month", F.col("growth_score").alias("x1"), F.col("inflation_score").alias("x2"))
    p = G.propagate_var1(s.join(causal_fits(spark, sf_dir).where("status = 'available'"), "month"), 0.1, 0.0, 0.1)
    return p.select("month", *(F.round(c, 6).alias(c) for c in p.columns if c != "month"))


@query(f"""WITH {SCORES}, s AS (SELECT month, list_var_samp([z1, z2, z3, z4]) / 4 AS gv, list_var_samp([z5, z6, z7, z8]) / 4 AS iv, available_at FROM scores WHERE growth_score IS NOT NULL AND inflation_score IS NOT NULL),
e AS (SELECT month, h AS horizon, z1 - z2 AS ge, z5 - z6 AS ie, CAST(available_at + to_months(h) AS DATE) AS available_at FROM scores CROSS JOIN (VALUES (3), (12)) v(h) WHERE growth_score IS NOT NULL AND inflation_score IS NOT NULL),
d AS (SELECT t.month, count(*) AS n, avg(s.gv) AS gv, avg(s.iv) AS iv FROM s t JOIN s ON s.month < t.month AND s.available_at < t.available_at GROUP BY t.month),
r AS (SELECT t.month, e.horizon, count(*) AS n, var_samp(ge) AS ge, var_samp(ie) AS ie, covar_samp(ge, ie) AS gie FROM s t JOIN e ON e.month < t.month AND e.available_at < t.available_at GROUP BY ALL)
SELECT month, horizon, d.n AS n_disagreement, r.n AS n_revision, round(gv + ge, 6) AS growth_variance, round(gie, 6) AS growth_inflation_covariance, round(iv + ie, 6) AS inflation_variance FROM d JOIN r USING (month)""")
def mapping_covariance(spark, sf_dir):
    s = scores(spark, sf_dir).where("growth_score is not null and inflation_score is not null")
    own = s.select("month", W.jackknife_variance([F.col(f"z{k}") for k in range(1, 5)]).alias("gv"), W.jackknife_variance([F.col(f"z{k}") for k in range(5, 9)]).alias("iv"), "available_at")
    e = s.select("month", F.explode(F.array(F.lit(3), F.lit(12))).alias("horizon"), (F.col("z1") - F.col("z2")).alias("ge"), (F.col("z5") - F.col("z6")).alias("ie"), "available_at").withColumn("available_at", F.expr("add_months(available_at, horizon)"))
    m = G.mapping_covariance(own, e, own.select("month", F.col("available_at").alias("cutoff")))
    return m.select("month", "horizon", "n_disagreement", "n_revision", *(F.round(c, 6).alias(c) for c in ("growth_variance", "growth_inflation_covariance", "inflation_variance")))


@query(f"""WITH {SCORES}, a AS (SELECT month, growth_score, available_at FROM scores WHERE growth_score IS NOT NULL), t AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)
SELECT d, a.month AS map_month, round(a.growth_score, 6) AS growth_score FROM (SELECT CAST(d - INTERVAL 26 YEAR - INTERVAL 4 MONTH + CAST(to_days(CAST(30 * day(d) AS INTEGER)) AS INTERVAL) AS DATE) AS d FROM t) ASOF LEFT JOIN a ON d > a.available_at""")
def mapping_asof(spark, sf_dir):
    """The newest map known strictly before each date."""
    from pit_engine.operators.asof import asof_join
    from pit_engine.plans.inputs import table

    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("t")).distinct().select(F.date_add(F.add_months("t", -316), F.day("t") * 30).alias("d"), F.lit(1).alias("k"))
    m = scores(spark, sf_dir).where("growth_score is not null").select(F.lit(1).alias("k"), F.col("month").alias("map_month"), "growth_score", "available_at")
    return asof_join(d, m, ["k"], "d", "available_at", ["map_month", "growth_score"], ties=["map_month"]).select("d", "map_month", F.round("growth_score", 6).alias("growth_score"))
