"""Queries of grouped fits, replays and allocation: beyond SQL, held against closed forms in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from pit_engine.operators import models as M
from pit_engine.operators import statistics as S
from pit_engine.plans import regimes as G
from pit_engine.plans.features import daily
from pit_engine.plans.inputs import ARCHIVE, scores, table
from pit_engine.plans.registry import query
from pit_engine.sources import charts


@query("""WITH x AS (SELECT vec_id, CAST(label AS BIGINT) AS label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL), c AS (SELECT vec_id, x.label, x.i, v - m AS v FROM x JOIN m ON m.label IS NOT DISTINCT FROM x.label AND m.i = x.i),
s AS (SELECT a.label, a.i, b.i AS j, count(*) AS n, avg(a.v * b.v) AS s, avg(a.v * a.v * b.v * b.v) AS q FROM c a JOIN c b ON b.vec_id = a.vec_id GROUP BY ALL),
h AS (SELECT label, any_value(n) AS n, sqrt(count(*)) AS p, sum(s) FILTER (i = j) AS tr, sum(s * s) AS norm, sum(q) AS q FROM s GROUP BY label), k AS (SELECT label, n, tr / p AS mu, (norm - tr * tr / p) / p AS delta, (q - norm) / (p * n) AS beta FROM h),
w AS (SELECT label, n, mu, CASE WHEN delta <= 0 THEN 0 ELSE least(beta, delta) / delta END AS shrinkage FROM k)
SELECT w.label, w.n, round(shrinkage, 6) AS shrinkage, list(round((1 - shrinkage) * s + CASE WHEN i = j THEN shrinkage * mu ELSE 0 END, 6) + 0 ORDER BY i, j) AS covariance FROM s JOIN w ON w.label IS NOT DISTINCT FROM s.label GROUP BY ALL""")
def ledoit_wolf_cov(spark, sf_dir):
    found = M.ledoit_wolf(table(spark, sf_dir, "embeddings").where("embedding is not null"), "label", "embedding")
    return found.withColumns({"shrinkage": F.round("shrinkage", 6), "covariance": F.transform("covariance", lambda x: F.round(x, 6) + 0)})


@query()
def gaussian_quadrants(spark, sf_dir):
    s = scores(spark, sf_dir).where("growth_score is not null and inflation_score is not null")
    return s.select("month", M.quadrant_masses("growth_score", "inflation_score", F.lit(0.25), F.lit(0.05), F.lit(0.36)).alias("masses"))


@query()
def transition_intervals(spark, sf_dir):
    from pyspark.sql import Window

    m = G.matrix(spark, sf_dir)
    a = F.col("n") + 0.5
    b = F.sum("n").over(Window.partitionBy("cutoff", "source")) + 2.0 - a
    m = m.withColumns({"_a": a.cast("double"), "_b": b.cast("double")})
    return m.select("cutoff", "source", "destination", F.round(M.beta_quantile(F.lit(0.025), "_a", "_b"), 9).alias("lower"), F.round(M.beta_quantile(F.lit(0.975), "_a", "_b"), 9).alias("upper"))


@query()
def robust_var(spark, sf_dir):
    return M.robust_var(G.var_input(spark, sf_dir), {"huber": 1.345, "student_t": 7.0})


def emission_rows(spark, sf_dir):
    d = daily(spark, sf_dir)
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("d")
    y = d.withColumns({"y": F.ln("level"), "x": F.lag(F.ln("level")).over(w), "dow": F.weekday("d").cast("double")})
    return y.withColumn("row_id", F.concat_ws("|", "series_id", F.col("d").cast("string")))


@query()
def emission_lambda(spark, sf_dir):
    s = M.rolling_origin_scores(emission_rows(spark, sf_dir), ["series_id"], "d", "y", ["x", "dow"], [0.0, 0.1, 1.0, 10.0], 10)
    return M.choose_lambda(s, ["series_id"])


@query()
def student_t_fit(spark, sf_dir):
    return M.student_t_emission(emission_rows(spark, sf_dir), ["series_id"], "y", ["x", "dow"], 1.0, 7.0)


def panel_emissions(spark, sf_dir):
    """Two responses of the monthly panel on the growth and inflation scores, with a calendar control."""
    s = scores(spark, sf_dir).where("growth_score is not null and inflation_score is not null")
    return s.select(F.lit("panel").alias("profile_id"), "month", F.col("z1").alias("r1"), F.col("z5").alias("r2"), "growth_score", "inflation_score", F.month("month").cast("double").alias("season"))


def panel_spec():
    """The first response doesn't load on inflation, the second not on growth."""
    from pit_engine.functions.emissions import EmissionSpec

    return EmissionSpec(("r1", "r2"), ("growth_score", "inflation_score"), ("season",), zero=((False, True), (True, False)), lambdas=(0.1, 1.0, 10.0))


@query()
def annual_tail_scores(spark, sf_dir):
    return M.annual_tail_scores(panel_emissions(spark, sf_dir), ["profile_id"], "month", panel_spec(), [None, 4.0, 7.0], 12)


@query()
def tuned_emissions(spark, sf_dir):
    return M.tuned_emissions(panel_emissions(spark, sf_dir), ["profile_id"], "month", panel_spec(), [None, 4.0, 7.0], 12)


@query()
def emission_residuals(spark, sf_dir):
    return M.rolling_origin_residuals(emission_rows(spark, sf_dir), ["series_id"], "d", "y", ["x", "dow"], [0.0, 1.0], 10)


@query()
def active_weights(spark, sf_dir):
    """Benchmark-relative weights of four limits, from the returns of all tickers."""
    import numpy as np
    import pandas as pd

    from pit_engine.functions import numerics as N
    from pit_engine.operators.windows import complete_case_returns
    from pit_engine.plans.inputs import TICKERS, prices

    r = complete_case_returns(prices(spark, sf_dir), "ticker", "date", "close", len(TICKERS))
    caps = F.explode(F.array(*(F.lit(x) for x in (0.01, 0.05, 0.2)))).alias("tracking_cap")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="ticker", values="ret").sort_index()
        cov, _ = N.ledoit_wolf(wide.to_numpy(float))
        n = wide.shape[1]
        even = np.full(n, 1.0 / n)
        w, status = N.active_allocate(wide.mean().to_numpy(), cov, even, even, np.full(n, 0.4), [], np.full(n, 0.0005), key[0], 0.05, 0.1, 10.0)
        return pd.DataFrame({"tracking_cap": key[0], "ticker": wide.columns, "target_weight": w, "status": status})

    return r.select("date", "ticker", "ret", caps).groupBy("tracking_cap").applyInPandas(run, "tracking_cap double, ticker string, target_weight double, status string")


PARAMETERS = {"start": 300, "b": [[0.6, 0.1], [0.0, 0.5]], "c": [0.0, 0.0], "q": [[0.3, 0.0], [0.0, 0.3]], "mean": [0.0, 0.0], "cov": [[1.0, 0.0], [0.0, 1.0]], "noise": [[0.5, 0.1], [0.1, 0.5]], "mapping": [[0.1, 0.0], [0.0, 0.1]]}


def filter_events(spark, sf_dir):
    """Early evidence on the 20th of the following month, the exact score a month later."""
    s = scores(spark, sf_dir).where("growth_score is not null and inflation_score is not null")
    month = M.months_since_1970(F.col("month")).cast("bigint")
    ev = s.select(F.date_add(F.add_months("month", 1), 19).alias("date"), F.lit("evidence").alias("kind"), F.concat(F.lit("e"), F.col("month").cast("string")).alias("event_id"), month.alias("month"), (F.col("growth_score") * 0.9).alias("y1"), (F.col("inflation_score") * 0.9).alias("y2"))
    ex = s.select(F.date_add(F.add_months("month", 2), 4).alias("date"), F.lit("exact").alias("kind"), F.concat(F.lit("x"), F.col("month").cast("string")).alias("event_id"), month.alias("month"), F.col("growth_score").alias("y1"), F.col("inflation_score").alias("y2"))
    return ev.unionByName(ex)


@query()
def kalman_replay(spark, sf_dir):
    return M.replay(filter_events(spark, sf_dir), {"gaussian": None, "student_t_7": 7.0, "transition_only": 0.0}, PARAMETERS)


def phased_records(spark, sf_dir):
    from pit_engine.functions.emissions import EmissionSpec
    from pit_engine.operators.phases import phased_filter as run
    from pit_engine.plans import walkforward as K

    seen, s = K.observed(spark, sf_dir), scores(spark, sf_dir).where("growth_score is not null and inflation_score is not null")
    names = ["f_A", "f_R", "f_N"]
    inputs = {
        "events": seen["live"].select("event_id", "release_date", "reference_month", *names),
        "training": seen["training"].select("reference_month", "training_available_at", *names, "growth_score", "inflation_score"),
        "scores": s.select("month", "growth_score", "inflation_score", "available_at"),
        "pairs": G.var_input(spark, sf_dir),
        "mappings": s.select("month", "available_at", F.lit(0.1).alias("gg"), F.lit(0.02).alias("gi"), F.lit(0.1).alias("ii")),
    }
    spec = EmissionSpec(("f_A", "f_R"), ("growth_score", "inflation_score"), ("f_N",))
    return run(inputs, spec, {"gaussian": (1.0, None), "student_t_7": (1.0, 7.0)}, "1998-01-01", "2000-06-30", 12, 8)


@query()
def phased_filter(spark, sf_dir):
    """All nine phases of two specifications: checkpoints, event and score audits, evaluations."""
    return phased_records(spark, sf_dir)


@query()
def decision_marginals(spark, sf_dir):
    from pit_engine.operators.phases import decision_marginals as decide

    weeks = spark.sql("SELECT explode(sequence(date'1998-01-05', date'2000-06-26', interval 7 days)) AS reference_week")
    return decide(phased_records(spark, sf_dir), weeks)


@query()
def discrete_replay(spark, sf_dir):
    """The discrete filter over the same months, with the quadrant as the confirmed regime a month later."""
    import numpy as np
    import pandas as pd

    from pit_engine.operators.filters import discrete_filter

    h = G.history(spark, sf_dir).where("regime_id is not null")
    rows = h.select("month", M.months_since_1970(F.col("month")).alias("m"), (G.G.regime_ord(F.col("regime_id")) - 1).alias("r"), F.lit("base").alias("specification"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m")
        a = np.full((4, 4), 0.5)
        for x, y in zip(pdf["r"], pdf["r"][1:], strict=False):
            a[x, y] += 1
        a /= a.sum(1, keepdims=True)
        days = [(m, int(n) + 2, [], [(int(n), int(r))]) for m, n, r in zip(pdf["month"], pdf["m"], pdf["r"], strict=True)]
        out = pd.DataFrame(discrete_filter(a, int(pdf["m"].iloc[0]) - 1, days))
        out.insert(0, "specification", key[0])
        return out

    return rows.groupBy("specification").applyInPandas(run, "specification string, date date, phase string, month bigint, p0 double, p1 double, p2 double, p3 double")


@query()
def optimizer_weights(spark, sf_dir):
    from pit_engine.operators.windows import complete_case_returns
    from pit_engine.plans.inputs import TICKERS, prices

    r = complete_case_returns(prices(spark, sf_dir), "ticker", "date", "close", len(TICKERS)).select(F.col("date").alias("period"), "ticker", "ret")
    return M.allocate_sequentially(r, {"kappa_0": 0.0, "kappa_60": 60.0}, 10, 0.4, 0.001, 0.5)


@query()
def serial_tests(spark, sf_dir):
    q = S.ljung_box(daily(spark, sf_dir), ["series_id"], "d", "level", 3)
    return q.withColumn("p_value", M.chi2_tail("q_statistic", F.lit(3.0)))


@query()
def cross_correlation_tests(spark, sf_dir):
    c = S.lagged_correlation(daily(spark, sf_dir), "series_id", "d", "level", [0, 1, 2], 10).withColumn("family", F.lit("all"))
    c = c.withColumn("p_value", M.correlation_p("correlation", F.col("n").cast("double"))).withColumn("test", F.concat_ws("|", "a", "b", "lag"))
    return S.benjamini_hochberg(c, ["family"], "p_value", "test").drop("family")


@query("SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY host")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT page_id, list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1), lambda x: x) AS links FROM pages")
def html_options(spark, sf_dir):
    """Values of repeated attributes in HTML, by one pattern, as vintage lists are read."""
    return table(spark, sf_dir, "pages").select("page_id", charts.attribute_values(F.col("html"), "a", "href").alias("links"))


@query(f"""WITH {ARCHIVE}, m AS (SELECT *, count(transformed_value) OVER w AS prior_n, avg(transformed_value) OVER w AS prior_mean, stddev_samp(transformed_value) OVER w AS prior_std FROM features WHERE status = 'available'
  WINDOW w AS (PARTITION BY series_id ORDER BY release_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
z AS (SELECT *, CASE WHEN prior_n < 12 THEN 'standardization_warmup' WHEN coalesce(prior_std, 0) <= 0 THEN 'standardization_unidentified' ELSE 'available' END AS feature_status FROM m)
SELECT 'shipments|' || series_id || '|' || strftime(reference_date, '%Y-%m-%d') || '|' || strftime(release_date, '%Y-%m-%d') AS event_id, 'shipments|' || strftime(release_date, '%Y-%m-%d') AS event_group_id, 'shipments' AS release_block, 'log_change' AS feature_name, series_id, reference_date, release_date,
  current_value, previous_value, round(transformed_value, 6) AS transformed_value, release_lag_days, prior_n, round(prior_mean, 6) AS prior_mean, round(prior_std, 6) AS prior_std, round(CASE WHEN feature_status = 'available' THEN (transformed_value - prior_mean) / prior_std END, 4) AS feature_value, feature_status FROM z""")
def canonical_events(spark, sf_dir):
    from pit_engine.plans.inputs import archive
    from pit_engine.plans.stages import build_evidence

    found = build_evidence(archive(spark, sf_dir), "shipments", "log_change", 12)["events"]
    return found.withColumns({c: F.round(c, 6) for c in ("transformed_value", "prior_mean", "prior_std")}).withColumn("feature_value", F.round("feature_value", 4))
