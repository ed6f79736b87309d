"""Ledger reasons, causality with uneven lags, coverage of samples, and what makes a query fail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

D = dt.date


def test_every_ledger_reason_in_its_order(spark):
    from pit_engine.operators.ledger import REASONS, feature_ledger

    v0, v1, v2 = D(2000, 4, 10), D(2000, 6, 10), D(2001, 3, 10)
    rows = [("s", D(2000, m, 1), v0, str(100 + m)) for m in (1, 2, 3)]
    rows += [("s", D(2000, m, 1), v1, x) for m, x in ((1, "101"), (2, "102"), (3, "103"), (4, "104"), (5, "bad"), (6, "106"))]
    rows += [("s", D(2000, m, 1), v2, x) for m, x in ((7, "107"), (8, None), (9, "-1"), (10, "110"), (11, "nan"), (12, "112"))]
    rows += [("s", D(2001, 1, 1), v2, "113"), ("s", D(2001, 2, 1), v2, "114"), ("s", D(2001, 4, 1), v2, "115")]
    a = spark.createDataFrame(rows, "series_id string, reference_date date, vintage_date date, value string")
    got = {(r.reference_date.year, r.reference_date.month): r for r in feature_ledger(a, "1999-12-01", "2001-06-01", F.lit("2001-05-15 12:00:00").cast("timestamp"), max_release_lag_days=90, active_start="2000-01-01").collect()}
    reason = {k: r.reason for k, r in got.items()}
    assert reason[1999, 12] == "outside_active_support" and reason[2001, 6] == "future_reference" and reason[2001, 5] == "absent_reference"
    assert reason[2000, 1] == reason[2000, 2] == "archive_bootstrap" and reason[2000, 3] == "retained"
    assert reason[2000, 4] == "retained" and reason[2000, 5] == "invalid_current_value" and reason[2000, 6] == "negative_release_lag"
    assert reason[2000, 7] == "excessive_release_lag" and reason[2000, 8] == "unavailable_by_asof" and reason[2000, 11] == "invalid_current_value"
    assert reason[2000, 12] == "invalid_prior_value" and reason[2001, 1] == reason[2001, 2] == "retained" and reason[2001, 4] == "negative_release_lag"
    assert set(reason.values()) <= set(REASONS)
    assert got[2001, 1].previous_value == 112 and got[2000, 4].archive_vintage_date == v1
    # What was not yet visible leaves no trace.
    early = feature_ledger(a, "2000-01-01", "2000-04-01", F.lit("2000-04-10 12:00:00").cast("timestamp")).collect()
    assert {r.reason for r in early} == {"unavailable_by_asof"} and all(r.current_value is None for r in early)


def test_missing_prior_reasons(spark):
    from pit_engine.operators.ledger import feature_ledger

    v = D(2000, 6, 10)
    rows = [("s", D(2000, 1, 1), D(2000, 2, 1), "1"), ("s", D(2000, 3, 1), v, "3"), ("s", D(2000, 4, 1), v, None), ("s", D(2000, 5, 1), v, "5")]
    a = spark.createDataFrame(rows, "series_id string, reference_date date, vintage_date date, value string")
    got = {r.reference_date.month: r.reason for r in feature_ledger(a, "2000-03-01", "2000-05-01", F.lit("2001-01-01").cast("timestamp"), max_release_lag_days=100).collect()}
    assert got == {3: "missing_prior_reference", 4: "unavailable_by_asof", 5: "missing_prior_value"}


def test_a_late_pair_never_enters_an_earlier_fit(spark):
    from pit_engine.operators.regimes import causal_var1

    months = [D(2000 + k // 12, k % 12 + 1, 1) for k in range(12)]
    # The fourth pair was published a year late.
    pairs = [(m, float(k % 5), float(k % 3), float(k % 4), float(k % 7), D(m.year + 1, m.month, 1) if k == 3 else D(m.year, m.month, 28)) for k, m in enumerate(months)]
    p = spark.createDataFrame(pairs, "month date, x1 double, x2 double, y1 double, y2 double, pair_available_at date")
    t = spark.createDataFrame([(D(2000, 9, 1), D(2000, 10, 5)), (D(2001, 9, 1), D(2001, 10, 5))], "month date, cutoff date")
    n = {r.month: (r.n, r.status) for r in causal_var1(p, t, 8).collect()}
    assert n == {D(2000, 9, 1): (7, "insufficient_pairs"), D(2001, 9, 1): (12, "available")}


def test_sliced_as_of_join_equals_a_loop(spark):
    import random

    from pit_engine.operators.asof import asof_join

    rng = random.Random(5)
    day = lambda: D(2000, 1, 1) + dt.timedelta(rng.randrange(400))
    left = [(rng.choice("ab"), day(), i) for i in range(300)]
    right = [(rng.choice("ab"), day(), i, None if i % 9 == 0 else i) for i in range(120)]
    l = spark.createDataFrame(left, "k string, t date, i int")
    r = spark.createDataFrame(right, "k string, u date, j int, v int")
    for strict in (True, False):
        for days in (1, 7, 32, 5000):
            got = {x.i: (x.j, x.v) for x in asof_join(l, r, ["k"], "t", "u", ["j", "v"], strict, ["j"], slice_days=days).collect()}
            for k, t, i in left:
                ok = [(u, j, v) for q, u, j, v in right if q == k and (u < t if strict else u <= t)]
                assert got[i] == (max(ok, key=lambda z: z[:2])[1:] if ok else (None, None)), (strict, days, i)


def test_a_residual_without_a_name_is_an_error(spark):
    from pit_engine.operators.forecasts import monthly_residuals, normalize_residuals

    rows = [("b", "m", "r", D(2000, 1, 5), D(2000, 2, 1), D(2000, 1, 5), 1.0), ("b", "m", "r", D(2000, 1, 9), D(2000, 2, 2), D(2000, 1, 9), 2.0)]
    schema = "block_id string, model_id string, response_id string, reference_date date, available_at date, observation_date date, residual double"
    df = spark.createDataFrame(rows, schema)
    assert [(r.residual, r.source_rows) for r in monthly_residuals(df, ["R"]).collect()] == [(1.5, 2)]
    with pytest.raises(Exception, match="two residuals"):
        monthly_residuals(df, []).collect()
    for bad in (df.withColumn("model_id", F.lit(" ")), df.withColumn("residual", F.lit(float("nan"))), df.withColumn("available_at", F.lit(None).cast("date"))):
        with pytest.raises(Exception, match="missing name"):
            normalize_residuals(bad).collect()


def test_an_improper_signal_is_an_error(spark):
    from pit_engine.operators.weekly import select_signals

    schema = "variant_id string, signal_date date, reference_month date, p_uu double, p_du double, p_ud double, p_dd double"
    weeks = spark.createDataFrame([(D(2000, 1, 10),), (D(2000, 1, 17),)], "reference_week date")
    good = [("b", D(2000, 1, 5), D(1999, 12, 1), 1.0, 0.0, 0.0, 0.0), ("b", D(2000, 1, 5), D(2000, 1, 1), 0.0, 1.0, 0.0, 0.0), ("b", D(2000, 1, 12), D(2000, 1, 1), 0.0, 0.0, 1.0, 0.0), ("x", D(2000, 1, 6), D(2000, 1, 1), 9.0, 0.0, 0.0, 0.0)]
    got = sorted((r.reference_week, r.signal_date, r.p_du) for r in select_signals(spark.createDataFrame(good, schema), weeks, "b").collect())
    assert got == [(D(2000, 1, 10), D(2000, 1, 5), 1.0), (D(2000, 1, 17), D(2000, 1, 12), 0.0)]
    for bad in (("b", D(2000, 1, 7), D(2000, 1, 1), 0.5, 0.0, 0.0, 0.0), ("b", D(2000, 1, 7), D(2000, 2, 1), 1.0, 0.0, 0.0, 0.0), good[0]):
        with pytest.raises(Exception, match="improper"):
            select_signals(spark.createDataFrame([*good, bad], schema), weeks, "b").collect()


def test_block_likelihood_of_three_features_against_numpy(spark):
    import math

    import numpy as np

    from pit_engine.functions.emissions import uncentred_ledoit_wolf
    from pit_engine.operators.walkforward import block_likelihood, log_likelihoods

    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(90, 3)) * [1, 2, 0.5], rng.integers(0, 3, 90)
    names = ["UU", "DU", "UD", "DD"]
    df = spark.createDataFrame([(names[k], *map(float, v)) for k, v in zip(g, x, strict=True)], "regime_id string, a double, b double, c double")
    means = np.array([(x[g == k].sum(0) + 5 * x.mean(0)) / ((g == k).sum() + 5) for k in range(4)])
    cov, shrink = uncentred_ledoit_wolf(x - means[g])
    fit = block_likelihood(df, ["a", "b", "c"])
    got = {r.regime_id: (r.n, r.m_a, r.m_b, r.m_c) for r in fit["means"].collect()}
    assert got["DD"][0] == 0 and np.allclose([got[n][1:] for n in names], means)
    row = fit["covariance"].first()
    assert np.allclose(np.array(row.c).reshape(3, 3), cov) and math.isclose(row.shrinkage, shrink)
    live = spark.createDataFrame([(1, 0.5, -1.0, 0.2)], "id int, a double, b double, c double")
    for nu in (7.0, None):
        out = {r.regime_id: r.loglik for r in log_likelihoods(live, ["id"], fit, ["a", "b", "c"], nu).collect()}
        for k, n in enumerate(names):
            scale = cov * (1 if nu is None else (nu - 2) / nu)
            e = np.array([0.5, -1.0, 0.2]) - means[k]
            m, ld = e @ np.linalg.inv(scale) @ e, math.log(np.linalg.det(scale))
            want = -0.5 * (3 * math.log(2 * math.pi) + ld + m) if nu is None else math.lgamma(5) - math.lgamma(3.5) - 0.5 * (3 * math.log(7 * math.pi) + ld) - 5 * math.log1p(m / 7)
            assert math.isclose(out[n], want, rel_tol=1e-9)
