from datetime import date

import numpy as np
import pytest
from dateutil.relativedelta import relativedelta
from pyspark.sql import functions as F

from pit_engine.operators import evidence as E
from pit_engine.plans import stages


def month(k):
    return date(2000, 1, 1) + relativedelta(months=k)


def archive(spark, n=40, series=("g1", "g2", "i1", "i2")):
    rng = np.random.default_rng(0)
    rows = []
    for s in series:
        level = np.exp(rng.normal(size=n).cumsum() * 0.02 + 3)
        for v in range(2, n + 1):
            # A vintage two months on shows the last two months; the newest is revised once.
            for m in range(max(0, v - 3), v):
                rows.append((s, month(m), month(v) + relativedelta(days=4), float(level[m] * (1 + 0.001 * (v - m)))))
    return spark.createDataFrame(rows, "series_id string, reference_date date, vintage_date date, value double")


def test_scores_to_regimes_to_transitions(spark):
    out = stages.build_scores(archive(spark), ["g1", "g2"], ["i1", "i2"], 12)
    scores = out["scores"].where("growth_score is not null")
    assert scores.count() > 20
    assert scores.where("available_at < month").count() == 0
    cut = spark.sql("SELECT explode(array(date'2002-01-01', date'2003-01-01')) AS cutoff")
    t = stages.build_transition(out["regimes"], cut)
    m = t["matrices"].groupBy("cutoff", "source").agg(F.sum("p").alias("s")).collect()
    assert len(m) == 8 and all(abs(r.s - 1) < 1e-12 for r in m)
    early, late = (t["matrices"].where(F.col("cutoff") == c).agg(F.sum("n")).first()[0] for c in ("2002-01-01", "2003-01-01"))
    assert early < late


def test_later_vintages_leave_earlier_scores_alone(spark):
    a = archive(spark)
    full = stages.build_scores(a, ["g1", "g2"], ["i1", "i2"], 12)["scores"]
    cut = stages.build_scores(a.where("vintage_date <= date'2002-06-30'"), ["g1", "g2"], ["i1", "i2"], 12)["scores"]
    key = lambda df: {r.month: r.growth_score for r in df.collect()}
    f, c = key(full), key(cut)
    assert c and all(f[m] == v or abs(f[m] - v) < 1e-9 for m, v in c.items() if v is not None)


def test_evidence_contract(spark):
    e = stages.build_evidence(archive(spark), "block", "feature", 12)["events"]
    assert e.columns == E.EVENT_COLUMNS and e.count() > 0
    with pytest.raises(Exception, match="contract"):
        E.validate_events(e.unionByName(e)).collect()


def test_weekly_events_reject_gaps(spark):
    rows = [("w", date(2020, 1, 4) + relativedelta(days=7 * k + (1 if k == 5 else 0)), date(2020, 1, 9) + relativedelta(days=7 * k), 10.0 + k % 3) for k in range(8)]
    df = spark.createDataFrame(rows, "series_id string, reference_date date, release_date date, level double")
    with pytest.raises(Exception, match="gap"):
        E.weekly_events(df, "b", "f", 3, 3).collect()
    assert E.weekly_events(df.where("day(reference_date) <> 9 and reference_date < date'2020-02-01'"), "b", "f", 2, 2).count() == 4


def test_backtest_accounts_for_cost_and_drift(spark):
    days = [date(2024, 1, 1) + relativedelta(days=k) for k in range(0, 29)]
    rows = [(d, t, 100.0 * (1 + r) ** k, 100.0 * (1 + r) ** k * 1.001) for k, d in enumerate(days) if d.weekday() < 5 for t, r in (("A", 0.01), ("B", 0.0))]
    prices = spark.createDataFrame(rows, "date date, ticker string, open double, close double")
    weeks = [date(2024, 1, 1) + relativedelta(days=7 * k) for k in range(4)]
    targets = spark.createDataFrame([("m", w, t, x) for w in weeks for t, x in (("A", 0.5), ("B", 0.5))], "method string, period date, ticker string, target_weight double")
    out = stages.build_backtest(targets, prices, 2, F.trunc("date", "week"), F.date_add("period", 7), 0.01, 52.0)
    sim = out["simulation"].orderBy("period").collect()
    g = 1.01**7 - 1
    drift = 0.5 * (1 + g) / (1 + 0.5 * g)
    assert abs(sim[0].one_way_turnover - 0.5) < 1e-12 and abs(sim[1].one_way_turnover - (drift - 0.5)) < 1e-9
    assert abs(sim[0].net_return - ((1 - 0.01) * (1 + 0.5 * g) - 1)) < 1e-9
    nav = out["daily_nav"].orderBy("date", "phase_order").collect()
    assert abs(nav[-1].nav - sim[-1].nav) < 1e-9 and nav[0].nav == 1.0


def test_source_audit(spark):
    a = archive(spark, 12, ("x",))
    changed = a.withColumn("value", F.when(F.col("reference_date") == "2000-05-01", F.col("value") + 1).otherwise(F.col("value")))
    out = stages.build_source_audit(changed, a.where("reference_date < date'2000-10-01'"), F.lit("2002-01-01").cast("timestamp"))
    got = {r.status: r["count"] for r in out["changes"].groupBy("status").count().collect()}
    assert got["changed"] == 1 and got["added"] >= 1


# ------------------------------------------------------------------ stages over derived inputs


def test_retail_sensitivity_carries_snapshots(spark):
    a = spark.createDataFrame([("n", month(0), date(2000, 3, 1), 10.0), ("n", month(1), date(2000, 3, 1), 12.0), ("n", month(1), date(2000, 5, 1), 13.0)], "series_id string, reference_date date, vintage_date date, value double")
    b = spark.createDataFrame([("r", month(0), date(2000, 4, 1), 5.0), ("r", month(1), date(2000, 4, 1), 6.0)], "series_id string, reference_date date, vintage_date date, value double")
    out = stages.build_retail_sensitivity(a, b)
    got = {(r.vintage_date, r.reference_date): r.value for r in out["archive"].collect()}
    # Before the second archive's first snapshot there is no ratio; the newest snapshot of the first lacks month 0.
    assert got == {(date(2000, 4, 1), month(0)): 200.0, (date(2000, 4, 1), month(1)): 200.0, (date(2000, 5, 1), month(1)): pytest.approx(100 * 13 / 6)}
    assert out["features"].count() == 2


def test_evidence_experiments_are_derived_within_one_vintage(spark):
    out = stages.build_evidence_experiments(archive(spark), {"g1/g2": ("g1", "g2")}, {"i1-i2": ("i1", "i2")}, 6)
    a = archive(spark).where("series_id in ('g1', 'g2')").groupBy("reference_date", "vintage_date").pivot("series_id").agg(F.first("value"))
    want = {(r.reference_date, r.vintage_date): 100 * np.log(r.g1 / r.g2) for r in a.collect() if r.g1 and r.g2}
    got = {(r.reference_date, r.vintage_date): r.value for r in out["archive"].where("series_id = 'g1/g2'").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r.series_id for r in out["events"].select("series_id").distinct().collect()} <= {"g1/g2", "i1-i2"} and out["events"].count() > 20


def test_inference_sensitivities_and_block_attribution(spark):
    rng = np.random.default_rng(1)
    rows = [(v, month(k), float(e), float(e * e)) for k in range(30) for v, e in (("base", rng.normal()), ("wide", rng.normal() * 3))]
    ev = spark.createDataFrame(rows, "variant string, date date, error double, score double")
    folds = spark.createDataFrame([("p", lam, nu, y, "scored", 12, float(y % 7 + lam + nu / 10)) for lam in (0.1, 1.0) for nu in (4.0, 7.0) for y in (2000, 2001)], "profile_id string, base_lambda double, degrees_of_freedom double, year int, status string, n bigint, total_nll double")
    out = stages.build_inference_sensitivities(ev, "base", {"all": (None, None), "first": (None, "2001-01-01")}, folds, ["p", "q"], [4.0, 7.0])
    assert {(r.variant, r.period): r.n for r in out["subperiods"].collect()} == {(v, p): n for v in ("base", "wide") for p, n in (("all", 30), ("first", 12))}
    assert out["comparisons"].first().mean_difference > 0
    tails = {(r.profile_id, r.degrees_of_freedom): (r.base_lambda, r.best_tail, r.status) for r in out["tails"].collect()}
    assert tails["p", 4.0] == (0.1, True, "evaluated") and tails["p", 7.0][1] is False and tails["q", 4.0] == (None, False, "insufficient_history")

    d = spark.createDataFrame([(b, a, "loss", k, float(rng.normal() + (2 if b == "x" else 0))) for b in ("x", "y") for a in ("add", "drop") for k in range(48)], "block_id string, arm string, metric string, position bigint, d double")
    audit = spark.createDataFrame([(b, month(k), month(k + 1), "applied" if k % 2 else "fit_error:x", 0.5) for b in ("x", "y") for k in range(10)], "block_id string, reference_month date, release_date date, update_status string, event_weight double")
    got = {r.block_id: r for r in stages.build_block_attribution(d, audit, ["add", "drop"], ["loss"], 200)["summary"].collect()}
    assert got["x"].add_probability_beneficial_loss == 1.0 and got["x"].add_benefit_loss > 1.5 and got["y"].applied_updates == 5 and got["y"].fit_error_rows == 5
    holm = {(r.block_id, r.arm): (r.p_value, r.holm_p) for r in stages.build_block_attribution(d, audit, ["add", "drop"], ["loss"], 200)["inference"].collect()}
    assert holm["x", "add"][0] < 0.02 and all(h >= p for p, h in holm.values())


def test_experiment_inference_and_current_baseline(spark):
    rng = np.random.default_rng(2)
    res = [("b", "m", s, month(k) + relativedelta(days=7 * w), month(k) + relativedelta(days=7 * w + 4), month(k) + relativedelta(days=7 * w), float(rng.normal())) for s in ("w1", "w2") for k in range(14) for w in range(4)]
    residuals = spark.createDataFrame(res, "block_id string, model_id string, response_id string, reference_date date, available_at date, observation_date date, residual double")
    audit = spark.createDataFrame([("v", "m", month(0), month(1), "applied", 1.0)], "variant_id string, observation_model_id string, reference_month date, release_date date, update_status string, event_weight double")
    points = spark.createDataFrame([("v", k, month(k), 0.25, 0.25, 0.25, 0.25) for k in range(6)], "variant string, checkpoint_id bigint, date date, p_uu double, p_du double, p_ud double, p_dd double")
    names = ["p_uu", "p_du", "p_ud", "p_dd"]
    frozen = points.where("checkpoint_id < 4").withColumn("p_uu", F.when(F.col("checkpoint_id") == 2, 0.3).otherwise(F.col("p_uu")))
    out = stages.build_experiment_inference(audit, residuals, ["w1", "w2"], (("m", "w1"), ("m", "w2")), points, frozen, ["variant", "checkpoint_id"], names, 1e-9)
    assert out["monthly_residuals"].where("source_rows = 4").count() >= 20
    x, y = ([r[-1] for r in res if r[2] == s] for s in ("w1", "w2"))
    both = {r.statistic: r.correlation for r in out["same_publication"].collect()}
    assert abs(both["pearson"] - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert {r.status: r.n for r in out["invariance"].collect()} == {"same": 3, "changed": 1, "left_only": 2}
    base = stages.build_current_baseline(points, frozen)
    assert base["newest"].first().checkpoint_id == 5 and {r.status: r.n for r in base["invariance"].collect()} == {"same": 3, "changed": 1}


def test_feature_revision_lists_what_changed(spark):
    a = archive(spark, 20)
    b = a.withColumn("value", F.when((F.col("series_id") == "g1") & (F.col("reference_date") == month(10)), F.col("value") * 1.5).otherwise(F.col("value")))
    out = stages.build_feature_revision(a, b, [3], F.lit("2010-01-01").cast("date"))
    changed = {(r.series_id, r.reference_date) for r in out["changes"].where("status = 'changed'").collect()}
    assert changed == {("g1", month(10)), ("g1", month(11))}


def weekly_prices(spark, weeks=120):
    rng = np.random.default_rng(4)
    rows = []
    for t in ("a", "b", "c"):
        level = 100.0
        for k in range(weeks * 5):
            day = date(2000, 1, 5) + relativedelta(days=k + 2 * (k // 5))
            level *= float(np.exp(rng.normal() * 0.01))
            rows.append((day, t, level, level * 1.001))
    return spark.createDataFrame(rows, "date date, ticker string, open double, close double")


def test_weekly_live_update_and_the_diagnostics_of_its_targets(spark):
    from pit_engine.operators import weekly as K
    from pit_engine.plans.inputs import settle

    mondays = [date(2001, 3, 5) + relativedelta(weeks=k) for k in range(20)]
    weeks = spark.createDataFrame([(d,) for d in mondays], "reference_week date")
    marginals = spark.createDataFrame([("v", d, d.replace(day=1), 0.4, 0.3, 0.2, 0.1) for d in mondays], "variant_id string, signal_date date, reference_month date, p_uu double, p_du double, p_ud double, p_dd double")
    specs = {"base": (104.0, 10.0, 1.0), "loose": (0.0, 10.0, 1.5)}
    out = stages.weekly_live_update(archive(spark), ["g1", "g2"], ["i1", "i2"], marginals, "v", weeks, weekly_prices(spark), 3, specs, 4, 0.5, 0.001, 6, keep=settle)
    # A first Wednesday is no whole week.
    assert out["returns"].agg(F.min("period")).first()[0] == date(2000, 1, 10)
    sums = out["targets"].groupBy("method", "period").agg(F.sum("target_weight").alias("s"), F.max("target_weight").alias("m")).collect()
    assert len(sums) == 40 and all(abs(r.s - 1) < 1e-6 for r in sums) and all(r.m <= 0.5 + 1e-6 for r in sums if r.method == "base")
    assert out["simulation"].count() == 40
    # Nothing that was published after the day before a signal counts.
    known = K.labelled_returns(out["returns"], out["regimes"], spark.createDataFrame([(date(2001, 5, 1),)], "cutoff date"))
    assert known.agg(F.max("period")).first()[0] <= date(2001, 4, 23) and known.count() > 10

    diagnostic = stages.build_active_diagnostic(out["simulation"], out["signals"].select("reference_week", "signal_date", "reference_month"), out["regimes"], "loose", "base")
    assert diagnostic["attribution"].agg(F.sum("periods")).first()[0] == diagnostic["window"].count() > 0
    cutoff = spark.createDataFrame([(date(2001, 6, 1),)], "cutoff date")
    labelled = K.labelled_returns(out["returns"], out["regimes"], cutoff)
    posterior = cutoff.select("cutoff", F.explode(F.array(*(F.struct(F.lit(r).alias("regime_id"), F.lit(0.25).alias("p")) for r in ("UU", "DU", "UD", "DD")))).alias("x")).select("cutoff", "x.*")
    wide, narrow = ({k: settle(v) for k, v in K.regime_return_model(r, 10.0).items()} for r in (labelled, labelled.where("ticker <> 'c'")))
    caps = spark.createDataFrame([(t, 0.5) for t in "abc"], "ticker string, cap double")
    e = stages.build_expanded_universe(out["targets"], caps, wide, narrow, posterior, out["returns"], ("loose", "base"))
    assert e["parity"].first().cells == 2 and e["risk_change"].first().tickers == 2 and e["utilization"].count() == 6 and e["assets"].count() == 3
    assert e["distance"].agg(F.min("half_l1_distance")).first()[0] >= 0
    # The mixture's covariance against numpy.
    x = labelled.toPandas()
    p = x.pivot(index="period", columns="ticker", values="ret")
    lab = x.drop_duplicates("period").set_index("period")["regime_id"].loc[p.index]
    m = {r: (p[lab == r].sum() + 10 * p.mean()) / ((lab == r).sum() + 10) if (lab == r).any() else p.mean() for r in ("UU", "DU", "UD", "DD")}
    mu = sum(m.values()) / 4
    between = sum(np.outer(v - mu, v - mu) for v in m.values()) / 4
    got = {(r.a, r.b): r.between for r in K.mixture(wide, posterior)["covariance"].collect()}
    assert all(abs(got[a, b] - between[i, j]) < 1e-12 for i, a in enumerate("abc") for j, b in enumerate("abc"))
