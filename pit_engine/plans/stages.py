"""Whole stages over general inputs: each composes operators and returns its tables by name.

Inputs are long archives (series_id, reference_date, vintage_date, value),
price panels (date, ticker, open, close) and regime histories; outputs are
DataFrames that ``sources.snapshots.write_table`` can store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pit_engine.operators import backtest as B
from pit_engine.operators import evidence as E
from pit_engine.operators import forecasts as O
from pit_engine.operators import models as M
from pit_engine.operators import regimes as G
from pit_engine.operators import statistics as S
from pit_engine.operators import vintages as V
from pit_engine.operators import weekly as K
from pit_engine.operators import windows as W


def build_scores(archive: DataFrame, growth: list[str], inflation: list[str], minimum: int = 60, transform: str = "log_difference") -> dict[str, DataFrame]:
    """First releases, composite scores of both axes and when each month's score was known."""
    features = V.first_release_features(archive, transform)
    z = W.lagged_expanding_zscore(features, ["series_id"], "reference_date", "transformed_value", minimum)
    series = [*growth, *inflation]
    wide = z.groupBy(F.col("reference_date").alias("month")).pivot("series_id", series).agg(F.first("z"))
    scores = W.composite(W.composite(wide, [f"`{s}`" for s in growth], "growth_score"), [f"`{s}`" for s in inflation], "inflation_score")
    known = V.cumulative_availability(features.where(F.col("series_id").isin(series)), len(series)).withColumnRenamed("reference_date", "month")
    scores = scores.join(known, "month", "left").withColumnRenamed("score_available_at", "available_at").drop("n_components")
    regimes = scores.select("month", G.quadrant(F.col("growth_score"), F.col("inflation_score")).alias("regime_id"), F.col("available_at").alias("label_available_at"))
    return {"features": features, "scores": scores, "regimes": regimes}


def build_evidence(archive: DataFrame, block: str, feature: str, minimum: int = 60) -> dict[str, DataFrame]:
    """The canonical, validated event table of a block."""
    return {"events": E.validate_events(E.monthly_events(V.first_release_features(archive), block, feature, minimum))}


def build_transition(regimes: DataFrame, cutoffs: DataFrame, alpha: float = 0.5) -> dict[str, DataFrame]:
    pairs = G.transition_pairs(regimes)
    return {"pairs": pairs, "matrices": G.transition_matrix(pairs, cutoffs, alpha)}


def build_probability_map(archive: DataFrame, scores: DataFrame, components: int, horizons: list[int], cutoff: Column) -> dict[str, DataFrame]:
    """Revision errors by component and axis at each horizon."""
    from pyspark.sql import Window

    features = V.first_release_features(archive)
    past = Window.partitionBy("series_id").orderBy(F.unix_date("release_date")).rangeBetween(Window.unboundedPreceding, -1)
    scales = features.where("status = 'available'").select("series_id", "reference_date", F.stddev_samp("transformed_value").over(past).alias("scale"))
    errors = V.revision_errors(archive, features, scales, horizons, cutoff)
    return {"component_errors": errors, "axis_errors": V.axis_revision_errors(errors, components), "scores": scores}


def build_inference(events: DataFrame, variants: dict[str, float | None], parameters: dict) -> dict[str, DataFrame]:
    """Checkpoints of every variant's replay and their status counts."""
    rows = M.replay(events, variants, parameters)
    return {"checkpoints": rows, "status": S.status_counts(rows, ["variant"], "status")}


def build_backtest(targets: DataFrame, prices: DataFrame, tickers: int, period: Column, step: Column, costs: float, periods_per_year: float) -> dict[str, DataFrame]:
    """Holding returns, simulation, daily values, performance and concentration of given targets."""
    held = B.holding_returns(prices, tickers, period, step)
    simulation = B.simulate(targets, held, costs)
    nav = B.daily_nav(targets, simulation, prices)
    drawdown = W.max_drawdown(nav, ["method"], ["date", "phase_order"], "nav")
    return {"holding_returns": held, "simulation": simulation, "daily_nav": nav, "performance": B.performance(simulation, drawdown, periods_per_year), "concentration": B.concentration(targets)}


def build_source_audit(current: DataFrame, previous: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Availability ledgers of two captures of an archive and how they differ."""
    a, b = V.availability_ledger(previous, as_of), V.availability_ledger(current, as_of)
    from pit_engine.operators.asof import compare_keyed

    return {"ledger": b, "reasons": S.status_counts(b, ["series_id"], "reason"), "changes": compare_keyed(a, b, ["series_id", "reference_date"], "value")}


def build_retail_sensitivity(nominal: DataFrame, deflated: DataFrame, derived: str = "implicit_deflator") -> dict[str, DataFrame]:
    """An implicit deflator from two archives, each carrying its latest snapshot to the union of information dates.

    The derived archive's vintages are the information dates, so first releases
    and same-vintage changes are those of the pair, not of either side.
    """
    aligned = V.align_vintages(nominal, deflated)
    ratio = F.when((F.col("a_value") > 0) & (F.col("b_value") > 0), 100 * F.col("a_value") / F.col("b_value"))
    archive = aligned.select(F.lit(derived).alias("series_id"), "reference_date", F.col("information_date").alias("vintage_date"), ratio.alias("value"))
    return {"aligned": aligned, "archive": archive, "features": V.first_release_features(archive)}


def build_evidence_experiments(archive: DataFrame, ratios: dict[str, tuple[str, str]], differences: dict[str, tuple[str, str]], minimum: int = 60) -> dict[str, DataFrame]:
    """Events of derived series: log ratios and differences of two series, cell by cell in each vintage."""
    of = lambda s: archive.where(F.col("series_id") == s)
    made = [V.combine_same_vintage(of(a), of(b), name, how).withColumn("_t", F.lit(t)) for pairs, how, t in ((ratios, "log_ratio", "difference"), (differences, "difference", "log_difference")) for name, (a, b) in pairs.items()]
    derived = made[0]
    for d in made[1:]:
        derived = derived.unionByName(d)
    events = None
    for t in ("difference", "log_difference"):
        part = E.monthly_events(V.first_release_features(derived.where(F.col("_t") == t).drop("_t"), t), "experiments", t, minimum)
        events = part if events is None else events.unionByName(part)
    return {"archive": derived.drop("_t"), "events": E.validate_events(events)}


def build_inference_sensitivities(evaluations: DataFrame, baseline: str, spans: dict[str, tuple[str | None, str | None]], folds: DataFrame, profiles: list[str], degrees: list[float]) -> dict[str, DataFrame]:
    """Summaries of variants over all and part of the time, paired comparisons, and the tails of the folds.

    evaluations: variant, date, error, score (smaller is better).
    """
    return {
        "summary": S.evaluation_summary(evaluations, ["variant"], "error", "score"),
        "subperiods": S.evaluation_summary(S.in_subperiods(evaluations, "date", spans), ["variant", "period"], "error", "score"),
        "comparisons": S.paired_comparison(evaluations, ["date"], "variant", baseline, "score"),
        "tails": O.tail_summary(folds, profiles, degrees),
    }


def build_experiment_inference(audit: DataFrame, residuals: DataFrame, weekly: list[str], pair: tuple[tuple[str, str], tuple[str, str]], checkpoints: DataFrame, frozen: DataFrame, keys: list[str], values: list[str], tolerance: float) -> dict[str, DataFrame]:
    """Coverage of updates, monthly residuals and their dependence, and whether frozen checkpoints stayed what they were."""
    monthly = O.monthly_residuals(residuals, weekly)
    return {
        "coverage": O.update_coverage(audit, ["variant_id", "observation_model_id"]),
        "monthly_residuals": monthly,
        "cross_dependence": S.lagged_correlation(monthly.select(F.concat_ws("|", "block_id", "response_id").alias("series"), F.col("reference_month").alias("d"), F.col("residual").alias("x")), "series", "d", "x", [0], 12),
        "same_publication": O.same_publication(residuals, *pair),
        "invariance": S.invariance(checkpoints, frozen, keys, values, tolerance),
    }


def build_block_attribution(benefits: DataFrame, audit: DataFrame, arms: list[str], metrics: list[str], resamples: int = 2000, block: int = 12, periods_per_year: float = 12.0) -> dict[str, DataFrame]:
    """Benefit of each block, alone and left out, with bootstrap inference, Holm's correction and coverage.

    benefits: block_id, arm, metric, position (0-based), d.
    """
    keys = ["block_id", "arm", "metric"]
    inference = S.paired_inference(benefits, keys, resamples, block, periods_per_year)
    # A two-sided bootstrap p-value, never zero.
    p = F.least(F.lit(1.0), 2 * (F.least("share_positive", 1 - F.col("share_positive")) * resamples + 1) / (resamples + 1))
    inference = S.holm(inference.withColumn("p_value", p), ["arm", "metric"], "p_value", "block_id")
    coverage = O.update_coverage(audit, ["block_id"])
    return {"inference": inference, "coverage": coverage, "summary": O.attribution_summary(inference.select(*keys, F.col("mean_difference").alias("benefit")), inference, coverage, arms, metrics)}


def build_feature_revision(old: DataFrame, new: DataFrame, horizons: list[int], cutoff: Column) -> dict[str, DataFrame]:
    """How features change when one archive replaces another: features of both, their differences, revision errors of the new one."""
    from pit_engine.operators.asof import compare_keyed

    a, b = V.first_release_features(old), V.first_release_features(new)
    past = Window.partitionBy("series_id").orderBy(F.unix_date("release_date")).rangeBetween(Window.unboundedPreceding, -1)
    scales = b.where("status = 'available'").select("series_id", "reference_date", F.stddev_samp("transformed_value").over(past).alias("scale"))
    return {"old": a, "new": b, "changes": compare_keyed(a, b, ["series_id", "reference_date"], "transformed_value", 1e-9), "revision_errors": V.revision_errors(new, b, scales, horizons, cutoff)}


def build_current_baseline(checkpoints: DataFrame, frozen: DataFrame, tolerance: float = 1e-9) -> dict[str, DataFrame]:
    """The newest checkpoint of each variant, and proof that all frozen ones are unchanged.

    checkpoints, frozen: variant, checkpoint_id, date, p_uu, p_du, p_ud, p_dd.
    """
    names = ["p_uu", "p_du", "p_ud", "p_dd"]
    newest = checkpoints.groupBy("variant").agg(F.max_by(F.struct("checkpoint_id", "date", *names), "checkpoint_id").alias("c")).select("variant", "c.*")
    common = checkpoints.join(frozen.select("variant", "checkpoint_id"), ["variant", "checkpoint_id"], "left_semi")
    return {"newest": newest, "invariance": S.invariance(common, frozen, ["variant", "checkpoint_id"], names, tolerance)}


def build_active_diagnostic(simulation: DataFrame, weeks: DataFrame, history: DataFrame, method: str, baseline: str, periods_per_year: float = 52.0) -> dict[str, DataFrame]:
    """Where an active method's difference to its baseline comes from, by the regime that was published later."""
    window = K.oracle_window(weeks, history)
    truth = window.select(F.col("reference_week").alias("period"), F.col("oracle_regime_id").alias("regime_id"))
    return {"window": window, "attribution": K.regime_attribution(simulation, truth, method, baseline, periods_per_year)}


def build_expanded_universe(targets: DataFrame, caps: DataFrame, expanded: dict[str, DataFrame], original: dict[str, DataFrame], posterior: DataFrame, returns: DataFrame, methods: tuple[str, str], periods_per_year: float = 52.0) -> dict[str, DataFrame]:
    """Diagnostics of a universe that grew: use of caps, distance of targets, returns against expectations, and what changed for the old assets.

    expanded, original: the tables of ``weekly.regime_return_model``. The query
    of ``parity`` fails if an old asset's expected return changed.
    """
    wide, narrow = K.mixture(expanded, posterior)["expected"], K.mixture(original, posterior)["expected"]
    return {
        "utilization": K.utilization(targets, caps), "concentration": B.concentration(targets), "distance": K.target_distance(targets, *methods),
        "assets": K.asset_diagnostics(returns, wide, periods_per_year), "risk_change": K.risk_change(expanded["covariance"], original["covariance"]), "parity": K.mean_parity(wide, narrow),
    }


def weekly_live_update(archive: DataFrame, growth: list[str], inflation: list[str], marginals: DataFrame, variant: str, weeks: DataFrame, prices: DataFrame, tickers: int, specifications: dict[str, tuple[float, float, float]], minimum: int, cap: float, cost: float, score_minimum: int = 60, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """One run from releases to targets: scores, regimes, signals, returns, targets and their simulation.

    ``keep`` may write the calendars that later steps read several times.
    """
    built = {k: keep(v) for k, v in build_scores(archive, growth, inflation, score_minimum).items()}
    signals = keep(K.select_signals(marginals, weeks, variant))
    returns = keep(K.estimator_history(B.holding_returns(prices, tickers, F.trunc("date", "week"), F.date_add("period", 7))))
    targets = keep(K.dynamic_targets(returns, built["regimes"], signals, specifications, minimum, cap, cost, keep=keep))
    return {**built, "signals": signals, "returns": returns, "targets": targets, "simulation": B.simulate(targets.drop("status"), returns, cost)}
