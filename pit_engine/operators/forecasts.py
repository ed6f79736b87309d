"""Forecasts against what came: targets, shared evaluation, residual chains, coverage and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pit_engine.operators.statistics import average_ranks

STATUSES = ("eligible", "unclassified_target", "before_evaluation_start", "not_strictly_pre_confirmation", "invalid_probabilities")


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def attach_targets(forecasts: DataFrame, history: DataFrame, classes: list[str], start: Column) -> DataFrame:
    """Forecasts with the regime that came, when it was known, and whether the forecast may be judged.

    forecasts: target_month, checkpoint_date and a probability for each class.
    history: month, regime_id, label_available_at. A forecast has to be made
    strictly before its target was known; the first status that applies stands.
    """
    truth = history.select(F.col("month").alias("target_month"), F.col("regime_id").alias("realized"), "label_available_at")
    p = [F.col(c) for c in classes]
    proper = F.lit(True)
    for x in p:
        proper = proper & F.coalesce(~F.isnan(x) & (x >= 0), F.lit(False))
    proper = proper & (F.abs(_total(p) - 1) <= 1e-8 + 1e-5)
    status = (
        F.when(F.col("realized").isNull(), STATUSES[1])
        .when(F.col("target_month") < start, STATUSES[2])
        .when(~F.coalesce(F.col("checkpoint_date") < F.col("label_available_at"), F.lit(False)), STATUSES[3])
        .when(~proper, STATUSES[4])
        .otherwise(STATUSES[0])
    )
    return forecasts.join(truth, "target_month", "left").withColumns({"evaluation_status": status})


def shared_evaluation(scored: DataFrame, classes: list[str], keys: list[str], by: list[str], baseline: str, specification: str = "specification_id") -> DataFrame:
    """Scores of each specification and of the baseline on the forecasts that both made.

    ``keys`` tell the forecasts of one specification apart, ``by`` groups them.
    Columns: n, log loss and Brier score of both, their difference and skill.
    """
    own = F.lit(None).cast("double")
    for c in classes:
        own = F.when(F.col("realized") == c, F.col(c)).otherwise(own)
    loss = F.when(own > 0, -F.ln(own)).otherwise(float("inf"))
    brier = _total([F.pow(F.col(c) - (F.col("realized") == c).cast("double"), 2) for c in classes])
    rows = scored.where("evaluation_status = 'eligible'").select(specification, *dict.fromkeys([*keys, *by]), loss.alias("loss"), brier.alias("brier"))
    base = rows.where(F.col(specification) == baseline).select(*keys, F.col("loss").alias("base_loss"), F.col("brier").alias("base_brier"))
    m = rows.join(base, keys).groupBy(specification, *by).agg(
        F.count("*").alias("n"), F.avg("loss").alias("log_loss"), F.avg("brier").alias("brier"), F.avg("base_loss").alias("baseline_log_loss"), F.avg("base_brier").alias("baseline_brier"))
    skill = F.when(F.col("baseline_brier") > 0, 1 - F.col("brier") / F.col("baseline_brier"))
    return m.withColumns({"log_loss_difference": F.col("log_loss") - F.col("baseline_log_loss"), "brier_skill": skill})


def normalize_residuals(residuals: DataFrame) -> DataFrame:
    """Residual rows in one shape and one total order; the query fails on a missing name, date or value.

    residuals: block_id, model_id, response_id, reference_date, available_at, observation_date, residual.
    """
    names = ["block_id", "model_id", "response_id"]
    rows = residuals.select(*(F.trim(n).alias(n) for n in names), F.trunc("reference_date", "month").alias("reference_month"), "available_at", "observation_date", F.col("residual").cast("double").alias("residual"))
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.length(n) > 0)
    ok = ok & F.col("reference_month").isNotNull() & F.col("available_at").isNotNull() & ~F.isnan("residual") & (F.abs("residual") < float("inf"))
    return rows.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("a residual row has a missing name, date or value")).isNull())


def monthly_residuals(residuals: DataFrame, weekly: list[str]) -> DataFrame:
    """One residual for each response and month: the mean of a weekly response's, the only one of a monthly response.

    The query fails if a monthly response has two; a mean is known when its last part is.
    """
    is_weekly = F.lower("response_id").isin([w.lower() for w in weekly])
    g = normalize_residuals(residuals).groupBy("block_id", "model_id", "response_id", "reference_month").agg(
        F.avg("residual").alias("residual"), F.max("available_at").alias("available_at"), F.count("*").alias("source_rows"))
    g = g.withColumn("source_frequency", F.when(is_weekly, "weekly_aggregated").otherwise("monthly"))
    return g.where(F.assert_true(is_weekly | (F.col("source_rows") == 1), F.lit("a monthly response has two residuals of one month")).isNull())


def same_publication(residuals: DataFrame, left: tuple[str, str], right: tuple[str, str], minimum: int = 12) -> DataFrame:
    """Pearson and Spearman correlation of two responses' residuals on their common publication dates."""
    rows = normalize_residuals(residuals)
    side = lambda who, x: rows.where((F.col("model_id") == who[0]) & (F.col("response_id") == who[1])).groupBy("available_at").agg(F.avg("residual").alias(x))
    both = side(left, "x").join(side(right, "y"), "available_at").withColumn("_all", F.lit(1))
    ranked = average_ranks(average_ranks(both, ["_all"], "x", "rx"), ["_all"], "y", "ry")
    m = ranked.agg(F.count("*").alias("n"), F.min("available_at").alias("first_date"), F.max("available_at").alias("last_date"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("statistic"), F.col(k).alias("r")) for k in ("pearson", "spearman")))).alias("z")
    enough = F.col("n") >= minimum
    return m.select("n", "first_date", "last_date", each).select("z.statistic", F.when(enough, F.col("z.r")).alias("correlation"), "n", "first_date", "last_date", F.when(enough, "ok").otherwise("insufficient_observations").alias("status"))


def tail_summary(folds: DataFrame, profiles: list[str], degrees: list[float]) -> DataFrame:
    """Per profile and tail the best penalty over all scored folds, and which tail is best; profiles without folds are listed.

    folds: profile_id, base_lambda, degrees_of_freedom, year, status, n, total_nll. Ties take the larger penalty.
    """
    g = folds.where("status = 'scored'").groupBy("profile_id", "base_lambda", "degrees_of_freedom").agg(F.countDistinct("year").alias("folds"), F.sum("n").alias("observations"), F.sum("total_nll").alias("total_nll"))
    g = g.withColumn("mean_nll", F.col("total_nll") / F.col("observations"))
    best = g.groupBy("profile_id", "degrees_of_freedom").agg(F.min_by(F.struct("base_lambda", "folds", "observations", "mean_nll"), F.struct("mean_nll", -F.col("base_lambda"))).alias("b")).select("profile_id", "degrees_of_freedom", "b.*")
    spark = folds.sparkSession
    wanted = spark.createDataFrame([(p, float(d)) for p in profiles for d in degrees], "profile_id string, degrees_of_freedom double")
    full = wanted.join(best, ["profile_id", "degrees_of_freedom"], "left")
    least = F.min("mean_nll").over(Window.partitionBy("profile_id"))
    return full.select("profile_id", "degrees_of_freedom", "base_lambda", F.coalesce("folds", F.lit(0)).alias("folds"), F.coalesce("observations", F.lit(0)).alias("observations"), "mean_nll",
        F.coalesce(F.abs(F.col("mean_nll") - least) <= 1e-8 + 1e-5 * F.abs(least), F.lit(False)).alias("best_tail"), F.when(F.col("mean_nll").isNull(), "insufficient_history").otherwise("evaluated").alias("status"))


def update_coverage(audit: DataFrame, by: list[str]) -> DataFrame:
    """What became of the updates of each group: rows, applied, errors, predictive only, others, months, dates and the median weight."""
    s = F.coalesce("update_status", F.lit(""))
    applied, error, exact = s == "applied", s.startswith("fit_error:"), s == "target_exact_predictive_only"
    return audit.groupBy(*by).agg(
        F.count("*").alias("audit_rows"), F.count_if(applied).alias("applied_updates"), F.countDistinct(F.when(applied, F.col("reference_month"))).alias("active_reference_months"), F.count_if(error).alias("fit_error_rows"),
        F.count_if(exact).alias("target_exact_rows"), F.count_if(~applied & ~error & ~exact).alias("other_rows"), F.min(F.when(applied, F.col("release_date"))).alias("first_applied_release"),
        F.max(F.when(applied, F.col("release_date"))).alias("last_applied_release"), F.median(F.when(applied, F.col("event_weight"))).alias("median_event_weight"))


def attribution_summary(comparisons: DataFrame, inference: DataFrame, coverage: DataFrame, arms: list[str], metrics: list[str]) -> DataFrame:
    """One row a block: the benefit and the probability of benefit of each arm and metric, and the block's coverage.

    comparisons: block_id, arm, metric, benefit. inference: block_id, arm, metric, share_positive.
    """
    keys = ["block_id", "arm", "metric"]
    rows = comparisons.join(inference.select(*keys, "share_positive"), keys)
    pick = lambda a, m, c: F.max(F.when((F.col("arm") == a) & (F.col("metric") == m), F.col(c)))
    wide = rows.groupBy("block_id").agg(*(pick(a, m, c).alias(f"{a}_{x}_{m}") for a in arms for m in metrics for c, x in (("benefit", "benefit"), ("share_positive", "probability_beneficial"))))
    return wide.join(coverage, "block_id")
