"""Release events in one fixed shape, and the derived archives that feed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pit_engine.operators.windows import group_causal_ar1, group_causal_zscore

EVENT_COLUMNS = ["event_id", "event_group_id", "release_block", "feature_name", "series_id", "reference_date", "release_date", "current_value", "previous_value", "transformed_value", "release_lag_days", "prior_n", "prior_mean", "prior_std", "feature_value", "feature_status"]
KEY = ["event_id", "feature_name", "series_id"]


def event_id(block: Column, series: Column, reference: Column, release: Column) -> Column:
    """One id for each publication of a series' reference."""
    return F.concat_ws("|", block, series, F.date_format(reference, "yyyy-MM-dd"), F.date_format(release, "yyyy-MM-dd"))


def monthly_events(features: DataFrame, block: str, feature: str, minimum: int = 60) -> DataFrame:
    """First-release features as events with a group-causal score."""
    z = group_causal_zscore(features.where("status = 'available'").drop("status"), ["series_id"], "release_date", "transformed_value", minimum)
    status = F.when(F.col("status") == "warmup", "standardization_warmup").when(F.col("status") == "unidentified", "standardization_unidentified").otherwise("available")
    ids = event_id(F.lit(block), F.col("series_id"), F.col("reference_date"), F.col("release_date"))
    return z.select(
        ids.alias("event_id"), F.concat_ws("|", F.lit(block), F.date_format("release_date", "yyyy-MM-dd")).alias("event_group_id"), F.lit(block).alias("release_block"), F.lit(feature).alias("feature_name"), "series_id", "reference_date", "release_date",
        "current_value", "previous_value", "transformed_value", "release_lag_days", "prior_n", "prior_mean", "prior_std", F.col("z").alias("feature_value"), status.alias("feature_status"))


def weekly_events(levels: DataFrame, block: str, feature: str, minimum_ar: int = 52, minimum_std: int = 52) -> DataFrame:
    """Weekly levels as events of log AR(1) innovations; a reference that breaks the seven-day chain is an error."""
    from pyspark.sql import Window

    own = Window.partitionBy("series_id").orderBy("reference_date")
    prev = F.lag("reference_date").over(own)
    chained = levels.withColumn("_gap", F.datediff("reference_date", prev))
    chained = chained.where(F.assert_true(F.col("_gap").isNull() | (F.col("_gap") == 7), F.lit("weekly references have a gap")).isNull()).drop("_gap")
    z = group_causal_ar1(chained, ["series_id"], "reference_date", "release_date", "level", minimum_ar, minimum_std)
    ids = event_id(F.lit(block), F.col("series_id"), F.col("reference_date"), F.col("release_date"))
    return z.select(
        ids.alias("event_id"), F.concat_ws("|", F.lit(block), F.date_format("release_date", "yyyy-MM-dd")).alias("event_group_id"), F.lit(block).alias("release_block"), F.lit(feature).alias("feature_name"), "series_id", "reference_date", "release_date",
        F.col("level").alias("current_value"), F.exp("y_prev").alias("previous_value"), F.col("innovation").alias("transformed_value"), F.datediff("release_date", "reference_date").alias("release_lag_days"), F.col("innov_n").alias("prior_n"), F.col("innov_mean").alias("prior_mean"), F.col("innov_std").alias("prior_std"), F.col("z").alias("feature_value"), F.col("status").alias("feature_status"))


def validate_events(events: DataFrame) -> DataFrame:
    """The events; the query fails on a repeated key, a wrong status or a value without the status for it."""
    from pyspark.sql import Window

    known = ["available", "standardization_warmup", "standardization_unidentified", "ar_warmup", "ar_unidentified"]
    checked = events.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    ok = (F.col("_n") == 1) & F.col("feature_status").isin(known) & ((F.col("feature_status") == "available") == F.col("feature_value").isNotNull()) & (F.col("release_date") >= F.col("reference_date"))
    return checked.where(F.assert_true(ok, F.lit("an event breaks the table's contract")).isNull()).select(*events.columns)


def paired_ratio_events(events: DataFrame, numerator: str, denominator: str, derived: str, minimum: int = 60) -> DataFrame:
    """Log-ratio change of two series published together for one reference, with a group-causal score.

    The change is of the ratio against the previous values that the same
    publications carried.
    """
    side = lambda s, p: events.where(F.col("series_id") == s).select("reference_date", "release_date", F.col("current_value").alias(f"{p}1"), F.col("previous_value").alias(f"{p}0"))
    both = side(numerator, "n").join(side(denominator, "d"), ["reference_date", "release_date"])
    ok = (F.least("n1", "n0", "d1", "d0") > 0) & F.col("n1").isNotNull() & F.col("n0").isNotNull() & F.col("d1").isNotNull() & F.col("d0").isNotNull()
    change = 100 * (F.ln(F.col("n1") / F.col("d1")) - F.ln(F.col("n0") / F.col("d0")))
    rows = both.where(ok).select(F.lit(derived).alias("series_id"), "reference_date", "release_date", change.alias("transformed_value"))
    return group_causal_zscore(rows, ["series_id"], "release_date", "transformed_value", minimum)


def disjoint_component(events: DataFrame, total: str, part: str, derived: str) -> DataFrame:
    """Log change of total minus part from one publication's current and previous levels."""
    side = lambda s, p: events.where(F.col("series_id") == s).select("reference_date", "release_date", F.col("current_value").alias(f"{p}1"), F.col("previous_value").alias(f"{p}0"))
    both = side(total, "t").join(side(part, "p"), ["reference_date", "release_date"])
    now, before = F.col("t1") - F.col("p1"), F.col("t0") - F.col("p0")
    rows = both.where((now > 0) & (before > 0))
    return rows.select(F.lit(derived).alias("series_id"), "reference_date", "release_date", now.alias("current_value"), before.alias("previous_value"), (100 * (F.ln(now) - F.ln(before))).alias("transformed_value"))
