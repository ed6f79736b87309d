"""The feature ledger: every month of a series with its first visible level, or the reason why there is none.

Levels are strings or numbers as an archive holds them: a missing cell is NULL,
a cell that is no finite number is invalid, and the two are never confused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: In the order in which they are decided (fixed values).
REASONS = (
    "outside_active_support", "future_reference", "unavailable_by_asof", "absent_reference", "invalid_current_value", "negative_release_lag", "archive_bootstrap",
    "excessive_release_lag", "missing_prior_reference", "missing_prior_value", "invalid_prior_value", "nonpositive_log_levels", "invalid_transformed_value", "retained",
)


def _finite(c: Column) -> Column:
    """The number that a cell holds, NULL for anything else."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def feature_ledger(archive: DataFrame, start: str, end: str, as_of: Column, transform: str = "log_difference", max_release_lag_days: int = 92, archive_start_latest_only: bool = True, active_start: str | None = None, active_end: str | None = None, timezone: str = "America/New_York") -> DataFrame:
    """One row for each series and month from ``start`` to ``end`` with status, reason, levels and transform.

    archive: series_id, reference_date, vintage_date, value (any type). A vintage
    is visible from local midnight after its date. The first nonmissing visible
    cell of a reference decides; a later revision never repairs it. The prior
    level has to stand in the same vintage. Reasons are decided in the order of
    ``REASONS``; everything before a vintage is looked at comes first.
    """
    cell = archive.select("series_id", "reference_date", "vintage_date", F.col("value").cast("string").alias("value"))
    visible = cell.where(F.to_utc_timestamp(F.date_add("vintage_date", 1).cast("timestamp"), timezone) <= as_of)
    local_day = F.to_date(F.from_utc_timestamp(as_of, timezone))
    series = archive.select("series_id").distinct().join(visible.groupBy("series_id").agg(F.min("vintage_date").alias("first_vintage")), "series_id", "left")
    months = series.select("series_id", "first_vintage", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("reference_date"))
    known = visible.groupBy("series_id", "reference_date").agg(
        F.min(F.when(F.col("value").isNotNull(), F.col("vintage_date"))).alias("vintage_date"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("vintage_date"))).alias("cell"))
    # A reference that any visible vintage lists counts as present in all of them.
    listed = known.select("series_id", F.add_months("reference_date", 1).alias("reference_date"), F.lit(True).alias("prior_listed"))
    prior = visible.select("series_id", F.add_months("reference_date", 1).alias("reference_date"), "vintage_date", F.col("value").alias("prior_cell"))
    complete = visible.where("value is not null and last_day(reference_date) <= vintage_date").groupBy("series_id", "vintage_date").agg(F.max("reference_date").alias("latest"))
    complete = complete.select("series_id", F.col("vintage_date").alias("first_vintage"), "latest")
    keys = ["series_id", "reference_date"]
    rows = months.join(known.withColumn("present", F.lit(True)), keys, "left").join(listed, keys, "left").join(prior, [*keys, "vintage_date"], "left").join(complete, ["series_id", "first_vintage"], "left")
    rows = rows.withColumns({"current_value": _finite(F.col("cell")), "previous_value": _finite(F.col("prior_cell")), "release_lag_days": F.datediff("vintage_date", F.last_day("reference_date"))})
    now, before = F.col("current_value"), F.col("previous_value")
    change = {"log_difference": 100 * (F.ln(now) - F.ln(before)), "difference": now - before, "negative_difference": before - now}[transform]
    day = F.col("reference_date")
    outside = (day < F.lit(active_start).cast("date") if active_start else F.lit(False)) | (day > F.lit(active_end).cast("date") if active_end else F.lit(False))
    lag = F.col("release_lag_days")
    bootstrap = (F.col("vintage_date") == F.col("first_vintage")) & ~day.eqNullSafe(F.col("latest")) if archive_start_latest_only else F.lit(False)
    reason = (
        F.when(outside, "outside_active_support")
        .when(day > local_day, "future_reference")
        .when(F.col("first_vintage").isNull(), "unavailable_by_asof")
        .when(F.col("present").isNull(), "absent_reference")
        .when(F.col("vintage_date").isNull(), "unavailable_by_asof")
        .when(now.isNull(), "invalid_current_value")
        .when(lag < 0, "negative_release_lag")
        .when(bootstrap, "archive_bootstrap")
        .when(lag > max_release_lag_days, "excessive_release_lag")
        .when(F.col("prior_listed").isNull(), "missing_prior_reference")
        .when(F.col("prior_cell").isNull(), "missing_prior_value")
        .when(before.isNull(), "invalid_prior_value")
        .when(F.lit(transform == "log_difference") & (F.least(now, before) <= 0), "nonpositive_log_levels")
        .when(_finite(change).isNull(), "invalid_transformed_value")
        .otherwise("retained")
    )
    looked = F.col("reason").isin(*REASONS[:4])
    out = rows.withColumn("reason", reason)
    return out.select(
        *keys, F.when(F.col("reason") == "retained", "retained").otherwise("excluded").alias("status"), "reason",
        F.when(~looked, F.col("vintage_date")).alias("archive_vintage_date"), F.when(~looked, now).alias("current_value"),
        F.when(F.col("reason").isin(*REASONS[11:]), before).alias("previous_value"), F.when(~looked & now.isNotNull(), lag).alias("release_lag_days"), F.when(F.col("reason") == "retained", change).alias("transformed_value"))


def splice_audit(features: DataFrame, old: str, new: str) -> DataFrame:
    """One row: how two series' first changes compare on their common months, before one is spliced to the other."""
    kept = features.where("status in ('available', 'retained')").select("series_id", "reference_date", "transformed_value", "release_date")
    a = kept.where(F.col("series_id") == old).select("reference_date", F.col("transformed_value").alias("x"), F.col("release_date").alias("xa"))
    b = kept.where(F.col("series_id") == new).select("reference_date", F.col("transformed_value").alias("y"), F.col("release_date").alias("ya"))
    both = a.join(b, "reference_date", "full")
    gap = F.col("y") - F.col("x")
    return both.agg(
        F.count_if(F.expr("xa is not null and ya is not null")).alias("common_months"), F.count_if(F.expr("ya is null")).alias("old_only_months"), F.count_if(F.expr("xa is null")).alias("new_only_months"),
        F.avg(gap).alias("mean_difference"), F.max(F.abs(gap)).alias("max_absolute_difference"), F.max(F.greatest("xa", "ya")).alias("jointly_available_at"),
    ).withColumn("status", F.when(F.col("common_months") > 0, "descriptive_overlap").otherwise("insufficient_common_support"))


def snapshot_diff(old: DataFrame, new: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per ticker: coverage of two price snapshots, and changed levels and returns on their common dates.

    old, new: ticker, date, close. More dates alone are no revision; a return is
    compared where both snapshots have the same pair of adjacent dates.
    """
    own = Window.partitionBy("ticker").orderBy("date")

    def side(df: DataFrame, x: str) -> DataFrame:
        r = df.withColumns({"_p": F.lag("date").over(own), "_r": F.col("close") / F.lag("close").over(own) - 1})
        return r.select("ticker", "date", F.col("close").alias(f"{x}_close"), F.col("_p").alias(f"{x}_prior"), F.col("_r").alias(f"{x}_return"), F.lit(True).alias(f"in_{x}"))

    both = side(old, "old").join(side(new, "new"), ["ticker", "date"], "full")
    common = F.col("in_old") & F.col("in_new")
    paired = common & (F.col("old_prior") == F.col("new_prior"))
    changed = lambda a, b: F.abs(F.col(a) - F.col(b)) > tolerance
    out = both.groupBy("ticker").agg(
        F.count_if(common).alias("common_dates"), F.count_if(F.col("in_new").isNull()).alias("old_only_dates"), F.count_if(F.col("in_old").isNull()).alias("new_only_dates"),
        F.count_if(common & changed("old_close", "new_close")).alias("price_changes"), F.count_if(paired).alias("compared_intervals"), F.count_if(paired & changed("old_return", "new_return")).alias("return_changes"),
        F.max(F.when(paired, F.abs(F.col("new_return") - F.col("old_return")) * 10_000)).alias("largest_return_change_bps"))
    status = F.when(F.col("common_dates") == 0, "insufficient_data").when(F.col("price_changes") > 0, "changed_common_support").otherwise("unchanged_common_support")
    return out.withColumn("status", status)
