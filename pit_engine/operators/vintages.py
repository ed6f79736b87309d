"""Bitemporal extraction: what was first published, when, and how it was revised.

The archive is a long table (series_id, reference_date, vintage_date, value),
one row for each cell of a revision matrix; a missing cell is a NULL or absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pit_engine.operators.asof import clean
from pit_engine.operators.calendar import gapless, release_lag_days

KEY = ["series_id", "reference_date"]


def densify(increments: DataFrame) -> DataFrame:
    """A cumulative archive from increments: each cell after the first release carries the level."""
    first = increments.groupBy(*KEY).agg(F.min("vintage_date").alias("_first"))
    # A series' snapshots are a calendar; every reference unfolds the part of it from its own first release on.
    calendars = increments.groupBy("series_id").agg(F.sort_array(F.collect_set("vintage_date")).alias("_all"))
    later = F.slice("_all", F.array_position("_all", F.col("_first")).cast("int"), F.size("_all"))
    grid = first.join(calendars, "series_id").select(*KEY, F.explode(later).alias("vintage_date"))
    running = Window.partitionBy(*KEY).orderBy("vintage_date").rowsBetween(Window.unboundedPreceding, 0)
    cells = grid.join(increments, [*KEY, "vintage_date"], "left")
    return cells.select(*KEY, "vintage_date", F.sum(F.coalesce("value", F.lit(0))).over(running).alias("value"))


def apply_transform(current: Column, previous: Column, transform: str) -> Column:
    """difference, negative_difference or log_difference (100 times the log ratio of positive levels)."""
    if transform == "difference":
        return current - previous
    if transform == "negative_difference":
        return previous - current
    if transform == "log_difference":
        return F.when((current > 0) & (previous > 0), 100 * (F.ln(current) - F.ln(previous)))
    if transform == "level":
        return current
    raise ValueError(f"unknown transform: {transform}")


def first_release(archive: DataFrame) -> DataFrame:
    """Per reference the earliest vintage with a value: release_date, value."""
    seen = archive.where(clean("value").isNotNull())
    return seen.groupBy(*KEY).agg(F.min("vintage_date").alias("release_date"), F.min_by("value", "vintage_date").alias("value"))


def prior_in_vintage(archive: DataFrame, releases: DataFrame, months: int = 1) -> DataFrame:
    """Releases with ``previous_value``: the level ``months`` earlier as the same vintage shows it."""
    prior = archive.select("series_id", F.add_months("reference_date", months).alias("reference_date"), F.col("vintage_date").alias("release_date"), F.col("value").alias("previous_value"))
    return releases.join(prior, [*KEY, "release_date"], "left")


def first_release_features(archive: DataFrame, transform: str = "log_difference", max_release_lag_days: int = 92, months: int = 1, archive_start_latest_only: bool = False) -> DataFrame:
    """First releases with their same-vintage transform, lag and status.

    An ineligible first appearance is never repaired by a later vintage. With
    ``archive_start_latest_only`` the archive's first snapshot counts as a
    release for its latest reference only.
    """
    found = prior_in_vintage(archive, first_release(archive), months)
    lag = release_lag_days("reference_date", "release_date")
    first_vintage = F.min("release_date").over(Window.partitionBy("series_id"))
    latest = F.max("reference_date").over(Window.partitionBy("series_id", "release_date"))
    bootstrap = (F.col("release_date") == first_vintage) & (F.col("reference_date") < latest) if archive_start_latest_only else F.lit(False)
    value = apply_transform(F.col("value"), F.col("previous_value"), transform)
    status = (
        F.when(F.col("_boot"), "archive_start")
        .when(F.col("release_lag_days") < 0, "released_before_period_end")
        .when(F.col("release_lag_days") > max_release_lag_days, "released_too_late")
        .when(F.col("previous_value").isNull(), "missing_prior_level")
        .when(F.col("_t").isNull(), "undefined_transform")
        .otherwise("available")
    )
    out = found.withColumns({"release_lag_days": lag, "_boot": bootstrap, "_t": value}).withColumn("status", status)
    return out.select(*KEY, "release_date", F.col("value").alias("current_value"), "previous_value", F.when(F.col("status") == "available", F.col("_t")).alias("transformed_value"), "release_lag_days", "status")


def contemporaneous_features(archive: DataFrame, transform: str = "log_difference") -> DataFrame:
    """First releases within their own reference month."""
    first = first_release(archive).where(F.col("release_date").between(F.trunc("reference_date", "month"), F.last_day("reference_date")))
    found = prior_in_vintage(archive, first)
    value = apply_transform(F.col("value"), F.col("previous_value"), transform)
    return found.where("previous_value is not null").select(*KEY, "release_date", F.col("value").alias("current_value"), "previous_value", value.alias("transformed_value"))


def first_release_levels(archive: DataFrame, max_release_lag_days: int = 92, contemporaneous: bool = False) -> DataFrame:
    """First releases as levels, if they came in time."""
    lag = release_lag_days("reference_date", "release_date")
    inside = F.col("release_date").between(F.trunc("reference_date", "month"), F.last_day("reference_date"))
    return first_release(archive).withColumn("release_lag_days", lag).where(inside if contemporaneous else lag.between(0, max_release_lag_days))


def combine_same_vintage(numerator: DataFrame, denominator: DataFrame, derived: str, how: str) -> DataFrame:
    """A derived archive from two: "log_ratio" (100 times) or "difference" (NULL unless positive), cell by cell."""
    a, b = numerator.drop("series_id").withColumnRenamed("value", "_a"), denominator.drop("series_id").withColumnRenamed("value", "_b")
    both = a.join(b, ["reference_date", "vintage_date"])
    if how == "log_ratio":
        value = F.when((F.col("_a") > 0) & (F.col("_b") > 0), 100 * F.ln(F.col("_a") / F.col("_b")))
    else:
        value = F.when(F.col("_a") - F.col("_b") > 0, F.col("_a") - F.col("_b"))
    return both.select(F.lit(derived).alias("series_id"), "reference_date", "vintage_date", value.alias("value"))


def align_vintages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two archives on the union of their information dates, each carrying its latest snapshot.

    The snapshot is carried, not its cells: a cell that the newest snapshot
    lacks stays missing.
    """
    dates = a.select("vintage_date").union(b.select("vintage_date")).distinct().withColumnRenamed("vintage_date", "information_date")
    own = [x.select(F.col("vintage_date")).distinct().withColumn(f"_{k}", F.col("vintage_date")) for k, x in (("a", a), ("b", b))]
    line = dates
    for k, x in zip(("a", "b"), own, strict=True):
        line = line.join(x.withColumnRenamed("vintage_date", "information_date"), "information_date", "left")
    # One row for each vintage of the archives, so the unpartitioned window is over dates only.
    past = Window.orderBy("information_date").rowsBetween(Window.unboundedPreceding, 0)
    line = line.select("information_date", *(F.last(f"_{k}", ignorenulls=True).over(past).alias(f"_{k}") for k in ("a", "b")))
    left = line.join(a.select("reference_date", F.col("vintage_date").alias("_a"), F.col("value").alias("a_value")), "_a")
    right = line.join(b.select("reference_date", F.col("vintage_date").alias("_b"), F.col("value").alias("b_value")), "_b")
    return left.select("information_date", "reference_date", "a_value").join(right.select("information_date", "reference_date", "b_value"), ["information_date", "reference_date"])


def availability_ledger(archive: DataFrame, as_of: Column, timezone: str = "America/New_York", max_release_lag_days: int = 92) -> DataFrame:
    """Every month between a series' first and last reference with status and reason.

    A vintage is visible at local midnight of the day after it, so only the
    prefix known at ``as_of`` counts.
    """
    known = F.to_utc_timestamp(F.date_add("vintage_date", 1).cast("timestamp"), timezone)
    first = first_release(archive.where(known <= as_of))
    months = gapless(archive, ["series_id"], "reference_date")
    full = months.join(first, KEY, "left").withColumn("release_lag_days", release_lag_days("reference_date", "release_date"))
    reason = F.when(F.col("release_date").isNull(), "not_released").when(F.col("release_lag_days") < 0, "before_period_end").when(F.col("release_lag_days") > max_release_lag_days, "too_late").otherwise("available")
    return full.select(*KEY, "release_date", F.when(reason == "available", F.col("value")).alias("value"), "release_lag_days", reason.alias("reason"))


def mature_vintages(features: DataFrame, horizons: list[int], cutoff: Column) -> DataFrame:
    """The vintages needed to judge revisions: release date plus each horizon, if known by the cutoff."""
    rows = features.select("series_id", "reference_date", "release_date", F.explode(F.array(*(F.lit(h) for h in horizons))).alias("horizon_months"))
    due = F.expr("add_months(release_date, horizon_months)")
    return rows.withColumn("mature_at", due).where(F.col("mature_at") <= cutoff)


def revision_errors(archive: DataFrame, features: DataFrame, scales: DataFrame, horizons: list[int], cutoff: Column, transform: str = "log_difference") -> DataFrame:
    """(revised - first) / frozen scale at each horizon, with status.

    The revised value is read from the latest snapshot at the horizon; ``scales``
    has one scale for each (series, reference). Snapshots are found by an
    as-of join on dates, cells by equi-joins.
    """
    due = mature_vintages(features.where("status = 'available'"), horizons, cutoff)
    snapshots = archive.select("series_id", "vintage_date").distinct()
    line = due.select("series_id", F.col("mature_at").alias("t")).distinct()
    both = line.withColumn("v", F.lit(None).cast("date")).unionByName(snapshots.select("series_id", F.col("vintage_date").alias("t"), F.col("vintage_date").alias("v")))
    past = Window.partitionBy("series_id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("snapshot", F.max("v").over(past)).where("v is null").select("series_id", F.col("t").alias("mature_at"), "snapshot")
    cell = archive.select("series_id", "reference_date", F.col("vintage_date").alias("snapshot"), F.col("value").alias("revised_level"))
    prior = cell.select("series_id", F.add_months("reference_date", 1).alias("reference_date"), "snapshot", F.col("revised_level").alias("revised_prior"))
    full = due.join(at, ["series_id", "mature_at"]).join(cell, [*KEY, "snapshot"], "left").join(prior, [*KEY, "snapshot"], "left")
    full = full.join(features.select(*KEY, "transformed_value"), KEY).join(scales, KEY, "left")
    revised = apply_transform(F.col("revised_level"), F.col("revised_prior"), transform)
    error = (revised - F.col("transformed_value")) / F.col("scale")
    status = F.when(revised.isNull(), "missing_revised_value").when(F.col("scale").isNull() | (F.col("scale") <= 0), "missing_scale").otherwise("available")
    return full.select(*KEY, "horizon_months", "mature_at", "snapshot", F.when(status == "available", error).alias("revision_error"), status.alias("status"))


def axis_revision_errors(errors: DataFrame, components: int) -> DataFrame:
    """Mean error per reference and horizon, only where all components have one."""
    ok = errors.groupBy("reference_date", "horizon_months").agg(F.avg("revision_error").alias("m"), F.count("revision_error").alias("n_components"))
    return ok.select("reference_date", "horizon_months", "n_components", F.when(F.col("n_components") == components, F.col("m")).alias("axis_error"))


def cumulative_availability(releases: DataFrame, components: int) -> DataFrame:
    """When each month's score was known: the latest release so far of every component, if all are there."""
    so_far = Window.partitionBy("series_id").orderBy("reference_date").rowsBetween(Window.unboundedPreceding, 0)
    known = releases.withColumn("known", F.max("release_date").over(so_far))
    months = known.groupBy("reference_date").agg(F.count("known").alias("n"), F.max("known").alias("m"))
    return months.select("reference_date", F.col("n").alias("n_components"), F.when(F.col("n") == components, F.col("m")).alias("score_available_at"))


def drop_archive_start(releases: DataFrame) -> DataFrame:
    """Without the references that an archive's first snapshot brought besides its latest."""
    first = F.min("release_date").over(Window.partitionBy("series_id"))
    latest = F.max("reference_date").over(Window.partitionBy("series_id", "release_date"))
    return releases.withColumns({"_f": first, "_l": latest}).where("release_date > _f or reference_date = _l").drop("_f", "_l")


def freshness(df: DataFrame, family: str, date: str, as_of: Column, most_days: int) -> DataFrame:
    """Age of each family's newest row and whether it is fresh."""
    out = df.groupBy(F.col(family).alias("family")).agg(F.max(date).alias("latest"), F.count("*").alias("n_rows"))
    age = F.datediff(as_of, "latest")
    return out.select("family", "latest", "n_rows", age.alias("age_days"), F.when(age <= most_days, "fresh").otherwise("stale").alias("status"))


def expected_missing(all_rows: DataFrame, found: DataFrame) -> DataFrame:
    """(series, reference) cells of the full calendar of ``all_rows`` that ``found`` lacks.

    The calendar, the distinct references, is one array; each series unfolds it.
    """
    months = all_rows.agg(F.collect_set("reference_date").alias("m")).scalar()
    expected = all_rows.select("series_id").distinct().select("series_id", F.explode(months).alias("reference_date"))
    return expected.join(found.select(*KEY), KEY, "left_anti")


def assert_cutoff(df: DataFrame, columns: list[str], cutoff: Column) -> DataFrame:
    """The rows; the query fails if one is later than the cutoff. Nothing is trimmed."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c) <= cutoff, F.lit(True))
    return df.where(F.assert_true(ok, F.lit(f"rows later than the cutoff in {', '.join(columns)}")).isNull())


def monthly_average_control(events: DataFrame, observations: DataFrame) -> DataFrame:
    """Per event the mean of the same month's observations that were public by the event's release.

    events: event_id, reference_date, release_date (dates). observations:
    reference_date, available_at (a date), value. Both sides are reduced to days
    of a month before they meet: running sums on the days of publication, one
    lookup for each day of release. Events without an observation are left out.
    """
    days = observations.groupBy(F.trunc("reference_date", "month").alias("_m"), F.col("available_at").alias("_d")).agg(F.count("value").alias("_n"), F.sum("value").alias("_s"))
    rows = events.withColumn("_m", F.trunc("reference_date", "month"))
    asked = rows.select("_m", F.col("release_date").alias("_d")).distinct().withColumn("_ask", F.lit(True))
    so_far = Window.partitionBy("_m").orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = days.join(asked, ["_m", "_d"], "full").withColumns({"n_observations": F.sum("_n").over(so_far), "_s": F.sum("_s").over(so_far)})
    known = both.where("_ask and n_observations > 0").select("_m", F.col("_d").alias("release_date"), "n_observations", (F.col("_s") / F.col("n_observations")).alias("control_value"))
    return rows.join(known, ["_m", "release_date"]).select("event_id", "n_observations", "control_value")


def paired_release(events: DataFrame, control: DataFrame, days: int = 7) -> DataFrame:
    """Responses with the control of the same publication whose reference is ``days`` later."""
    c = control.select(F.date_sub("reference_date", days).alias("reference_date"), "release_date", F.col("value").alias("control_value"))
    return events.join(c, ["reference_date", "release_date"], "left")


def axis_availability(releases: DataFrame, axes: dict[str, str]) -> DataFrame:
    """reference_date, axis, available_at: when each axis' score was known, NULL while a component is missing.

    axes: series -> axis. A component counts with its latest release so far.
    """
    axis = F.create_map(*(F.lit(x) for pair in axes.items() for x in pair))[F.col("series_id")]
    so_far = Window.partitionBy("series_id").orderBy("reference_date").rowsBetween(Window.unboundedPreceding, 0)
    known = releases.where(F.col("series_id").isin(list(axes))).select("reference_date", axis.alias("axis"), F.max("release_date").over(so_far).alias("known"))
    needed = F.create_map(*(F.lit(x) for a in dict.fromkeys(axes.values()) for x in (a, sum(v == a for v in axes.values()))))[F.col("axis")]
    months = known.groupBy("reference_date", "axis").agg(F.count("known").alias("_n"), F.max("known").alias("_m"))
    return months.select("reference_date", "axis", F.when(F.col("_n") == needed, F.col("_m")).alias("available_at"))


def timeline(sources: dict[str, DataFrame], start: Column, end: Column) -> DataFrame:
    """date, kinds: every date on which something happens, with month starts and month ends between ``start`` and ``end``.

    sources: kind -> a table of one date column.
    """
    months = next(iter(sources.values())).sparkSession.range(1).select(F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))).alias("m"))
    rows = months.select(F.explode(F.array(F.struct(F.col("m").alias("date"), F.lit("month_start").alias("kind")), F.struct(F.last_day("m").alias("date"), F.lit("month_end").alias("kind")))).alias("x")).select("x.*")
    for kind, df in sources.items():
        rows = rows.unionByName(df.select(F.col(df.columns[0]).alias("date"), F.lit(kind).alias("kind")))
    return rows.where(F.col("date").between(start, end)).groupBy("date").agg(F.array_join(F.sort_array(F.collect_set("kind")), "+").alias("kinds"))
