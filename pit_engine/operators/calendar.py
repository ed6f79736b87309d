"""Calendar keys: months and Monday weeks as dates, gapless calendars, release lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Step of a calendar and the key that a date falls into.
STEPS = {"month": "interval 1 month", "week": "interval 7 days", "day": "interval 1 day"}


def month(c: Column | str) -> Column:
    """First day of the month."""
    return F.trunc(c, "month")


def week(c: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(c, "week")


def add_months(c: Column | str, n: int) -> Column:
    """A calendar offset; never a row offset, so gaps are not bridged."""
    return F.add_months(c, n)


def release_lag_days(reference: Column | str, release: Column | str) -> Column:
    """Days from the end of the reference month to the release."""
    return F.datediff(release, F.last_day(reference))


def gapless(df: DataFrame, keys: list[str], date: str, step: str = "month") -> DataFrame:
    """One row per key and step between the key's first and last date."""
    ends = df.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(STEPS[step]))).alias(date))


def weekly_saturdays(start: Column, end: Column) -> Column:
    """All Saturdays from ``start`` to ``end`` as an array."""
    first = F.date_add(start, F.pmod(F.lit(5) - F.weekday(start), F.lit(7)))
    return F.when(first <= end, F.sequence(first, end, F.expr(STEPS["week"]))).otherwise(F.array().cast("array<date>"))
