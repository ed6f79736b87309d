"""As-of joins, knowledge-time visibility and joins with checked cardinality.

As-of joins are a union of both sides and one ordered window per slice of a key:
linear in the rows after one shuffle, where a correlated lookup would be a nested
loop. A slice is a stretch of time of one key; it starts with the last value of
the slices before it, so a key with very many rows is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(c: Column | str) -> Column:
    """NULL instead of NaN or an infinity: missing stays missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def visible(df: DataFrame, available_at: str, cutoff: Column, boundary: str = "strict") -> DataFrame:
    """Rows known before the cutoff ("strict") or at it as well ("inclusive")."""
    known = F.col(available_at)
    return df.where(known < cutoff if boundary == "strict" else known <= cutoff)


#: Days of a slice of time of an as-of join.
SLICE_DAYS = 32


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], strict: bool = True, ties: list[str] | None = None, slice_days: int = SLICE_DAYS) -> DataFrame:
    """Left rows with the latest right row of their key before (strict) or up to their time.

    ``ties`` orders right rows of equal time; the last one wins. Left rows
    without an earlier right row get NULLs; right rows with a NULL value
    still count as the latest. Values get the names they have on the right.
    """
    names = [f"_l_{c}" for c in left.columns]
    probe = left.select(*(F.col(k) for k in keys), F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*(F.col(c).alias(n) for c, n in zip(left.columns, names, strict=True))).alias("_left"))
    tie = F.struct(*(F.col(c) for c in ties)) if ties else F.struct(F.lit(0).alias("x"))
    build = right.where(F.col(right_time).isNotNull()).select(*(F.col(k) for k in keys), F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), tie.alias("_tie"), F.struct(*(F.col(v) for v in values)).alias("_right"))
    part = lambda df: df.withColumn("_slice", F.floor(F.unix_date(F.to_date("_t")) / slice_days))
    probe, build = part(probe), part(build)
    # One row for each slice that has right rows: its last value opens the next slice that has any row.
    last = build.groupBy(*keys, "_slice").agg(F.max_by("_right", F.struct("_t", "_side", "_tie")).alias("_right"))
    slices = probe.select(*keys, "_slice").union(build.select(*keys, "_slice")).distinct().join(last, [*keys, "_slice"], "left")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = slices.select(*keys, "_slice", F.last("_right", ignorenulls=True).over(before).alias("_right")).where("_right is not null").withColumn("_first", F.lit(True))
    both = probe.unionByName(build, allowMissingColumns=True).unionByName(opening, allowMissingColumns=True)
    order = [F.asc_nulls_last("_first"), F.col("_t"), F.col("_side"), F.asc_nulls_first("_tie")]
    past = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(past)).where(F.col("_left").isNotNull())
    return found.select(*(F.col(f"_left.{n}").alias(c) for c, n in zip(left.columns, names, strict=True)), *(F.col(f"_hit.{v}").alias(v) for v in values))


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join that fails if a side declared unique has a key twice."""

    def unique(df: DataFrame, side: str) -> DataFrame:
        counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*on)))
        ok = F.assert_true(F.col("_n") == 1, F.lit(f"{side} keys are not unique: {', '.join(on)}"))
        return counted.where(ok.isNull()).drop("_n")

    if validate in ("one_to_one", "one_to_many"):
        left = unique(left, "left")
    if validate in ("one_to_one", "many_to_one"):
        right = unique(right, "right")
    return left.join(right, on, how)


def lagged_self_join(df: DataFrame, keys: list[str], date: str, months: int, values: list[str], suffix: str = "_prior") -> DataFrame:
    """Each row with the values of exactly ``months`` months earlier; a gap gives no row's values."""
    prior = df.select(*keys, F.add_months(date, months).alias(date), *(F.col(v).alias(f"{v}{suffix}") for v in values))
    return df.join(prior, [*keys, date], "left")


def unordered_pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each pair of rows once, the smaller key on the left: columns left_*, right_*.

    For dimensions of a bounded size only: the result has n (n - 1) / 2 rows.
    """
    left, right = (df.select(*(F.col(c).alias(f"{side}_{c}") for c in dict.fromkeys([key, *columns]))) for side in ("left", "right"))
    return left.join(right, F.col(f"left_{key}") < F.col(f"right_{key}"))


def compare_keyed(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Full outer comparison: key, both values and status same / changed / added / lost."""
    l, r = left.select(*keys, F.col(value).alias("left_value"), F.lit(1).alias("_l")), right.select(*keys, F.col(value).alias("right_value"), F.lit(1).alias("_r"))
    close = F.col("left_value").eqNullSafe(F.col("right_value")) | F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, F.lit(False))
    status = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "lost").when(close, "same").otherwise("changed")
    return l.join(r, keys, "full").select(*keys, "left_value", "right_value", status.alias("status"))
