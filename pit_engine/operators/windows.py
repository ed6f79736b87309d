"""Causal window features: each row sees earlier rows only, ties in time see each other never."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Machine epsilon of a double.
EPSILON = 2.220446049250313e-16


def lagged_expanding_moments(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """prior_n, prior_mean, prior_std (sample) over all earlier rows of the key."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({"prior_n": F.count(value).over(past), "prior_mean": F.avg(value).over(past), "prior_std": F.stddev_samp(value).over(past)})


def lagged_expanding_zscore(df: DataFrame, keys: list[str], order: str, value: str, min_periods: int = 60) -> DataFrame:
    """z against all earlier rows; NULL below ``min_periods`` values or without variation."""
    m = lagged_expanding_moments(df, keys, order, value)
    return m.withColumn("z", F.when((F.col("prior_n") >= min_periods) & (F.col("prior_std") > 0), (F.col(value) - F.col("prior_mean")) / F.col("prior_std")))


def group_causal_zscore(df: DataFrame, keys: list[str], date: str, value: str, min_history: int) -> DataFrame:
    """z against rows of strictly earlier dates: rows of one date never see each other.

    status: available, warmup (too few earlier values) or unidentified (no variation).
    """
    past = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(Window.unboundedPreceding, -1)
    m = df.withColumns({"prior_n": F.count(value).over(past), "prior_mean": F.avg(value).over(past), "prior_std": F.stddev_samp(value).over(past)})
    status = F.when(F.col("prior_n") < min_history, "warmup").when(F.coalesce(F.col("prior_std"), F.lit(0.0)) <= 0, "unidentified").otherwise("available")
    z = F.when(status == "available", (F.col(value) - F.col("prior_mean")) / F.col("prior_std"))
    return m.withColumns({"status": status, "z": z})


def group_causal_ar1(df: DataFrame, keys: list[str], reference: str, release: str, level: str, min_history: int, min_standardization: int) -> DataFrame:
    """One-step innovations of a log AR(1) fitted on earlier publications, standardised on earlier innovations.

    A pair (previous, current) enters the fit when the current value is
    published. Slope and intercept come from running sums over a RANGE frame,
    so each row costs what the frame's update costs, not a fit of its own. A
    history whose variation is rounding noise, machine epsilon times its sum of
    squares, doesn't identify a slope.
    """
    own = Window.partitionBy(*keys).orderBy(reference)
    y = df.withColumn("y", F.when(F.col(level) > 0, F.ln(level))).withColumn("y_prev", F.lag("y").over(own))
    past = Window.partitionBy(*keys).orderBy(F.unix_date(release)).rangeBetween(Window.unboundedPreceding, -1)
    pair = F.col("y").isNotNull() & F.col("y_prev").isNotNull()
    squares = F.sum(F.when(pair, F.col("y_prev") * F.col("y_prev"))).over(past)
    varies = F.regr_sxx("y", "y_prev").over(past) > EPSILON * F.greatest(F.lit(1.0), squares)
    fit = y.withColumns({
        "ar_n": F.count(F.when(pair, 1)).over(past),
        "ar_slope": F.when(varies, F.regr_slope("y", "y_prev").over(past)),
        "ar_intercept": F.when(varies, F.regr_intercept("y", "y_prev").over(past)),
    })
    forecast = F.col("ar_intercept") + F.col("ar_slope") * F.col("y_prev")
    e = fit.withColumn("innovation", F.when(F.col("ar_n") >= min_history, F.col("y") - forecast))
    s = e.withColumns({"innov_n": F.count("innovation").over(past), "innov_mean": F.avg("innovation").over(past), "innov_std": F.stddev_samp("innovation").over(past)})
    status = (
        F.when(F.col("y_prev").isNull() | (F.col("ar_n") < min_history), "ar_warmup")
        .when(F.col("ar_slope").isNull(), "ar_unidentified")
        .when(F.col("innov_n") < min_standardization, "standardization_warmup")
        .when(F.coalesce(F.col("innov_std"), F.lit(0.0)) <= 0, "standardization_unidentified")
        .otherwise("available")
    )
    z = F.when(status == "available", (F.col("innovation") - F.col("innov_mean")) / F.col("innov_std"))
    return s.withColumns({"status": status, "z": z})


def trailing_full_mean(df: DataFrame, keys: list[str], order: str, value: str, k: int) -> DataFrame:
    """Mean of the last ``k`` rows, only where all of them have a value."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(k - 1), 0)
    return df.withColumn("trailing_mean", F.when(F.count(value).over(w) == k, F.avg(value).over(w)))


def composite(wide: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Equal-weight mean that is NULL as soon as one component is."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return wide.withColumn(name, total / len(columns))


def jackknife_variance(values: list[Column]) -> Column:
    """Jackknife variance of the mean of a row's components: sample variance over n."""
    n = len(values)
    mean = sum(values[1:], values[0]) / n
    total = sum(((v - mean) * (v - mean) for v in values[1:]), (values[0] - mean) * (values[0] - mean))
    return total / (n - 1) / n


def successor_pairs(df: DataFrame, keys: list[str], month: str, values: list[str], available: str) -> DataFrame:
    """Rows with the following row; status valid only if it is exactly one month later and complete."""
    w = Window.partitionBy(*keys).orderBy(month)
    nxt = df.withColumns({"next_month": F.lead(month).over(w), "next_available": F.lead(available).over(w)} | {f"next_{v}": F.lead(v).over(w) for v in values})
    full = F.lit(True)
    for v in values:
        full = full & F.col(v).isNotNull() & F.col(f"next_{v}").isNotNull()
    status = F.when(F.col("next_month").isNull(), "no_successor").when(F.col("next_month") != F.add_months(month, 1), "calendar_gap").when(~full, "missing_value").otherwise("valid")
    known = F.when((status == "valid") & F.col(available).isNotNull() & F.col("next_available").isNotNull(), F.greatest(F.col(available), F.col("next_available")))
    return nxt.withColumns({"pair_status": status, "pair_available_at": known})


def total_returns(prices: DataFrame, keys: list[str], date: str, close: str, cash: str, split: str) -> DataFrame:
    """Daily total return, its index (first day 1), the split factor still to come and split-adjusted closes.

    The factor of a day is the product of all later splits: a close divided by
    it is comparable to the last one.
    """
    own = Window.partitionBy(*keys).orderBy(date)
    r = (F.col(close) * F.coalesce(F.col(split), F.lit(1.0)) + F.coalesce(F.col(cash), F.lit(0.0))) / F.lag(close).over(own) - 1
    out = prices.withColumn("total_return", r)
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    later = own.rowsBetween(1, Window.unboundedFollowing)
    factor = F.exp(F.coalesce(F.sum(F.ln(F.coalesce(F.col(split), F.lit(1.0)))).over(later), F.lit(0.0)))
    out = out.withColumn("total_return_index", F.exp(F.sum(F.ln(1 + F.coalesce("total_return", F.lit(0.0)))).over(running)))
    return out.withColumn("split_factor", factor).withColumn("split_adjusted_close", F.col(close) / F.col("split_factor"))


def complete_case_returns(prices: DataFrame, ticker: str, date: str, close: str, n: int) -> DataFrame:
    """Simple returns on dates on which all ``n`` tickers have one."""
    own = Window.partitionBy(ticker).orderBy(date)
    r = prices.withColumn("ret", F.col(close) / F.lag(close).over(own) - 1)
    return r.withColumn("_n", F.count("ret").over(Window.partitionBy(date))).where(F.col("_n") == n).drop("_n")


def max_drawdown(nav: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Least of value / running maximum - 1 for each key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return nav.withColumn("_d", F.col(value) / F.max(value).over(w) - 1).groupBy(*keys).agg(F.min("_d").alias("max_drawdown"))


def period_end_returns(prices: DataFrame, ticker: str, date: str, close: str, period: Column) -> DataFrame:
    """Return from the last session of a period to the last session of the next."""
    last = prices.groupBy(ticker, period.alias("period")).agg(F.max_by(close, date).alias("last_close"), F.max(date).alias("last_date"))
    own = Window.partitionBy(ticker).orderBy("period")
    return last.withColumn("period_return", F.col("last_close") / F.lag("last_close").over(own) - 1)


def level_transforms(levels: DataFrame, keys: str, date: str, value: str, transforms: dict[str, str]) -> DataFrame:
    """Monthly changes of levels that share one vintage: ``transformed``, by each series' own transform.

    transforms: series -> log_difference, difference, negative_difference or
    level. The month before has to be there; a gap gives no change.
    """
    from pit_engine.operators.vintages import apply_transform

    own = Window.partitionBy(keys).orderBy(date)
    prior = F.when(F.lag(date).over(own) == F.add_months(date, -1), F.lag(value).over(own))
    out = F.lit(None).cast("double")
    for series, how in transforms.items():
        out = F.when(F.col(keys) == series, apply_transform(F.col(value), F.col("_prior"), how)).otherwise(out)
    return levels.withColumn("_prior", prior).withColumn("transformed", out).drop("_prior")


def composite_features(levels: DataFrame, keys: str, date: str, value: str, transforms: dict[str, str], axes: dict[str, str], minimum: int, window: int) -> DataFrame:
    """date, axis, score, smoothed: composites of one vintage's levels, by transform, lagged z-score, mean and trailing mean."""
    z = lagged_expanding_zscore(level_transforms(levels, keys, date, value, transforms), [keys], date, "transformed", minimum)
    axis = F.create_map(*(F.lit(x) for pair in axes.items() for x in pair))[F.col(keys)]
    needed = F.create_map(*(F.lit(x) for a in dict.fromkeys(axes.values()) for x in (a, sum(v == a for v in axes.values()))))[F.col("axis")]
    scores = z.where(F.col(keys).isin(list(axes))).groupBy(date, axis.alias("axis")).agg(F.count("z").alias("_n"), F.avg("z").alias("_m"))
    scores = scores.select(date, "axis", F.when(F.col("_n") == needed, F.col("_m")).alias("score"))
    return trailing_full_mean(scores, ["axis"], date, "score", window).withColumnRenamed("trailing_mean", "smoothed")
