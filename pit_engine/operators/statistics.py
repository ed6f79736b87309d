"""Forecast scores, multiple-testing corrections, serial and cross dependence, comparisons and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pit_engine.operators.asof import clean


def long_probabilities(df: DataFrame, classes: list[str], keys: list[str], target: str) -> DataFrame:
    """One row per (key, class): ord, p, hit (the class is the target)."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(c).alias("cls"), F.col(c).alias("p")) for k, c in enumerate(classes)))).alias("x")
    return df.select(*keys, F.col(target).alias("target"), cells).select(*keys, "target", "x.*").withColumn("hit", (F.col("cls") == F.col("target")).cast("int"))


def proper_scores(df: DataFrame, classes: list[str], target: str, by: list[str]) -> DataFrame:
    """Log loss (infinite at zero), Brier score and accuracy of the most probable class (ties: the first)."""
    p = F.lit(None).cast("double")
    for c in classes:
        p = F.when(F.col(target) == c, F.col(c)).otherwise(p)
    loss = F.when(p > 0, -F.ln(p)).otherwise(float("inf"))
    brier = sum((F.pow(F.col(c) - (F.col(target) == c).cast("double"), 2) for c in classes), F.lit(0.0))
    best = F.greatest(*classes)
    top = F.lit(None).cast("string")
    for c in reversed(classes):
        top = F.when(F.col(c) == best, c).otherwise(top)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(loss).alias("log_loss"), F.avg(brier).alias("brier"), F.avg((top == F.col(target)).cast("double")).alias("map_accuracy"))


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Macro recall over the classes that occur and macro F1 over those that occur or are predicted."""
    t = df.groupBy(F.col(truth).alias("cls")).agg(F.count("*").alias("support"), F.sum((F.col(truth) == F.col(predicted)).cast("int")).alias("tp"))
    p = df.groupBy(F.col(predicted).alias("cls")).agg(F.count("*").alias("predicted"))
    c = t.join(p, "cls", "full").na.fill(0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    return c.agg(F.avg(recall).alias("macro_recall"), F.avg(2 * F.col("tp") / (F.col("support") + F.col("predicted"))).alias("macro_f1"))


def calibration_bins(df: DataFrame, by: list[str], p: str, hit: str, bins: int) -> DataFrame:
    """Equal-width bins, the last one closed: n, mean probability, hit rate; empty bins are kept."""
    b = F.least(F.floor(F.col(p) * bins).cast("int"), F.lit(bins - 1))
    got = df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_probability"), F.avg(F.col(hit).cast("double")).alias("hit_rate"))
    grid = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(got, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(bins: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute gap between probability and hit rate, weighted by the bins' rows."""
    gap = F.col("n") * F.abs(F.col("mean_probability") - F.col("hit_rate"))
    return bins.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def holm(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """Holm's step-down adjustment: running maximum of min(1, (n - rank) p)."""
    order = Window.partitionBy(*by).orderBy(p, tie)
    n = F.count("*").over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), (n - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("holm_p", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """q values: running minimum of n p / rank from the largest p down."""
    order = Window.partitionBy(*by).orderBy(p, tie)
    n = F.count("*").over(Window.partitionBy(*by))
    step = df.withColumns({"_s": n * F.col(p) / F.row_number().over(order), "_r": F.row_number().over(order)})
    down = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("bh_q", F.least(F.lit(1.0), F.min("_s").over(down))).drop("_s", "_r")


def ljung_box(df: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """Ljung-Box statistic n (n + 2) sum r_k^2 / (n - k): each row meets its lags once, in one window."""
    centred = df.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    own = Window.partitionBy(*keys).orderBy(order)
    lagged = centred.select(*keys, "_x", *(F.lag("_x", k).over(own).alias(f"_l{k}") for k in range(1, lags + 1)))
    s = lagged.groupBy(*keys).agg(F.count("_x").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("_v"), *(F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)))
    q = sum((F.pow(F.col(f"_c{k}") / F.col("_v"), 2) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return s.select(*keys, "n", (F.col("n") * (F.col("n") + 2) * q).alias("q_statistic"))


def lagged_correlation(df: DataFrame, series: str, date: str, value: str, lags: list[int], minimum: int) -> DataFrame:
    """Pearson correlation of each ordered pair of series at day lags, by equi-joins on shifted dates."""
    left = df.select(F.col(series).alias("a"), F.col(date).alias("_d"), F.col(value).alias("x"))
    right = df.select(F.col(series).alias("b"), F.col(date).alias("_e"), F.col(value).alias("y"), F.explode(F.array(*(F.lit(k) for k in lags))).alias("lag"))
    right = right.withColumn("_d", F.date_sub("_e", F.col("lag")))
    both = left.join(right, "_d").where("a <> b")
    c = both.groupBy("a", "b", "lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("correlation"))
    return c.where(F.col("n") >= minimum)


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks with ties sharing their mean."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of two columns."""
    r = average_ranks(average_ranks(df, by, x, "_rx"), by, y, "_ry")
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("spearman"))


#: Modulus and multipliers of the generator of block starts (fixed values).
MODULUS, MULTIPLIERS = 2_147_483_647, (48_271, 16_807)


def block_starts(groups: DataFrame, by: list[str], resamples: int, block: int) -> DataFrame:
    """by, n, resample, k, start: circular block starts in 0..n-1, as many blocks as a group's ``n`` positions need.

    Starts come from the numbers of resample and block alone, so groups of one
    length share them and any engine gets the same ones.
    """
    a, b = MULTIPLIERS
    grid = groups.select(*by, F.col("n").cast("bigint").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(resamples - 1).cast("bigint"))).alias("resample"))
    grid = grid.select(*by, "n", "resample", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("k"))
    x = (1 + 7919 * F.col("resample") + 104_729 * F.col("k")) % MODULUS * a % MODULUS
    y = x * x % MODULUS * b % MODULUS
    return grid.select(*by, "n", "resample", "k", F.floor(y * F.col("n") / MODULUS).alias("start"))


def block_bootstrap(differences: DataFrame, by: list[str], starts: DataFrame, block: int) -> DataFrame:
    """by, resample, mean_d: the mean of each resample of circular blocks.

    differences: by, position (0-based), d. Every start is unfolded to its block; the positions wrap around.
    """
    at = starts.select(*by, "n", "resample", "k", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j"))
    at = at.where(F.col("k") * block + F.col("j") < F.col("n")).select(*by, "resample", ((F.col("start") + F.col("j")) % F.col("n")).alias("position"))
    return at.join(differences, [*by, "position"]).groupBy(*by, "resample").agg(F.avg("d").alias("mean_d"))


def paired_inference(differences: DataFrame, by: list[str], resamples: int, block: int, periods_per_year: float) -> DataFrame:
    """Per group: n, mean difference, naive t, information ratio, and the block bootstrap's interval and share above zero."""
    base = differences.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("_s"))
    m = block_bootstrap(differences, by, block_starts(base.where("n > 0"), by, resamples, block), block)
    boot = m.groupBy(*by).agg(F.expr("percentile(mean_d, 0.025)").alias("ci_lower"), F.expr("percentile(mean_d, 0.975)").alias("ci_upper"), F.avg((F.col("mean_d") > 0).cast("double")).alias("share_positive"))
    t = F.when(F.col("_s") > 0, F.col("mean_difference") / F.col("_s") * F.sqrt("n"))
    ir = F.when(F.col("_s") > 0, F.col("mean_difference") / F.col("_s") * periods_per_year**0.5)
    return base.join(boot, by).select(*by, "n", "mean_difference", t.alias("naive_t"), ir.alias("information_ratio"), "ci_lower", "ci_upper", "share_positive")


def evaluation_summary(df: DataFrame, by: list[str], error: str, score: str) -> DataFrame:
    """n, bias, RMSE, median absolute error and mean score of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(error).alias("bias"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"), F.expr(f"percentile(abs({error}), 0.5)").alias("median_abs_error"), F.avg(score).alias("mean_score"))


def in_subperiods(df: DataFrame, date: str, spans: dict[str, tuple[str | None, str | None]]) -> DataFrame:
    """Rows once for each span that holds their date, with its name in ``period``; spans may overlap, ends are exclusive."""
    inside = lambda lo, hi: (F.col(date) >= F.lit(lo).cast("date") if lo else F.lit(True)) & (F.col(date) < F.lit(hi).cast("date") if hi else F.lit(True))
    names = F.array_compact(F.array(*(F.when(inside(lo, hi), F.lit(name)) for name, (lo, hi) in spans.items())))
    return df.withColumn("period", F.explode(names))


def paired_comparison(df: DataFrame, keys: list[str], variant: str, baseline: str, value: str) -> DataFrame:
    """Mean difference of each variant to the baseline on keys where both have a value, and the share of wins (smaller is better)."""
    b = df.where(F.col(variant) == baseline).select(*keys, F.col(value).alias("_b"))
    both = df.where(F.col(variant) != baseline).join(b, keys).where(F.col(value).isNotNull() & F.col("_b").isNotNull())
    return both.groupBy(variant).agg(F.count("*").alias("n"), F.avg(F.col(value) - F.col("_b")).alias("mean_difference"), F.avg((F.col(value) < F.col("_b")).cast("double")).alias("win_share"))


def invariance(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """Rows by status when two keyed frames are compared: same, changed, left_only, right_only."""
    l = left.select(*keys, *(F.col(v).alias(f"_l_{v}") for v in values), F.lit(1).alias("_l"))
    r = right.select(*keys, *(F.col(v).alias(f"_r_{v}") for v in values), F.lit(1).alias("_r"))
    same = F.lit(True)
    for v in values:
        a, b = F.col(f"_l_{v}"), F.col(f"_r_{v}")
        same = same & (a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(same, "same").otherwise("changed")
    return l.join(r, keys, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def reconcile_prices(bars: DataFrame, tolerance_bps: float) -> DataFrame:
    """Adjusted against cash returns by session, in basis points, with a status."""
    own = Window.partitionBy("ticker").orderBy("date")
    cash = (F.col("close") + F.coalesce("cash", F.lit(0.0))) / F.lag("close").over(own) - 1
    adjusted = F.col("adjusted_close") / F.lag("adjusted_close").over(own) - 1
    gap = (clean(adjusted) - clean(cash)) * 10_000
    d = bars.withColumn("gap_bps", gap)
    return d.withColumn("status", F.when(F.col("gap_bps").isNull(), "no_prior_session").when(F.abs("gap_bps") <= tolerance_bps, "reconciled").otherwise("mismatch"))


def status_counts(df: DataFrame, by: list[str], status: str) -> DataFrame:
    """Rows of each status by group, with their share."""
    c = df.groupBy(*by, status).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def probability_distance(p: list[Column], q: list[Column], clip: float = 1e-15) -> dict[str, Column]:
    """Cross-entropy, Brier distance and KL of a forecast q to a target p, clipped."""
    c = [F.greatest(x, F.lit(clip)) for x in q]
    zero = F.lit(0.0)
    return {
        "cross_entropy": -sum((a * F.ln(b) for a, b in zip(p, c, strict=True)), zero),
        "brier": sum(((a - b) * (a - b) for a, b in zip(p, q, strict=True)), zero),
        "kl": sum((F.when(a > 0, a * (F.ln(F.greatest(a, F.lit(clip))) - F.ln(b))).otherwise(0.0) for a, b in zip(p, c, strict=True)), zero),
    }
