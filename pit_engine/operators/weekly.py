"""Weekly signals, causal regime-return models, targets and the diagnostics of allocation rules."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pit_engine.operators.asof import asof_join
from pit_engine.operators.regimes import REGIMES


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def select_signals(marginals: DataFrame, weeks: DataFrame, variant: str) -> DataFrame:
    """Each reference week with the newest signal on or before its Monday, at the signal's newest reference month.

    marginals: variant_id, signal_date, reference_month and a probability p_* for
    each regime. The query fails on an improper vector, a month after the
    signal's, or two rows of one signal and month.
    """
    names = [f"p_{r.lower()}" for r in REGIMES]
    own = marginals.where(F.col("variant_id") == variant)
    once = F.count("*").over(Window.partitionBy("signal_date", "reference_month"))
    p = [F.col(n) for n in names]
    ok = (F.abs(_total(p) - 1) <= 1e-8) & (F.least(*p) >= 0) & (F.col("reference_month") <= F.trunc("signal_date", "month")) & (F.col("_n") == 1)
    own = own.withColumn("_n", once).where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("a decision marginal is improper, repeated or of a future month")).isNull())
    newest = own.groupBy("signal_date").agg(F.max_by(F.struct("reference_month", *names), "reference_month").alias("s")).select(F.lit(1).alias("_all"), "signal_date", F.col("signal_date").alias("_at"), "s.*")
    found = asof_join(weeks.select("reference_week", F.lit(1).alias("_all")), newest, ["_all"], "reference_week", "_at", ["signal_date", "reference_month", *names], strict=False)
    return found.where("signal_date is not null").drop("_all")


def estimator_history(returns: DataFrame) -> DataFrame:
    """Weekly returns without a leading week that the source's first day cuts short.

    returns: period (a Monday), start_date, ...; history begins with the first
    Monday on or after the first common open.
    """
    first = returns.agg(F.min("start_date").alias("d"))
    anchor = first.select(F.when(F.trunc("d", "week") < F.col("d"), F.date_add(F.trunc("d", "week"), 7)).otherwise(F.col("d")).alias("a")).scalar()
    return returns.where(F.col("period") >= anchor)


def labelled_returns(returns: DataFrame, history: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """cutoff, period, ticker, ret, regime_id: what was known at each cutoff.

    A period has the label of the month that holds its first day; return and
    label both have to be available on or before the cutoff.
    """
    h = history.where("regime_id is not null").select(F.col("month").alias("_m"), "regime_id", "label_available_at")
    rows = returns.withColumn("_m", F.trunc("period", "month")).join(h, "_m")
    known = rows.join(cutoffs, (F.col("end_date") <= F.col("cutoff")) & (F.col("label_available_at") <= F.col("cutoff")))
    return known.select("cutoff", "period", "ticker", "ret", "regime_id")


def regime_return_model(rows: DataFrame, kappa: float) -> dict[str, DataFrame]:
    """Means per regime, shrunk towards the global mean by ``kappa`` periods, and one covariance within regimes.

    rows: those of ``labelled_returns``, complete in tickers. The covariance is a
    Ledoit-Wolf estimate of residuals around the regimes' own means, from sums
    of products alone. Tables: means (cutoff, regime_id, ticker, n, sample_mean,
    global_mean, mean), covariance (cutoff, a, b, n, shrinkage, c).
    """
    overall = rows.groupBy("cutoff", "ticker").agg(F.avg("ret").alias("global_mean"))
    own = rows.groupBy("cutoff", "regime_id", "ticker").agg(F.count("*").alias("n"), F.avg("ret").alias("_m"))
    grid = overall.select("*", F.explode(F.array(*(F.lit(r) for r in REGIMES))).alias("regime_id"))
    means = grid.join(own, ["cutoff", "regime_id", "ticker"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sample = F.coalesce("_m", "global_mean")
    means = means.select("cutoff", "regime_id", "ticker", "n", sample.alias("sample_mean"), "global_mean", F.when(F.col("n") == 0, F.col("global_mean")).otherwise((F.col("n") * sample + kappa * F.col("global_mean")) / (F.col("n") + kappa)).alias("mean"))
    e = rows.join(means.select("cutoff", "regime_id", "ticker", "sample_mean"), ["cutoff", "regime_id", "ticker"]).select("cutoff", "period", "ticker", (F.col("ret") - F.col("sample_mean")).alias("e"))
    squares = e.groupBy("cutoff", "period").agg(F.sum(F.col("e") * F.col("e")).alias("s")).groupBy("cutoff").agg(F.count("*").alias("n"), F.avg(F.col("s") * F.col("s")).alias("_q"))
    pairs = e.select("cutoff", "period", F.col("ticker").alias("a"), F.col("e").alias("x")).join(e.select("cutoff", "period", F.col("ticker").alias("b"), F.col("e").alias("y")), ["cutoff", "period"])
    s = pairs.groupBy("cutoff", "a", "b").agg(F.avg(F.col("x") * F.col("y")).alias("s"))
    shape = s.groupBy("cutoff").agg(F.sum(F.col("s") * F.col("s")).alias("_norm"), F.count_if(F.col("a") == F.col("b")).alias("_d"), F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("_trace")).join(squares, "cutoff")
    d, norm, mu = F.col("_d"), F.col("_norm"), F.col("_trace") / F.col("_d")
    delta, beta = (norm - d * mu * mu) / d, (F.col("_q") - norm) / (d * F.col("n"))
    shape = shape.select("cutoff", "n", mu.alias("_mu"), F.when((d == 1) | (delta <= 0), 0.0).otherwise(F.greatest(F.least(beta, delta), F.lit(0.0)) / delta).alias("shrinkage"))
    c = (1 - F.col("shrinkage")) * F.col("s") + F.when(F.col("a") == F.col("b"), F.col("shrinkage") * F.col("_mu")).otherwise(0.0)
    return {"means": means, "covariance": s.join(shape, "cutoff").select("cutoff", "a", "b", "n", "shrinkage", c.alias("c"))}


def mixture(model: dict[str, DataFrame], posterior: DataFrame, value: str = "mean") -> dict[str, DataFrame]:
    """Moments of the mixture over regimes: expected returns, and the covariance within plus between regimes.

    posterior: cutoff, regime_id, p.
    """
    m = model["means"].join(posterior, ["cutoff", "regime_id"]).select("cutoff", "regime_id", "ticker", "p", F.col(value).alias("m"))
    expected = m.groupBy("cutoff", "ticker").agg(F.sum(F.col("p") * F.col("m")).alias("expected_return"))
    gap = m.join(expected, ["cutoff", "ticker"]).select("cutoff", "regime_id", "p", "ticker", (F.col("m") - F.col("expected_return")).alias("g"))
    pairs = gap.select("cutoff", "regime_id", "p", F.col("ticker").alias("a"), F.col("g").alias("x")).join(gap.select("cutoff", "regime_id", F.col("ticker").alias("b"), F.col("g").alias("y")), ["cutoff", "regime_id"])
    between = pairs.groupBy("cutoff", "a", "b").agg(F.sum(F.col("p") * F.col("x") * F.col("y")).alias("between"))
    total = model["covariance"].join(between, ["cutoff", "a", "b"]).select("cutoff", "a", "b", F.col("c").alias("within"), "between", (F.col("c") + F.col("between")).alias("covariance"))
    return {"expected": expected, "covariance": total}


def pooled(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The moments without a view on the regime: the regimes' frequencies over their own sample means."""
    n = model["means"].select("cutoff", "regime_id", "n").distinct()
    frequency = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cutoff"))).drop("n")
    return mixture(model, frequency, "sample_mean")


def dynamic_targets(returns: DataFrame, history: DataFrame, signals: DataFrame, specifications: dict[str, tuple[float, float, float]], minimum: int, cap: float, cost: float, annualization: float = 52.0, group_caps: list[tuple[list[str], float]] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Targets of each specification at each signal: model at the day before, mixture moments, then the allocator.

    specifications: method -> (kappa, volatility cap, cap multiplier). The model
    is relational and fitted once for each (cutoff, kappa); the loop over weeks
    is a fold, since a trade starts from the last target, drifted. Specifications
    run in parallel. ``keep`` may persist the tables that are read several times
    (calendars of cutoffs, regimes and tickers).
    """
    cut = signals.select(F.date_sub("signal_date", 1).alias("cutoff")).distinct()
    known = keep(labelled_returns(returns, history, cut))
    names = [f"p_{r.lower()}" for r in REGIMES]
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("regime_id"), F.col(n).alias("p")) for r, n in zip(REGIMES, names, strict=True)))).alias("x")
    posterior = signals.select(F.date_sub("signal_date", 1).alias("cutoff"), each).select("cutoff", "x.*").distinct()
    parts = []
    for kappa in sorted({s[0] for s in specifications.values()}):
        model = {k: keep(v) for k, v in regime_return_model(known, kappa).items()}
        mix = mixture(model, posterior)
        cells = mix["covariance"].groupBy("cutoff").agg(F.sort_array(F.collect_list(F.struct("a", "b", "covariance"))).alias("cov"))
        mu = mix["expected"].groupBy("cutoff").agg(F.sort_array(F.collect_list(F.struct("ticker", "expected_return"))).alias("mu"))
        parts.append(cells.join(mu, "cutoff").withColumn("kappa", F.lit(float(kappa))))
    moments = parts[0]
    for p in parts[1:]:
        moments = moments.unionByName(p)
    enough = known.groupBy("cutoff").agg(F.countDistinct("period").alias("n"))
    held = returns.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("ticker", "ret"))).alias("held"))
    rows = signals.withColumn("cutoff", F.date_sub("signal_date", 1)).join(moments, "cutoff").join(enough, "cutoff").join(held.withColumnRenamed("period", "reference_week"), "reference_week", "left")
    spec = F.explode(F.array(*(F.struct(F.lit(k).alias("method"), F.lit(float(a)).alias("kappa"), F.lit(float(v)).alias("vol_cap"), F.lit(float(m)).alias("multiplier")) for k, (a, v, m) in specifications.items()))).alias("s")
    rows = rows.select("*", spec).where("s.kappa = kappa").select("reference_week", "n", "mu", "cov", "held", "s.method", "s.vol_cap", "s.multiplier")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from pit_engine.functions import numerics as N

        before, out = None, []
        for r in pdf.sort_values("reference_week").itertuples():
            tickers = [x["ticker"] for x in r.mu]
            d = len(tickers)
            before = np.full(d, 1.0 / d) if before is None else before
            status, w = "insufficient_observations", before
            if r.n >= minimum:
                cov = np.array([x["covariance"] for x in r.cov], float).reshape(d, d) * annualization
                limits = np.minimum(1.0, np.full(d, cap) * r.multiplier)
                groups = [(np.array([t in members for t in tickers], float), min(1.0, most * r.multiplier)) for members, most in group_caps or []]
                w, status = N.allocate(np.array([x["expected_return"] for x in r.mu]), cov, before, limits, groups, np.full(d, cost), r.vol_cap)
                w = np.maximum(w, 0) / np.maximum(w, 0).sum()
            out += [(key[0], r.reference_week, t, float(x), status) for t, x in zip(tickers, w, strict=True)]
            if r.held is not None and len(r.held) == d:
                grown = w * (1 + np.array([x["ret"] for x in r.held]))
                before = grown / grown.sum()
            else:
                before = w
        return pd.DataFrame(out, columns=["method", "period", "ticker", "target_weight", "status"])

    return rows.groupBy("method").applyInPandas(run, "method string, period date, ticker string, target_weight double, status string")


def benchmark_targets(periods: DataFrame, tickers: list[str], static: dict[str, float]) -> DataFrame:
    """method, period, ticker, target_weight of the equal-weight and a fixed allocation."""
    cells = [F.struct(F.lit(m).alias("method"), F.lit(t).alias("ticker"), F.lit(w).alias("target_weight")) for m, ws in (("equal_weight", dict.fromkeys(tickers, 1.0 / len(tickers))), ("static", {t: static.get(t, 0.0) for t in tickers})) for t, w in ws.items()]
    return periods.select("period", F.explode(F.array(*cells)).alias("x")).select("x.method", "period", "x.ticker", "x.target_weight")


def sensitivity(metrics: DataFrame, baseline: str, names: list[str]) -> DataFrame:
    """Each method's metrics and their differences to the baseline's."""
    base = metrics.where(F.col("method") == baseline).select(*(F.col(n).alias(f"_{n}") for n in names))
    # The baseline is one row.
    return metrics.join(base).select("method", *names, *((F.col(n) - F.col(f"_{n}")).alias(f"delta_{n}") for n in names))


def compare_universes(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Metrics of methods that two universes share: both values and their difference."""
    a = left.select("method", *(F.col(n).alias(f"left_{n}") for n in names))
    b = right.select("method", *(F.col(n).alias(f"right_{n}") for n in names))
    return a.join(b, "method").select("*", *((F.col(f"left_{n}") - F.col(f"right_{n}")).alias(f"delta_{n}") for n in names))


def oracle_window(weeks: DataFrame, history: DataFrame) -> DataFrame:
    """The weeks before the first one whose month never got a label, with the label and whether it was known at the signal.

    weeks: reference_week, signal_date, reference_month. For diagnostics with
    hindsight only: the label is the one that was published later.
    """
    truth = history.where("regime_id is not null").select(F.col("month").alias("reference_month"), F.col("regime_id").alias("oracle_regime_id"), "label_available_at")
    rows = weeks.join(truth, "reference_month", "left")
    stop = rows.where("oracle_regime_id is null").agg(F.min("reference_week").alias("stop")).scalar()
    kept = rows.where(F.coalesce(F.col("reference_week") < stop, F.lit(True)))
    return kept.select("reference_week", "signal_date", "reference_month", "oracle_regime_id", (F.col("label_available_at") <= F.col("signal_date")).alias("available_at_signal"))


def regime_attribution(simulation: DataFrame, truth: DataFrame, method: str, baseline: str, periods_per_year: float) -> DataFrame:
    """By realized regime: periods, annualised net and gross difference of two methods, tracking error, information ratio, share won."""
    side = lambda m, x: simulation.where(F.col("method") == m).select("period", F.col("net_return").alias(f"{x}n"), F.col("gross_return").alias(f"{x}g"))
    d = side(method, "a").join(side(baseline, "b"), "period").join(truth, "period").select("regime_id", (F.col("an") - F.col("bn")).alias("n"), (F.col("ag") - F.col("bg")).alias("g"))
    m = d.groupBy("regime_id").agg(F.count("*").alias("periods"), (F.avg("n") * periods_per_year).alias("net_difference"), (F.avg("g") * periods_per_year).alias("gross_difference"), (F.stddev_samp("n") * periods_per_year**0.5).alias("tracking_error"), F.avg((F.col("n") > 0).cast("double")).alias("positive_share"))
    return m.withColumn("information_ratio", F.when(F.col("tracking_error") > 0, F.col("net_difference") / F.col("tracking_error")))


def utilization(targets: DataFrame, caps: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """By method and ticker: mean, largest and least weight, periods, shares above one per cent and at the cap."""
    w = targets.join(caps, "ticker", "left")
    return w.groupBy("method", "ticker").agg(
        F.avg("target_weight").alias("average_weight"), F.max("target_weight").alias("largest_weight"), F.min("target_weight").alias("least_weight"), F.count("*").alias("periods"), F.max("cap").alias("cap"),
        F.avg((F.col("target_weight") > 0.01).cast("double")).alias("share_above_one_percent"), F.avg((F.abs(F.col("target_weight") - F.col("cap")) <= tolerance).cast("double")).alias("share_at_cap"))


def target_distance(targets: DataFrame, left: str, right: str) -> DataFrame:
    """period, half the sum of absolute differences between two methods' weights."""
    side = lambda m, x: targets.where(F.col("method") == m).select("period", "ticker", F.col("target_weight").alias(x))
    both = side(left, "x").join(side(right, "y"), ["period", "ticker"], "full")
    return both.groupBy("period").agg((0.5 * F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))).alias("half_l1_distance"))


def asset_diagnostics(returns: DataFrame, expected: DataFrame, periods_per_year: float) -> DataFrame:
    """By ticker: realized annual return, volatility and total return, and the average expected one.

    returns: period, ticker, ret. expected: cutoff, ticker, expected_return.
    """
    r = returns.groupBy("ticker").agg((F.avg("ret") * periods_per_year).alias("realized_return"), (F.stddev_samp("ret") * periods_per_year**0.5).alias("realized_volatility"), (F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1).alias("total_return"))
    e = expected.groupBy("ticker").agg((F.avg("expected_return") * periods_per_year).alias("expected_return"))
    return r.join(e, "ticker").withColumn("realized_minus_expected", F.col("realized_return") - F.col("expected_return"))


def risk_change(new: DataFrame, old: DataFrame) -> DataFrame:
    """By cutoff: how variances of the tickers in both covariance tables changed, relative to the old ones."""
    side = lambda df, x: df.where("a = b").select("cutoff", F.col("a").alias("ticker"), F.col("c").alias(f"{x}_c"), F.col("shrinkage").alias(f"{x}_shrinkage"))
    both = side(new, "new").join(side(old, "old"), ["cutoff", "ticker"]).withColumn("_r", F.abs(F.col("new_c") / F.col("old_c") - 1))
    return both.groupBy("cutoff").agg(F.count("*").alias("tickers"), F.max("old_shrinkage").alias("old_shrinkage"), F.max("new_shrinkage").alias("new_shrinkage"), F.avg("_r").alias("mean_relative_change"), F.max("_r").alias("largest_relative_change"))


def mean_parity(new: DataFrame, old: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row: common (cutoff, ticker) cells, the largest difference of expected returns; the query fails beyond the tolerance."""
    both = new.select("cutoff", "ticker", F.col("expected_return").alias("x")).join(old.select("cutoff", "ticker", F.col("expected_return").alias("y")), ["cutoff", "ticker"])
    out = both.agg(F.count("*").alias("cells"), F.max(F.abs(F.col("x") - F.col("y"))).alias("largest_difference"))
    return out.where(F.assert_true(F.coalesce(F.col("largest_difference") <= tolerance, F.lit(True)), F.lit("expected returns changed")).isNull())
