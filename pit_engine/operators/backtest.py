"""Holding periods, targets, simulation with costs, daily values and allocation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_sessions(prices: DataFrame, n: int) -> DataFrame:
    """Prices on dates on which all ``n`` tickers have a positive open and close."""
    ok = prices.where((F.col("open") > 0) & (F.col("close") > 0))
    counted = ok.withColumn("_n", F.count("*").over(Window.partitionBy("date")))
    return counted.where(F.col("_n") == n).drop("_n")


def execution_schedule(prices: DataFrame, n: int, period: Column, step: Column) -> DataFrame:
    """period, start_date, end_date, sessions: first common date of each period and of the next one.

    The last period is open-ended (end NULL), and so is one without a direct successor.
    """
    dates = complete_sessions(prices, n).select("date", period.alias("period")).distinct()
    first = dates.groupBy("period").agg(F.min("date").alias("start_date"), F.count("*").alias("trading_sessions"))
    w = Window.partitionBy().orderBy("period")
    nxt = first.withColumns({"_np": F.lead("period").over(w), "_nd": F.lead("start_date").over(w)})
    return nxt.select("period", "start_date", F.when(F.col("_np") == step, F.col("_nd")).alias("end_date"), "trading_sessions")


def holding_returns(prices: DataFrame, n: int, period: Column, step: Column) -> DataFrame:
    """First-open to next-first-open return per period and ticker; periods without an end are left out."""
    s = execution_schedule(prices, n, period, step).where("end_date is not null")
    o = prices.select("date", "ticker", "open")
    start = s.join(o.withColumnRenamed("date", "start_date").withColumnRenamed("open", "_o0"), "start_date")
    both = start.join(o.withColumnRenamed("date", "end_date").withColumnRenamed("open", "_o1"), ["end_date", "ticker"])
    return both.select("period", "ticker", "start_date", "end_date", "trading_sessions", (F.col("_o1") / F.col("_o0") - 1).alias("ret"))


def drift_weights(targets: DataFrame, returns: DataFrame) -> DataFrame:
    """Weights at the end of each period: w (1 + r) over their sum."""
    grown = targets.join(returns.select("period", "ticker", "start_date", "end_date", "ret"), ["period", "ticker"]).withColumn("_g", F.col("target_weight") * (1 + F.col("ret")))
    return grown.withColumn("drifted", F.col("_g") / F.sum("_g").over(Window.partitionBy("method", "period"))).drop("_g")


def simulate(targets: DataFrame, returns: DataFrame, costs: DataFrame | float) -> DataFrame:
    """One row per method and period: gross, turnover, cost, net and value after it.

    The pretrade weight of a period is the drifted target of the one before, so
    nothing is recursive: a lag per ticker is enough. The first trade starts
    from nothing.
    """
    d = drift_weights(targets, returns)
    own = Window.partitionBy("method", "ticker").orderBy("period")
    rate = F.lit(costs) if isinstance(costs, float) else F.col("cost_rate")
    d = d if isinstance(costs, float) else d.join(costs, "ticker")
    trade = F.abs(F.col("target_weight") - F.coalesce(F.lag("drifted").over(own), F.lit(0.0)))
    d = d.withColumns({"_trade": trade, "_rate": rate})
    p = d.groupBy("method", "period", "start_date", "end_date").agg(
        F.sum(F.col("target_weight") * F.col("ret")).alias("gross_return"),
        (F.sum("_trade") / 2).alias("one_way_turnover"),
        F.sum(F.col("_trade") * F.col("_rate")).alias("transaction_cost_rate"),
    )
    p = p.withColumn("net_return", (1 - F.col("transaction_cost_rate")) * (1 + F.col("gross_return")) - 1)
    run = Window.partitionBy("method").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("nav", F.exp(F.sum(F.ln(1 + F.col("net_return"))).over(run)))


def daily_nav(targets: DataFrame, simulation: DataFrame, prices: DataFrame) -> DataFrame:
    """method, date, phase_order, phase, period, nav: before and after each trade, at each close, and at the end."""
    own = Window.partitionBy("method").orderBy("period")
    s = simulation.select("method", "period", "start_date", "end_date", F.coalesce(F.lag("nav").over(own), F.lit(1.0)).alias("before"), "transaction_cost_rate", F.col("nav").alias("after_period"), F.lead("period").over(own).alias("_next"))
    s = s.withColumn("after", F.col("before") * (1 - F.col("transaction_cost_rate")))
    trade = s.select("method", F.col("start_date").alias("date"), "period", F.explode(F.array(F.struct(F.lit(0).alias("phase_order"), F.lit("pre_trade_open").alias("phase"), F.col("before").alias("nav")), F.struct(F.lit(1).alias("phase_order"), F.lit("post_trade_open").alias("phase"), F.col("after").alias("nav")))).alias("x")).select("method", "date", "x.phase_order", "x.phase", "period", "x.nav")
    last = s.where("_next is null").select("method", F.col("end_date").alias("date"), F.lit(0).alias("phase_order"), F.lit("terminal_open").alias("phase"), "period", F.col("after_period").alias("nav"))
    # Sessions are matched to their holding period by an exploded calendar of days, an equi-join.
    days = s.select("method", "period", "start_date", "after", F.explode(F.sequence("start_date", F.date_sub("end_date", 1))).alias("date"))
    held = days.join(targets.select("method", "period", "ticker", "target_weight"), ["method", "period"])
    held = held.join(prices.select("date", "ticker", "close"), ["date", "ticker"]).join(prices.select(F.col("date").alias("start_date"), "ticker", F.col("open").alias("_o0")), ["start_date", "ticker"])
    close = held.groupBy("method", "date", "period").agg(F.first("after").alias("after"), F.sum(F.col("target_weight") * F.col("close") / F.col("_o0")).alias("_r"))
    return trade.unionByName(last).unionByName(close.select("method", "date", F.lit(2).alias("phase_order"), F.lit("close").alias("phase"), "period", (F.col("after") * F.col("_r")).alias("nav")))


def performance(simulation: DataFrame, drawdown: DataFrame, periods_per_year: float) -> DataFrame:
    """Return, risk, drawdown and trading figures of each method."""
    k = periods_per_year
    net, gross = F.col("net_return"), F.col("gross_return")
    growth = lambda c: F.exp(F.sum(F.ln(1 + c)))
    m = simulation.groupBy("method").agg(
        F.count("*").alias("periods"),
        (growth(net) - 1).alias("total_return"),
        (F.pow(growth(net), k / F.count("*")) - 1).alias("cagr"),
        (F.pow(growth(gross), k / F.count("*")) - 1).alias("gross_cagr"),
        (F.stddev_samp(net) * k**0.5).alias("annualized_volatility"),
        (F.avg(net) * k).alias("_mean"),
        (F.sqrt(F.avg(F.pow(F.least(net, F.lit(0.0)), 2))) * k**0.5).alias("_down"),
        F.min(net).alias("worst_period"),
        F.max(net).alias("best_period"),
        F.avg((net > 0).cast("double")).alias("positive_fraction"),
        F.avg("one_way_turnover").alias("average_one_way_turnover"),
        F.sum("transaction_cost_rate").alias("sum_transaction_cost_rates"),
    )
    m = m.join(drawdown, "method", "left")
    out = m.withColumns({
        "annualized_cost_drag": F.col("gross_cagr") - F.col("cagr"),
        "sharpe_zero_rate": F.when(F.col("annualized_volatility") > 0, F.col("_mean") / F.col("annualized_volatility")),
        "sortino_zero_rate": F.when(F.col("_down") > 0, F.col("_mean") / F.col("_down")),
        "calmar_ratio": F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")),
    })
    return out.drop("_mean", "_down")


def equal_weight(tickers: Column) -> Column:
    """An array of (ticker, target_weight) with equal weights."""
    return F.transform(tickers, lambda t: F.struct(t.alias("ticker"), (F.lit(1.0) / F.size(tickers)).alias("target_weight")))


def shrunk_regime_means(labelled: DataFrame, kappa: float) -> DataFrame:
    """Per regime and ticker the mean shrunk towards the pooled mean by kappa observations."""
    pooled = labelled.groupBy("ticker").agg(F.avg("ret").alias("pooled_mean"))
    own = labelled.groupBy("regime_id", "ticker").agg(F.count("ret").alias("n"), F.avg("ret").alias("own_mean"))
    return own.join(pooled, "ticker").withColumn("shrunk_mean", (F.col("n") * F.col("own_mean") + kappa * F.col("pooled_mean")) / (F.col("n") + kappa))


def mixture_moments(means: DataFrame, posterior: DataFrame) -> DataFrame:
    """Posterior mean per ticker and its between-regime variance."""
    m = means.join(posterior, "regime_id").withColumn("w", F.col("p"))
    total = m.groupBy("ticker").agg(F.sum(F.col("w") * F.col("shrunk_mean")).alias("mixture_mean"), F.sum(F.col("w") * F.col("shrunk_mean") * F.col("shrunk_mean")).alias("_s"))
    return total.select("ticker", "mixture_mean", (F.col("_s") - F.col("mixture_mean") * F.col("mixture_mean")).alias("between_variance"))


def sharpe_weights(returns: DataFrame, minimum: int, annualization: float = 252.0, shift: float = 0.1) -> DataFrame:
    """Weights from shifted Sharpe scores of complete same-regime days; equal weights below ``minimum`` days."""
    s = returns.groupBy("ticker").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    s = s.withColumn("score", F.when((F.col("s") > 2.220446049250313e-16), annualization**0.5 * F.col("m") / F.col("s")).otherwise(0.0))
    every = Window.partitionBy()
    s = s.withColumn("shifted", F.col("score") + F.abs(F.min("score").over(every)) + shift)
    weight = F.when(F.min("n").over(every) < minimum, 1.0 / F.count("*").over(every)).otherwise(F.col("shifted") / F.sum("shifted").over(every))
    return s.select("ticker", "n", "score", weight.alias("target_weight"))


def blend(core: DataFrame, active: DataFrame, share: float, method: str) -> DataFrame:
    """(1 - share) of one set of weights and share of another; a ticker missing on one side weighs nothing there."""
    both = core.select("period", "ticker", F.col("target_weight").alias("_c")).join(active.select("period", "ticker", F.col("target_weight").alias("_a")), ["period", "ticker"], "full")
    w = (1 - share) * F.coalesce("_c", F.lit(0.0)) + share * F.coalesce("_a", F.lit(0.0))
    return both.select(F.lit(method).alias("method"), "period", "ticker", w.alias("target_weight"))


def concentration(targets: DataFrame) -> DataFrame:
    """Herfindahl index, effective number of holdings and largest weight."""
    h = F.sum(F.col("target_weight") * F.col("target_weight"))
    return targets.groupBy("method", "period").agg(h.alias("hhi"), (1 / h).alias("effective_holdings"), F.max("target_weight").alias("largest_weight"))


def feasibility(weights: DataFrame, caps: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Per method and period: sum, least weight, worst cap excess, and whether all constraints hold."""
    w = weights.join(caps, "ticker")
    a = w.groupBy("method", "period").agg(F.sum("target_weight").alias("weight_sum"), F.min("target_weight").alias("least_weight"), F.max(F.col("target_weight") - F.col("cap")).alias("worst_excess"))
    ok = (F.abs(F.col("weight_sum") - 1) <= tolerance) & (F.col("least_weight") >= -tolerance) & (F.col("worst_excess") <= tolerance)
    return a.withColumn("feasible", ok)


def pretrade_weights(targets: DataFrame, prices: DataFrame, signal: str = "signal_date") -> DataFrame:
    """Previous target drifted to the last close strictly before the signal."""
    from pit_engine.operators.asof import asof_join

    p = asof_join(targets, prices.select("ticker", "date", "close"), ["ticker"], signal, "date", ["close"], strict=True)
    p = p.join(prices.select("ticker", F.col("date").alias("entry_date"), F.col("open").alias("_o")), ["ticker", "entry_date"])
    p = p.withColumn("_v", F.col("target_weight") * F.col("close") / F.col("_o"))
    return p.withColumn("pretrade_weight", F.col("_v") / F.sum("_v").over(Window.partitionBy("method", signal))).drop("_v", "_o", "close")
