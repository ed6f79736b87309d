"""Queries of holding periods, simulation, performance and allocation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from pit_engine.operators import backtest as B
from pit_engine.operators.windows import complete_case_returns, max_drawdown
from pit_engine.plans.inputs import PRICES, TICKERS, prices, shared
from pit_engine.plans.registry import query

N = len(TICKERS)
_SCHEDULE = f"""{PRICES.strip()},
full_ AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM prices WHERE open > 0 AND close > 0) WHERE n = {N}),
firsts AS (SELECT period, min(date) AS start_date, count(*) AS trading_sessions FROM (SELECT DISTINCT date, CAST(date_trunc('week', date) AS DATE) AS period FROM full_) GROUP BY period),
schedule AS (SELECT period, start_date, CASE WHEN lead(period) OVER w = period + 7 THEN lead(start_date) OVER w END AS end_date, trading_sessions FROM firsts WINDOW w AS (ORDER BY period)),
holding AS (SELECT s.period, a.ticker, start_date, end_date, trading_sessions, b.open / a.open - 1 AS ret FROM schedule s JOIN prices a ON a.date = start_date JOIN prices b ON b.date = end_date AND b.ticker = a.ticker),
tickers AS (SELECT DISTINCT ticker FROM holding),
targets AS (SELECT 'equal' AS method, period, ticker, 1.0::DOUBLE / {N} AS target_weight FROM (SELECT DISTINCT period FROM holding), tickers
  UNION ALL SELECT 'tilt', period, ticker, CASE ticker WHEN 'view' THEN 0.6::DOUBLE WHEN 'click' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END FROM (SELECT DISTINCT period FROM holding), tickers),
grown AS (SELECT t.*, start_date, end_date, ret, target_weight * (1 + ret) AS g FROM targets t JOIN holding h USING (period, ticker)),
drifted AS (SELECT *, g / sum(g) OVER (PARTITION BY method, period) AS drifted FROM grown),
trades AS (SELECT *, abs(target_weight - coalesce(lag(drifted) OVER (PARTITION BY method, ticker ORDER BY period), 0)) AS trade FROM drifted),
sim0 AS (SELECT method, period, start_date, end_date, sum(target_weight * ret) AS gross_return, sum(trade) / 2 AS one_way_turnover, sum(trade * 0.001::DOUBLE) AS transaction_cost_rate FROM trades GROUP BY ALL),
sim1 AS (SELECT *, (1 - transaction_cost_rate) * (1 + gross_return) - 1 AS net_return FROM sim0),
sim AS (SELECT *, exp(sum(ln(1 + net_return)) OVER (PARTITION BY method ORDER BY period)) AS nav FROM sim1),
s0 AS (SELECT *, coalesce(lag(nav) OVER w, 1) AS before, lead(period) OVER w AS nxt FROM sim WINDOW w AS (PARTITION BY method ORDER BY period)),
s1 AS (SELECT *, before * (1 - transaction_cost_rate) AS after FROM s0),
nav AS (SELECT method, start_date AS date, 0 AS phase_order, 'pre_trade_open' AS phase, period, before AS nav FROM s1
  UNION ALL SELECT method, start_date, 1, 'post_trade_open', period, after FROM s1
  UNION ALL SELECT method, end_date, 0, 'terminal_open', period, nav FROM s1 WHERE nxt IS NULL
  UNION ALL SELECT s1.method, c.date, 2, 'close', s1.period, any_value(after) * sum(t.target_weight * c.close / o.open) FROM s1 JOIN targets t ON t.method = s1.method AND t.period = s1.period
    JOIN prices c ON c.ticker = t.ticker AND c.date >= s1.start_date AND c.date < s1.end_date JOIN prices o ON o.ticker = t.ticker AND o.date = s1.start_date GROUP BY s1.method, c.date, s1.period)"""


def _weeks():
    """The period of a date, and the period after one."""
    return F.trunc("date", "week"), F.date_add("period", 7)


def holding(spark, sf_dir):
    return shared(B.holding_returns(prices(spark, sf_dir), N, *_weeks()))


def targets(spark, sf_dir):
    tilt = F.array(*(F.struct(F.lit(t).alias("ticker"), F.lit({"view": 0.6, "click": 0.4}.get(t, 0.0)).alias("target_weight")) for t in TICKERS))
    even = B.equal_weight(F.array(*(F.lit(t) for t in TICKERS)))
    each = lambda m, c: holding(spark, sf_dir).select("period").distinct().select(F.lit(m).alias("method"), "period", F.explode(c).alias("x")).select("method", "period", "x.*")
    return each("equal", even).unionByName(each("tilt", tilt))


def simulation(spark, sf_dir):
    return shared(B.simulate(targets(spark, sf_dir), holding(spark, sf_dir), 0.001))


def nav(spark, sf_dir):
    return B.daily_nav(targets(spark, sf_dir), simulation(spark, sf_dir), prices(spark, sf_dir))


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {_SCHEDULE} SELECT * FROM schedule")
def execution_schedule(spark, sf_dir):
    return B.execution_schedule(prices(spark, sf_dir), N, *_weeks())


@query(f"WITH {_SCHEDULE} SELECT period, ticker, start_date, end_date, trading_sessions, round(ret, 6) AS ret FROM holding")
def weekly_holding_returns(spark, sf_dir):
    return _r6(holding(spark, sf_dir), "ret")


@query("""WITH m AS (SELECT o_orderstatus AS ticker, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS open FROM orders GROUP BY ALL),
f AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS period FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM m) WHERE n = 3),
s AS (SELECT period, min(date) AS start_date, count(DISTINCT date) AS trading_sessions FROM f GROUP BY period),
e AS (SELECT *, CASE WHEN lead(period) OVER w = CAST(period + INTERVAL 1 MONTH AS DATE) THEN lead(start_date) OVER w END AS end_date FROM s WINDOW w AS (ORDER BY period))
SELECT e.period, a.ticker, start_date, end_date, trading_sessions, round(b.open / a.open - 1, 6) AS ret FROM e JOIN m a ON a.date = start_date JOIN m b ON b.date = end_date AND b.ticker = a.ticker""")
def monthly_holding_returns(spark, sf_dir):
    from pit_engine.plans.inputs import cents, table

    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg((F.sum(cents("o_totalprice")).cast("double") / F.count("*")).alias("open"))
    return _r6(B.holding_returns(o.withColumn("close", F.col("open")), 3, F.trunc("date", "month"), F.add_months("period", 1)), "ret")


@query(f"WITH {_SCHEDULE} SELECT method, period, ticker, round(drifted, 6) AS drifted FROM drifted")
def drift_weights(spark, sf_dir):
    return _r6(B.drift_weights(targets(spark, sf_dir), holding(spark, sf_dir)), "drifted").select("method", "period", "ticker", "drifted")


@query(f"WITH {_SCHEDULE} SELECT method, period, start_date, end_date, round(gross_return, 6) AS gross_return, round(one_way_turnover, 6) AS one_way_turnover, round(transaction_cost_rate, 6) AS transaction_cost_rate, round(net_return, 6) AS net_return, round(nav, 6) AS nav FROM sim")
def simulate_targets(spark, sf_dir):
    return _r6(simulation(spark, sf_dir), "gross_return", "one_way_turnover", "transaction_cost_rate", "net_return", "nav")


@query(f"WITH {_SCHEDULE} SELECT method, date, phase_order, phase, period, round(nav, 6) AS nav FROM nav")
def daily_nav(spark, sf_dir):
    return _r6(nav(spark, sf_dir), "nav")


_DRAWDOWN = "dd AS (SELECT method, min(d) AS max_drawdown FROM (SELECT method, nav / max(nav) OVER (PARTITION BY method ORDER BY date, phase_order ROWS UNBOUNDED PRECEDING) - 1 AS d FROM nav) GROUP BY method)"


@query(f"WITH {_SCHEDULE}, {_DRAWDOWN} SELECT method, round(max_drawdown, 6) AS max_drawdown FROM dd")
def nav_max_drawdown(spark, sf_dir):
    return _r6(max_drawdown(nav(spark, sf_dir), ["method"], ["date", "phase_order"], "nav"), "max_drawdown")


_PERF = ["total_return", "cagr", "gross_cagr", "annualized_volatility", "worst_period", "best_period", "positive_fraction", "average_one_way_turnover", "sum_transaction_cost_rates", "max_drawdown", "annualized_cost_drag", "sharpe_zero_rate", "sortino_zero_rate", "calmar_ratio"]


@query(f"""WITH {_SCHEDULE}, {_DRAWDOWN}, m AS (SELECT method, count(*) AS periods, exp(sum(ln(1+net_return)))-1 AS total_return, pow(exp(sum(ln(1+net_return))), 52.0::DOUBLE/count(*))-1 AS cagr, pow(exp(sum(ln(1+gross_return))), 52.0::DOUBLE/count(*))-1 AS gross_cagr,
  stddev_samp(net_return)*sqrt(52) AS annualized_volatility, avg(net_return)*52 AS mean_, sqrt(avg(pow(least(net_return, 0), 2)))*sqrt(52) AS down, min(net_return) AS worst_period, max(net_return) AS best_period, avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) AS positive_fraction,
  avg(one_way_turnover) AS average_one_way_turnover, sum(transaction_cost_rate) AS sum_transaction_cost_rates FROM sim GROUP BY method),
f AS (SELECT m.*, max_drawdown, gross_cagr - cagr AS annualized_cost_drag, CASE WHEN annualized_volatility > 0 THEN mean_/annualized_volatility END AS sharpe_zero_rate, CASE WHEN down > 0 THEN mean_/down END AS sortino_zero_rate, CASE WHEN max_drawdown < 0 THEN cagr/abs(max_drawdown) END AS calmar_ratio FROM m JOIN dd USING (method))
SELECT method, periods, {', '.join(f'round({c}, 4) AS {c}' for c in _PERF)} FROM f""")
def performance_metrics(spark, sf_dir):
    m = B.performance(simulation(spark, sf_dir), max_drawdown(nav(spark, sf_dir), ["method"], ["date", "phase_order"], "nav"), 52.0)
    return m.withColumns({c: F.round(c, 4) for c in _PERF})


_DAYS = f"""{PRICES.strip()}, r AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices),
days AS (SELECT ticker, date, ret, CASE WHEN day(date) % 2 = 0 THEN 'even' ELSE 'odd' END AS regime_id FROM (SELECT *, count(ret) OVER (PARTITION BY date) AS n FROM r) WHERE n = {N})"""


def days(spark, sf_dir):
    r = complete_case_returns(prices(spark, sf_dir), "ticker", "date", "close", N)
    return r.select("ticker", "date", "ret", F.when(F.day("date") % 2 == 0, "even").otherwise("odd").alias("regime_id"))


@query(f"""WITH {_DAYS}, s AS (SELECT ticker, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM days WHERE regime_id = 'even' AND date < DATE '2024-01-28' GROUP BY ticker), c AS (SELECT *, CASE WHEN s > 2.220446049250313e-16 THEN sqrt(252) * m / s ELSE 0 END AS score FROM s),
h AS (SELECT *, score + abs(min(score) OVER ()) + 0.1::DOUBLE AS shifted FROM c) SELECT ticker, n, round(score, 6) AS score, round(CASE WHEN min(n) OVER () < 8 THEN 1.0::DOUBLE / count(*) OVER () ELSE shifted / sum(shifted) OVER () END, 6) AS target_weight FROM h""")
def legacy_sharpe(spark, sf_dir):
    same = days(spark, sf_dir).where("regime_id = 'even' and date < date'2024-01-28'")
    return _r6(B.sharpe_weights(same, 8), "score", "target_weight")


_SHRUNK = f"{_DAYS}, pooled AS (SELECT ticker, avg(ret) AS pooled_mean FROM days GROUP BY ticker), shrunk AS (SELECT regime_id, ticker, n, own_mean, pooled_mean, (n * own_mean + 10 * pooled_mean) / (n + 10) AS shrunk_mean FROM (SELECT regime_id, ticker, count(ret) AS n, avg(ret) AS own_mean FROM days GROUP BY ALL) JOIN pooled USING (ticker))"


@query(f"WITH {_SHRUNK} SELECT regime_id, ticker, n, round(own_mean, 6) AS own_mean, round(pooled_mean, 6) AS pooled_mean, round(shrunk_mean, 6) AS shrunk_mean FROM shrunk")
def regime_shrunk_means(spark, sf_dir):
    return _r6(B.shrunk_regime_means(days(spark, sf_dir), 10.0), "own_mean", "pooled_mean", "shrunk_mean")


@query(f"WITH {_SHRUNK}, m AS (SELECT ticker, CASE regime_id WHEN 'even' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS p, shrunk_mean AS x FROM shrunk) SELECT ticker, round(sum(p * x), 6) AS mixture_mean, round(sum(p * x * x) - pow(sum(p * x), 2), 6) AS between_variance FROM m GROUP BY ticker")
def mixture_mean(spark, sf_dir):
    posterior = spark.sql("SELECT * FROM VALUES ('even', 0.7D), ('odd', 0.3D) AS v(regime_id, p)")
    return _r6(B.mixture_moments(B.shrunk_regime_means(days(spark, sf_dir), 10.0), posterior), "mixture_mean", "between_variance")


_BLEND = f"{_SCHEDULE}, blend AS (SELECT 'blend' AS method, period, ticker, 0.75::DOUBLE * coalesce(c.target_weight, 0) + 0.25::DOUBLE * coalesce(a.target_weight, 0) AS target_weight FROM (SELECT * FROM targets WHERE method = 'equal') c FULL JOIN (SELECT * FROM targets WHERE method = 'tilt' AND target_weight > 0) a USING (period, ticker))"


def blended(spark, sf_dir):
    t = targets(spark, sf_dir)
    return B.blend(t.where("method = 'equal'"), t.where("method = 'tilt' and target_weight > 0"), 0.25, "blend")


@query(f"WITH {_BLEND} SELECT method, period, ticker, round(target_weight, 6) AS target_weight FROM blend")
def blend_sleeve(spark, sf_dir):
    return _r6(blended(spark, sf_dir), "target_weight")


@query(f"WITH {_BLEND} SELECT method, period, round(sum(target_weight * target_weight), 6) AS hhi, round(1 / sum(target_weight * target_weight), 6) AS effective_holdings, round(max(target_weight), 6) AS largest_weight FROM blend GROUP BY ALL")
def concentration(spark, sf_dir):
    return _r6(B.concentration(blended(spark, sf_dir)), "hhi", "effective_holdings", "largest_weight")


@query(f"""WITH {_SCHEDULE}, c AS (SELECT t.*, CASE ticker WHEN 'view' THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS cap FROM targets t)
SELECT method, period, round(sum(target_weight), 6) AS weight_sum, round(min(target_weight), 6) AS least_weight, round(max(target_weight - cap), 6) AS worst_excess, abs(sum(target_weight) - 1) <= 1e-8 AND min(target_weight) >= -1e-8 AND max(target_weight - cap) <= 1e-8 AS feasible FROM c GROUP BY ALL""")
def feasibility_audit(spark, sf_dir):
    caps = spark.sql("SELECT * FROM VALUES ('view', 0.5D), ('click', 0.9D), ('error', 0.9D), ('purchase', 0.9D), ('signup', 0.9D) AS v(ticker, cap)")
    return _r6(B.feasibility(targets(spark, sf_dir), caps), "weight_sum", "least_weight", "worst_excess")


@query(f"""WITH {_SCHEDULE}, t AS (SELECT t.method, t.period, t.ticker, t.target_weight, s.start_date AS entry_date, s.end_date AS signal_date FROM targets t JOIN schedule s USING (period)),
v AS (SELECT t.*, target_weight * (SELECT arg_max(close, date) FROM prices p WHERE p.ticker = t.ticker AND p.date < signal_date) / o.open AS v FROM t JOIN prices o ON o.ticker = t.ticker AND o.date = entry_date)
SELECT method, period, ticker, round(v / sum(v) OVER (PARTITION BY method, signal_date), 6) AS pretrade_weight FROM v""")
def pretrade_weights(spark, sf_dir):
    s = B.execution_schedule(prices(spark, sf_dir), N, *_weeks())
    t = targets(spark, sf_dir).join(s.select("period", F.col("start_date").alias("entry_date"), F.col("end_date").alias("signal_date")), "period")
    return _r6(B.pretrade_weights(t, prices(spark, sf_dir)), "pretrade_weight").select("method", "period", "ticker", "pretrade_weight")
