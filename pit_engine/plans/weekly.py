"""Queries of weekly signals, causal regime-return models and allocation diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pit_engine.operators import backtest as B
from pit_engine.operators import weekly as W
from pit_engine.operators.windows import max_drawdown
from pit_engine.plans.inputs import SCORES, cents, scores, settle, shared, table
from pit_engine.plans.portfolio import _DRAWDOWN, _SCHEDULE, nav, simulation, targets
from pit_engine.plans.regimes import history
from pit_engine.plans.registry import query


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ------------------------------------------------------------------ signals

_MARGINALS = """marg AS (SELECT v AS variant_id, CAST(month + to_days(k) AS DATE) AS signal_date, CAST(month - to_months(lag) AS DATE) AS reference_month, a/(a+b+c+d) AS p_uu, b/(a+b+c+d) AS p_du, c/(a+b+c+d) AS p_ud, d/(a+b+c+d) AS p_dd FROM (
  SELECT *, 1.0::DOUBLE + month(month) % 3 + lag AS a, 1.0::DOUBLE + k % 4 AS b, 1.0::DOUBLE + year(month) % 2 AS c, 1.0::DOUBLE AS d FROM (SELECT month FROM scores) CROSS JOIN (VALUES ('base'), ('other')) x(v) CROSS JOIN (VALUES (4), (18)) y(k) CROSS JOIN (VALUES (0), (1)) z(lag))),
weeks AS (SELECT CAST(unnest(generate_series(date_trunc('week', min(month)), date_trunc('week', max(month)), INTERVAL 7 DAY)) AS DATE) AS reference_week FROM scores),
newest AS (SELECT * FROM marg WHERE variant_id = 'base' QUALIFY row_number() OVER (PARTITION BY signal_date ORDER BY reference_month DESC) = 1),
signals AS (SELECT w.reference_week, n.* EXCLUDE (variant_id) FROM weeks w ASOF JOIN newest n ON w.reference_week >= n.signal_date)"""


def weekly_signals_table(spark, sf_dir):
    s = scores(spark, sf_dir).select("month")
    m = s.select("month", F.explode(F.array(F.lit("base"), F.lit("other"))).alias("variant_id")).select("*", F.explode(F.array(F.lit(4), F.lit(18))).alias("k")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("lag"))
    w = [1.0 + F.month("month") % 3 + F.col("lag"), 1.0 + F.col("k") % 4, 1.0 + F.year("month") % 2, F.lit(1.0)]
    total = w[0] + w[1] + w[2] + w[3]
    marginals = m.select("variant_id", F.expr("date_add(month, k)").alias("signal_date"), F.expr("add_months(month, -lag)").alias("reference_month"), *((x / total).alias(n) for x, n in zip(w, ("p_uu", "p_du", "p_ud", "p_dd"), strict=True)))
    weeks = s.agg(F.trunc(F.min("month"), "week").alias("a"), F.trunc(F.max("month"), "week").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("reference_week"))
    return W.select_signals(marginals, weeks, "base")


@query(f"WITH {SCORES}, {_MARGINALS} SELECT reference_week, signal_date, reference_month, round(p_uu, 9) AS p_uu, round(p_du, 9) AS p_du, round(p_ud, 9) AS p_ud, round(p_dd, 9) AS p_dd FROM signals")
def weekly_signals(spark, sf_dir):
    return _r(weekly_signals_table(spark, sf_dir), "p_uu", "p_du", "p_ud", "p_dd", digits=9)


# ------------------------------------------------------------------ causal regime-return models

_ORDERS = """px AS (SELECT o_orderstatus AS ticker, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS open FROM orders GROUP BY ALL),
pf AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS period FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM px) WHERE n = 3),
ps AS (SELECT period, min(date) AS start_date FROM pf GROUP BY period),
pe AS (SELECT *, CASE WHEN lead(period) OVER w = period + 7 THEN lead(start_date) OVER w END AS end_date FROM ps WINDOW w AS (ORDER BY period)),
ret0 AS (SELECT pe.period, a.ticker, start_date, end_date, b.open / a.open - 1 AS ret FROM pe JOIN px a ON a.date = start_date JOIN px b ON b.date = end_date AND b.ticker = a.ticker),
anchor AS (SELECT CASE WHEN date_trunc('week', min(start_date)) < min(start_date) THEN CAST(date_trunc('week', min(start_date)) AS DATE) + 7 ELSE min(start_date) END AS a FROM ret0),
ret AS (SELECT * FROM ret0 WHERE period >= (SELECT a FROM anchor))"""
_CUTS = ["1998-03-01", "2000-03-01"]
_KAPPA = 104.0
_MODEL = f"""WITH {SCORES}, {_ORDERS}, cuts AS (SELECT * FROM (VALUES {', '.join(f"(DATE '{c}')" for c in _CUTS)}) v(cutoff)),
lab AS (SELECT cutoff, period, ticker, ret, regime_id FROM ret JOIN regimes ON month = date_trunc('month', period) JOIN cuts ON end_date <= cutoff AND available_at <= cutoff WHERE regime_id IS NOT NULL),
overall AS (SELECT cutoff, ticker, avg(ret) AS global_mean FROM lab GROUP BY ALL), own AS (SELECT cutoff, regime_id, ticker, count(*) AS n, avg(ret) AS m FROM lab GROUP BY ALL),
means AS (SELECT o.cutoff, v.r AS regime_id, o.ticker, coalesce(n, 0) AS n, coalesce(m, global_mean) AS sample_mean, global_mean, CASE WHEN n IS NULL THEN global_mean ELSE (n * m + {_KAPPA} * global_mean) / (n + {_KAPPA}) END AS mean
  FROM overall o CROSS JOIN (VALUES ('UU'), ('DU'), ('UD'), ('DD')) v(r) LEFT JOIN own ON own.cutoff = o.cutoff AND own.regime_id = v.r AND own.ticker = o.ticker),
e AS (SELECT cutoff, period, ticker, ret - sample_mean AS e FROM lab JOIN means USING (cutoff, regime_id, ticker)),
sq AS (SELECT cutoff, count(*) AS n, avg(s * s) AS q FROM (SELECT cutoff, period, sum(e * e) AS s FROM e GROUP BY ALL) GROUP BY cutoff),
s AS (SELECT x.cutoff, x.ticker AS a, y.ticker AS b, avg(x.e * y.e) AS s FROM e x JOIN e y ON y.cutoff = x.cutoff AND y.period = x.period GROUP BY ALL),
sh AS (SELECT cutoff, n, mu, CASE WHEN delta <= 0 THEN 0 ELSE greatest(least(beta, delta), 0) / delta END AS shrinkage FROM (SELECT cutoff, sq.n, tr / 3 AS mu, (norm - tr * tr / 3) / 3 AS delta, (q - norm) / (3 * sq.n) AS beta FROM (SELECT cutoff, sum(s * s) AS norm, sum(s) FILTER (a = b) AS tr FROM s GROUP BY cutoff) JOIN sq USING (cutoff))),
cov AS (SELECT cutoff, a, b, n, shrinkage, (1 - shrinkage) * s + CASE WHEN a = b THEN shrinkage * mu ELSE 0 END AS c FROM s JOIN sh USING (cutoff)),
post AS (SELECT cutoff, r AS regime_id, p FROM cuts CROSS JOIN (VALUES ('UU', 0.4::DOUBLE), ('DU', 0.3::DOUBLE), ('UD', 0.2::DOUBLE), ('DD', 0.1::DOUBLE)) v(r, p)),
mx AS (SELECT m.*, p FROM means m JOIN post USING (cutoff, regime_id)), ex AS (SELECT cutoff, ticker, sum(p * mean) AS expected_return FROM mx GROUP BY ALL),
g AS (SELECT cutoff, regime_id, p, ticker, mean - expected_return AS g FROM mx JOIN ex USING (cutoff, ticker)),
bt AS (SELECT x.cutoff, x.ticker AS a, y.ticker AS b, sum(x.p * x.g * y.g) AS between_ FROM g x JOIN g y ON y.cutoff = x.cutoff AND y.regime_id = x.regime_id GROUP BY ALL),
pm AS (SELECT m.*, n / sum(n) OVER (PARTITION BY cutoff, ticker) AS p FROM means m), pex AS (SELECT cutoff, ticker, sum(p * sample_mean) AS expected_return FROM pm GROUP BY ALL)"""


def order_returns(spark, sf_dir):
    """Weekly holding returns of three order states, from the first whole week on."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg((F.sum(cents("o_totalprice")).cast("double") / F.count("*")).alias("open"))
    r = B.holding_returns(o.withColumn("close", F.col("open")), 3, F.trunc("date", "week"), F.date_add("period", 7))
    return shared(W.estimator_history(r))


def cuts(spark):
    return spark.createDataFrame([(c,) for c in _CUTS], "cutoff string").select(F.col("cutoff").cast("date").alias("cutoff"))


def model(spark, sf_dir, kappa=_KAPPA):
    known = settle(W.labelled_returns(order_returns(spark, sf_dir), history(spark, sf_dir), cuts(spark)))
    return {k: settle(v) for k, v in W.regime_return_model(known, kappa).items()}


def posterior(spark):
    p = F.explode(F.array(*(F.struct(F.lit(r).alias("regime_id"), F.lit(x).alias("p")) for r, x in (("UU", 0.4), ("DU", 0.3), ("UD", 0.2), ("DD", 0.1))))).alias("x")
    return cuts(spark).select("cutoff", p).select("cutoff", "x.*")


@query(f"WITH {_ORDERS} SELECT period, ticker, start_date, end_date, round(ret, 6) AS ret FROM ret")
def estimator_history(spark, sf_dir):
    return _r(order_returns(spark, sf_dir), "ret").select("period", "ticker", "start_date", "end_date", "ret")


@query(f"{_MODEL} SELECT cutoff, regime_id, ticker, CAST(n AS BIGINT) AS n, round(sample_mean, 6) AS sample_mean, round(global_mean, 6) AS global_mean, round(mean, 6) AS mean FROM means")
def regime_return_means(spark, sf_dir):
    return _r(model(spark, sf_dir)["means"], "sample_mean", "global_mean", "mean")


@query(f"{_MODEL} SELECT cutoff, a, b, n, round(shrinkage, 6) AS shrinkage, round(c, 6) AS c FROM cov")
def regime_return_covariance(spark, sf_dir):
    return _r(model(spark, sf_dir)["covariance"], "shrinkage", "c")


@query(f"{_MODEL} SELECT cutoff, a, b, round(c, 6) AS within, round(between_, 6) + 0 AS between, round(c + between_, 6) AS covariance FROM cov JOIN bt USING (cutoff, a, b)")
def mixture_covariance(spark, sf_dir):
    m = _r(W.mixture(model(spark, sf_dir), posterior(spark))["covariance"], "within", "between", "covariance")
    return m.withColumn("between", F.col("between") + 0)


@query(f"{_MODEL} SELECT cutoff, ticker, round(expected_return, 6) AS expected_return FROM ex")
def mixture_expected(spark, sf_dir):
    return _r(W.mixture(model(spark, sf_dir), posterior(spark))["expected"], "expected_return")


@query(f"""{_MODEL}, pg AS (SELECT cutoff, regime_id, p, ticker, sample_mean - expected_return AS g FROM pm JOIN pex USING (cutoff, ticker)), pb AS (SELECT x.cutoff, x.ticker AS a, y.ticker AS b, sum(x.p * x.g * y.g) AS between_ FROM pg x JOIN pg y ON y.cutoff = x.cutoff AND y.regime_id = x.regime_id GROUP BY ALL)
SELECT cutoff, a, b, round(c, 6) AS within, round(between_, 6) + 0 AS between, round(c + between_, 6) AS covariance FROM cov JOIN pb USING (cutoff, a, b)""")
def pooled_covariance(spark, sf_dir):
    m = _r(W.pooled(model(spark, sf_dir))["covariance"], "within", "between", "covariance")
    return m.withColumn("between", F.col("between") + 0)


@query(f"""{_MODEL}, r AS (SELECT ticker, avg(ret) * 52 AS rr, stddev_samp(ret) * sqrt(52) AS rv, exp(sum(ln(1 + ret))) - 1 AS tr FROM ret GROUP BY ticker), x AS (SELECT ticker, avg(expected_return) * 52 AS er FROM ex GROUP BY ticker)
SELECT ticker, round(rr, 4) AS realized_return, round(rv, 4) AS realized_volatility, round(tr, 4) AS total_return, round(er, 4) AS expected_return, round(rr - er, 4) AS realized_minus_expected FROM r JOIN x USING (ticker)""")
def asset_diagnostics(spark, sf_dir):
    d = W.asset_diagnostics(order_returns(spark, sf_dir), W.mixture(model(spark, sf_dir), posterior(spark))["expected"], 52.0)
    return _r(d, *[c for c in d.columns if c != "ticker"], digits=4)


@query(f"""{_MODEL}, o AS (SELECT cutoff, a AS ticker, c, shrinkage FROM cov WHERE a = b), w AS (SELECT x.cutoff, count(*) AS tickers, max(y.shrinkage) AS old_shrinkage, max(x.shrinkage) AS new_shrinkage, avg(abs(x.c / y.c - 1)) AS m, max(abs(x.c / y.c - 1)) AS mm FROM o x JOIN o y ON y.cutoff = DATE '{_CUTS[0]}' AND x.ticker = y.ticker WHERE x.cutoff = DATE '{_CUTS[1]}' GROUP BY x.cutoff)
SELECT cutoff, tickers, round(old_shrinkage, 6) AS old_shrinkage, round(new_shrinkage, 6) AS new_shrinkage, round(m, 6) AS mean_relative_change, round(mm, 6) AS largest_relative_change FROM w""")
def risk_change(spark, sf_dir):
    """The later cutoff's variances against the earlier one's."""
    c = model(spark, sf_dir)["covariance"]
    late = c.where(F.col("cutoff") == F.lit(_CUTS[1]).cast("date"))
    early = c.where(F.col("cutoff") == F.lit(_CUTS[0]).cast("date")).withColumn("cutoff", F.lit(_CUTS[1]).cast("date"))
    return _r(W.risk_change(late, early), "old_shrinkage", "new_shrinkage", "mean_relative_change", "largest_relative_change")


@query(f"{_MODEL} SELECT count(*) AS cells, CASE WHEN count(*) > 0 THEN 0.0::DOUBLE END AS largest_difference FROM ex WHERE ticker IN ('F', 'O')")
def mean_parity(spark, sf_dir):
    """Expected returns of two tickers don't change when a third one joins the model."""
    known = W.labelled_returns(order_returns(spark, sf_dir), history(spark, sf_dir), cuts(spark))
    wide, narrow = (W.mixture(W.regime_return_model(r, _KAPPA), posterior(spark))["expected"] for r in (known, known.where("ticker in ('F', 'O')")))
    return _r(W.mean_parity(wide, narrow), "largest_difference", digits=12)


@query()
def dynamic_targets(spark, sf_dir):
    s = settle(weekly_signals_table(spark, sf_dir))
    specs = {"base": (104.0, 100.0, 1.0), "loose": (104.0, 100.0, 1.5), "kappa_0": (0.0, 100.0, 1.0)}
    return W.dynamic_targets(settle(order_returns(spark, sf_dir)), settle(history(spark, sf_dir)), s.where("reference_week >= date'2000-01-01'"), specs, 52, 0.5, 0.001, keep=settle)


# ------------------------------------------------------------------ targets and diagnostics

@query(f"WITH {_ORDERS}, p AS (SELECT DISTINCT period FROM ret) SELECT 'equal_weight' AS method, period, t AS ticker, round(1.0::DOUBLE / 3, 9) AS target_weight FROM p, (VALUES ('F'), ('O'), ('P')) v(t) UNION ALL SELECT 'static', period, t, w FROM p, (VALUES ('F', 0.6::DOUBLE), ('O', 0.4::DOUBLE), ('P', 0.0::DOUBLE)) v(t, w)")
def benchmark_targets(spark, sf_dir):
    return _r(W.benchmark_targets(order_returns(spark, sf_dir).select("period").distinct(), ["F", "O", "P"], {"F": 0.6, "O": 0.4}), "target_weight", digits=9)


def performance(spark, sf_dir):
    return B.performance(simulation(spark, sf_dir), max_drawdown(nav(spark, sf_dir), ["method"], ["date", "phase_order"], "nav"), 52.0)


_PERF = f"WITH {_SCHEDULE}, {_DRAWDOWN}, perf AS (SELECT method, exp(sum(ln(1+net_return)))-1 AS total_return, avg(one_way_turnover) AS average_one_way_turnover, any_value(max_drawdown) AS max_drawdown FROM sim JOIN dd USING (method) GROUP BY method)"
_NAMES = ["total_return", "average_one_way_turnover", "max_drawdown"]


@query(f"{_PERF} SELECT p.method, {', '.join(f'round(p.{n}, 6) AS {n}, round(p.{n} - b.{n}, 6) + 0 AS delta_{n}' for n in _NAMES)} FROM perf p, (SELECT * FROM perf WHERE method = 'equal') b")
def sensitivity_deltas(spark, sf_dir):
    out = W.sensitivity(performance(spark, sf_dir), "equal", _NAMES)
    return _r(out, *[c for c in out.columns if c != "method"]).withColumns({f"delta_{n}": F.round(f"delta_{n}", 6) + 0 for n in _NAMES})


@query(f"""{_PERF}, half AS (SELECT method, exp(sum(ln(1+net_return)))-1 AS total_return, avg(one_way_turnover) AS average_one_way_turnover FROM sim WHERE period >= (SELECT min(period) + 7 FROM sim) GROUP BY method)
SELECT method, round(p.total_return, 6) AS left_total_return, round(h.total_return, 6) AS right_total_return, round(p.total_return - h.total_return, 6) + 0 AS delta_total_return, round(p.average_one_way_turnover, 6) AS left_average_one_way_turnover, round(h.average_one_way_turnover, 6) AS right_average_one_way_turnover, round(p.average_one_way_turnover - h.average_one_way_turnover, 6) + 0 AS delta_average_one_way_turnover FROM perf p JOIN half h USING (method)""")
def universe_comparison(spark, sf_dir):
    """The whole sample against the one without its first period, by method."""
    s = simulation(spark, sf_dir)
    first = s.agg(F.date_add(F.min("period"), 7).alias("p")).scalar()
    growth = lambda df: df.groupBy("method").agg((F.exp(F.sum(F.ln(1 + F.col("net_return")))) - 1).alias("total_return"), F.avg("one_way_turnover").alias("average_one_way_turnover"))
    out = W.compare_universes(growth(s), growth(s.where(F.col("period") >= first)), _NAMES[:2])
    return _r(out, *[c for c in out.columns if c != "method"]).withColumns({f"delta_{n}": F.round(f"delta_{n}", 6) + 0 for n in _NAMES[:2]})


@query(f"""WITH {SCORES}, {_MARGINALS}, t AS (SELECT s.*, g.regime_id AS oracle_regime_id, g.available_at FROM signals s LEFT JOIN (SELECT * FROM regimes WHERE regime_id IS NOT NULL) g ON g.month = s.reference_month WHERE s.reference_month >= DATE '1996-06-01')
SELECT reference_week, signal_date, reference_month, oracle_regime_id, available_at <= signal_date AS available_at_signal FROM t WHERE coalesce(reference_week < (SELECT min(reference_week) FROM t WHERE oracle_regime_id IS NULL), true)""")
def oracle_window(spark, sf_dir):
    s = weekly_signals_table(spark, sf_dir).where("reference_month >= date'1996-06-01'").select("reference_week", "signal_date", "reference_month")
    return W.oracle_window(s, history(spark, sf_dir))


@query(f"""WITH {_SCHEDULE}, truth AS (SELECT DISTINCT period, CASE WHEN day(period) % 2 = 0 THEN 'even' ELSE 'odd' END AS regime_id FROM sim), d AS (SELECT regime_id, a.net_return - b.net_return AS n, a.gross_return - b.gross_return AS g FROM (SELECT * FROM sim WHERE method = 'tilt') a JOIN (SELECT * FROM sim WHERE method = 'equal') b USING (period) JOIN truth USING (period)),
m AS (SELECT regime_id, count(*) AS periods, avg(n) * 52 AS nd, avg(g) * 52 AS gd, stddev_samp(n) * sqrt(52) AS te, avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END) AS ps FROM d GROUP BY regime_id)
SELECT regime_id, periods, round(nd, 6) AS net_difference, round(gd, 6) AS gross_difference, round(te, 6) AS tracking_error, round(ps, 6) AS positive_share, round(CASE WHEN te > 0 THEN nd / te END, 4) AS information_ratio FROM m""")
def regime_attribution(spark, sf_dir):
    s = simulation(spark, sf_dir)
    truth = s.select("period", F.when(F.day("period") % 2 == 0, "even").otherwise("odd").alias("regime_id")).distinct()
    out = W.regime_attribution(s, truth, "tilt", "equal", 52.0)
    return _r(_r(out, "net_difference", "gross_difference", "tracking_error", "positive_share"), "information_ratio", digits=4)


_CAPS = "(VALUES ('view', 0.6::DOUBLE), ('click', 0.5::DOUBLE), ('error', 0.2::DOUBLE), ('purchase', 0.2::DOUBLE), ('signup', 0.2::DOUBLE)) c(ticker, cap)"


@query(f"WITH {_SCHEDULE} SELECT method, ticker, round(avg(target_weight), 6) AS average_weight, max(target_weight) AS largest_weight, min(target_weight) AS least_weight, count(*) AS periods, max(cap) AS cap, round(avg(CASE WHEN target_weight > 0.01 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_above_one_percent, round(avg(CASE WHEN abs(target_weight - cap) <= 1e-6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_at_cap FROM targets JOIN {_CAPS} USING (ticker) GROUP BY ALL")
def cap_utilization(spark, sf_dir):
    caps = spark.createDataFrame([("view", 0.6), ("click", 0.5), ("error", 0.2), ("purchase", 0.2), ("signup", 0.2)], "ticker string, cap double")
    return _r(W.utilization(targets(spark, sf_dir), caps), "average_weight", "share_above_one_percent", "share_at_cap")


@query(f"WITH {_SCHEDULE} SELECT period, round(0.5 * sum(abs(a.target_weight - b.target_weight)), 6) AS half_l1_distance FROM (SELECT * FROM targets WHERE method = 'tilt') a JOIN (SELECT * FROM targets WHERE method = 'equal') b USING (period, ticker) GROUP BY period")
def target_distance(spark, sf_dir):
    return _r(W.target_distance(targets(spark, sf_dir), "tilt", "equal"), "half_l1_distance")
