"""Quadrant regimes, transition estimates, path probabilities and causal moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pit_engine.operators.windows import successor_pairs

#: Canonical order; ties go to the first.
REGIMES = ["UU", "DU", "UD", "DD"]


def quadrant(growth: Column, inflation: Column) -> Column:
    """Growth and inflation up or down; exactly zero is up, NULL if either score is."""
    first, second = F.when(growth >= 0, "U").otherwise("D"), F.when(inflation >= 0, "U").otherwise("D")
    return F.when(growth.isNotNull() & inflation.isNotNull(), F.concat(first, second))


def regime_ord(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(r) for r in REGIMES)), c).cast("int")


def transition_pairs(history: DataFrame) -> DataFrame:
    """Adjacent labelled months: source, destination, available_at (both labels known)."""
    p = successor_pairs(history.withColumn("_all", F.lit(1)), ["_all"], "month", ["regime_id"], "label_available_at")
    return p.where("pair_status = 'valid'").select("month", F.col("regime_id").alias("source"), F.col("next_regime_id").alias("destination"), F.col("pair_available_at").alias("available_at"))


def transition_matrix(pairs: DataFrame, cutoffs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Dense smoothed matrices, one for each cutoff: pairs known on or before it count.

    cutoffs (column cutoff) is a short list of dates. Pairs are counted by
    availability first, so what meets the cutoffs is one row per cell and date.
    """
    daily = pairs.groupBy("source", "destination", "available_at").agg(F.count("*").alias("n"))
    known = daily.join(cutoffs, F.col("available_at") <= F.col("cutoff")).groupBy("cutoff", "source", "destination").agg(F.sum("n").alias("n"))
    states = F.array(*(F.lit(r) for r in REGIMES))
    grid = cutoffs.select("cutoff", F.explode(states).alias("source")).select("cutoff", "source", F.explode(states).alias("destination"))
    full = grid.join(known, ["cutoff", "source", "destination"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy("cutoff", "source"))
    return full.select("cutoff", "source", "destination", "n", F.when(row > 0, F.col("n") / row).alias("mle"), ((F.col("n") + alpha) / (row + len(REGIMES) * alpha)).alias("p"))


def propagate(marginal: DataFrame, matrix: DataFrame) -> DataFrame:
    """regime_id, p one month on: marginal times matrix."""
    both = matrix.join(marginal.select(F.col("regime_id").alias("source"), F.col("p").alias("m")), "source")
    return both.groupBy(F.col("destination").alias("regime_id")).agg(F.sum(F.col("m") * F.col("p")).alias("p"))


def initial_path(marginal: DataFrame, matrix: DataFrame) -> DataFrame:
    """a, b, c, d, p: the joint distribution of four successive months."""
    path = marginal.select(F.col("regime_id").alias("a"), "p")
    step = matrix.select(F.col("source").alias("_s"), F.col("destination").alias("_d"), F.col("p").alias("_p"))
    for prev, nxt in (("a", "b"), ("b", "c"), ("c", "d")):
        path = path.join(step, F.col(prev) == F.col("_s")).withColumns({nxt: F.col("_d"), "p": F.col("p") * F.col("_p")}).drop("_s", "_d", "_p")
    return path


def shift_path(path: DataFrame, matrix: DataFrame) -> DataFrame:
    """Drop the oldest month, append a new one."""
    kept = path.groupBy(F.col("b").alias("a"), F.col("c").alias("b"), F.col("d").alias("c")).agg(F.sum("p").alias("p"))
    step = matrix.select(F.col("source").alias("c"), F.col("destination").alias("d"), F.col("p").alias("_p"))
    return kept.join(step, "c").select("a", "b", "c", "d", (F.col("p") * F.col("_p")).alias("p"))


def path_marginals(path: DataFrame) -> DataFrame:
    """position (0 oldest), regime_id, p."""
    long = path.select("p", F.posexplode(F.array("a", "b", "c", "d")).alias("position", "regime_id"))
    return long.groupBy("position", "regime_id").agg(F.sum("p").alias("p"))


def condition_path(path: DataFrame, known: dict[str, str]) -> DataFrame:
    """Keep the paths that agree with known months and renormalise; impossible evidence is an error."""
    kept = path
    for position, regime in known.items():
        kept = kept.where(F.col(position) == regime)
    total = F.sum("p").over(Window.partitionBy())
    return kept.withColumn("_t", total).where(F.assert_true(F.col("_t") > 0, F.lit("known regimes have no probability")).isNull()).withColumn("p", F.col("p") / F.col("_t")).drop("_t")


def bayes_update(path: DataFrame, updates: list[tuple[str, DataFrame]]) -> DataFrame:
    """Posterior after log likelihoods by position, all applied at once.

    updates: (position, DataFrame regime_id, loglik). Normalised in the log domain.
    """
    out = path.withColumn("_l", F.when(F.col("p") > 0, F.ln("p")))
    for k, (position, like) in enumerate(updates):
        out = out.join(like.select(F.col("regime_id").alias(position), F.col("loglik").alias(f"_k{k}")), position).withColumn("_l", F.col("_l") + F.col(f"_k{k}")).drop(f"_k{k}")
    every = Window.partitionBy()
    w = out.withColumn("_w", F.exp(F.col("_l") - F.max("_l").over(every)))
    return w.select("a", "b", "c", "d", (F.coalesce("_w", F.lit(0.0)) / F.sum("_w").over(every)).alias("p"))


def entropy(p: Column) -> Column:
    """Entropy in nats, as an aggregate."""
    return -F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def kl(posterior: Column, prior: Column) -> Column:
    """Relative entropy as an aggregate; infinite where the prior has no support."""
    term = F.when(posterior <= 0, 0.0).when(prior <= 0, float("inf")).otherwise(posterior * (F.ln(posterior) - F.ln(prior)))
    return F.sum(term)


def mapping_covariance(scores: DataFrame, errors: DataFrame, targets: DataFrame) -> DataFrame:
    """Causal covariance of the score-to-regime map per target month and horizon.

    Means of earlier months' jackknife variances plus the covariance of earlier
    revision errors, where earlier means a smaller reference month *and* known
    before the target's own availability. scores: month, gv, iv, available_at.
    errors: month, horizon, ge, ie, available_at. targets: month, cutoff.
    """
    s = scores.select(F.col("month").alias("_m"), "gv", "iv", F.col("available_at").alias("_a"))
    d = targets.join(s, (F.col("_m") < F.col("month")) & (F.col("_a") < F.col("cutoff"))).groupBy("month").agg(F.count("*").alias("n_disagreement"), F.avg("gv").alias("gv"), F.avg("iv").alias("iv"))
    e = errors.select(F.col("month").alias("_m"), "horizon", "ge", "ie", F.col("available_at").alias("_a"))
    r = targets.join(e, (F.col("_m") < F.col("month")) & (F.col("_a") < F.col("cutoff"))).groupBy("month", "horizon").agg(F.count("*").alias("n_revision"), F.var_samp("ge").alias("ge"), F.var_samp("ie").alias("ie"), F.covar_samp("ge", "ie").alias("gie"))
    return d.join(r, "month").select("month", "horizon", "n_disagreement", "n_revision", (F.col("gv") + F.col("ge")).alias("growth_variance"), F.col("gie").alias("growth_inflation_covariance"), (F.col("iv") + F.col("ie")).alias("inflation_variance"))


def select_training(vectors: DataFrame, cutoff: Column, features: list[str]) -> DataFrame:
    """Rows with a reason: included only if complete, labelled and known strictly before the cutoff."""
    full = F.lit(True)
    for f in features:
        full = full & F.col(f).isNotNull()
    known = F.when(F.col("release_date").isNotNull() & F.col("label_available_at").isNotNull(), F.greatest("release_date", "label_available_at"))
    reason = F.when(F.col("regime_id").isNull(), "missing_regime").when(~full, "incomplete_vector").when(known.isNull(), "missing_availability").when(known >= cutoff, "not_available_by_cutoff").otherwise("included")
    return vectors.withColumns({"training_available_at": known, "reason": reason})


def var1_normal_equations(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of products for y = B [1, x1, x2]: everything a VAR(1) fit needs, in one aggregation."""
    x = {"1": F.lit(1.0), "x1": F.col("x1"), "x2": F.col("x2")}
    xx = [F.sum(x[a] * x[b]).alias(f"s_{a}_{b}") for a, b in (("1", "1"), ("1", "x1"), ("1", "x2"), ("x1", "x1"), ("x1", "x2"), ("x2", "x2"))]
    xy = [F.sum(x[a] * F.col(y)).alias(f"s_{a}_{y}") for a in x for y in ("y1", "y2")]
    yy = [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in (("y1", "y1"), ("y1", "y2"), ("y2", "y2"))]
    return pairs.groupBy(*keys).agg(*xx, *xy, *yy)


def var1_solution(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficients by Cramer's rule and innovation covariance with n - 3 degrees of freedom."""
    a, b, c, d, e, f = (F.col(f"s_{k}") for k in ("1_1", "1_x1", "1_x2", "x1_x1", "x1_x2", "x2_x2"))
    det3 = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    det = det3([a, b, c, b, d, e, c, e, f])
    out = {}
    for y in ("y1", "y2"):
        p, q, r = (F.col(f"s_{k}_{y}") for k in ("1", "x1", "x2"))
        out[f"{y}_const"] = det3([p, b, c, q, d, e, r, e, f]) / det
        out[f"{y}_x1"] = det3([a, p, c, b, q, e, c, r, f]) / det
        out[f"{y}_x2"] = det3([a, b, p, b, d, q, c, e, r]) / det
    fit = sums.withColumns(out)
    dof = F.col("s_1_1") - 3
    resid = lambda u, v: (F.col(f"s_{u}_{v}") - sum((F.col(f"{u}_{k}") * F.col(f"s_{s}_{v}") for k, s in (("const", "1"), ("x1", "x1"), ("x2", "x2"))), F.lit(0.0))) / dof
    return fit.select(*keys, F.col("s_1_1").cast("bigint").alias("n"), *out, resid("y1", "y1").alias("q11"), resid("y1", "y2").alias("q12"), resid("y2", "y2").alias("q22"))


def causal_var1(pairs: DataFrame, targets: DataFrame, minimum: int) -> DataFrame:
    """A VAR(1) fit for each target month: month, n, status and the fit's columns (NULL below ``minimum`` pairs).

    pairs: month (of the source), x1, x2, y1, y2, pair_available_at. targets:
    month, cutoff. A pair counts if its successor is not after the target month
    *and* it was available by the cutoff: order in calendar time alone would
    look ahead wherever a release is late. Both sides are calendars of months;
    products are summed before anything is solved.
    """
    p = pairs.select("x1", "x2", "y1", "y2", F.add_months("month", 1).alias("_next"), "pair_available_at")
    known = targets.join(p, (F.col("_next") <= F.col("month")) & (F.col("pair_available_at") <= F.col("cutoff")))
    fit = var1_solution(var1_normal_equations(known, ["month"]), ["month"])
    enough = F.col("n") >= minimum
    return fit.select("month", "n", F.when(enough, "available").otherwise("insufficient_pairs").alias("status"), *(F.when(enough, F.col(c)).alias(c) for c in fit.columns if c not in ("month", "n")))


def propagate_var1(rows: DataFrame, gg: float, gi: float, ii: float) -> DataFrame:
    """month, next month's mean and covariance given an exact score (x1, x2), and the covariance at readout.

    gg, gi, ii: covariance of the map from scores to regimes. It is added for
    the readout only and never enters the state that is carried on.
    """
    mean = lambda y: F.col(f"{y}_const") + F.col(f"{y}_x1") * F.col("x1") + F.col(f"{y}_x2") * F.col("x2")
    state = rows.select("month", mean("y1").alias("growth_mean"), mean("y2").alias("inflation_mean"), F.col("q11").alias("growth_variance"), F.col("q12").alias("covariance"), F.col("q22").alias("inflation_variance"))
    readout = {"readout_growth_variance": F.col("growth_variance") + gg, "readout_covariance": F.col("covariance") + gi, "readout_inflation_variance": F.col("inflation_variance") + ii}
    return state.withColumns(readout)
