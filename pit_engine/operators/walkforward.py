"""What walk-forward filters read: vectors of released features, causal samples, likelihoods and signals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pit_engine.operators.regimes import REGIMES

VECTOR_KEYS = ["event_id", "event_group_id", "release_block", "release_date", "reference_month"]


def _all_present(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def block_vectors(events: DataFrame, history: DataFrame, block: str, features: list[str]) -> DataFrame:
    """One vector for each event of a block, with its month's regime and the day from which it may train.

    events: long (``VECTOR_KEYS``, feature_name, feature_value, feature_status).
    history: month, regime_id, label_available_at. Incomplete vectors stay, so
    they can be audited; only complete, labelled ones are candidates.
    """
    rows = events.where((F.col("release_block") == block) & F.col("feature_name").isin(features) & (F.col("feature_status") == "available"))
    wide = rows.groupBy(*VECTOR_KEYS).pivot("feature_name", features).agg(F.first("feature_value"))
    out = wide.join(history.select(F.col("month").alias("reference_month"), "regime_id", "label_available_at"), "reference_month", "left")
    labelled = F.col("regime_id").isNotNull() & F.col("label_available_at").isNotNull()
    return out.withColumns({
        "complete_vector": _all_present(features),
        "training_available_at": F.when(labelled, F.greatest("release_date", "label_available_at")),
        "training_candidate": _all_present(features) & labelled,
    })


def observation_vectors(events: DataFrame, scores: DataFrame, model: str, responses: list[str], controls: list[str]) -> dict[str, DataFrame]:
    """Live event vectors, one training row a month, and an audit of what was left out.

    events: event_id, release_date, reference_month, feature_name, feature_value.
    scores: month, growth_score, inflation_score, available_at. A live vector may
    be partial. A training row is assembled over a month's releases and known
    when the last of responses, controls and the target score is.
    """
    names = [*responses, *controls]
    rows = events.where(F.col("feature_name").isin(names))
    live = rows.groupBy("event_id", "release_date", "reference_month").pivot("feature_name", names).agg(F.first("feature_value"))
    some = F.coalesce(*(F.col(r) for r in responses)).isNotNull()
    live = live.where(some).withColumns({"observation_model_id": F.lit(model), "complete_response_vector": _all_present(responses)})

    released = rows.groupBy("reference_month").pivot("feature_name", names).agg(F.first("feature_value").alias("v"), F.max("release_date").alias("d"))
    latest = lambda xs: F.when(_all_present([f"{x}_d" for x in xs]), F.greatest(*(F.col(f"{x}_d") for x in xs)) if len(xs) > 1 else F.col(f"{xs[0]}_d"))
    base = released.select("reference_month", *(F.col(f"{x}_v").alias(x) for x in names), latest(responses).alias("response_available_at"), (latest(controls) if controls else F.lit(None).cast("date")).alias("control_available_at"))
    base = base.join(scores.select(F.col("month").alias("reference_month"), "growth_score", "inflation_score", F.col("available_at").alias("target_score_available_at")), "reference_month", "left")
    full_r, full_c, full_s = _all_present(responses), _all_present(controls), _all_present(["growth_score", "inflation_score", "target_score_available_at"])
    base = base.withColumns({"_r": full_r, "_c": full_c, "_s": full_s})
    audit = base.agg(
        F.lit(model).alias("observation_model_id"), F.count_if(F.expr("_r and _c and _s")).alias("training_candidates"), F.count_if(F.expr("not _r")).alias("excluded_incomplete_response"),
        F.count_if(F.expr("_r and not _c")).alias("excluded_incomplete_control"), F.count_if(F.expr("_r and _c and not _s")).alias("excluded_score_unavailable"))
    known = F.greatest("response_available_at", "control_available_at", "target_score_available_at")
    training = base.where("_r and _c and _s").drop("_r", "_c", "_s").withColumns({"observation_model_id": F.lit(model), "training_available_at": known})
    return {"live": live, "training": training, "audit": audit}


def select_emission_rows(table: DataFrame, columns: list[str], available_at: str, cutoff: Column) -> DataFrame:
    """Every row with its reason: empty for a complete row known strictly before the cutoff."""
    full = _all_present(columns)
    reason = F.when(~full, "incomplete_model_vector").when(F.coalesce(F.col(available_at) < cutoff, F.lit(False)), "").otherwise("not_available_strictly_before_cutoff")
    return table.withColumns({"exclusion_reason": reason, "eligible": reason == ""})


def training_samples(vectors: DataFrame, start: str, end: str, minimum: int) -> DataFrame:
    """The distinct causal training samples of each block: block, training_count, first_cutoff.

    A cutoff is a release date; its sample is the candidates known strictly
    before it, told apart by their number. Each sample is listed once, at the
    first cutoff that sees it, so a fit is made once however many cutoffs share it.
    """
    cuts = vectors.where(F.col("release_date").between(start, end)).select("release_block", F.col("release_date").alias("t")).distinct().withColumn("_cut", F.lit(True))
    known = vectors.where("training_candidate").groupBy("release_block", F.col("training_available_at").alias("t")).agg(F.count("*").alias("_n"))
    both = cuts.join(known, ["release_block", "t"], "full")
    past = Window.partitionBy("release_block").orderBy(F.unix_date("t")).rangeBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("training_count", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    return counted.where(F.col("_cut") & (F.col("training_count") >= minimum)).groupBy("release_block", "training_count").agg(F.min("t").alias("first_cutoff"))


def fit_signature(training: DataFrame, cutoffs: DataFrame, row_id: str = "event_instance_id") -> DataFrame:
    """cutoff, sha256 of the ordered ids known strictly before it, their number and the latest availability.

    Bounded by the calendar: training rows are one a month, cutoffs a short list.
    """
    rows = cutoffs.join(training.select(row_id, "training_available_at"), F.col("training_available_at") < F.col("cutoff"), "left")
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col(row_id).isNotNull(), F.struct("training_available_at", row_id)))), lambda x: F.concat(x[row_id], F.lit("\n")))
    return rows.groupBy("cutoff").agg(F.sha2(F.array_join(ids, ""), 256).alias("signature"), F.count(row_id).alias("training_count"), F.max("training_available_at").alias("latest"))


def active_controls(training: DataFrame, controls: list[str], cutoff: Column, least: float = 1e-12) -> DataFrame:
    """control, active: whether it is complete and varies in the sample known strictly before the cutoff."""
    known = training.where(F.col("training_available_at") < cutoff)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("control"), F.col(c).cast("double").alias("v")) for c in controls))).alias("x")
    g = known.select(cells).groupBy("x.control").agg(F.count("*").alias("n"), F.count("x.v").alias("k"), (F.max("x.v") - F.min("x.v")).alias("spread"))
    return g.select("control", "n", ((F.col("k") == F.col("n")) & F.coalesce(F.col("spread") > least, F.lit(False))).alias("active"))


def earliest_start(scores: DataFrame, pairs: DataFrame, minimum: int, end: str) -> DataFrame:
    """The first month with four months of history known and enough pairs to fit the transition: month, n_pairs.

    scores: month, available_at. pairs: month (source), pair_available_at.
    """
    oldest = scores.select(F.add_months("month", 3).alias("candidate"), F.col("available_at").alias("_known"))
    able = oldest.where((F.col("_known") < F.col("candidate")) & (F.col("candidate") <= F.lit(end).cast("date")))
    p = pairs.select(F.add_months("month", 1).alias("_next"), "pair_available_at")
    n = able.join(p, (F.col("_next") < F.col("candidate")) & (F.col("pair_available_at") <= F.col("candidate"))).groupBy("candidate").agg(F.count("*").alias("n_pairs"))
    return n.where(F.col("n_pairs") >= minimum).orderBy("candidate").limit(1).select(F.col("candidate").alias("month"), "n_pairs")


def own_month_mapping(targets: DataFrame, mappings: DataFrame, values: list[str]) -> DataFrame:
    """Each target (month, date) with its own month's newest mapping on or before the date, NULL if there is none."""
    m = mappings.select("month", F.col("available_at").alias("_a"), F.struct("available_at", *values).alias("_m"))
    hit = targets.select("month", "date").distinct().join(m, "month").where(F.col("_a") <= F.col("date")).groupBy("month", "date").agg(F.max_by("_m", "_a").alias("_m"))
    return targets.join(hit, ["month", "date"], "left").select(*targets.columns, F.col("_m.available_at").alias("mapping_available_at"), *(F.col(f"_m.{v}").alias(v) for v in values))


def post_roll_signals(checkpoints: DataFrame, marginals: DataFrame, specification: str) -> DataFrame:
    """One row for each month: the marginal of the current month just after the path was rolled.

    The query fails if a checkpoint lacks a regime, or its probabilities don't sum to one.
    """
    c = checkpoints.where((F.col("specification_id") == specification) & (F.col("checkpoint_type") == "post_month_roll"))
    m = marginals.where((F.col("marginal_type") == "path") & (F.col("relative_month") == 0)).select("checkpoint_id", "regime_id", "probability")
    wide = m.groupBy("checkpoint_id").pivot("regime_id", REGIMES).agg(F.sum("probability"))
    ok = _all_present(REGIMES) & (F.abs(sum((F.col(r) for r in REGIMES[1:]), F.col(REGIMES[0])) - 1) <= 1e-8)
    out = c.join(wide, "checkpoint_id", "left").where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("a checkpoint has no proper marginal")).isNull())
    return out.select(F.col("anchor_month").alias("holding_month"), F.col("as_of_date").alias("signal_date"), "checkpoint_id", *(F.col(r).alias(f"p_{r.lower()}") for r in REGIMES))


# ------------------------------------------------------------------ block likelihood


def block_likelihood(vectors: DataFrame, features: list[str], kappa: float = 5.0, method: str = "ledoit_wolf", fixed_shrinkage: float = 0.0, scale_multiplier: float = 1.0) -> dict[str, DataFrame]:
    """Shrunken means of the regimes and one covariance of the residuals around them.

    vectors: complete, labelled rows (regime_id and ``features``). Means are
    pulled towards the pooled mean by ``kappa`` observations; residuals are
    taken around the *shrunken* means and not centred. Everything is sums of
    products, so the sample may be of any size. ``method``: ledoit_wolf,
    empirical or fixed_spherical. Tables: means (regime_id, n, m_*), covariance
    (one row: n, shrinkage, c: row-major).
    """
    d = len(features)
    pooled = vectors.agg(*(F.avg(f).alias(f"_p_{f}") for f in features))
    own = vectors.groupBy("regime_id").agg(F.count("*").alias("n"), *(F.avg(f).alias(f"_m_{f}") for f in features))
    grid = vectors.sparkSession.createDataFrame([(r,) for r in REGIMES], "regime_id string")
    # One row of pooled means meets four regimes.
    means = grid.join(own, "regime_id", "left").join(pooled).withColumn("n", F.coalesce("n", F.lit(0)))
    shrunk = {f: (F.col("n") * F.coalesce(F.col(f"_m_{f}"), F.lit(0.0)) + kappa * F.col(f"_p_{f}")) / (F.col("n") + kappa) for f in features}
    means = means.select("regime_id", "n", *(v.alias(f"m_{f}") for f, v in shrunk.items()))
    e = vectors.join(means.drop("n"), "regime_id").select(*((F.col(f) - F.col(f"m_{f}")).alias(f) for f in features))
    squares = sum((F.col(f) * F.col(f) for f in features[1:]), F.col(features[0]) * F.col(features[0]))
    products = e.agg(F.count("*").alias("n"), F.avg(squares * squares).alias("_q"), *(F.avg(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j))
    s = lambda i, j: F.col(f"s_{min(i, j)}_{max(i, j)}")
    total = lambda xs: sum(xs[1:], xs[0])
    mu = total([s(i, i) for i in range(d)]) / d
    norm = total([s(i, j) * s(i, j) for i in range(d) for j in range(d)])
    delta, beta = (norm - d * mu * mu) / d, (F.col("_q") - norm) / (d * F.col("n"))
    shrinkage = {"ledoit_wolf": F.when((d == 1) | (delta <= 0), F.lit(0.0)).otherwise(F.greatest(F.least(beta, delta), F.lit(0.0)) / delta), "empirical": F.lit(0.0), "fixed_spherical": F.lit(float(fixed_shrinkage))}[method]
    products = products.withColumns({"shrinkage": shrinkage, "_mu": mu})
    cell = lambda i, j: ((1 - F.col("shrinkage")) * s(i, j) + (F.col("shrinkage") * F.col("_mu") if i == j else F.lit(0.0))) * scale_multiplier**2
    return {"means": means, "covariance": products.select("n", "shrinkage", F.array(*(cell(i, j) for i in range(d) for j in range(d))).alias("c"))}


def log_likelihoods(observations: DataFrame, keys: list[str], fit: dict[str, DataFrame], features: list[str], degrees_of_freedom: float | None = 7.0) -> DataFrame:
    """keys, regime_id, loglik: the log density of each observation in each regime, Student-t or Gaussian."""
    d, nu = len(features), degrees_of_freedom
    factor = 1.0 if nu is None else (nu - 2) / nu

    @F.pandas_udf(T.StructType([T.StructField("maha", T.DoubleType()), T.StructField("logdet", T.DoubleType())]))
    def solved(x: pd.Series, c: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"maha": [], "logdet": []}, dtype=float)
        # The covariance is one for all rows.
        scale = factor * np.asarray(c.iloc[0], float).reshape(d, d)
        v = np.stack([np.asarray(r, float) for r in x])
        return pd.DataFrame({"maha": (v * np.linalg.solve(scale, v.T).T).sum(1), "logdet": np.full(len(v), np.linalg.slogdet(scale)[1])})

    rows = observations.select(*keys, *features).join(fit["means"].drop("n")).join(fit["covariance"].select(F.col("c").alias("_cov")))
    gap = F.array(*(F.col(f) - F.col(f"m_{f}") for f in features))
    rows = rows.withColumn("_s", solved(gap, "_cov"))
    maha, logdet = F.col("_s.maha"), F.col("_s.logdet")
    if nu is None:
        density = -0.5 * (d * math.log(2 * math.pi) + logdet + maha)
    else:
        density = math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - 0.5 * (d * math.log(nu * math.pi) + logdet) - 0.5 * (nu + d) * F.log1p(maha / nu)
    return rows.select(*keys, "regime_id", density.alias("loglik"))


# ------------------------------------------------------------------ partial defining releases


def partial_defining(releases: DataFrame, scores: DataFrame, axes: dict[str, str], tolerance: float = 1e-10) -> DataFrame:
    """First releases of score components as events, with status and the composition of each event.

    releases: month, component, release_date, transformed_value. scores: month,
    growth_score, inflation_score and z_* for each component. axes: component ->
    growth or inflation. The query fails if a complete month's score is not the
    mean of its components' z.
    """
    names = list(axes)
    of_axis = {a: [c for c in names if axes[c] == a] for a in ("growth", "inflation")}
    for axis, members in of_axis.items():
        z = [F.col(f"z_{c}") for c in members]
        gap = F.abs(sum(z[1:], z[0]) / len(z) - F.col(f"{axis}_score"))
        scores = scores.where(F.assert_true(F.coalesce(gap <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"{axis}_score"))), F.lit(True)), F.lit(f"the {axis} score is not the mean of its components")).isNull())
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(f"z_{c}").alias("component_z"), F.lit(axes[c]).alias("axis"), F.lit(1.0 / len(of_axis[axes[c]])).alias("component_weight")) for c in names))).alias("x")
    long = scores.select("month", cells).select("month", "x.*")
    rows = releases.join(long, ["month", "component"], "left")
    status = F.when(F.col("month").isNull() | F.col("release_date").isNull(), "invalid_date").when(F.col("transformed_value").isNull(), "invalid_transformed_value").when(F.col("component_z").isNull(), "component_z_unavailable").otherwise("available")
    rows = rows.withColumns({"preparation_status": status, "event_id": F.concat_ws("|", F.date_format("release_date", "yyyy-MM-dd"), F.date_format("month", "yyyy-MM")), "weighted_contribution": F.col("component_weight") * F.col("component_z")})
    event = Window.partitionBy("event_id", F.col("preparation_status") == "available")
    parts = F.array_join(F.sort_array(F.collect_set("component").over(event)), "+")
    return rows.withColumns({"event_component_count": F.count("*").over(event), "event_components": parts})


def weight_audit(pairs: DataFrame, fits: DataFrame, estimators: dict[str, float]) -> DataFrame:
    """estimator, month, innovations, squared distance, weight and downweighted, for every pair of a robust VAR(1).

    fits: the table of ``models.robust_var`` (estimator, coefficients, scale).
    """
    tuning = F.create_map(*(x for k, v in estimators.items() for x in (F.lit(k), F.lit(float(v)))))
    rows = pairs.select("month", "x1", "x2", "y1", "y2").join(fits.select("estimator", "coefficients", "scale"))
    b = lambda i, j: F.get("coefficients", F.lit(2 * i + j))
    e = {f"innovation_{k + 1}": F.col(f"y{k + 1}") - b(0, k) - b(1, k) * F.col("x1") - b(2, k) * F.col("x2") for k in range(2)}
    rows = rows.withColumns(e)
    s = lambda i: F.get("scale", F.lit(i))
    u, v = F.col("innovation_1"), F.col("innovation_2")
    distance = (s(3) * u * u - (s(1) + s(2)) * u * v + s(0) * v * v) / (s(0) * s(3) - s(1) * s(2))
    rows = rows.withColumns({"squared_distance": distance, "_t": tuning[F.col("estimator")]})
    d2 = F.col("squared_distance")
    weight = F.when(F.col("estimator") == "student_t", (F.col("_t") + 2) / (F.col("_t") + d2)).otherwise(F.least(F.lit(1.0), F.col("_t") / F.sqrt(F.greatest(d2, F.lit(1e-300)))))
    return rows.select("estimator", "month", *e, "squared_distance", weight.alias("event_weight"), (weight < 1 - 1e-12).alias("is_downweighted"))
