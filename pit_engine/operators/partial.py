"""Evidence from a month's components before its scores are complete, and tuning schedules.

A score axis is the mean of its components. Components released so far say
something about the axis through their joint Gaussian with the others; an axis
whose components are all there is known exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pit_engine.functions.numerics import floor_eigenvalues, ledoit_wolf
from pit_engine.operators.filters import AXES, GaussianPath


def component_gaussian(history: np.ndarray, least: int, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and shrunk covariance of complete component rows; None below ``least`` rows."""
    rows = history[np.isfinite(history).all(1)]
    if len(rows) < least:
        return None
    return rows.mean(0), floor_eigenvalues(ledoit_wolf(rows)[0], floor)


def conditional_emission(mean: np.ndarray, cov: np.ndarray, axes: np.ndarray, new: list[int], known: list[int], floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New components as a linear Gaussian emission of the two scores and the components already seen.

    axes (2 x components) averages components into scores. Returns (intercept,
    loading on the scores, loading on the known components, noise).
    """
    given = np.vstack([axes, np.eye(len(mean))[known]])
    g, c = given @ cov @ given.T, np.eye(len(mean))[new] @ cov @ given.T
    gain = c @ np.linalg.pinv(g)
    noise = floor_eigenvalues(cov[np.ix_(new, new)] - gain @ c.T, floor)
    return mean[new] - gain @ (given @ mean), gain[:, :AXES], gain[:, AXES:], noise


def condition_axes(s: GaussianPath, month: int, values: dict[int, float], tolerance: float = 1e-8) -> GaussianPath:
    """Fix one or both axes of a month by pseudo-inverse; a known axis with another value is an error."""
    at = s.block(month)
    idx = [at.start + a for a in sorted(values)]
    want = np.array([values[a] for a in sorted(values)])
    known = np.diag(s.cov)[idx] < tolerance
    if (np.abs(s.mean[idx] - want)[known] > tolerance).any():
        raise ValueError("a fixed axis was given another value")
    gain = s.cov[:, idx] @ np.linalg.pinv(s.cov[np.ix_(idx, idx)])
    mean, cov = s.mean + gain @ (want - s.mean[idx]), s.cov - gain @ s.cov[idx]
    mean[idx] = want
    cov[idx, :] = cov[:, idx] = 0.0
    exact = s.exact.copy()
    exact[at.start // AXES] = bool((np.diag(cov)[at] < tolerance).all())
    return GaussianPath(s.newest, mean, (cov + cov.T) / 2, exact)


def apply_components(s: GaussianPath, month: int, new: dict[int, float], seen: dict[int, float], fit: tuple[np.ndarray, np.ndarray], axes: np.ndarray) -> GaussianPath:
    """One publication of components: an update given those seen before, then exact axes where complete.

    A component that was seen before is an error: no evidence counts twice.
    """
    from pit_engine.operators.filters import update

    if set(new) & set(seen):
        raise ValueError(f"components were processed before: {sorted(set(new) & set(seen))}")
    order, known = sorted(new), sorted(seen)
    all_values = seen | new
    done = {a: float(np.mean([all_values[j] for j in np.flatnonzero(axes[a])])) for a in range(AXES) if all(j in all_values for j in np.flatnonzero(axes[a]))}
    # Components of an axis that becomes exact carry nothing beyond it.
    order = [j for j in order if not any(axes[a, j] for a in done)]
    if order:
        intercept, loading, on_known, noise = conditional_emission(*fit, axes, order, known)
        y = np.array([new[j] for j in order]) - on_known @ np.array([seen[j] for j in known]) if known else np.array([new[j] for j in order])
        s, _, _ = update(s, month, y, loading, noise, intercept)
    return condition_axes(s, month, done) if done else s


def annual_schedule(folds: DataFrame, first_year: int, last_year: int, least_events: int, fallback: tuple[float, float]) -> DataFrame:
    """year, lambda, dof, source: for each year the pair that scored best in all earlier years.

    folds: year, lambda, dof, n, loss_sum. Ties go to the larger lambda, then to
    more degrees of freedom; too few earlier events give the fallback.
    """
    yearly = folds.groupBy("year", "lambda", "dof").agg(F.sum("n").alias("n"), F.sum("loss_sum").alias("loss"))
    years = folds.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("target"))
    past = Window.partitionBy("lambda", "dof").orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    every = F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("year")
    grid = yearly.select("lambda", "dof").distinct().select(every, "lambda", "dof", F.lit(0).alias("n"), F.lit(0.0).alias("loss"), F.lit(1).alias("_target"))
    run = yearly.withColumn("_target", F.lit(0)).unionByName(grid).withColumns({"past_n": F.sum("n").over(past), "past_loss": F.sum("loss").over(past)})
    best = run.where("_target = 1 and past_n > 0").groupBy("year").agg(F.max_by(F.struct("lambda", "dof", "past_n"), F.struct((-F.col("past_loss") / F.col("past_n")).alias("s"), F.col("lambda"), F.col("dof"))).alias("b"))
    out = years.select(F.col("target").alias("year")).join(best, "year", "left")
    ok = F.col("b.past_n") >= least_events
    pick = lambda c, k: F.when(ok, F.col(f"b.{c}")).otherwise(F.lit(float(fallback[k]))).alias(c)
    return out.select("year", pick("lambda", 0), pick("dof", 1), F.when(ok, "earlier_years").otherwise("fallback").alias("source"))


def segment_circular_means(segments: list[np.ndarray], replications: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Means of resamples by circular blocks within each gapless segment: no block bridges a gap."""
    total = np.zeros(replications)
    for x in segments:
        b = min(block, len(x))
        starts = rng.integers(0, len(x), (replications, -(-len(x) // b)))
        at = ((starts[:, :, None] + np.arange(b)) % len(x)).reshape(replications, -1)[:, : len(x)]
        total += x[at].sum(1)
    return total / sum(map(len, segments))


def centred_p_value(means: np.ndarray, observed: float) -> float:
    """Two-sided p-value of an observed mean under the resampled means moved to zero."""
    return float((1 + (np.abs(means - means.mean()) >= abs(observed)).sum()) / (1 + len(means)))
