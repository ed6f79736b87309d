"""Grouped fits and replays: NumPy bodies over bounded groups, partial sums where groups are not bounded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pit_engine.functions import emissions as E
from pit_engine.functions import numerics as N
from pit_engine.functions.emissions import EmissionSpec


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def quadrant_masses(g: pd.Series, i: pd.Series, vg: pd.Series, cgi: pd.Series, vi: pd.Series) -> pd.Series:
    """Masses of the four quadrants (UU, DU, UD, DD) of a bivariate normal."""
    rows = zip(g, i, vg, cgi, vi, strict=True)
    return pd.Series([N.quadrant_masses(np.array([a, b]), np.array([[c, d], [d, e]])) for a, b, c, d, e in rows])


@F.pandas_udf(T.DoubleType())
def beta_quantile(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([N.beta_ppf(*x) for x in zip(p, a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([N.chi2_sf(*v) for v in zip(x, dof, strict=True)])


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation."""
    t = r * np.sqrt((n - 2) / (1 - r * r).clip(lower=1e-300))
    return pd.Series([N.t_two_sided(a, b - 2) for a, b in zip(t, n, strict=True)])


def ledoit_wolf(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, n, shrinkage, covariance (row-major) of each group, however large.

    Each task reduces its rows to sums of products of fixed size per group; only
    those are shuffled and combined.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist())
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            for k in dict.fromkeys(keys.tolist()):
                v = x[keys == k]
                s = [np.float64(len(v)), v.sum(0), v.T @ v, (v * v).T @ (v * v), (v * v).T @ v]
                sums[k] = s if k not in sums else [a + b for a, b in zip(sums[k], s, strict=True)]
        rows = [(k, float(s[0]), *(a.ravel().tolist() for a in s[1:])) for k, s in sums.items()]
        names = ["k", "n", "s1", "s2", "s4", "s3"]
        kinds = [pa.int64(), pa.float64()] + [pa.list_(pa.float64())] * 4
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].sum()
        s1, s2, s4, s3 = (np.sum(np.stack(pdf[c].to_list()), axis=0) for c in ("s1", "s2", "s4", "s3"))
        p = len(s1)
        m, s2, s4, s3 = s1 / n, s2.reshape(p, p), s4.reshape(p, p), s3.reshape(p, p)
        cov = s2 / n - np.outer(m, m)
        # Sum over rows of (x_i - m_i)^2 (x_j - m_j)^2 from raw moments.
        q = np.diag(s2)
        mm = m * m
        quad = s4 - 2 * s3 * m - 2 * s3.T * m[:, None] + np.outer(q, mm) + np.outer(mm, q) + 4 * np.outer(m, m) * s2 - 3 * n * np.outer(mm, mm)
        mu = np.trace(cov) / p
        delta = ((cov * cov).sum() - p * mu * mu) / p
        beta = (quad / n - cov * cov).sum() / (p * n)
        shrink = 0.0 if delta <= 0 or p == 1 else min(beta, delta) / delta
        out = (1 - shrink) * cov + shrink * mu * np.eye(p)
        return pd.DataFrame({group: [key[0]], "n": [int(n)], "shrinkage": [float(shrink)], "covariance": [out.ravel().tolist()]})

    rows = df.select(F.col(group).cast("bigint").alias("k"), vector)
    sums = rows.mapInArrow(partial, "k bigint, n double, s1 array<double>, s2 array<double>, s4 array<double>, s3 array<double>")
    return sums.groupBy("k").applyInPandas(combine, f"{group} bigint, n bigint, shrinkage double, covariance array<double>")


def robust_var(pairs: DataFrame, estimators: dict[str, float]) -> DataFrame:
    """estimator, n, converged, coefficients (3 x 2, row-major), innovation covariance, least weight.

    pairs: x1, x2, y1, y2. The group is one score history: months, not rows of data.
    """
    spec = F.explode(F.array(*(F.struct(F.lit(k).alias("estimator"), F.lit(float(v)).alias("tuning")) for k, v in estimators.items()))).alias("e")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["month"])
        x = np.column_stack([np.ones(len(pdf)), pdf["x1"], pdf["x2"]])
        y = pdf[["y1", "y2"]].to_numpy(float)
        b, scale, w, ok = N.irls(y, x, key[0], key[1])
        return pd.DataFrame({"estimator": [key[0]], "n": [len(pdf)], "converged": [bool(ok)], "coefficients": [b.ravel().tolist()], "scale": [scale.ravel().tolist()], "least_weight": [float(w.min())]})

    rows = pairs.select("month", "x1", "x2", "y1", "y2", spec).select("month", "x1", "x2", "y1", "y2", "e.*")
    return rows.groupBy("estimator", "tuning").applyInPandas(fit, "estimator string, n bigint, converged boolean, coefficients array<double>, scale array<double>, least_weight double")


def rolling_origin_residuals(table: DataFrame, by: list[str], date: str, response: str, states: list[str], lambdas: list[float], minimum: int) -> DataFrame:
    """Out-of-sample residuals of a ridge emission at each penalty: fits see earlier dates only.

    Columns: by, lambda, date, n (rows the fit saw), prediction, residual,
    variance and loss (the predictive log loss). One group for each (model,
    penalty); rows of one date are held out together. A fit needs the sums of
    products of all earlier rows, and those grow by one date's rows at a time.
    """

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([date]).reset_index(drop=True)
        x = np.column_stack([np.ones(len(pdf)), pdf[states].to_numpy(float)])
        y = pdf[response].to_numpy(float)
        penalty = np.diag([0.0] + [key[-1]] * len(states))
        xx, xy, yy, n = np.zeros((x.shape[1],) * 2), np.zeros(x.shape[1]), 0.0, 0
        out = []
        for d, rows in pdf.groupby(date, sort=True).groups.items():
            u, v = x[rows], y[rows]
            if n >= minimum:
                b = np.linalg.lstsq(xx + penalty, xy, rcond=None)[0]
                variance = max(float((yy - 2 * b @ xy + b @ xx @ b) / n), 1e-12)
                for a, e in zip(u @ b, v - u @ b, strict=True):
                    out.append((*key, d, n, float(a), float(e), variance, float(0.5 * (np.log(2 * np.pi * variance) + e * e / variance))))
            xx, xy, yy, n = xx + u.T @ u, xy + u.T @ v, yy + v @ v, n + len(rows)
        return pd.DataFrame(out, columns=[*by, "lambda", date, "n", "prediction", "residual", "variance", "loss"])

    rows = table.select(*by, date, response, *states, F.explode(F.array(*(F.lit(float(v)) for v in lambdas))).alias("lambda")).dropna()
    kinds = dict(table.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + f", lambda double, {date} {kinds[date]}, n bigint, prediction double, residual double, variance double, loss double"
    return rows.groupBy(*by, "lambda").applyInPandas(score, schema)


def rolling_origin_scores(table: DataFrame, by: list[str], date: str, response: str, states: list[str], lambdas: list[float], minimum: int) -> DataFrame:
    """Mean predictive log loss of a ridge emission at each penalty."""
    e = rolling_origin_residuals(table, by, date, response, states, lambdas, minimum)
    return e.groupBy(*by, "lambda").agg(F.count("loss").alias("n"), F.avg("loss").alias("mean_loss"))


def choose_lambda(scores: DataFrame, by: list[str]) -> DataFrame:
    """The penalty of least loss; ties go to the larger one."""
    best = F.max_by(F.struct("lambda", "mean_loss", "n"), F.struct(-F.col("mean_loss"), F.col("lambda")))
    return scores.where("mean_loss is not null").groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def student_t_emission(table: DataFrame, by: list[str], response: str, states: list[str], penalty: float, dof: float) -> DataFrame:
    """IRLS Student-t emission per model: coefficients, scale, least weight, convergence and an id of the sample."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_id"])
        x = np.column_stack([np.ones(len(pdf)), pdf[states].to_numpy(float)])
        b, scale, w, ok = N.irls(pdf[[response]].to_numpy(float), x, "student_t", dof, np.array([0.0] + [penalty] * len(states)))
        sample = hashlib.sha256("|".join(map(str, pdf["row_id"])).encode()).hexdigest()
        return pd.DataFrame([[*key, len(pdf), b[:, 0].tolist(), float(scale[0, 0]), float(w.min()), bool(ok), sample]], columns=[*by, "n", "coefficients", "scale", "least_weight", "converged", "sample_sha256"])

    schema = ", ".join(f"{c} {dict(table.dtypes)[c]}" for c in by) + ", n bigint, coefficients array<double>, scale double, least_weight double, converged boolean, sample_sha256 string"
    return table.select(*by, "row_id", response, *states).dropna().groupBy(*by).applyInPandas(fit, schema)


CHECKPOINT = "variant string, checkpoint_id bigint, date date, phase string, month bigint, newest_month bigint, status string, log_density double, event_weight double, growth_mean double, inflation_mean double, p_uu double, p_du double, p_ud double, p_dd double"


def replay(events: DataFrame, variants: dict[str, float | None], parameters: dict) -> DataFrame:
    """The event-driven filter for each variant: one ordered fold per variant, variants in parallel.

    events: date, kind (evidence / exact), event_id, month (months since 1970),
    y1, y2. variants: name -> Student-t degrees of freedom, None for Gaussian,
    0 for a replay without evidence.
    """
    from pit_engine.operators.filters import EventFilter

    p = {k: np.array(v, float) for k, v in parameters.items() if k != "start"}
    start = int(parameters["start"])
    name = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.lit(v, ).cast("double").alias("dof")) for k, v in variants.items()))).alias("v")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dof = None if key[1] is None or np.isnan(key[1]) else key[1]
        f = EventFilter(p["b"], p["c"], p["q"], start, p["mean"], p["cov"], np.eye(2), p["noise"], np.zeros(2), dof or None, p["mapping"])
        rows = []
        for date, day in pdf.sort_values(["date", "event_id"]).groupby("date", sort=True):
            evidence = [{"event_id": r.event_id, "month": int(r.month), "y": np.array([r.y1, r.y2])} for r in day.itertuples() if r.kind == "evidence" and dof != 0]
            exact = [{"month": int(r.month), "score": np.array([r.y1, r.y2])} for r in day.itertuples() if r.kind == "exact"]
            rows += f.day(date, date.year * 12 + date.month - 1 - 1970 * 12, evidence, exact)
        return pd.DataFrame([{"variant": key[0], **r} for r in rows], columns=[c.strip().split(" ")[0] for c in CHECKPOINT.split(",")])

    rows = events.select("date", "kind", "event_id", "month", "y1", "y2", name).select("*", "v.*").drop("v")
    return rows.groupBy("variant", "dof").applyInPandas(run, CHECKPOINT)


def allocate_sequentially(returns: DataFrame, specifications: dict[str, float], minimum: int, cap: float, cost: float, vol_cap: float) -> DataFrame:
    """Target weights per specification and period: each fit sees earlier periods, each trade starts from the drifted target.

    returns: period, ticker, ret. specifications: name -> shrinkage kappa.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="period", columns="ticker", values="ret").sort_index().dropna()
        n = wide.shape[1]
        held, rows = np.full(n, 1.0 / n), []
        for t in range(minimum, len(wide)):
            past = wide.iloc[:t].to_numpy(float)
            mu = past.mean(0) * len(past) / (len(past) + key[1])
            cov, _ = N.ledoit_wolf(past)
            w, status = N.allocate(mu, cov, held, np.full(n, cap), [], np.full(n, cost), vol_cap)
            w = np.maximum(w, 0) / np.maximum(w, 0).sum()
            rows += [(key[0], wide.index[t], a, float(x), status) for a, x in zip(wide.columns, w, strict=True)]
            held = w * (1 + wide.iloc[t].to_numpy(float))
            held = held / held.sum()
        return pd.DataFrame(rows, columns=["method", "period", "ticker", "target_weight", "status"])

    spec = F.explode(F.array(*(F.struct(F.lit(k).alias("method"), F.lit(float(v)).alias("kappa")) for k, v in specifications.items()))).alias("s")
    rows = returns.select("period", "ticker", "ret", spec).select("period", "ticker", "ret", "s.*")
    return rows.groupBy("method", "kappa").applyInPandas(run, "method string, period date, ticker string, target_weight double, status string")


def months_since_1970(c: Column) -> Column:
    return (F.year(c) - 1970) * 12 + F.month(c) - 1


def annual_tail_scores(table: DataFrame, by: list[str], date: str, spec: EmissionSpec, degrees: list[float | None], minimum: int) -> DataFrame:
    """Predictive log loss of each year by fits on the rows known before it, for each penalty and tail.

    Columns: by, base_lambda, degrees_of_freedom (NULL: Gaussian), year, status
    (scored, insufficient_history or fit_error), n, total_nll, mean_nll. One
    group for each (by, penalty, tail): the folds of a grid run in parallel.
    """
    grid = [F.struct(F.lit(float(lam)).alias("base_lambda"), F.lit(nu).cast("double").alias("degrees_of_freedom")) for lam in spec.lambdas for nu in degrees]

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([date, *spec.columns])
        lam, nu = key[-2], None if key[-1] is None or np.isnan(key[-1]) else key[-1]
        y, x, u = (pdf[list(c)].to_numpy(float).reshape(len(pdf), len(c)) for c in (spec.responses, spec.states, spec.controls))
        years, out = pd.to_datetime(pdf[date]).dt.year.to_numpy(), []
        for year in np.unique(years):
            past, now = years < year, years == year
            total, status = None, "insufficient_history"
            if past.sum() >= minimum:
                try:
                    fit = E.fit_emission(y[past], x[past], u[past], spec, lam, nu)
                    total, status = float(E.predictive_nll(fit, y[now], x[now], u[now]).sum()), "scored"
                except (ValueError, np.linalg.LinAlgError):
                    status = "fit_error"
            out.append((*key[:-2], lam, nu, int(year), status, int(now.sum()), total, None if total is None else total / int(now.sum())))
        return pd.DataFrame(out, columns=[*by, "base_lambda", "degrees_of_freedom", "year", "status", "n", "total_nll", "mean_nll"])

    rows = table.select(*by, date, *spec.columns, F.explode(F.array(*grid)).alias("_grid")).select(*by, date, *spec.columns, "_grid.*").dropna(subset=[date, *spec.columns])
    kinds = dict(table.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", base_lambda double, degrees_of_freedom double, year int, status string, n bigint, total_nll double, mean_nll double"
    return rows.groupBy(*by, "base_lambda", "degrees_of_freedom").applyInPandas(score, schema)


def tuned_emissions(table: DataFrame, by: list[str], date: str, spec: EmissionSpec, degrees: list[float | None], minimum: int) -> DataFrame:
    """Per model the penalty and tail of least predictive loss (ties: larger), refitted on all its rows.

    Columns: by, base_lambda, degrees_of_freedom, mean_nll, n, intercept, loadings, control_loadings, covariance, converged.
    """
    scores = annual_tail_scores(table, by, date, spec, degrees, minimum).where("status = 'scored'").groupBy(*by, "base_lambda", "degrees_of_freedom").agg((F.sum("total_nll") / F.sum("n")).alias("mean_nll"))
    tail = F.coalesce("degrees_of_freedom", F.lit(float("inf")))
    best = scores.groupBy(*by).agg(F.min_by(F.struct("base_lambda", "degrees_of_freedom", "mean_nll"), F.struct("mean_nll", -F.col("base_lambda"), -tail)).alias("b")).select(*by, "b.*")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([date, *spec.columns])
        y, x, u = (pdf[list(c)].to_numpy(float).reshape(len(pdf), len(c)) for c in (spec.responses, spec.states, spec.controls))
        lam, nu, nll = key[-3:]
        nu = None if nu is None or np.isnan(nu) else nu
        f = E.fit_emission(y, x, u, spec, lam, nu)
        row = (*key[:-3], lam, nu, nll, len(pdf), f.intercept.tolist(), f.states.ravel().tolist(), f.controls.ravel().tolist(), f.covariance.ravel().tolist(), bool(f.converged))
        return pd.DataFrame([row], columns=[*by, "base_lambda", "degrees_of_freedom", "mean_nll", "n", "intercept", "loadings", "control_loadings", "covariance", "converged"])

    rows = table.select(*by, date, *spec.columns).dropna(subset=[date, *spec.columns]).join(best, by)
    kinds = dict(table.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", base_lambda double, degrees_of_freedom double, mean_nll double, n bigint, intercept array<double>, loadings array<double>, control_loadings array<double>, covariance array<double>, converged boolean"
    return rows.groupBy(*by, "base_lambda", "degrees_of_freedom", "mean_nll").applyInPandas(fit, schema)
