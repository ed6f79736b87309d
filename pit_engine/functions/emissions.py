"""Linear emissions: specification, ridge and Student-t fits, observed parts and tail scores (NumPy only)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from pit_engine.functions import numerics as N


@dataclass(frozen=True)
class EmissionSpec:
    """What an emission relates, how loadings are penalised, and which are exactly zero.

    penalties and zero: one row for each response, one column for each state.
    """

    responses: tuple[str, ...]
    states: tuple[str, ...]
    controls: tuple[str, ...] = ()
    penalties: tuple[tuple[float, ...], ...] = ()
    zero: tuple[tuple[bool, ...], ...] = ()
    lambdas: tuple[float, ...] = (0.0, 0.1, 1.0, 10.0)
    eigenvalue_floor: float = 1e-8
    columns: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        shape = (len(self.responses), len(self.states))
        names = (*self.responses, *self.states, *self.controls)
        if not self.responses or not self.states or len(set(names)) < len(names):
            raise ValueError("an emission needs responses and states, and every name once")
        object.__setattr__(self, "penalties", self.penalties or ((1.0,) * shape[1],) * shape[0])
        object.__setattr__(self, "zero", self.zero or ((False,) * shape[1],) * shape[0])
        for m in (self.penalties, self.zero):
            if len(m) != shape[0] or any(len(row) != shape[1] for row in m):
                raise ValueError("penalties and zeros need a row for each response and a column for each state")
        if any(x < 0 for row in self.penalties for x in row) or any(x < 0 for x in self.lambdas):
            raise ValueError("penalties are not negative")
        object.__setattr__(self, "columns", names)


@dataclass(frozen=True)
class EmissionFit:
    """Intercept, loadings of states and controls, covariance (or Student-t scale) and the residuals it came from."""

    spec: EmissionSpec
    intercept: np.ndarray
    states: np.ndarray
    controls: np.ndarray
    covariance: np.ndarray
    residuals: np.ndarray
    active_controls: np.ndarray
    weights: np.ndarray
    degrees_of_freedom: float | None = None
    converged: bool = True

    def predict(self, states: np.ndarray, controls: np.ndarray) -> np.ndarray:
        return self.intercept + states @ self.states.T + controls @ self.controls.T

    def observed_system(self, observation: np.ndarray, controls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(innovation target, loadings, noise) of the responses that are there: y - intercept - controls, H, R.

        Missing responses are NaN; an observation without any is an error, and
        so is a missing control with a loading other than zero.
        """
        there = np.isfinite(observation)
        if not there.any():
            raise ValueError("an observation needs at least one response")
        used = np.abs(self.controls[there]).max(0, initial=0.0) > 0
        if not np.isfinite(controls[used]).all():
            raise ValueError("an observed response needs its controls")
        shift = self.controls[there][:, used] @ controls[used] if used.any() else 0.0
        return observation[there] - self.intercept[there] - shift, self.states[there], self.covariance[np.ix_(there, there)]


def fit_emission(y: np.ndarray, x: np.ndarray, u: np.ndarray, spec: EmissionSpec, base_lambda: float, degrees_of_freedom: float | None = None, iterations: int = 100, tolerance: float = 1e-8, least_weight: float = 1e-6) -> EmissionFit:
    """A ridge emission at one penalty: Gaussian, or Student-t by reweighting with one more fit at the final weights.

    Each response has its own design: an intercept, the states that its zeros
    leave, and the controls that vary. The residual covariance is a Ledoit-Wolf
    estimate that is not centred; a Student-t scale is the weighted mean of
    products. Eigenvalues are floored.
    """
    n, p, k = len(y), len(spec.responses), len(spec.states)
    active = np.ptp(u, axis=0) > 1e-12 if u.size else np.zeros(u.shape[1], bool)
    penalties, zero = np.array(spec.penalties, float), np.array(spec.zero, bool)

    def solve(w: np.ndarray):
        b, h, g = np.zeros(p), np.zeros((p, k)), np.zeros((p, u.shape[1]))
        for i in range(p):
            free = ~zero[i]
            design = np.column_stack([np.ones(n), x[:, free], u[:, active]])
            diagonal = np.concatenate([[0.0], base_lambda * penalties[i, free], np.zeros(int(active.sum()))])
            open_ = diagonal == 0
            if np.linalg.matrix_rank(design[:, open_]) < open_.sum():
                raise ValueError(f"the unpenalised design of {spec.responses[i]} is rank deficient")
            coefficients = N.ridge(y[:, i : i + 1], design, diagonal, w)[:, 0]
            b[i], h[i, free], g[i, active] = coefficients[0], coefficients[1 : 1 + free.sum()], coefficients[1 + free.sum() :]
        return b, h, g

    def scale_of(e: np.ndarray, w: np.ndarray) -> np.ndarray:
        if degrees_of_freedom is None:
            return N.floor_eigenvalues(uncentred_ledoit_wolf(e)[0], spec.eigenvalue_floor)
        return N.floor_eigenvalues((e * w[:, None]).T @ e / n, spec.eigenvalue_floor)

    w, converged = np.ones(n), degrees_of_freedom is None
    b, h, g = solve(w)
    if degrees_of_freedom is not None:
        for _ in range(iterations):
            e = y - b - x @ h.T - u @ g.T
            w = np.maximum(N.student_t_weights(e, scale_of(e, w), degrees_of_freedom), least_weight)
            last = np.concatenate([b, h.ravel(), g.ravel()])
            b, h, g = solve(w)
            moved = np.abs(np.concatenate([b, h.ravel(), g.ravel()]) - last).max()
            if moved <= tolerance * max(1.0, float(np.abs(last).max())):
                converged = True
                break
    e = y - b - x @ h.T - u @ g.T
    return EmissionFit(spec, b, h, g, scale_of(e, w), e, active, w, degrees_of_freedom, converged)


def uncentred_ledoit_wolf(e: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance of residuals that are not centred, shrunk towards a multiple of the identity, and the shrinkage."""
    n, p = e.shape
    s = e.T @ e / n
    mu = np.trace(s) / p
    delta = ((s * s).sum() - p * mu * mu) / p
    beta = (((e * e).sum(1) ** 2).mean() - (s * s).sum()) / (p * n)
    shrink = 0.0 if delta <= 0 or p == 1 else max(min(beta, delta), 0.0) / delta
    return (1 - shrink) * s + shrink * mu * np.eye(p), float(shrink)


def predictive_nll(fit: EmissionFit, y: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Negative log density of new rows under a fit."""
    e = y - fit.predict(x, u)
    if fit.degrees_of_freedom is not None:
        return N.student_t_nll(e, fit.covariance, fit.degrees_of_freedom)
    maha = (e * np.linalg.solve(fit.covariance, e.T).T).sum(1)
    return 0.5 * (e.shape[1] * math.log(2 * math.pi) + np.linalg.slogdet(fit.covariance)[1] + maha)
