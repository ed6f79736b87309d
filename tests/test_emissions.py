"""Emission fits, tail scores and allocation against independent computations."""

import math

import numpy as np
import pytest

from pit_engine.functions import emissions as E
from pit_engine.functions import numerics as N


def data(n=120, seed=0):
    rng = np.random.default_rng(seed)
    x, u = rng.normal(size=(n, 2)), np.column_stack([rng.normal(size=n), np.full(n, 3.0)])
    y = np.column_stack([1 + 0.5 * x[:, 0] + 0.2 * u[:, 0], -1 + 0.7 * x[:, 1]]) + 0.1 * rng.standard_t(4, size=(n, 2))
    return y, x, u


SPEC = E.EmissionSpec(("a", "b"), ("g", "i"), ("c", "k"), zero=((False, True), (True, False)))


def test_ridge_with_zeros_and_a_constant_control():
    y, x, u = data()
    f = E.fit_emission(y, x, u, SPEC, 2.0)
    assert f.active_controls.tolist() == [True, False]
    assert f.states[0, 1] == 0 and f.states[1, 0] == 0 and not f.controls[:, 1].any()
    design = np.column_stack([np.ones(len(x)), x[:, 0], u[:, 0]])
    want = np.linalg.solve(design.T @ design + np.diag([0, 2.0, 0]), design.T @ y[:, 0])
    assert np.allclose([f.intercept[0], f.states[0, 0], f.controls[0, 0]], want)
    assert np.allclose(f.residuals, y - f.predict(x, u))
    with pytest.raises(ValueError):
        E.fit_emission(y, np.zeros_like(x), u, SPEC, 0.0)


def test_student_t_fit_is_a_fixed_point():
    y, x, u = data()
    f = E.fit_emission(y, x, u, SPEC, 1.0, 5.0)
    assert f.converged and f.weights.min() < 0.9
    d2 = np.einsum("ij,jk,ik->i", f.residuals, np.linalg.inv(f.covariance), f.residuals)
    assert np.allclose(f.weights, (5 + 2) / (5 + d2), rtol=1e-3)
    design = np.column_stack([np.ones(len(x)), x[:, 1], u[:, 0]])
    w = f.weights[:, None]
    want = np.linalg.solve((design * w).T @ design + np.diag([0, 1.0, 0]), (design * w).T @ y[:, 1])
    assert np.allclose([f.intercept[1], f.states[1, 1], f.controls[1, 0]], want)


def test_observed_parts_and_densities():
    y, x, u = data()
    f = E.fit_emission(y, x, u, SPEC, 1.0)
    target, loadings, noise = f.observed_system(np.array([np.nan, 2.0]), np.array([0.5, np.nan]))
    assert np.allclose(target, 2.0 - f.intercept[1] - f.controls[1, 0] * 0.5) and loadings.shape == (1, 2) and np.allclose(noise, f.covariance[1:, 1:])
    with pytest.raises(ValueError):
        f.observed_system(np.array([np.nan, np.nan]), np.zeros(2))
    with pytest.raises(ValueError):
        f.observed_system(np.array([1.0, np.nan]), np.array([np.nan, 0.0]))
    e = y[:3] - f.predict(x[:3], u[:3])
    c = f.covariance
    want = [0.5 * (v @ np.linalg.inv(c) @ v + math.log(np.linalg.det(c)) + 2 * math.log(2 * math.pi)) for v in e]
    assert np.allclose(E.predictive_nll(f, y[:3], x[:3], u[:3]), want)


def test_specifications_are_checked():
    for bad in ({"responses": ()}, {"states": ("a",)}, {"zero": ((True,),)}, {"lambdas": (-1.0,)}):
        with pytest.raises(ValueError):
            E.EmissionSpec(**({"responses": ("a", "b"), "states": ("g", "i")} | bad))


def test_annual_tail_scores_against_a_loop(spark):
    import datetime

    from pit_engine.operators import models as M

    y, x, u = data(72)
    days = [datetime.date(2000 + k // 12, k % 12 + 1, 1) for k in range(72)]
    rows = [("p", d, *map(float, (*a, *b, *c))) for d, a, b, c in zip(days, y, x, u, strict=True)]
    table = spark.createDataFrame(rows, "profile string, d date, a double, b double, g double, i double, c double, k double")
    spec = E.EmissionSpec(SPEC.responses, SPEC.states, SPEC.controls, zero=SPEC.zero, lambdas=(0.5, 2.0))
    got = {(r.base_lambda, r.degrees_of_freedom, r.year): r for r in M.annual_tail_scores(table, ["profile"], "d", spec, [None, 5.0], 24).collect()}
    assert len(got) == 2 * 2 * 6 and got[0.5, None, 2001].status == "insufficient_history"
    for (lam, nu, year), r in got.items():
        at = np.array([d.year for d in days])
        if (at < year).sum() < 24:
            continue
        past, now = at < year, at == year
        f = E.fit_emission(y[past], x[past], u[past], spec, lam, nu)
        assert r.status == "scored" and math.isclose(r.total_nll, E.predictive_nll(f, y[now], x[now], u[now]).sum(), rel_tol=1e-6)
    best = M.tuned_emissions(table, ["profile"], "d", spec, [None, 5.0], 24).collect()[0]
    means = {}
    for (lam, nu, _), r in got.items():
        if r.status == "scored":
            means.setdefault((lam, nu), []).append(r.total_nll)
    assert (best.base_lambda, best.degrees_of_freedom) == min(means, key=lambda k: sum(means[k])) and best.n == 72 and best.loadings[1] == 0


def test_active_allocation_meets_its_limits_and_beats_a_grid():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [0.01, 0.02, 0.015]
    cov, gain = np.cov(x.T) * 52, np.array([0.0004, 0.0012, 0.0002])
    bench, before, caps, costs = np.array([0.5, 0.2, 0.3]), np.array([0.45, 0.25, 0.3]), np.full(3, 0.6), np.full(3, 0.0003)
    for te in (0.005, 0.02, 0.2):
        args = (gain, cov, bench, before, caps, [(np.array([0, 1]), 0.75)], costs, te, 0.08, 0.1, 0.2)
        w, status = N.active_allocate(*args)
        value = lambda w: gain @ (w - bench) - costs @ np.abs(w - before)
        assert status == "optimal" and abs(w.sum() - 1) < 1e-7 and (np.abs(w - bench) < 0.08 + 1e-6).all() and np.abs(w - bench).sum() / 2 < 0.1 + 1e-6
        assert (w - bench) @ cov @ (w - bench) < (te + 1e-6) ** 2 and w[:2].sum() < 0.75 + 1e-6
        best = -np.inf
        for a in np.linspace(-0.08, 0.08, 81):
            for b in np.linspace(-0.08, 0.08, 81):
                v = bench + [a, b, -a - b]
                d = v - bench
                if np.abs(d).max() <= 0.08 and np.abs(d).sum() / 2 <= 0.1 and d @ cov @ d <= te**2 and v @ cov @ v <= 0.04 and v[:2].sum() <= 0.75 and v.max() <= 0.6:
                    best = max(best, value(v))
        assert value(w) >= best - 1e-6
    w, status = N.active_allocate(-np.zeros(3), cov, bench, bench, caps, [], costs, 0.01, 0.05, 0.1, 0.2)
    assert status == "benchmark" and (w == bench).all()
