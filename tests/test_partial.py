import numpy as np
import pytest

from pit_engine.operators import filters as K
from pit_engine.operators import partial as P

AX = np.array([[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]])
B, C, Q = np.array([[0.6, 0.1], [0.0, 0.5]]), np.zeros(2), np.eye(2) * 0.3


def fit():
    x = np.random.default_rng(0).normal(size=(200, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0.2, 0], [0, 0, 1, 0.4], [0, 0, 0, 1]])
    return P.component_gaussian(x, 60)


def test_emission_is_the_conditional_gaussian():
    m, c = fit()
    a, on_scores, on_known, noise = P.conditional_emission(m, c, AX, [1], [2])
    given = np.vstack([AX, np.eye(4)[[2]]])
    v = np.array([0.3, -0.2, 0.7])
    want = m[1] + c[1] @ given.T @ np.linalg.solve(given @ c @ given.T, v - given @ m)
    assert np.allclose(a + on_scores @ v[:2] + on_known @ v[2:], want) and noise[0, 0] < c[1, 1]
    assert P.component_gaussian(np.full((70, 4), np.nan), 60) is None


def test_complete_axis_is_exact_and_nothing_counts_twice():
    s = K.initial_path(0, np.zeros(2), np.eye(2), B, C, Q)
    one = P.apply_components(s, 3, {0: 1.0}, {}, fit(), AX)
    at = s.block(3)
    assert one.cov[at, at][0, 0] < s.cov[at, at][0, 0] and not one.exact[3]
    two = P.apply_components(one, 3, {1: 2.0}, {0: 1.0}, fit(), AX)
    assert np.isclose(two.mean[at][0], 1.5) and np.isclose(two.cov[at, at][0, 0], 0) and not two.exact[3]
    full = P.apply_components(two, 3, {2: 0.0, 3: 1.0}, {0: 1.0, 1: 2.0}, fit(), AX)
    assert full.exact[3] and np.allclose(full.mean[at], [1.5, 0.5])
    with pytest.raises(ValueError):
        P.apply_components(two, 3, {0: 1.0}, {0: 1.0}, fit(), AX)
    with pytest.raises(ValueError):
        P.condition_axes(two, 3, {0: 9.0})


def test_schedule_sees_earlier_years_only(spark):
    rows = [(2000, 1.0, 5.0, 10, 20.0), (2000, 2.0, 5.0, 10, 10.0), (2001, 1.0, 5.0, 10, 5.0), (2001, 2.0, 5.0, 10, 25.0), (2002, 1.0, 5.0, 10, 0.0), (2002, 2.0, 5.0, 10, 99.0)]
    got = {r.year: (r["lambda"], r.source) for r in P.annual_schedule(spark.createDataFrame(rows, "year int, lambda double, dof double, n int, loss_sum double"), 2000, 2003, 10, (9.0, 7.0)).collect()}
    assert got == {2000: (9.0, "fallback"), 2001: (2.0, "earlier_years"), 2002: (1.0, "earlier_years"), 2003: (1.0, "earlier_years")}


def test_segments_are_not_bridged():
    rng = np.random.default_rng(0)
    m = P.segment_circular_means([np.zeros(10), np.ones(10)], 50, 4, rng)
    assert np.allclose(m, 0.5)
    x = rng.normal(size=60)
    m = P.segment_circular_means([x], 2000, 6, rng)
    assert abs(m.mean() - x.mean()) < 0.02
    assert P.centred_p_value(m, 5.0) < 0.001 and P.centred_p_value(m, 0.0) == 1.0
