from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pit_engine.operators import asof as A
from pit_engine.operators import windows as W


def d(n):
    return date(2024, 1, 1) + timedelta(n)


def test_asof_boundaries_and_ties(spark):
    left = spark.createDataFrame([("a", d(5), 1), ("a", d(1), 2), ("b", d(9), 3), (None, d(9), 4)], "k string, t date, id int")
    right = spark.createDataFrame([("a", d(5), 10, 1), ("a", d(2), 20, 1), ("a", d(2), 21, 2), ("a", None, 99, 1)], "k string, s date, v int, o int")
    strict = {r.id: r.v for r in A.asof_join(left, right, ["k"], "t", "s", ["v"], True, ["o"]).collect()}
    loose = {r.id: r.v for r in A.asof_join(left, right, ["k"], "t", "s", ["v"], False, ["o"]).collect()}
    assert strict == {1: 21, 2: None, 3: None, 4: None} and loose == {1: 10, 2: None, 3: None, 4: None}


def test_asof_with_clashing_names_and_empty_sides(spark):
    left = spark.createDataFrame([("a", d(5), 7)], "k string, t date, v int")
    right = spark.createDataFrame([("a", d(1), 8)], "k string, s date, w int")
    assert A.asof_join(left, right.limit(0), ["k"], "t", "s", ["w"]).collect()[0].w is None
    assert A.asof_join(left.limit(0), right, ["k"], "t", "s", ["w"]).count() == 0


def test_checked_join_rejects_repeated_keys(spark):
    l = spark.createDataFrame([(1, "x")], "k int, a string")
    r = spark.createDataFrame([(1, "y"), (1, "z")], "k int, b string")
    with pytest.raises(Exception, match="not unique"):
        A.join_checked(l, r, ["k"]).collect()
    assert A.join_checked(r, l, ["k"]).count() == 2


def test_equal_dates_never_see_each_other(spark):
    rows = [("s", d(i // 2), float((i * 7) % 5)) for i in range(20)]
    z = W.group_causal_zscore(spark.createDataFrame(rows, "k string, t date, v double"), ["k"], "t", "v", 4).collect()
    for r in z:
        past = [v for _, t, v in rows if t < r.t]
        assert r.prior_n == len(past)
        if r.status == "available":
            assert abs(r.z - (r.v - np.mean(past)) / np.std(past, ddof=1)) < 1e-9


def test_ar1_matches_a_fit_on_earlier_publications(spark):
    rng = np.random.default_rng(0)
    level = np.exp(rng.normal(size=40).cumsum() * 0.1)
    df = spark.createDataFrame([("s", d(7 * i), d(7 * i + 5), float(x)) for i, x in enumerate(level)], "k string, ref date, rel date, level double")
    out = W.group_causal_ar1(df, ["k"], "ref", "rel", "level", 10, 5).orderBy("ref").collect()
    y = np.log(level)
    for t in (15, 30, 39):
        slope, const = np.polyfit(y[: t - 1], y[1:t], 1)
        assert abs(out[t].innovation - (y[t] - const - slope * y[t - 1])) < 1e-9


def test_pairs_do_not_bridge_gaps(spark):
    df = spark.createDataFrame([(1, date(2020, 1, 1), 1.0, d(0)), (1, date(2020, 2, 1), 2.0, d(1)), (1, date(2020, 4, 1), 3.0, d(2))], "k int, m date, x double, a date")
    assert [r.pair_status for r in W.successor_pairs(df, ["k"], "m", ["x"], "a").orderBy("m").collect()] == ["valid", "calendar_gap", "no_successor"]


def test_compare_keyed(spark):
    l = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    r = spark.createDataFrame([(2, 2.5), (3, None), (4, 4.0)], "k int, v double")
    got = {x.k: x.status for x in A.compare_keyed(l, r, ["k"], "v", 0.1).collect()}
    assert got == {1: "lost", 2: "changed", 3: "same", 4: "added"}


def test_drawdown_and_trailing_mean(spark):
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate([1.0, 1.2, 0.9, 1.1])], "m string, i int, v double")
    assert abs(W.max_drawdown(df, ["m"], ["i"], "v").first()[1] + 0.25) < 1e-12
    assert [r.trailing_mean is None for r in W.trailing_full_mean(df, ["m"], "i", "v", 3).orderBy("i").collect()] == [True, True, False, False]
