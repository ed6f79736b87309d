from datetime import date

from pyspark.sql import functions as F

from pit_engine.operators import vintages as V
from pit_engine.operators.calendar import gapless

#: One series, three vintages (the golden revision matrix).
CELLS = [
    ("X", date(2019, 11, 1), date(2020, 1, 10), 90.0), ("X", date(2019, 12, 1), date(2020, 1, 10), 100.0), ("X", date(2020, 1, 1), date(2020, 1, 10), None),
    ("X", date(2019, 11, 1), date(2020, 2, 7), 91.0), ("X", date(2019, 12, 1), date(2020, 2, 7), 102.0), ("X", date(2020, 1, 1), date(2020, 2, 7), 112.0),
    ("X", date(2019, 11, 1), date(2020, 3, 6), 92.0), ("X", date(2019, 12, 1), date(2020, 3, 6), 103.0), ("X", date(2020, 1, 1), date(2020, 3, 6), 113.0), ("X", date(2020, 2, 1), date(2020, 3, 6), 120.0),
]
SCHEMA = "series_id string, reference_date date, vintage_date date, value double"


def test_prior_level_comes_from_the_same_vintage(spark):
    a = spark.createDataFrame(CELLS, SCHEMA)
    f = V.first_release_features(a, "difference", 60).where("status = 'available'").orderBy("reference_date").collect()
    assert [(r.reference_date, r.release_date, r.transformed_value) for r in f] == [
        (date(2019, 12, 1), date(2020, 1, 10), 10.0), (date(2020, 1, 1), date(2020, 2, 7), 10.0), (date(2020, 2, 1), date(2020, 3, 6), 7.0)]


def test_later_vintages_change_nothing_earlier(spark):
    early = spark.createDataFrame([c for c in CELLS if c[2] < date(2020, 3, 1)], SCHEMA)
    full = spark.createDataFrame([(*c[:3], (c[3] or 0) * 7 if c[2] > date(2020, 3, 1) else c[3]) for c in CELLS], SCHEMA)
    cut = V.first_release_features(full, "difference", 60).where("release_date < date'2020-03-01'")
    assert sorted(map(tuple, V.first_release_features(early, "difference", 60).collect())) == sorted(map(tuple, cut.collect()))


def test_archive_start_and_late_releases(spark):
    a = spark.createDataFrame(CELLS, SCHEMA)
    rows = {r.reference_date: r.status for r in V.first_release_features(a, "difference", 8, archive_start_latest_only=True).collect()}
    assert rows[date(2019, 11, 1)] == "archive_start"
    assert rows[date(2020, 2, 1)] == "available" and rows[date(2019, 12, 1)] == "released_too_late"


def test_nan_is_missing(spark):
    a = spark.createDataFrame([("X", date(2020, 1, 1), date(2020, 2, 1), float("nan")), ("X", date(2020, 1, 1), date(2020, 3, 1), 5.0)], SCHEMA)
    assert [tuple(r) for r in V.first_release(a).collect()] == [("X", date(2020, 1, 1), date(2020, 3, 1), 5.0)]


def test_ledger_reasons(spark):
    a = spark.createDataFrame([("X", date(2020, m, 1), date(2020, m + 1, 10), 1.0) for m in (1, 3)], SCHEMA)
    l = V.availability_ledger(a, F.lit("2020-03-01").cast("timestamp")).orderBy("reference_date").collect()
    assert [r.reason for r in l] == ["available", "not_released", "not_released"]


def test_alignment_carries_snapshots_not_cells(spark):
    a = spark.createDataFrame([("A", date(2020, 1, 1), date(2020, 2, 1), 1.0), ("A", date(2020, 1, 1), date(2020, 3, 1), None)], SCHEMA)
    b = spark.createDataFrame([("B", date(2020, 1, 1), date(2020, 2, 15), 2.0), ("B", date(2020, 1, 1), date(2020, 3, 15), 3.0)], SCHEMA)
    rows = sorted(map(tuple, V.align_vintages(a, b).collect()), key=str)
    assert rows == [(date(2020, 2, 15), date(2020, 1, 1), 1.0, 2.0), (date(2020, 3, 1), date(2020, 1, 1), None, 2.0), (date(2020, 3, 15), date(2020, 1, 1), None, 3.0)]


def test_gapless_calendar(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1)), ("a", date(2020, 4, 1))], "k string, d date")
    assert gapless(df, ["k"], "d").count() == 4
    assert gapless(df.limit(0), ["k"], "d").count() == 0


def test_transforms(spark):
    df = spark.createDataFrame([(2.0, 1.0), (-1.0, 1.0), (None, 1.0)], "a double, b double")
    got = df.select(*(V.apply_transform(F.col("a"), F.col("b"), t).alias(t) for t in ("difference", "negative_difference", "log_difference"))).collect()
    assert got[0][0] == 1.0 and got[0][1] == -1.0 and abs(got[0][2] - 69.3147) < 1e-3
    assert got[1][2] is None and got[2][0] is None
