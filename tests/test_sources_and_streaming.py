import io
import json
from datetime import date

import pytest

from pit_engine.sources import charts, snapshots, vintage_zip


def test_vintage_zip_round_trip(spark, tmp_path):
    cells = [("X", date(2020, m, 1), date(2020, v, 5), None if v < m else float(10 * m + v)) for m in (1, 2) for v in (1, 2, 3)]
    data = vintage_zip.encode(cells)
    assert data == vintage_zip.encode(list(reversed(cells))) and sorted(vintage_zip.read_cells(io.BytesIO(data)), key=str) == sorted(cells, key=str)
    (tmp_path / "x.zip").write_bytes(data)
    vintage_zip.register(spark)
    rows = spark.read.format("vintage_zip").option("paths", str(tmp_path / "x.zip")).load().collect()
    assert sorted(map(tuple, rows), key=str) == sorted(cells, key=str)
    assert vintage_zip.read_binary(spark, str(tmp_path)).count() == len(cells)


def test_bad_vintage_columns():
    with pytest.raises(ValueError):
        vintage_zip.vintage_of("X_2020")


def test_snapshots_detect_changes(tmp_path):
    s = snapshots.SnapshotStore(tmp_path)
    what = {"provider_id": "p", "series_id": "s", "source_url": "https://example.org/x", "query": {"id": "s"}, "retrieved_at": "2024-01-01T00:00:00+00:00"}
    r = s.capture(b"abc", **what)
    assert s.capture(b"abc", **what) == r and s.read(r) == b"abc" and r["retrieval_status"] == "retrieved"
    with pytest.raises(ValueError, match="other bytes"):
        s.capture(b"abd", **what)
    for bad in ({"source_url": "x"}, {"source_url": "https://u:p@example.org"}, {"query": {"api_key": "k"}}, {"source_url": "https://example.org/?token=1"}, {"retrieved_at": "2024-01-01"}, {"provider_id": ""}):
        with pytest.raises(ValueError):
            s.capture(b"abc", **what | bad)
    next((tmp_path / "objects").rglob(r["sha256"])).write_bytes(b"abd")
    with pytest.raises(ValueError):
        s.read(r)


def test_strict_config_and_json():
    assert snapshots.load_yaml("a: 1\nb: {c: 2}", {"a", "b"})["b"] == {"c": 2}
    for bad in ("a: 1\na: 2", "a: 1\nz: 1", "z: 1"):
        with pytest.raises(ValueError):
            snapshots.load_yaml(bad, {"a"})
    assert snapshots.strict_json({"x": float("nan")}) == '{"x": null}'


def test_manifest_and_publish(tmp_path):
    snapshots.publish(tmp_path, {"b.txt": b"2", "README.md": b"1"}, last="README.md")
    m = snapshots.manifest(tmp_path, ["b.txt"])
    assert snapshots.verified_bytes(tmp_path, "b.txt", m) == b"2"
    (tmp_path / "b.txt").write_bytes(b"3")
    with pytest.raises(ValueError):
        snapshots.verified_bytes(tmp_path, "b.txt", m)


def test_charts(spark):
    doc = {"chart": {"result": [{"meta": {"symbol": "T", "exchangeTimezoneName": "America/New_York"}, "timestamp": [1704205800, 1704292200], "events": {"dividends": {"1": {"amount": 0.5, "date": 1704292200}}}, "indicators": {"quote": [{"open": [1.0, 2.0], "high": [1.0, 2.0], "low": [1.0, 2.0], "close": [1.5, None], "volume": [10, 20]}], "adjclose": [{"adjclose": [1.4, None]}]}}]}}
    raw = spark.createDataFrame([(json.dumps(doc),)], "value string")
    bars = charts.parse_charts(raw).orderBy("date").collect()
    assert [(b.date, b.close) for b in bars] == [(date(2024, 1, 2), 1.5), (date(2024, 1, 3), None)]
    assert [(a.date, a.cash_distribution) for a in charts.parse_actions(raw).collect()] == [(date(2024, 1, 3), 0.5)]
    later = charts.parse_charts(raw).withColumn("date", __import__("pyspark.sql.functions", fromlist=["date_add"]).date_add("date", 1))
    assert charts.fill_latest_bar(charts.parse_charts(raw), later).count() == 3


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "k int, v double")
    for form, comp in (("parquet", None), ("csv", "gzip"), ("json", None)):
        snapshots.write_table(df, str(tmp_path / form), form, comp)
    assert spark.read.parquet(str(tmp_path / "parquet")).where("v is null").count() == 1
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from pit_engine.operators.models import replay
    from pit_engine.plans.models import PARAMETERS
    from pit_engine.streaming.replay import deduplicated, filter_stream, weekly_totals

    events = [(date(1995, 5 + k, 20), "evidence", f"e{k}", 303 + k, 0.5 * k, -0.2) for k in range(5)] + [(date(1995, 6 + k, 5), "exact", f"x{k}", 303 + k, 0.4 * k, -0.1) for k in range(4)]
    schema = "date date, kind string, event_id string, month bigint, y1 double, y2 double"
    for n, part in enumerate((sorted(events)[:4], sorted(events)[4:])):
        spark.createDataFrame([("g", *e) for e in part], "variant string, " + schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("variant string, " + schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = filter_stream(stream, PARAMETERS).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.checkpoint_id, r.phase, r.status, round(r.growth_mean, 9))
    batch = replay(spark.createDataFrame(events, schema), {"g": None}, PARAMETERS).collect()
    assert sorted(map(key, spark.table("replayed").collect())) == sorted(map(key, batch))

    ev = spark.createDataFrame([("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-01 10:00:00", 1.0), ("b", "2024-01-09 00:00:00", 2.0)], "id string, ts string, v double").selectExpr("id", "cast(ts as timestamp) ts", "v")
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = deduplicated(s, "ts", "id").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2
    weeks = {(str(r.week), r.n) for r in weekly_totals(ev, "ts", [], "v").collect()}
    assert weeks == {("2024-01-01", 2), ("2024-01-08", 1)}
