import json
from datetime import date, datetime
from urllib.parse import parse_qs, urlparse

import pytest

from pit_engine.sources import providers as P
from pit_engine.sources import report

VINTAGES = [date(2020, 1, 10), date(2020, 2, 7)]


def fake(url):
    u = urlparse(url)
    q = {k: v[0] for k, v in parse_qs(u.query).items()}
    if u.path.endswith("vintagedates"):
        rows = [v.isoformat() for v in VINTAGES]
        at = int(q["offset"])
        return json.dumps({"count": 2, "vintage_dates": rows[at : at + int(q["limit"])]}).encode()
    if u.path.endswith("observations") and q["output_type"] == "4":
        return json.dumps({"count": 1, "observations": [{"date": "2019-12-01", "realtime_start": "2020-01-10", "value": "1.5"}]}).encode()
    if u.path.endswith("observations"):
        row = {"date": "2019-12-01"} | {f"X_{v.replace('-', '')}": "1.5" for v in q["vintage_dates"].split(",")}
        return json.dumps({"count": 1, "observations": [row]}).encode()
    if u.path.endswith("vintages"):
        return b'<select><option value="2020-01-10">a</option><option selected value="2020-02-07">b</option></select>'
    dates = q["vintage_date"].split(",")
    return ("observation_date," + ",".join(f"X_{v.replace('-', '')}" for v in dates) + "\n2019-12-01," + ",".join("." if v < "2020-02" else "1.5" for v in dates)).encode()


def test_clients_and_cache(tmp_path):
    j = P.JsonClient("http://h", "k", fake, page=1)
    assert j.vintages("X") == VINTAGES and list(j.first_releases("X")) == [(date(2019, 12, 1), date(2020, 1, 10), 1.5)]
    assert list(j.cells("X", VINTAGES)) == [("X", date(2019, 12, 1), v, 1.5) for v in VINTAGES]
    c = P.choose("auto", {}, "KEY", "http://h", "http://h", fake)
    assert isinstance(c, P.CsvClient) and c.vintages("X") == VINTAGES
    cells = P.download_or_load(c, "X", tmp_path)
    assert cells == [("X", date(2019, 12, 1), VINTAGES[0], None), ("X", date(2019, 12, 1), VINTAGES[1], 1.5)]
    broken = P.CsvClient("http://h", lambda url: (_ for _ in ()).throw(OSError("down")))
    assert P.download_or_load(broken, "X", tmp_path, vintages=VINTAGES[1:]) == cells[1:]
    assert isinstance(P.choose("auto", {"KEY": "k"}, "KEY", "http://h", "http://h", fake), P.JsonClient)
    with pytest.raises(ValueError):
        P.choose("json", {}, "KEY", "http://h", "http://h", fake)
    with pytest.raises(ValueError):
        list(P.read_graph_csv(b"observation_date,X_20200110\n", "X", VINTAGES))


def test_retries():
    calls, waits = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("no")
        return b"ok"

    assert P.retried(flaky, 4, 1.0, waits.append)("u") == b"ok" and waits == [1.0, 2.0]


def test_report():
    s = {"as_of": "2024-01-05", "signal_week": "2024-01-08", "weights": {"A": 0.6, "B": 0.4}, "probabilities": {"UU": 1.0}, "metrics": [{"method": "m", "cagr": 0.1}]}
    now = datetime(2024, 1, 8)
    page = report.update_page(f"x{report.BEGIN}old{report.END}y", report.render(s, now))
    assert "| A | 60.0% |" in page and "old" not in page and page.startswith("x") and page.endswith("y")
    for bad in ({**s, "weights": {"A": 0.9}}, {**s, "as_of": "2025-01-01"}, {k: v for k, v in s.items() if k != "metrics"}):
        with pytest.raises(ValueError):
            report.validate(bad, now)
    with pytest.raises(ValueError):
        report.update_page("no markers", "b")
