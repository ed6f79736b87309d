"""Release events on a stream: watermarked deduplication, week totals and the stateful filter.

The filter is the batch fold with its state kept by Structured Streaming. Late
and early targets are emitted with a status, never dropped silently; a repeated
event is reported as a duplicate. One date must lie in one micro-batch, which
holds for append-only files of whole days.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pit_engine.operators.filters import EventFilter
from pit_engine.operators.models import CHECKPOINT

#: The longest lag of a release after its period.
MAX_LATENESS = "92 days"


def deduplicated(events: DataFrame, time: str, key: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, MAX_LATENESS).dropDuplicatesWithinWatermark([key])


def weekly_totals(events: DataFrame, time: str, by: list[str], value: str, lateness: str = "1 day") -> DataFrame:
    """Totals in tumbling weeks that start on Monday (the epoch was a Thursday)."""
    week = F.window(time, "7 days", startTime="4 days").alias("w")
    out = events.withWatermark(time, lateness).groupBy(*by, week).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*by, F.to_date("w.start").alias("week"), "n", "total")


def filter_stream(events: DataFrame, parameters: dict, dof: float | None = None) -> DataFrame:
    """Checkpoint rows of the event filter, one keyed state per variant.

    events: variant, date, kind, event_id, month, y1, y2 (as for the batch replay).
    """
    p = {k: np.array(v, float) for k, v in parameters.items() if k != "start"}
    start = int(parameters["start"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pickle.loads(state.get[0]) if state.exists else EventFilter(p["b"], p["c"], p["q"], start, p["mean"], p["cov"], np.eye(2), p["noise"], np.zeros(2), dof, p["mapping"])
        rows = []
        for date, day in pd.concat(list(batches)).sort_values(["date", "event_id"]).groupby("date", sort=True):
            evidence = [{"event_id": r.event_id, "month": int(r.month), "y": np.array([r.y1, r.y2])} for r in day.itertuples() if r.kind == "evidence"]
            exact = [{"month": int(r.month), "score": np.array([r.y1, r.y2])} for r in day.itertuples() if r.kind == "exact"]
            rows += f.day(date, date.year * 12 + date.month - 1 - 1970 * 12, evidence, exact)
        state.update((pickle.dumps(f),))
        yield pd.DataFrame([{"variant": key[0], **r} for r in rows], columns=[c.strip().split(" ")[0] for c in CHECKPOINT.split(",")])

    return events.groupBy("variant").applyInPandasWithState(step, CHECKPOINT, "filter binary", "append", GroupStateTimeout.NoTimeout)
