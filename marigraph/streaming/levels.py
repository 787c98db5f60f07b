"""Streams of water levels: windowed means with late data, and peaks as they pass.

Both are extensions. Watermarks bound the state; peaks keep two points a station.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PEAKS = "station_id long, type string, ts timestamp, height double"
_STATE = "ts1 timestamp, y1 double, ts2 timestamp, y2 double"


def windowed_levels(levels: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Mean, least and largest height of each station in windows of time; rows later than ``late`` are left out."""
    marked = levels.withWatermark("ts", late)
    out = marked.groupBy(F.window("ts", window), "station_id").agg(F.avg("height").alias("mean"), F.min("height").alias("low"), F.max("height").alias("high"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("begin"), "station_id", "mean", "low", "high", "n")


def _peaks(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    points = pd.concat(list(batches)).sort_values("ts")
    held = []
    if state.exists:
        a, b, c, d = state.get
        held = [p for p in ((a, b), (c, d)) if p[0] is not None and not pd.isna(p[0])]
    run = held + list(zip(points["ts"], points["height"], strict=True))
    out = []
    for (_, a), (t, y), (_, c) in zip(run, run[1:], run[2:], strict=False):
        if (y > a and y > c) or (y < a and y < c):
            out.append((key[0], "High" if y > a else "Low", t, y))
    last = ([(None, None)] * 2 + run)[-2:]
    state.update((last[0][0], last[0][1], last[1][0], last[1][1]))
    yield pd.DataFrame(out, columns=["station_id", "type", "ts", "height"])


def streaming_peaks(levels: DataFrame) -> DataFrame:
    """Three-point extrema of each station (station_id, ts, height in order of time) as soon as the point after them is there."""
    return levels.groupBy("station_id").applyInPandasWithState(_peaks, PEAKS, _STATE, "append", GroupStateTimeout.NoTimeout)
