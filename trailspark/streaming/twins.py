"""Streaming forms of the causal operators; on a finished input they give the batch results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailspark.operators.lineage import python_workers


def tumbling_counts(stream: DataFrame, width: str, late: str, time: str = "ts", key: str | None = None) -> DataFrame:
    """Rows and distinct tracks of each window of time: windows of each track first, then their counts, so that both are exact. In append mode."""
    keys = [key] if key else []
    per = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys, "track_id").agg(F.count("*").alias("n"))
    return per.groupBy(F.window(F.window_time("window"), width), *keys).agg(F.sum("n").alias("n"), F.count("*").alias("tracks"))


def session_platoons(stream: DataFrame, gap: str, late: str, key: str, time: str = "ts") -> DataFrame:
    """Platoons of events less than ``gap`` apart."""
    return stream.withWatermark(time, late).groupBy(F.col(key), F.session_window(time, gap)).agg(F.count("*").alias("n"))


def speed_field(stream: DataFrame, width: str, cell: float, late: str, time: str = "ts") -> DataFrame:
    """Mean speed of time by station cells."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), F.floor(F.col("x") / cell).alias("si")).agg(F.avg("speed").alias("speed"), F.count("*").alias("n"))


def _by_time(stream: DataFrame, time: str | None) -> str:
    """Timeouts by event time where the stream has a watermark on ``time``, else none."""
    return GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout


def hysteresis(stream: DataFrame, low: float, high: float, key: str = "track_id", order: str = "k", time: str | None = None, quiet_ms: int = 60_000) -> DataFrame:
    """Changes of the two-threshold state of each track: key, order, stopped. State: the last value of it and the last order seen.

    Rows of one trigger are put in order; a row older than what was seen is too late and is
    left out. With ``time``, a timestamp under a watermark, the state of a track that has
    been quiet for ``quiet_ms`` beyond the watermark is dropped; a later row begins anew.
    """
    python_workers(stream.sparkSession)

    def step(key_values: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order)
        stopped, seen = state.get if state.exists else (None, None)
        out = []
        for k, v in zip(rows[order].tolist(), rows["speed"].tolist(), strict=True):
            if seen is not None and k <= seen:
                continue
            now = True if v < low else False if v > high else bool(stopped)
            if stopped is None or now != stopped:
                out.append((key_values[0], k, now))
            stopped, seen = now, k
        if seen is not None:
            state.update((stopped, seen))
            if time:
                state.setTimeoutTimestamp(max(int(rows[time].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + quiet_ms)
        yield pd.DataFrame(out, columns=[key, order, "stopped"])

    kinds = dict(stream.dtypes)
    cols = [key, order, "speed"] + ([time] if time else [])
    return stream.select(*cols).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, stopped boolean", f"stopped boolean, seen {kinds[order]}", "append", _by_time(stream, time))


def refractory(stream: DataFrame, seconds: float, key: str = "track_id", time: str = "t", clock: str | None = None) -> DataFrame:
    """Events at least ``seconds`` after the last accepted one of their key.

    With ``clock``, a timestamp under a watermark, a key's state is dropped ``seconds``
    after its last event, when it can hold nothing back any more.
    """
    python_workers(stream.sparkSession)

    def step(key_values: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(rows[time].tolist()):
            if last is None or t - last >= seconds:
                out.append((key_values[0], t))
                last = t
        if last is not None:
            state.update((last,))
            if clock:
                state.setTimeoutTimestamp(max(int(rows[clock].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(seconds * 1000) + 1)
        yield pd.DataFrame(out, columns=[key, time])

    kinds = dict(stream.dtypes)
    cols = [key, time] + ([clock] if clock else [])
    return stream.select(*cols).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {time} double", "last double", "append", _by_time(stream, clock))
