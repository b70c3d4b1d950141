"""Streaming forms: sessions of events, windowed aggregates, tracking with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signals import assignment


def timed(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """ts as a timestamp, watermarked if events is a stream (a timestamp without zone can't be)."""
    df = events.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, late) if events.isStreaming else df


def merged_events(events: DataFrame, key: str, gap: str, least_seconds: float, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events of a key nearer than `gap` become one; those that last `least_seconds` at least stay: (key, start, stop, n, seconds). Batch or stream."""
    sessions = timed(events, column, late).groupBy(key, F.session_window(column, gap).alias("w")).agg(F.count("*").alias("n"), F.min(column).alias("start"), F.max(column).alias("stop"))
    seconds = F.unix_micros("stop") - F.unix_micros("start")
    return sessions.select(key, "start", "stop", "n", (seconds / 1e6).alias("seconds")).where(F.col("seconds") >= least_seconds)


def windowed(events: DataFrame, key: str, size: str, slide: str | None = None, value: str = "value", column: str = "ts", late: str = "1 hour") -> DataFrame:
    """Count, mean, least and largest value in tumbling (or sliding) windows. Batch or stream."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    out = timed(events, column, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "mean", "low", "high")


def tracked(peaks: DataFrame, key: str, search_range: float = 2.0, memory: int = 10, idle_ms: int | None = None) -> DataFrame:
    """A stream peaks(key, frame, x) -> (key, frame, x, track): positions linked frame by frame across micro-batches.

    State of a key: its live tracks (number, position, last frame) and the next
    number.  Frames must reach a key in order; rows of frames that were linked
    already are dropped.  With idle_ms the state of a key without rows for so
    many milliseconds is given up; rows that come later begin anew.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(peaks.dtypes)[key]

    def run(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        numbers, positions, frames, following, last = state.get if state.exists else ([], [], [], 0, -(1 << 62))
        pdf = pd.concat(list(pdfs)).sort_values(["frame", "x"])
        rows = []
        for frame, part in pdf[pdf["frame"] > last].groupby("frame", sort=True):
            x = part["x"].to_numpy()
            live = [i for i, f in enumerate(frames) if frame - f <= memory + 1]
            numbers, positions, frames = ([a[i] for i in live] for a in (numbers, positions, frames))
            taken = {}
            if numbers:
                d = np.abs(np.array(positions)[:, None] - x[None])
                for r, c in zip(*assignment(np.where(d <= search_range, d**2, 1e12))):
                    if d[r, c] <= search_range:
                        taken[c] = r
            for c, v in enumerate(x):
                if c in taken:
                    r = taken[c]
                    positions[r], frames[r] = float(v), int(frame)
                    rows.append((group[0], int(frame), float(v), numbers[r]))
                else:
                    numbers.append(following)
                    positions.append(float(v))
                    frames.append(int(frame))
                    rows.append((group[0], int(frame), float(v), following))
                    following += 1
            last = int(frame)
        state.update((numbers, positions, frames, following, last))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[key, "frame", "x", "track"])

    out = f"{key} {kind}, frame bigint, x double, track bigint"
    kept = "numbers array<bigint>, positions array<double>, frames array<bigint>, following bigint, last bigint"
    return peaks.select(key, F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x")).groupBy(key).applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
