"""Tracking on event time: late-tolerant, with state that empties itself.

Positions of a frame may arrive in any order.  They wait in the state until the watermark passes their frame, which no row can then
join; frames are linked in their order, so a shuffled stream gives what the sorted table gives.  A track that found nothing for
`memory` frames is taken out by a timer on event time, whether or not its key ever has another row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.signals import matched_frame

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A track's number is its first frame times this, plus its place among the positions that began with it.
BEGUN = 1 << 20


class Tracker(StatefulProcessor):
    """State of a key: `waiting` positions (a list) and live `tracks` (a map from number to position, frame and time)."""

    def __init__(self, names: list[str], search_range: float, memory: int, frame_ms: int):
        self.names, self.search_range, self.memory, self.frame_ms = names, search_range, memory, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The watermark of the last timer, and the keys that have been linked up to it and had no row since.
        self.passed, self.done = None, set()
        self.waiting = handle.getListState("waiting", "frame bigint, at bigint, x double")
        self.tracks = handle.getMapState("tracks", "track bigint", "x double, frame bigint, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Keeps the rows, with a timer at each frame's time."""
        self.done.discard(tuple(key))
        for pdf in rows:
            at = pdf["sl_ms"].to_numpy()
            self.waiting.appendList(list(zip(pdf["frame"].tolist(), at.tolist(), pdf["x"].tolist())))
            for t in np.unique(at).tolist():
                self.handle.registerTimer(t)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Links all frames that the watermark has passed, then takes out the tracks that no later frame can continue."""
        passed = timerValues.getCurrentWatermarkInMs()
        if passed != self.passed:
            self.passed, self.done = passed, set()
        if tuple(key) in self.done:
            return
        self.done.add(tuple(key))
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = [w for w in waiting if w[1] <= passed]
        tracks = {k[0]: v for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        stored = {n: tuple(v) for n, v in tracks.items()}
        if ready:
            rest = [w for w in waiting if w[1] > passed]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            pdf = pd.DataFrame(ready, columns=["frame", "at", "x"]).sort_values(["frame", "x"])
            parts = [self._link(tracks, int(f), part) for f, part in pdf.groupby("frame", sort=True)]
            out = pd.concat(parts)
            for name, value in reversed(list(zip(self.names, key))):
                out.insert(0, name, value)
            yield out
        for number in [n for n, (_, _, at) in tracks.items() if at + (self.memory + 1) * self.frame_ms <= passed]:
            del tracks[number]
            if number in stored:
                self.tracks.removeKey((number,))
        # Each of these is a call to the JVM: only what is new, and one timer for all tracks of a time.
        for number, value in tracks.items():
            if stored.get(number) != tuple(value):
                self.tracks.updateValue((number,), value)
        for at in {v[2] for v in tracks.values()}:
            self.handle.registerTimer(at + (self.memory + 1) * self.frame_ms)

    def _link(self, tracks: dict[int, tuple], frame: int, part: pd.DataFrame) -> pd.DataFrame:
        x, at = part["x"].to_numpy(), int(part["at"].iloc[0])
        live = sorted(n for n, (_, f, _) in tracks.items() if frame - f <= self.memory + 1)
        found = matched_frame(np.array([tracks[n][0] for n in live]), x, self.search_range)
        numbers, begun = [], 0
        for c, i in enumerate(found.tolist()):
            number = live[i] if i >= 0 else frame * BEGUN + begun
            begun += i < 0
            tracks[number] = (float(x[c]), frame, at)
            numbers.append(number)
        return pd.DataFrame({"frame": frame, "x": x, "track": numbers})

    def close(self) -> None:
        pass


def tracked(peaks: DataFrame, keys: list[str], column: str, frame_ms: int, search_range: float = 2.0, memory: int = 10, late: str = "0 seconds") -> DataFrame:
    """A stream peaks(keys, frame, column, x) -> (keys, frame, x, track), appended once the watermark (the latest `column` less `late`) has passed a frame.

    `column` is the time of the row's frame, `frame_ms` milliseconds from frame to frame.  Rows behind the watermark are dropped.  A
    track's number tells its first frame and its place there (see BEGUN); numbers of a key rise as tracks begin.  The session must keep
    its state in RocksDB (`spark.sql.streaming.stateStore.providerClass`), as the operator's timers need.
    """
    kinds = dict(peaks.dtypes)
    df = peaks.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)
    df = df.select(*keys, column, F.col("frame").cast("long").alias("frame"), F.unix_millis(column).alias("sl_ms"), F.col("x").cast("double").alias("x"))
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", frame bigint, x double, track bigint"
    return df.groupBy(*keys).transformWithStateInPandas(Tracker(list(keys), search_range, memory, frame_ms), outputStructType=out, outputMode="Append", timeMode="EventTime")
