"""Tracking on event time gives the batch's tracks from a shuffled stream, and empties its state."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import signals
from sparkloom.streaming import tracking

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, tracking.ROCKSDB)
    yield spark
    spark.conf.unset(key)


def _walks(rng, key, frames, n):
    """Positions of n walking tracks with gaps of up to five frames."""
    rows, x = [], np.arange(n) * 4.0
    for f in range(frames):
        x = x + rng.normal(0, 0.4, n)
        rows += [(key, f, START + dt.timedelta(seconds=f), float(v)) for v in x[rng.random(n) > 0.6]]
    return rows


def _batch(rows, search_range, memory):
    frames = [np.array(sorted(x for _, f, _, x in rows if f == i)) for i in range(1 + max(f for _, f, _, _ in rows))]
    found = signals.linked(frames, search_range, memory)
    return {(f, x): t for f, (xs, ts) in enumerate(zip(frames, found)) for x, t in zip(xs.tolist(), ts.tolist())}


def _run(spark, rows, folder, batches, late, name, **options):
    """Rows in so many files, one a batch."""
    source = f"{folder}/in"
    for i in range(batches):
        part = rows[i * len(rows) // batches : (i + 1) * len(rows) // batches]
        spark.createDataFrame(part, "k string, frame long, ts timestamp, x double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k string, frame long, ts timestamp, x double").option("maxFilesPerTrigger", 1).parquet(source)
    out = tracking.tracked(stream, ["k"], "ts", 1000, late=late, **options)
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
    return spark.table(name).collect(), state


@pytest.mark.parametrize("batches,shuffle,late", [(1, 0, "0 seconds"), (6, 12, "25 seconds")])
def test_a_shuffled_stream_gives_the_batch_result(rocksdb, tmp_path, batches, shuffle, late):
    rng = np.random.default_rng(batches)
    keys = {k: _walks(rng, k, 60, 4) for k in ("a", "b")}
    rows = [r for rs in keys.values() for r in rs]
    # Rows come up to `shuffle` frames late; a far row pushes the watermark past all of them.
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + (rng.random() * shuffle))
    far = ("end", 10_000, START + dt.timedelta(seconds=10_000), 0.0)
    found, state = _run(rocksdb, [rows[i] for i in order] + [far], tmp_path, batches, late, f"tracks{batches}", search_range=1.5, memory=3)
    for k, own in keys.items():
        want = _batch(own, 1.5, 3)
        got = {(r.frame, r.x): r.track for r in found if r.k == k}
        assert got.keys() == want.keys()
        numbers = {t: i for i, t in enumerate(sorted(set(got.values())))}
        assert {p: numbers[t] for p, t in got.items()} == want and len(numbers) >= 4
        assert all(min(f for (f, _), u in got.items() if u == t) == t // tracking.BEGUN for t in numbers)


def test_state_is_empty_after_expiry(rocksdb, tmp_path):
    """Nothing waits and no track lives once the watermark is past all frames and the memory; only the last key's rows are left."""
    rows = _walks(np.random.default_rng(1), "a", 30, 5)
    far = [("z", 1000 + i, START + dt.timedelta(seconds=1000 + i), 0.0) for i in range(2)]
    found, state = _run(rocksdb, rows + far[:1], tmp_path, 1, "0 seconds", "expired", search_range=1.5, memory=3)
    assert len([r for r in found if r.k == "a"]) == len(rows)
    # The state's rows: z's track and its timer (in the timers' two column families).
    assert state <= 4


class _Held:
    """State of one key in memory, which counts the calls to it."""

    def __init__(self):
        self.rows, self.map, self.timers, self.calls = [], {}, [], 0

    def getListState(self, *_):
        return self

    def getMapState(self, *_):
        return _Map(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def appendList(self, rows):
        self.rows += rows

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def put(self, rows):
        self.rows = rows


class _Map:
    def __init__(self, held):
        self.held = held

    def exists(self):
        return bool(self.held.map)

    def iterator(self):
        self.held.calls += len(self.held.map)
        return iter(list(self.held.map.items()))

    def containsKey(self, key):
        self.held.calls += 1
        return key in self.held.map

    def updateValue(self, key, value):
        self.held.calls += 1
        self.held.map[key] = value

    def removeKey(self, key):
        self.held.calls += 1
        del self.held.map[key]


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_timers_of_a_watermark_read_the_state_once():
    """Every frame has a timer, and all of them fire behind one watermark; calls to the state don't grow with frames times tracks."""
    import pandas as pd

    n, frames = 50, 40
    held, tracker = _Held(), tracking.Tracker(["k"], 1.5, 2, 1000)
    tracker.init(held)
    rows = [(f, f * 1000, 4.0 * i) for f in range(frames) for i in range(n)]
    list(tracker.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["frame", "sl_ms", "x"])]), None))
    held.calls = 0
    found = [part for _ in range(frames) for part in tracker.handleExpiredTimer(("a",), _At((frames - 1) * 1000), None)]
    assert sum(map(len, found)) == n * frames and len(held.map) == n
    assert held.calls < 3 * n
    # Rows that come later are linked, at the same watermark too, and tracks end once it is far beyond them.
    list(tracker.handleInputRows(("a",), iter([pd.DataFrame([(frames, frames * 1000, 0.0)], columns=["frame", "sl_ms", "x"])]), None))
    later = [part for ms in (frames - 1, frames, 10 * frames) for part in tracker.handleExpiredTimer(("a",), _At(ms * 1000), None)]
    assert [r for part in later for r in part["track"]] == [0] and not held.map and not held.rows


def test_rows_behind_the_watermark_are_dropped(rocksdb, tmp_path):
    rows = [("a", f, START + dt.timedelta(seconds=f), 1.0) for f in (0, 1, 2, 50, 51)] + [("a", 1, START + dt.timedelta(seconds=1), 9.0), ("a", 52, START + dt.timedelta(seconds=52), 1.0)]
    late = rows[:5], rows[5:]
    source = f"{tmp_path}/in"
    schema = "k string, frame long, ts timestamp, x double"
    for part in late:
        rocksdb.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = rocksdb.readStream.schema(schema).parquet(source)
        out = tracking.tracked(stream, ["k"], "ts", 1000, memory=3)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    found = sorted((r.frame, r.x, r.track // tracking.BEGUN) for r in rocksdb.read.parquet(f"{tmp_path}/out").collect())
    assert found == [(0, 1.0, 0), (1, 1.0, 0), (2, 1.0, 0), (50, 1.0, 50), (51, 1.0, 50), (52, 1.0, 50)]
