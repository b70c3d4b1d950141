"""The store of maps, the cache of results, metadata with its fallback, predictors and reports."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import predict, tiled
from sparkloom.sources import files, maps
from sparkloom.streaming import progress


def _tiles(spark, value):
    frames = spark.createDataFrame([(1, f, 4, 4, [float(value + f)] * 16) for f in range(3)], "file_id int, frame int, h int, w int, data array<double>")
    return tiled.cut(frames, 2)


def test_maps_by_name_and_their_deletion(spark, tmp_path):
    store = maps.MapStore(spark, f"file://{tmp_path}/maps")
    assert store.names() == []
    store.write("image", _tiles(spark, 1))
    store.write("zbands", tiled.convolved(store.view("image"), np.full((1, 1), 2.0)))
    store.write("mbands", _tiles(spark, 5))
    assert store.names() == ["image", "mbands", "zbands"]
    total = lambda n: store.view(n).select(F.explode("data").alias("v")).agg(F.sum("v")).first()[0]
    assert (total("image"), total("zbands")) == (96.0, 192.0)
    # A map may be replaced by one computed from itself; the others stay.
    store.write("zbands", tiled.convolved(store.view("zbands"), np.full((1, 1), 0.5)))
    assert (total("image"), total("zbands"), total("mbands")) == (96.0, 96.0, 288.0)
    assert all("map_name=zbands" in f for f in store.view("zbands").inputFiles())
    with pytest.raises(FileNotFoundError, match="mask the cells"):
        store.view("cell_mask")
    with pytest.raises(AttributeError):
        store.view("nothing")
    with pytest.raises(ValueError):
        store.delete_derived(["image"])
    assert store.delete_derived(["mbands"]) == ["mbands"] and store.names() == ["image", "zbands"]
    assert store.delete_derived() == ["zbands"] and store.names() == ["image"] and total("image") == 96.0


def test_a_refresh_computes_only_changed_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(8):
        (source / f"f{i}.txt").write_text("x" * (i + 1))
    computed = []

    def compute(df):
        computed.append(sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").collect()))
        return df.select("path", F.length(F.col("content").cast("string")).alias("n"))

    cache = maps.ResultCache(spark, f"file://{tmp_path}/cache")
    with pytest.raises(FileNotFoundError):
        cache.load()
    names = lambda df: {r.path.rsplit("/", 1)[1]: r.n for r in df.collect()}
    assert names(cache.refresh(f"file://{source}", compute)) == {f"f{i}.txt": i + 1 for i in range(8)} and len(computed[0]) == 8
    assert names(cache.refresh(f"file://{source}", compute)) == {f"f{i}.txt": i + 1 for i in range(8)} and len(computed) == 1
    time.sleep(0.02)
    (source / "f3.txt").write_text("changed!")
    os.utime(source / "f4.txt")
    (source / "f5.txt").unlink()
    (source / "new [1].txt").write_text("n")
    found = names(cache.refresh(f"file://{source}", compute))
    assert found == {**{f"f{i}.txt": i + 1 for i in (0, 1, 2, 4, 6, 7)}, "f3.txt": 8, "new [1].txt": 1}
    assert computed[1] == ["f3.txt", "new [1].txt"] and names(cache.load()) == found
    for f in source.iterdir():
        f.unlink()
    (source / "last.txt").write_text("ab")
    assert names(cache.refresh(f"file://{source}", compute)) == {"last.txt": 2}


def test_unchanged_files_are_not_opened(spark, tmp_path):
    """Bytes that Spark's file system reads, as it counts them itself."""
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        (source / f"f{i}.bin").write_bytes(b"z" * 3_000_000)
    cache = maps.ResultCache(spark, f"file://{tmp_path}/cache")

    def read(work):
        bytes_ = lambda: sum(s.getBytesRead() for s in spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == "file")
        before = bytes_()
        assert work().count() == 4
        return bytes_() - before

    refresh = lambda: cache.refresh(f"file://{source}", lambda df: df.select("path", F.length("content").alias("n")))
    assert read(refresh) > 24_000_000
    assert read(refresh) < 1_000_000
    time.sleep(0.02)
    (source / "f2.bin").write_bytes(b"y" * 3_000_000)
    assert 6_000_000 <= read(refresh) < 8_000_000


def test_metadata_falls_back_to_the_temporary_copy(spark, tmp_path):
    def put(folder, name, text):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)

    put("a", "metadata.json", '{"pixelsize": 0.1, "frames": 3}')
    put("a", "metadata.temp.json", '{"pixelsize": 9, "frames": 9}')
    put("b", "metadata.json", '{"pixelsize": 0.1, "fra')
    put("b", "metadata.temp.json", '{"resxy": 0.2, "frames": 4}')
    put("c", "metadata.temp.json", '{"tint": 0.05, "frames": 5}')
    put("d", "metadata.json", "no json")
    put("e", "metadata.other.json", "{}")
    found = {r.folder.rsplit("/", 1)[1]: r for r in maps.load_metadata(spark, f"file://{tmp_path}", "pixelsize double, frametime double, frames int").collect()}
    plain = {k: (r.pixelsize, r.frametime, r.frames, r.source) for k, r in found.items()}
    assert plain == {"a": (0.1, None, 3, "kept"), "b": (0.2, None, 4, "temporary"), "c": (None, 0.05, 5, "temporary"), "d": (None, None, None, None)}
    assert found["d"].error == "metadata.json is broken; metadata.temp.json is missing" and found["a"].error is None


def _counting():
    """A predictor that tells how often it was built in this worker."""
    import sparkloom.operators.predict as module

    module.built = getattr(module, "built", 0) + 1
    return lambda x: np.stack([np.convolve(x, [0.25, 0.5, 0.25], "same"), np.full(len(x), module.built), np.full(len(x), len(x))])


def test_predictors_are_built_once_and_see_padded_series(spark):
    rng = np.random.default_rng(0)
    series = {k: rng.normal(size=n).astype(np.float32) for k, n in (("a", 1), ("b", 31), ("c", 32), ("d", 70))}
    rows = [(k, i, None if (k, i) == ("d", 5) else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, t int, y double").repartition(1)
    found = predict.predicted(df, ["k"], "t", "y", _counting, ["state", "built", "size"]).collect()
    assert len(found) == len(rows) and {r.built for r in found} == {1.0}
    series["d"][5] = 0
    for k, x in series.items():
        wide = np.pad(x, (0, 32 - len(x) % 32), mode="reflect" if len(x) > 1 else "edge")
        want = np.convolve(wide, [0.25, 0.5, 0.25], "same")[: len(x)]
        own = sorted((r.t, r.state, r.size) for r in found if r.k == k)
        assert np.allclose([s for _, s, _ in own], want, atol=1e-6) and {n for _, _, n in own} == {len(wide)}
    with pytest.raises(Exception, match="the predictor gave"):
        predict.predicted(df, ["k"], "t", "y", lambda: lambda x: x[:1]).collect()


def test_reports_of_a_batch_with_a_failing_step(spark):
    reports = progress.Reports(spark)
    broken = F.udf(lambda x: 1 // (x - x), "int")
    steps = [("good", lambda: spark.range(10).count()), ("bad", lambda: spark.range(4).select(broken("id")).collect()), ("last", lambda: 7)]
    assert progress.batch(reports, "work", steps) == {"good": 10, "last": 7}
    rows = progress.as_json(reports.table())
    assert [(r["event"], r["name"], r.get("done")) for r in rows] == [("started", "work", 0), ("done", "good", 1), ("failed", "bad", 2), ("done", "last", 3), ("ended", "work", 2)]
    assert "PythonException" in rows[2]["error"] or "ZeroDivision" in rows[2]["error"]
    assert rows[1]["left_seconds"] >= 0 and rows[3]["left_seconds"] == 0
    assert progress.batch(reports, "again", steps, stop=True) == {"good": 10}


def test_reports_of_running_and_failing_streams(spark, tmp_path):
    reports = progress.Reports(spark)
    listener = progress.StreamReports(reports)
    spark.streams.addListener(listener)
    try:
        spark.range(20).write.parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        for name, df in (("fine", source), ("broken", source.select(F.udf(lambda x: 1 // 0, "int")("id")))):
            q = df.writeStream.format("noop").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            try:
                q.awaitTermination(90)
            except Exception:
                pass
        deadline = time.monotonic() + 20
        while time.monotonic() < deadline and reports.table().where("event in ('ended', 'failed')").count() < 2:
            time.sleep(0.3)
    finally:
        spark.streams.removeListener(listener)
    rows = progress.as_json(reports.table())
    own = lambda n: [(r["event"], r.get("done")) for r in rows if r.get("name") == n]
    assert own("fine")[0] == ("started", None) and ("batch", 20) in own("fine") and own("fine")[-1][0] == "ended"
    assert own("broken")[-1][0] == "failed" and [r for r in rows if r["event"] == "failed"][0]["error"]
    reports.write(f"{tmp_path}/reports")
    assert spark.read.parquet(f"{tmp_path}/reports").count() == len(rows) and reports.table().count() == 0


def test_series_in_blocks_and_parts(spark, tmp_path):
    """Lines keep their numbers over parts of a series and blocks of a file; single files are series of their own."""
    df = spark.createDataFrame([(i, float(i) * 0.5) for i in range(5000)], "t long, y double").repartition(7)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    files.write_series(df, f"file://{tmp_path}/long", "t", "y")
    spark.conf.unset(coalesce)
    assert len([f for f in os.listdir(tmp_path / "long") if f.startswith("part-")]) > 1
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        found = files.read_series(spark, f"file://{tmp_path}/long").collect()
        (tmp_path / "one").mkdir()
        (tmp_path / "one" / "a.txt").write_text("1\nx\n 3 \n\n" + "\n".join(str(i) for i in range(3000)))
        (tmp_path / "one" / "b.txt").write_text("7\r\n8")
        alone = files.read_series(spark, f"file://{tmp_path}/one").collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.frame, r.y) for r in found) == [(i, i * 0.5) for i in range(5000)] and {r.path.rsplit("/", 1)[1] for r in found} == {"long"}
    a = {r.frame: r.y for r in alone if r.path.endswith("a.txt")}
    assert [a[i] for i in range(4)] == [1.0, None, 3.0, None] and all(a[i + 4] == i for i in range(3000)) and len(a) == 3004
    assert sorted((r.frame, r.y) for r in alone if r.path.endswith("b.txt")) == [(0, 7.0), (1, 8.0)]


def test_weighted_quantiles_of_uneven_values(spark):
    """One cell holds nearly all values; equal values, one value, a key of one row."""
    from sparkloom.operators import stats

    rng = np.random.default_rng(6)
    rows = [("a", float(v), float(w)) for v, w in zip(np.concatenate([rng.normal(0, 1e-6, 500), [1e9]]), rng.integers(1, 9, 501))]
    rows += [("b", float(v), float(w)) for v, w in zip(rng.integers(0, 5, 300), rng.random(300))] + [("c", 2.0, 1.0)] * 3 + [("d", -1.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double").repartition(3)
    percents = [0, 10, 50, 90, 99.9, 100]
    for r in stats.weighted_quantiles(df, ["k"], "x", "w", percents).collect():
        own = sorted((v, w) for k, v, w in rows if k == r.k)
        total = sum(w for _, w in own)
        for p, found in zip(percents, r[1:]):
            so_far, want = 0.0, own[-1][0]
            for v in sorted({v for v, _ in own}):
                so_far += sum(w for u, w in own if u == v)
                if so_far >= p / 100 * total - 1e-9:
                    want = v
                    break
            assert found == want, (r.k, p)
