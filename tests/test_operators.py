"""Hand cases of the DataFrame operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import angles, units
from sparkloom.operators import catalog, cycles, graph, raster, series, signal, spatial, stats, tables
from sparkloom.sources import files
from sparkloom.streaming import events


def _series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "k string, frame long, y double")


def _states(spark, text, key="a"):
    return spark.createDataFrame([(key, i, int(c)) for i, c in enumerate(text)], "k string, frame long, s int")


def _text(df, column):
    return "".join(str(r[column]) for r in df.orderBy("frame").collect())


def test_central_difference_of_a_line_is_constant(spark):
    w = series.over(["k"], ["frame"])
    rows = _series(spark, [3.0 + 2 * i for i in range(6)]).select(series.central_difference("y", w, 0.5).alias("v")).collect()
    assert [r.v for r in rows] == [4.0] * 6
    assert _series(spark, [1.0]).select(series.central_difference("y", w, 1.0).alias("v")).first().v is None


def test_missing_inside_is_no_edge(spark):
    w = series.over(["k"], ["frame"])
    rows = _series(spark, [0.0, None, 4.0, 6.0]).select("frame", series.central_difference("y", w, 1.0).alias("v")).orderBy("frame").collect()
    assert [r.v for r in rows] == [None, 2.0, None, 2.0]


@pytest.mark.parametrize("text, expected", [("0001101100010000", "0001111100000000"), ("1111111111111111", "0111111111111110"), ("0000000000000000", "0000000000000000")])
def test_closing_and_opening(spark, text, expected):
    out = series.opened_and_closed(_states(spark, text), ["k"], "frame", "s", 3, 3, "c")
    assert _text(out, "c") == expected


def test_border_runs_go(spark):
    out = series.cleared_border(_states(spark, "1100110000110"), ["k"], "frame", "s", 1, "c")
    assert _text(out, "c") == "0000110000110"
    out = series.cleared_border(_states(spark, "1100110000110"), ["k"], "frame", "s", 2, "c")
    assert _text(out, "c") == "0000110000000"


def test_runs_edges_and_table(spark):
    s = _states(spark, "0110011")
    assert [(r.run, r.start_frame, r.frames) for r in series.run_table(s, ["k"], "frame", "s", 0.5).orderBy("run").collect()] == [(1, 0, 2), (2, 4, 2)]
    assert [r.frame for r in series.rising_edges(s, ["k"], "frame", "s").orderBy("frame").collect()] == [0, 4]


def test_linear_fill_and_closest(spark):
    out = series.filled_gaps(_series(spark, [None, 0.0, None, None, 3.0, None]), ["k"], "frame", "y", 1, "f").orderBy("frame").collect()
    assert [r.f for r in out] == [None, 0.0, 1.0, None, 3.0, None]
    assert series.closest(_series(spark, [1.0, 3.0, None, 1.0]), ["k"], "frame", "y", F.lit(2.0)).first().frame == 0


def test_weighted_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("a", None, 5.0), ("b", 2.0, 0.0)], "k string, x double, w double")
    rows = {r.k: r for r in stats.weighted_mean_std(df, ["k"], "x", "w").collect()}
    assert rows["a"].weighted_mean == pytest.approx(2.5) and rows["a"].weighted_std == pytest.approx(math.sqrt(0.75))
    assert rows["b"].weighted_mean is None
    q = {r.k: r for r in stats.weighted_quantiles(df, ["k"], "x", "w", [25, 26, 100]).collect()}["a"]
    assert (q.q25, q.q26, q.q100) == (1.0, 3.0, 3.0)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 0.5, 1.0, 2.0, 2.1, -0.1)], "k string, x double")
    assert sorted((r.bin, r.n) for r in stats.histogram(df, ["k"], "x", 0.0, 2.0, 2).collect()) == [(0, 2), (1, 2)]
    assert stats.most_frequent_bin(spark.createDataFrame([("a", 5.0)] * 3, "k string, x double"), ["k"], "x").first().left_edge == 5.0


def test_order_parameter_of_parallel_and_crossed_axes(spark):
    df = spark.createDataFrame([("p", 0.3), ("p", 0.3 + math.pi), ("c", 0.0), ("c", math.pi / 2)], "k string, t double")
    rows = {r.k: r.o for r in df.groupBy("k").agg(angles.order_parameter(F.col("t")).alias("o")).collect()}
    assert rows["p"] == pytest.approx(1) and rows["c"] == pytest.approx(0, abs=1e-12)


def test_axial_difference_and_alignment(spark):
    df = spark.createDataFrame([(0.1, math.pi - 0.1)], "a double, b double")
    assert df.select(angles.axial_difference(F.col("a"), F.col("b")).alias("d")).first().d == pytest.approx(0.2)
    one = spark.range(1)
    facing = one.select(angles.alignment_index(F.lit(0.0), F.lit(math.pi), F.lit(0.0), F.lit(math.pi)).alias("x")).first().x
    away = one.select(angles.alignment_index(F.lit(math.pi), F.lit(0.0), F.lit(0.0), F.lit(math.pi)).alias("x")).first().x
    assert facing == pytest.approx(1) and away is None


def test_hausdorff_of_a_shifted_line(spark):
    points = [("k", line, float(i), 0.25 * line) for line in (0, 1) for i in range(5)]
    df = spark.createDataFrame(points, "g string, line long, y double, x double")
    assert spatial.hausdorff(df, ["g"], "line").first().hausdorff == pytest.approx(0.25)


def test_range_pairs_are_closed_and_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(-2, 2, (80, 2)), 1)
    df = spark.createDataFrame([("k", i, float(y), float(x)) for i, (y, x) in enumerate(p)], "g string, id long, y double, x double")
    found = {(r.a, r.b) for r in spatial.range_pairs(df, ["g"], "id", 0.5).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    assert found == {(i, j) for i in range(80) for j in range(i + 1, 80) if d[i, j] <= 0.5}
    near = {r.id: r.neighbour for r in spatial.nearest(df, ["g"], "id", 0.5).collect()}
    np.fill_diagonal(d, 9)
    assert near == {i: int(d[i].argmin()) for i in range(80) if d[i].min() <= 0.5}


def test_straight_and_bent_lines(spark):
    rows = [("s", i, float(i), float(i)) for i in range(4)] + [("o", 0, 0.0, 0.0)] + [("r", i, y, x) for i, (y, x) in enumerate([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)])]
    df = spark.createDataFrame(rows, "k string, i long, y double, x double")
    s = {r.k: r.straightness for r in spatial.straightness(df, ["k"], "i").collect()}
    b = {r.k: r.bending for r in spatial.bending(df, ["k"], "i").collect()}
    assert s["s"] == pytest.approx(1) and s["o"] == 1.0 and s["r"] == pytest.approx(0.5)
    assert b["s"] == pytest.approx(0) and b["o"] == 0.0 and b["r"] == pytest.approx((math.pi / 2) ** 2)


def test_components_of_long_chains_and_rings(spark):
    edges = [("a", i, i + 1) for i in range(1, 60)] + [("b", 1, 2), ("b", 2, 3), ("b", 3, 1)]
    nodes = [("a", i) for i in range(1, 61)] + [("b", i) for i in range(1, 5)]
    out = graph.components(spark.createDataFrame(nodes, "k string, id long"), spark.createDataFrame(edges, "k string, a long, b long"), ["k"])
    assert {(r.k, r.id): r.component for r in out.collect()} == {("a", i): 1 for i in range(1, 61)} | {("b", i): 1 for i in (1, 2, 3)} | {("b", 4): 4}


def test_communities_of_two_cliques():
    a, b = zip(*[(i, j) for base in (0, 5) for i in range(base, base + 5) for j in range(i + 1, base + 5)] + [(4, 5)])
    found = graph.modularity_communities(10, np.array(a), np.array(b), np.ones(len(a)), 1.0, 42)
    assert len(set(found[:5])) == 1 and len(set(found[5:])) == 1 and found[0] != found[9]


def test_lines_grow_and_rings_end():
    n = 12
    y, x = np.zeros(n), np.arange(n) * 2.0
    assert sorted(graph.grow_line(5, y, x, np.zeros(n), np.full(n, 2.0), 3, 0.5)) == list(range(n))
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    step = 2 * np.pi * 5 / 40
    ring = graph.grow_line(0, 5 * np.sin(t), 5 * np.cos(t), t + np.pi / 2, np.full(40, step), 1, 0.5)
    assert len(ring) == len(set(ring)) > 10


def test_popping_percent_time_and_smi(spark):
    rows = [("l", 1, 1, p, p, d, d) for p, d in enumerate([0.0, -1.0, -4.0, -2.0, 0.0])]
    inside = spark.createDataFrame(rows, "loi string, band long, cycle long, place long, frame long, delta double, vel double")
    assert cycles.percent_time(inside, 0.0, 100.0, 0.5).first().percent_time == 1.0
    assert cycles.percent_time(inside, 50.0, 0.0, 0.5).first().percent_time == 1.0
    with pytest.raises(ValueError):
        cycles.percent_time(inside, 50.0, 50.0, 0.5)
    assert cycles.surplus_motion(inside, 0.5).first().smi == pytest.approx(1.0)
    f = cycles.cycle_features(inside, 0.5).first()
    assert (f.contr_max, f.elong_max, f.time_to_peak, f.time_to_relax) == (-4.0, 0.0, 1.0, 1.5)


def test_tables(spark):
    df = spark.createDataFrame([(1, [1.0], "x/20240131_a.tif")], "a int, v array<double>, path string")
    assert tables.without_arrays(df).columns == ["a", "path"]
    assert tables.project(df, {"a": "bigint", "nothing": "double"}).first().asDict() == {"a": 1, "nothing": None}
    row = tables.with_conditions(df, day=files.date_in_name, name=files.base_name, batch=3).first()
    assert str(row.day) == "2024-01-31" and row.name == "20240131_a" and row.batch == 3
    assert [tables.parse_frames(t) for t in ("", "all", "7", "1, 2,x,4", "abc")] == [None, "all", 7, [1, 2, 4], 0]
    with pytest.raises(ValueError):
        tables.frames(df, "some")
    assert tables.feature_catalog(spark).count() == len(catalog.FEATURES) == len({f[0] for f in catalog.FEATURES})
    assert catalog.parameters(peaks__width=0.4)["peaks.width"] == "0.4"
    labels = spark.createDataFrame([(i,) for i in range(6)], "label long")
    new = {r.label: r.new_label for r in tables.shuffled_labels(labels, "label", 3).collect()}
    assert new[0] == 0 and sorted(new.values()) == list(range(6))


def test_units(spark):
    df = spark.createDataFrame([(0.5, 0.2, 100.0, "cm"), (0.5, 0.0, 0.0, "elephants")], "l double, p double, r double, u string")
    rows = df.select(units.pixels_rounded(F.col("l"), F.col("p")).alias("a"), units.pixels_truncated(F.col("l"), F.col("p")).alias("b"), units.odd_up(F.lit(4.2)).alias("o"), units.pixel_size(F.col("r"), F.col("u")).alias("s")).collect()
    assert (rows[0].a, rows[0].b, rows[0].o, rows[0].s) == (2, 2, 5, 100.0) and (rows[1].a, rows[1].s) == (None, None)


def test_images_and_series_files(spark, tmp_path):
    from sparkloom.functions import images

    page = np.zeros((12, 12), np.uint16)
    page[2:5, 2:9] = 500
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.tif").write_bytes(images.write_tiff([page, page * 2, page * 3], "fps=20", 1e4))
    df = files.read_images(spark, str(tmp_path), frames=[0, 2])
    assert sorted(r.frame for r in df.select("frame").collect()) == [0, 2]
    tiles = df.select(F.col("path").alias("file_id"), "frame", "h", "w", "data")
    found = raster.segmented(tiles, 100.0).collect()
    assert [r.area for r in found] == [21.0, 21.0] and len(found[0].ends) == 2
    px = raster.pixels(tiles)
    assert px.where("v > 0 and frame = 0").count() == 21
    series_path = str(tmp_path / "s")
    files.write_series(_series(spark, [1.5, None, 3.0]), series_path, "frame", "y")
    assert files.read_series(spark, series_path).where("y is not null").count() == 2


def test_json_profiles_and_exports(spark, tmp_path):
    value = {"a": np.arange(3), "b": np.float32(1.5), "c": [{"row": [0], "col": [1], "data": [2.0], "shape": [3, 3]}], "d": "x"}
    back = files.loads(files.dumps(value))
    assert back["a"].tolist() == [0, 1, 2] and back["b"] == np.float32(1.5) and back["c"][0]["shape"] == [3, 3]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1_loi.json").write_text('{"profiles": [[1, 2, 3], [4, 5, 6]], "line": [[0, 0], [3, 4]]}')
    rows = files.read_profiles(spark, str(tmp_path / "p")).orderBy("frame").collect()
    assert rows[0].x_pos == [0.0, 2.5, 5.0] and rows[1].profile == [4.0, 5.0, 6.0]
    df = spark.createDataFrame([(1, [1.0, 2.0])], "a int, v array<double>")
    for fmt in ("csv", "json", "xml", "parquet"):
        files.export(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().v == "[1.0,2.0]"
    with pytest.raises(ValueError):
        files.export(df, str(tmp_path / "y"), "xlsy")


def test_vectors_masks_and_domains(spark):
    h = w = 60
    z, m, a = np.zeros((h, w)), np.zeros((h, w)), np.zeros((h, w))
    z[10:50, 18:21] = z[10:50, 38:41] = 1.0
    m[10:50, 28:31] = 1.0
    tile = lambda x: spark.createDataFrame([("f", 0, h, w, x.ravel().tolist())], "file_id string, frame int, h int, w int, data array<double>")
    v = raster.extracted_vectors(tile(m), tile(z), tile(a), 0.1).cache()
    rows = v.collect()
    assert len(rows) > 20 and all(abs(r.len - 2.0) < 0.05 and abs(r.x - 2.9) < 0.06 for r in rows)
    mask = raster.vector_masks(v, (h, w), 0.1, 0.0).first()
    assert sum(mask.data) >= 20 * len(rows)
    d = raster.domain_features(v.withColumn("community", F.lit(1)), (h, w), 0.1, 1.0, 0.1).first()
    assert d.oop == pytest.approx(1.0) and d.n == len(rows)
    lines = v.select("file_id", "frame", F.lit(0).alias("line"), F.col("vec_id").alias("pos"), F.col("vec_id").alias("id"))
    total = sum(r.len for r in rows)
    assert raster.line_length_statistics(lines, v, (h, w), 0.1, 3).first().length_mean == pytest.approx(total, rel=1e-6)


def test_kernel_operators_keep_rows_and_columns(spark):
    df = _series(spark, [float(i) for i in range(20)]).withColumn("extra", F.lit("e")).unionByName(_series(spark, [None] * 3, "b").withColumn("extra", F.lit("f")))
    out = signal.smoothed(df, ["k"], "frame", "y", "s")
    assert out.count() == 23 and out.where("k = 'a' and abs(s - y) > 1e-9").count() == 0 and out.where("k = 'b' and s is not null").count() == 0


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}", 1.0) for s in (0, 2, 4, 30, 31)]
    ev = spark.createDataFrame(rows, "user long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [(r.n, r.seconds) for r in events.merged_events(ev, "user", "5 seconds", 2.0).collect()]
    assert got == [(3, 4.0)]
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", f, x) for f in range(3) for x in (0.0 + f * 0.2, 9.0)], "k string, frame long, x double").write.parquet(source)
    stream = events.tracked(spark.readStream.schema("k string, frame long, x double").parquet(source), "k")
    query = stream.writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.frame, r.track) for r in spark.table("tracks").collect()} == {(f, t) for f in range(3) for t in (0, 1)}


def test_communities_take_little_memory_a_link():
    """A dense key: dictionaries of links took over 200 bytes a link."""
    import tracemalloc

    n = 700
    a, b = np.triu_indices(n, 1)
    w = np.where((a < 350) == (b < 350), 1.0, 0.01)
    tracemalloc.start()
    found = graph.modularity_communities(n, a, b, w, 1.0, 42)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(found[:350])) == len(set(found[350:])) == 1 and found[0] != found[-1]
    assert peak < 100 * len(a)


def test_sparse_matching_equals_the_dense_one():
    from sparkloom.functions import signals

    rng = np.random.default_rng(3)
    for t in range(200):
        n, m = rng.integers(1, 14, 2)
        c = np.where(rng.random((n, m)) < rng.random(), rng.integers(1, 30, (n, m)) / 7 if t % 2 else rng.random((n, m)), 1e6)
        a, b = np.nonzero(c < 1e6)
        mate, u, v = signals.sparse_matching(n, m, a, b, c[a, b], 1e6)
        rows, cols = signals.assignment(c)
        on, ok = np.flatnonzero(mate >= 0), c[rows, cols] < 1e6
        assert len(set(mate[on])) == len(on) == ok.sum() and c[on, mate[on]].sum() == pytest.approx(c[rows, cols][ok].sum(), abs=1e-6)
        assert (c[a, b] - u[a] - v[b] > -1e-8).all()


def test_matching_of_a_large_key_holds_few_of_its_pairs(spark, monkeypatch):
    """All pairs of 120 ends: the dense matrix and all pairs in one task are no longer made, and the matching is the cheapest of all."""
    from sparkloom.functions import signals

    rng = np.random.default_rng(4)
    c = rng.random((60, 60))
    c[:, 5:] += (np.arange(60) < 40)[:, None] * 3  # 40 rows compete for five columns, so the first prices are not the last
    monkeypatch.setattr(graph, "CHEAPEST", 3)
    monkeypatch.setattr(signals, "assignment", None)
    df = spark.createDataFrame([(1, i, j, float(c[i, j])) for i in range(60) for j in range(60)], "k int, a int, b int, cost double")
    found = graph.matched(df, "k").collect()
    monkeypatch.undo()
    rows, cols = signals.assignment(c)
    assert len({r.a for r in found}) == len({r.b for r in found}) == len(found) == 60
    assert sum(r.cost for r in found) == pytest.approx(c[rows, cols].sum(), abs=1e-6)


def test_communities_of_points_hold_no_links(spark, monkeypatch):
    """Links are found from the places: they equal those of the join, and a dense key takes memory by its points (as arrays of links it took 12 bytes a link and end)."""
    import tracemalloc

    rng = np.random.default_rng(5)
    node, y, x, angle = np.repeat(np.arange(60), 2), rng.random(120) / 4, rng.random(120) / 4, rng.random(120) * 3
    y[:10], x[:10], angle[:10] = y[10:20], x[10:20], angle[10:20]
    links = graph.PointLinks(60, node, y, x, angle, 0.1, 0.65)
    rows = [("k", i, int(n), float(a), float(b), float(t)) for i, (n, a, b, t) in enumerate(zip(node, y, x, angle))]
    df = spark.createDataFrame(rows, "k string, id long, node long, y double, x double, angle double")
    joined = spatial.cosine_edges(df, ["k"], "id", 0.1, 0.65).selectExpr("k", "a div 2 a", "b div 2 b", "weight").where("a <> b")
    want = np.zeros((60, 60))
    for r in joined.collect():
        want[r.a, r.b] += r.weight
        want[r.b, r.a] += r.weight
    near = [np.bincount(o, weights=w, minlength=60) for o, w in map(links.near, range(60))]
    assert np.allclose(near, want) and np.allclose(links.strength, want.sum(axis=0)) and np.allclose(links.sums(np.arange(60) % 4, 4), [want[k::4].sum(axis=0) for k in range(4)])
    found = {r.node: r.community for r in graph.near_communities(df, "k", "node", 0.1, 0.65, 0.5).collect()}
    assert set(found) == {r[c] for r in joined.collect() for c in ("a", "b")} and all(found[c] == c for c in found.values())
    n = 2000
    monkeypatch.setattr(graph, "TABLE", 1 << 17)
    tracemalloc.start()
    links = graph.PointLinks(n, np.arange(n), rng.random(n) / 20, rng.random(n) / 20, np.zeros(n), 0.1, 0.65)
    label = graph._communities(links, 0.5, 42)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert label.shape == (n,) and (links.high - links.low).sum() > n * n * 0.9 and peak < 6 * n * n


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_best_matching_equals_the_dense_one(monkeypatch, held):
    """With all pairs at hand and with the cheapest only, from chunks that are asked for anew; ends that stay alone have no price, which was a million."""
    from sparkloom.functions import matching, signals

    monkeypatch.setattr(matching, "HELD", held)
    monkeypatch.setattr(matching, "THINNED", 5)
    monkeypatch.setattr(matching, "CHEAPEST", 2)
    monkeypatch.setattr(matching, "PATIENCE", 3)
    rng = np.random.default_rng(3)
    for t in range(200):
        n, m = rng.integers(1, 14, 2)
        c = np.where(rng.random((n, m)) < rng.random(), rng.integers(1, 6, (n, m)) / 7 if t % 2 else rng.random((n, m)), 1e6)
        a, b = np.nonzero(c < 1e6)
        i, j, cost = matching.best_matching(int(n), int(m), lambda: ((a[p], b[p], c[a[p], b[p]]) for p in (a % 3 == k for k in range(3))))
        rows, cols = signals.assignment(c)
        ok = c[rows, cols] < 1e6
        assert len(set(i)) == len(set(j)) == len(i) == ok.sum() and (cost == c[i, j]).all() and cost.sum() == pytest.approx(c[rows, cols][ok].sum(), abs=1e-9)


def test_near_points_are_matched_without_a_table_of_pairs(spark, monkeypatch):
    """Even and odd points within reach: as many pairs as can be, at least cost, once a key; nulls have none."""
    from sparkloom.functions import places, signals

    rng = np.random.default_rng(6)
    y, x = rng.random(300), rng.random(300)
    y[:20], x[:20] = y[20:40], x[20:40]
    d = np.hypot(y[::2, None] - y[1::2], x[::2, None] - x[1::2])
    pairs = {(int(i), int(j)) for part in places.near_pairs(y[::2], x[::2], y[1::2], x[1::2], 0.1) for i, j in zip(*part[:2])}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(d <= 0.1))}
    monkeypatch.setattr(graph, "stage", None)
    df = spark.createDataFrame([(k, i, float(y[i]), float(x[i]), i % 2) for k in (1, 2) for i in range(300)] + [(1, 300, None, 0.5, 0), (None, 301, 0.5, 0.5, 0)], "k int, id long, y double, x double, odd int")
    rows, cols = signals.assignment(np.where(d <= 0.1, d, 1e6))
    want = d[rows, cols][d[rows, cols] <= 0.1]
    found = graph.matched_near(df, "k", "id", 0.1, side="odd").collect()
    for k in (1, 2):
        own = [r for r in found if r.k == k]
        assert len({r.a for r in own}) == len({r.b for r in own}) == len(own) == len(want) and all(r.a % 2 == 0 and r.b % 2 == 1 for r in own)
        assert sum(r.cost for r in own) == pytest.approx(want.sum(), abs=1e-9)
    assert len(found) == 2 * len(want)
