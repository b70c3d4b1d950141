"""Tiled images: every filter equals that of the whole image, for any tiling; splines equal a dense solution; vector maps equal a plain drawing."""

import math
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.functions import images
from sparkloom.operators import splines, tiled


def _frames(spark, *stack):
    rows = [(1, i, a.shape[0], a.shape[1], [None if np.isnan(v) else float(v) for v in a.ravel()]) for i, a in enumerate(stack)]
    return spark.createDataFrame(rows, "file_id int, frame int, h int, w int, data array<double>")


def _arrays(tiles):
    return {r.frame: np.array([np.nan if v is None else v for v in r.data]).reshape(r.h, r.w) for r in tiled.whole(tiles).collect()}


IMAGES = [np.random.default_rng(3).normal(size=(23, 31)), np.random.default_rng(4).normal(size=(7, 5))]


@pytest.mark.parametrize("step", [4, 9, 40])
def test_cutting_and_joining(spark, step):
    found = _arrays(tiled.cut(_frames(spark, *IMAGES), step))
    assert all((found[i] == a).all() for i, a in enumerate(IMAGES))


@pytest.mark.parametrize("step", [3, 8, 64])
@pytest.mark.parametrize("edge,mode", [("reflect", "symmetric"), ("zero", "constant")])
def test_convolution_has_no_seams(spark, step, edge, mode):
    """The same bits as on the whole image, with a halo wider than a tile and than the small image too."""
    k = np.random.default_rng(1).normal(size=(9, 7))
    found = _arrays(tiled.convolved(tiled.cut(_frames(spark, *IMAGES), step), k, edge))
    for i, a in enumerate(IMAGES):
        wide = np.pad(a, 9, mode=mode)
        assert (found[i] == tiled.correlate(wide, k[::-1, ::-1].copy())[9:-9, 9:-9]).all()
        y, x = 2, 3
        assert math.isclose(found[i][y, x], sum(k[u, v] * wide[9 + y + 4 - u, 9 + x + 3 - v] for u in range(9) for v in range(7)), abs_tol=1e-9)


def test_medians_skip_missing_pixels(spark):
    a = IMAGES[0].copy()
    a[2:6, 3:8] = np.nan
    found = _arrays(tiled.medians(tiled.cut(_frames(spark, a), 6), 3))[0]
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            v = a[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2]
            assert np.isnan(found[y, x]) if np.isnan(v).all() else math.isclose(found[y, x], np.nanmedian(v))


@pytest.mark.parametrize("step", [10, 100])
def test_wavelets_equal_the_whole_image(spark, step):
    y, x = np.mgrid[:40, :50]
    a = ((x % 16) < 3).astype(float) + 0.1 * np.random.default_rng(0).random((40, 50))
    lengths, angles = np.array([1.6, 1.9, 2.2]), np.deg2rad([0.0, 30.0, 60.0])
    maps = tiled.wavelet_maps(tiled.cut(_frames(spark, a), step), 0.12, lengths, angles)
    best, n, t = images.best_wavelet(images.double_wavelets(a, lengths / 0.12, angles, 0.3 / 0.12, 0.15 / 0.12))
    score = _arrays(maps.select(*tiled.TILE, "data"))[0]
    assert np.abs(score - best).max() < 1e-9
    strong = best > 0.05 * best.max()
    assert (_arrays(maps.select(*tiled.TILE, maps.length.alias("data")))[0] == lengths[n])[strong].all()
    assert (_arrays(maps.select(*tiled.TILE, maps.angle.alias("data")))[0] == angles[t])[strong].all()


def test_tiles_from_pixels(spark):
    px = spark.createDataFrame([(1, 0, 2, 3, 5.0), (1, 0, 9, 9, 7.0)], "file_id int, frame int, y int, x int, v double")
    frames = spark.createDataFrame([(1, 0, 10, 10), (1, 1, 4, 6)], "file_id int, frame int, rows int, cols int")
    found = _arrays(tiled.from_pixels(px, frames, 4, fill=None))
    assert found[0][2, 3] == 5 and found[0][9, 9] == 7 and np.isnan(found[0]).sum() == 98 and np.isnan(found[1]).all() and found[1].shape == (4, 6)
    back = {(r.y, r.x): r.v for r in tiled.to_pixels(tiled.from_pixels(px, frames, 4)).where("frame = 0").collect()}
    assert len(back) == 100 and back[9, 9] == 7 and sum(back.values()) == 12


def _mirror(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def plain_spline(image, y, x, order):
    """The interpolating spline from dense linear systems over the mirrored image."""
    def solved(values, n):
        m = np.zeros((n, n))
        for i in range(n):
            for j in range(i - order, i + order + 1):
                m[i, _mirror(j, n)] += splines.basis(order, np.array([float(i - j)]))[0]
        return np.linalg.solve(m, values)

    c = solved(solved(image, image.shape[0]).T, image.shape[1]).T
    total = 0.0
    for i in range(math.floor(y) - order - 1, math.floor(y) + order + 2):
        for j in range(math.floor(x) - order - 1, math.floor(x) + order + 2):
            w = splines.basis(order, np.array([y - i, x - j]))
            total += w[0] * w[1] * c[_mirror(i, image.shape[0]), _mirror(j, image.shape[1])]
    return total


def test_basis_functions():
    x = np.linspace(-4, 4, 801)
    for n in range(1, 6):
        assert np.allclose(sum(splines.basis(n, x[300:500] - k) for k in range(-6, 7)), 1)
    assert np.allclose(splines.basis(3, np.array([0.0, 1.0, 2.0])), [2 / 3, 1 / 6, 0])
    assert np.allclose(splines.basis(5, np.array([0.0, 1.0, 2.0])), [66 / 120, 26 / 120, 1 / 120])


@pytest.mark.parametrize("order", range(6))
def test_kymographs_of_every_order(spark, order):
    """A bent line of three parallels over small tiles, part of it outside the image; a line of one point; two frames."""
    stack = [np.random.default_rng(s).normal(size=(18, 22)) for s in (1, 2)]
    points = [(2.3, -1.2), (9.7, 8.1), (9.7, 20.4), (19.4, 23.0)]
    lines = spark.createDataFrame([(1, "a", i, *p) for i, p in enumerate(points)] + [(1, "b", 0, 3.0, 3.0)], "file_id int, line string, pos int, y double, x double")
    found = {(r.line, r.frame, r.pos): r.v for r in splines.kymograph(tiled.cut(_frames(spark, *stack), 5), lines, 3, order).collect()}
    want = {}
    for f, image in enumerate(stack):
        k = 0
        for (y0, x0), (y1, x1) in zip(points, points[1:]):
            n = math.ceil(math.hypot(y1 - y0, x1 - x0) + 1)
            t = math.atan2(y1 - y0, x1 - x0)
            for i in range(n):
                y, x = y0 + (y1 - y0) * i / (n - 1), x0 + (x1 - x0) * i / (n - 1)
                want["a", f, k] = np.mean([plain_spline(image, y + o * math.cos(t), x - o * math.sin(t), order) for o in (-1, 0, 1)])
                k += 1
    assert found.keys() == want.keys()
    assert max(abs(found[k] - want[k]) for k in want) < 1e-9


def test_no_side_of_a_kymograph_is_broadcast(spark, tmp_path):
    """A stored table of lines looks small to the planner, whatever number of samples it stands for."""
    from sparkloom.operators import pipelines

    tiled.cut(_frames(spark, *IMAGES[:1]), 8).write.parquet(f"{tmp_path}/tiles")
    spark.createDataFrame([(1, i, p, 3.0 * p, 5.0 * p) for i in range(9) for p in range(3)], "file_id int, line int, pos int, y double, x double").write.parquet(f"{tmp_path}/lines")
    tiles, lines = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("tiles", "lines"))
    for found in (splines.kymograph(tiles, lines, 3, 1), pipelines.created_lines(tiles, lines, 0.1)):
        assert found.count() > 0
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_splines_go_through_the_pixels():
    image = np.random.default_rng(0).normal(size=(30, 26))
    for order in range(2, 6):
        c = splines.coefficients(np.pad(image, 45, mode="symmetric"), order)
        y, x = (a.ravel() for a in np.mgrid[0:30, 0:26])
        assert np.abs(splines.sampled(c, y + 45.0, x + 45.0, order) - image.ravel()).max() < 1e-9


def test_vector_maps_against_a_plain_drawing(spark):
    rng = np.random.default_rng(8)
    v = [(1, int(f), float(y), float(x), float(t), float(n), float(w)) for f, y, x, t, n, w in zip(rng.integers(0, 2, 60), rng.uniform(0, 20, 60), rng.uniform(0, 25, 60), rng.uniform(0, math.pi, 60), rng.uniform(1, 9, 60), rng.integers(1, 4, 60))]
    vectors = spark.createDataFrame(v, "file_id int, frame int, y double, x double, angle double, len double, weight double")
    frames = spark.createDataFrame([(1, 0, 20, 25), (1, 1, 20, 25)], "file_id int, frame int, rows int, cols int")
    labels = tiled.label_maps(vectors, frames)
    want = defaultdict(list)
    for _, f, y, x, t, n, w in v:
        ends = [int(e) for e in (y - math.sin(t) * n / 2, x - math.cos(t) * n / 2, y + math.sin(t) * n / 2, x + math.cos(t) * n / 2)]
        if min(ends) >= 0 and max(ends[0], ends[2]) < 20 and max(ends[1], ends[3]) < 25 and not any(e != math.floor(e) for e in ends):
            if min(y - abs(math.sin(t)) * n / 2, x - abs(math.cos(t)) * n / 2) <= -1:
                continue
            p = images.line_pixels(*ends)
            for i, (a, b) in enumerate(p.tolist()):
                want[f, a, b].append((w, t, -1 if i < len(p) // 2 else 1))
    found = {(r.frame, r.y, r.x): r for r in labels.collect()}
    assert found.keys() == want.keys() and len(want) > 150
    for k, drawn in want.items():
        s = sum(w * side * complex(math.cos(t), math.sin(t)) for w, t, side in drawn)
        a = sum(w * complex(math.cos(2 * t), math.sin(2 * t)) for w, t, _ in drawn)
        total = sum(w for w, _, _ in drawn)
        assert found[k].n == len(drawn) and math.isclose(found[k].strength, abs(a) / total, abs_tol=1e-9)
        assert abs(s) < 1e-9 or math.isclose(math.cos(found[k].direction - math.atan2(s.imag, s.real)), 1, abs_tol=1e-9)
        assert abs(a) < 1e-9 or math.isclose(math.cos(2 * found[k].axis - math.atan2(a.imag, a.real)), 1, abs_tol=1e-9)
    mask = _arrays(tiled.vector_mask(labels, frames, 6, 2))
    smooth = {(r.frame, r.y, r.x): r.direction for r in tiled.smoothed_directions(labels, frames, 6).collect()}
    for f in (0, 1):
        for y in range(20):
            for x in range(25):
                near = [(a, b) for g, a, b in want if g == f and (a - y) ** 2 + (b - x) ** 2 <= 4]
                assert mask[f][y, x] == (len(near) > 0)
                around = [found[g, a, b].direction for g, a, b in want if g == f and max(abs(a - y), abs(b - x)) <= 1]
                assert ((f, y, x) in smooth) == (len(around) > 0)
                if around:
                    s, c = np.median(np.sin(around)), np.median(np.cos(around))
                    assert math.hypot(s, c) < 1e-9 or math.isclose(math.cos(smooth[f, y, x] - math.atan2(s, c)), 1, abs_tol=1e-9)


def test_a_scan_makes_its_bars_once(monkeypatch):
    """Images of one size share the bars' spectra and give the bits of a scan that makes them anew; large scans keep none."""
    rng, grid, angles, made = np.random.default_rng(0), np.array([7.0, 9.0]), np.deg2rad([-90.0, 0.0, 40.0]), []
    bar = images.bar
    monkeypatch.setattr(images, "bar", lambda *a: made.append(1) or bar(*a))
    windows = [rng.random((23, 31)) for _ in range(4)]
    found = [images.double_wavelets(w, grid, angles, 1.7, 1.2) for w in windows]
    assert len(made) == 12
    monkeypatch.setattr(images, "KEPT_BYTES", 0)
    assert all((images.double_wavelets(w, grid, angles, 1.7, 1.2) == f).all() for w, f in zip(windows, found)) and len(made) == 12 + 4 * 12


def test_lines_drawn_at_once_equal_each_line():
    rng = np.random.default_rng(0)
    ends = np.concatenate([rng.integers(-9, 10, (400, 4)), np.zeros((1, 4), int), np.repeat(rng.integers(0, 40, (30, 2)), 2, axis=1)])
    line, y, x = images.lines_pixels(*ends.T)
    assert [list(zip(y[line == i].tolist(), x[line == i].tolist())) for i in range(len(ends))] == [list(map(tuple, images.line_pixels(*e).tolist())) for e in ends.tolist()]
    assert all(len(v) == 0 for v in images.lines_pixels(*np.empty((4, 0), int)))


def test_a_window_reads_its_own_pixels_only():
    """With missing pixels, a window of a large batch takes no longer than one of a small batch."""
    kind = pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.list_(pa.float64()))]))
    row = {"y0": 0, "x0": 0, "h": 16, "w": 16, "rows": 16, "cols": 16}
    took = []
    for n in (100, 10_000):
        strips = pa.array([[{"y": 0, "x": 0, "h": 16, "w": 16, "data": [None, *map(float, range(i, i + 255))]}] for i in range(n)], kind)
        start = time.process_time()
        for i in range(0, n, n // 100):
            window = tiled.padded(row, strips[i], 1, "nan")
            assert np.isnan(window[1, 1]) and window[1, 2] == i and window[16, 16] == i + 254
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.05


def test_tiles_are_never_broadcast(spark):
    labels = spark.range(50).selectExpr("1 as file_id", "0 as frame", "cast(id as int) as y", "3 as x", "cast(id as double) as direction")
    frames = spark.createDataFrame([(1, 0, 50, 8)], "file_id int, frame int, rows int, cols int")
    found = tiled.smoothed_directions(labels, frames, 6)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
    assert found.count() == 150
