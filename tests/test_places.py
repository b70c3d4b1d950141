"""Nearest points, Hausdorff distances and linked lines equal plain searches over all pairs, and their work grows with the points."""

import math
import time

import numpy as np
import pytest

from sparkloom.functions import places
from sparkloom.operators import spatial


def clouds(n, seed=0):
    """Points of uneven density with copies."""
    rng = np.random.default_rng(seed)
    y, x = rng.normal(0, 0.2, n), rng.standard_cauchy(n) * 0.05
    y[: n // 5], x[: n // 5] = y[n // 5 : 2 * (n // 5)], x[n // 5 : 2 * (n // 5)]
    return y, x


@pytest.mark.parametrize("n", [1, 2, 40, 700])
@pytest.mark.parametrize("limit", [0.03, math.inf])
def test_nearest_equals_the_plain_search(n, limit):
    y, x = clouds(n)
    name = np.random.default_rng(1).permutation(n) // 2 if n > 40 else np.arange(n)
    d = np.sqrt((y[:, None] - y[None]) ** 2 + (x[:, None] - x[None]) ** 2)
    assert (places.nearest(y, x, y[::3], x[::3])[0] == d[:, ::3].min(axis=1)).all()
    dist, other = places.nearest(y, x, y, x, limit, name, name)
    for i in range(n):
        found = min(((d[i, j], name[j]) for j in range(n) if name[j] != name[i] and d[i, j] <= limit), default=(math.inf, -1))
        assert (dist[i], other[i]) == found


@pytest.mark.parametrize("cut", [0.02, 0.1, 0.5])
def test_linked_sets_equal_components_of_all_pairs(cut):
    rng = np.random.default_rng(3)
    sets = np.repeat(np.arange(60), rng.integers(1, 12, 60))
    y, x = (rng.normal(0, 0.4, 60)[sets] + rng.normal(0, 0.06, len(sets)) for _ in "yx")
    x[sets == 7] = np.nan
    label = np.arange(60)
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                d = np.hypot(y[sets == a][:, None] - y[sets == b][None], x[sets == a][:, None] - x[sets == b][None])
                if max(d.min(axis=0).max(), d.min(axis=1).max()) < cut:
                    label[a] = label[b] = min(label[a], label[b])
    assert (places.linked_sets(sets, y, x, cut) == label).all()


def test_long_sets_are_linked_by_blocks(monkeypatch):
    t = np.linspace(0, 1, 300)
    y, x, sets = np.concatenate([t, t + 0.001, t]), np.concatenate([t * 0, t * 0 + 0.1, t * 0 + 0.3]), np.repeat([0, 1, 2], 300)
    monkeypatch.setattr(places, "TOGETHER", 1 << 12)
    assert places.linked_sets(sets, y, x, 0.15).tolist() == [0, 0, 2]


def test_hausdorff_equals_the_plain_search(spark, monkeypatch):
    monkeypatch.setattr(spatial, "POINTS_A_TASK", 40)
    y, x = clouds(300)
    rows = [(i % 3, i % 7, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))]
    rows += [(0, 8, None, 1.0), (0, 0, None, None), (1, 1, math.nan, 0.0), (None, 1, 0.0, 0.0), (2, None, 0.0, 0.0), (9, 1, 0.0, 0.0)]
    found = {(r.grp, r.a, r.b): r.hausdorff for r in spatial.hausdorff(spark.createDataFrame(rows, "grp int, line int, y double, x double"), ["grp"], "line").collect()}
    lines = {}
    for g, k, a, b in rows:
        if g is not None and k is not None:
            lines.setdefault((g, k), [])
            if a is not None:
                lines[g, k].append((a, b))
    assert set(found) == {(g, j, k) for g, j in lines for h, k in lines if g == h and j < k}
    for (g, j, k), d in found.items():
        p, q = lines[g, j], lines[g, k]
        if not p or not q:
            assert d is None
        elif any(math.isnan(v) for v, _ in p + q):
            assert math.isnan(d)
        else:
            one = [max(min(math.sqrt((a - c) ** 2 + (b - e) ** 2) for c, e in v) for a, b in u) for u, v in ((p, q), (q, p))]
            assert d == max(one)


def test_nearest_in_one_dense_cell(spark):
    """The pairs of 20,000 points of a cell would be 400 million; copies, repeated ids and places without numbers keep their results."""
    n = 20_000
    rng = np.random.default_rng(0)
    y, x = rng.uniform(0, 0.09, n), rng.uniform(0, 0.09, n)
    y[:3], x[:3] = 0.05, 0.05
    rows = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))] + [(0, n, 0.5, 0.5), (0, n, 0.5, 0.5), (0, n + 1, None, 0.0), (0, n + 2, math.nan, 0.0)], "grp int, id long, y double, x double")
    start = time.monotonic()
    found = {r.id: (r.neighbour, r.dist) for r in spatial.nearest(rows, ["grp"], "id", 0.1).collect()}
    assert time.monotonic() - start < 60 and set(found) == set(range(n))
    assert [found[i] for i in range(3)] == [(1, 0.0), (0, 0.0), (0, 0.0)]
    for i in range(3, n, 1111):
        d = np.sqrt((y - y[i]) ** 2 + (x - x[i]) ** 2)
        d[i] = 1
        assert found[i] == (int(d.argmin()), d.min())


def test_work_grows_with_the_points():
    took = []
    for n in (4_000, 40_000):
        y, x = clouds(n)
        start = time.process_time()
        places.nearest(y, x, *clouds(n, 1))
        took.append((time.process_time() - start) / n)
    assert took[1] < 4 * took[0]
