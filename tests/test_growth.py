"""Lines grown over cells equal lines grown over all vectors, in time near linear."""

import time

import numpy as np
import pytest

from sparkloom.operators import graph


def plain_line(seed, y, x, angle, length, persistence, reach):
    """Each step measures the distance to every vector."""
    line, used = [seed], {seed}
    heading, open_ends = [angle[seed], angle[seed] + np.pi], [True, True]
    while any(open_ends):
        for side in (0, 1):
            if open_ends[side]:
                tail = line[-persistence:] if side == 0 else line[:persistence]
                t = np.angle(np.exp(2j * angle[tail]).mean()) / 2
                heading[side] = t + np.pi if np.cos(t - heading[side]) < 0 else t
                end, step = line[-1] if side == 0 else line[0], length[tail].mean()
                d = np.hypot(y - (y[end] + np.sin(heading[side]) * step), x - (x[end] + np.cos(heading[side]) * step))
                d[list(used)] = np.inf
                best = int(d.argmin())
                if d[best] <= reach:
                    used.add(best)
                    line = [*line, best] if side == 0 else [best, *line]
                else:
                    open_ends[side] = False
    return line


@pytest.mark.parametrize("persistence", [1, 2, 4])
def test_lines_equal_the_plain_search(persistence):
    rng = np.random.default_rng(persistence)
    for n in (1, 5, 300):
        y, x, t, size = rng.uniform(0, 12, n), rng.uniform(0, 12, n), rng.normal(0.3, 0.3, n), rng.uniform(0.8, 1.4, n)
        near = graph.Neighbourhood(y, x, 0.5)
        for seed in range(0, n, 3):
            # Means over the same vectors in another order differ in the last bits only.
            assert graph.grow_line(seed, y, x, t, size, persistence, 0.5, near) == plain_line(seed, y, x, t, size, persistence, 0.5)
        assert near.free.all()


def test_closed_rings_end():
    a = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    line = graph.grow_line(0, 10 * np.sin(a), 10 * np.cos(a), a + np.pi / 2, np.full(40, 2 * 10 * np.sin(np.pi / 40)), 2, 0.5)
    assert sorted(line) == list(range(40))


def test_many_vectors_take_time_near_linear():
    took = []
    for n in (5_000, 50_000):
        rng = np.random.default_rng(0)
        side = np.sqrt(n)
        y, x, t, size = rng.uniform(0, side, n), rng.uniform(0, side, n), rng.normal(0, 0.2, n), np.full(n, 1.0)
        start = time.process_time()
        near = graph.Neighbourhood(y, x, 0.5)
        steps = sum(len(graph.grow_line(s, y, x, t, size, 3, 0.5, near)) for s in range(0, n, n // 500))
        took.append((time.process_time() - start) / (n + 20 * steps))
    assert took[1] < 4 * took[0]


@pytest.mark.parametrize("n", [600, 3000])
def test_lines_in_one_dense_cell_equal_the_plain_search(n):
    """All points lie within reach of each other, with copies, outliers and places that are no numbers."""
    rng = np.random.default_rng(n)
    y, x, t, size = rng.normal(0, 0.1, n), rng.normal(0, 0.1, n), rng.uniform(-3, 3, n), np.abs(rng.normal(0, 0.1, n))
    y[:40], x[:40] = y[40:80], x[40:80]
    y[-1], y[-2] = np.nan, 5.0
    near = graph.Neighbourhood(y, x, 0.5)
    for _ in range(300):
        a, b = rng.normal(0, 0.4, 2)
        near.free[rng.integers(0, n, 5)] = False
        d = np.where(near.free, np.hypot(y - a, x - b), np.nan)
        assert near.nearest(a, b) == (int(np.nanargmin(d)) if np.nanmin(d) <= 0.5 else None)
    finite = slice(0, n - 2)
    near = graph.Neighbourhood(y[finite], x[finite], 0.1)
    for seed in range(0, n - 2, 97):
        assert graph.grow_line(seed, y[finite], x[finite], t[finite], size[finite], 3, 0.1, near) == plain_line(seed, y[finite], x[finite], t[finite], size[finite], 3, 0.1)


def test_a_step_in_a_dense_cell_does_not_grow_with_its_points():
    took = []
    for n in (5_000, 100_000):
        rng = np.random.default_rng(0)
        near = graph.Neighbourhood(rng.normal(0, 0.12, n), rng.normal(0, 0.12, n), 0.1)
        at = rng.normal(0, 0.12, (1000, 2)).tolist()
        start = time.process_time()
        for a, b in at:
            near.nearest(a, b)
        took.append(time.process_time() - start)
    assert took[1] < 4 * took[0]


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_agglomeration_equals_the_plain_search(linkage):
    """Each step searches all pairs; distances with ties."""
    import pandas as pd

    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 40):
        full = rng.integers(1, 30, (n, n)).astype(float)
        pairs = [(a, b, full[a, b]) for a in range(n) for b in range(a + 1, n)]
        found = graph._agglomerated(pd.DataFrame(pairs, columns=["a", "b", "d"]), 18.0, linkage)
        d = np.full((n, n), np.inf)
        for a, b, v in pairs:
            d[a, b] = d[b, a] = v
        label, size = np.arange(n), np.ones(n)
        while n > 1:
            i, j = sorted(np.unravel_index(d.argmin(), d.shape))
            if not d[i, j] < 18:
                break
            new = {"complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]), "single": np.minimum(d[i], d[j])}[linkage]
            d[i], d[:, i] = new, new
            d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
            size[i] += size[j]
            label[label == j] = i
        if n > 1:
            assert dict(zip(found["id"], found["cluster"])) == dict(enumerate(label))
