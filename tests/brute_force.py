"""Plain Python answers, from the tables' files alone, to the registered queries that have no SQL.

Each check gets the query's rows and the folder of the tables.  Smoothing and
peak kernels have closed-form tests of their own (test_functions.py); here they
are applied to plain arrays, which tests grouping, order and missing values.
"""

from __future__ import annotations

import datetime
import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

from sparkloom.functions import images, signals


def _table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def _traces(sf):
    out = defaultdict(list)
    for e in sorted(_table(sf, "events"), key=lambda e: (e["user_id"], e["ts"], e["event_id"])):
        out[e["user_id"]].append(e["value"])
    return out


def _vectors(sf):
    out = defaultdict(dict)
    for r in _table(sf, "embeddings"):
        e = [float(x) for x in r["embedding"]]
        out[r["label"]][r["vec_id"]] = (e[0], e[1], math.atan2(e[3], e[2]), abs(e[4]))
    return out


def _series(rows, column):
    return {(r["series"], r["frame"]): r[column] for r in rows}


def _same(found, want, tolerance=2e-6):
    assert set(found) == set(want)
    for k, v in want.items():
        if v is None or math.isnan(v):
            assert found[k] is None, k
        else:
            assert abs(found[k] - v) <= tolerance * max(1, abs(v)), (k, found[k], v)


def low_pass(rows, sf):
    _same(_series(rows, "low"), {(s, i): v for s, y in _traces(sf).items() for i, v in enumerate(signals.nan_low_pass(np.array(y)))})


def gap_fill_cubic(rows, sf):
    want = {}
    for s, y in _traces(sf).items():
        holes = np.array([math.nan if (i + s) % 5 == 0 else v for i, v in enumerate(y)])
        for i, v in enumerate(signals.fill_gaps(holes, 3)):
            want[s, i] = v
        assert all(want[s, i] == v for i, v in enumerate(y) if (i + s) % 5)
    _same(_series(rows, "filled"), want)


def _peaks(sf):
    profiles = defaultdict(dict)
    for s, y in _traces(sf).items():
        for i, v in enumerate(y):
            profiles[s % 10, i][s] = v
    out = {}
    for key, p in profiles.items():
        at = np.array(sorted(p), dtype=float)
        step = at[1] - at[0] if len(at) > 1 else 1.0
        out[key] = signals.band_positions(at, np.array([p[s] for s in sorted(p)]), 0.2, int(round(14 / step)), int(round(5 / step)))
    return out


def peaks(rows, sf):
    _same({(r["loi"], r["frame"], r["place"]): r["x"] for r in rows}, {(*k, i): x for k, xs in _peaks(sf).items() for i, x in enumerate(xs)})


def tracking(rows, sf):
    """Positions are the peaks; a track has one position a frame, steps within reach and gaps within memory."""
    want = sorted((loi, f, round(float(x), 6)) for (loi, f), xs in _peaks(sf).items() for x in xs)
    assert sorted((r["loi"], r["frame"], r["x"]) for r in rows) == want
    tracks = defaultdict(dict)
    for r in rows:
        assert r["frame"] not in tracks[r["loi"], r["track"]]
        tracks[r["loi"], r["track"]][r["frame"]] = r["x"]
    for t in tracks.values():
        for a, b in itertools.pairwise(sorted(t)):
            assert b - a <= 11 and abs(t[a] - t[b]) <= 20.0 + 1e-6


def _pairs(points, reach):
    for a, b in itertools.combinations(sorted(points), 2):
        d = math.hypot(points[a][0] - points[b][0], points[a][1] - points[b][1])
        if d <= reach:
            yield a, b, d


def assignment(rows, sf):
    """Pairs are allowed ones, no point has two, and as many are joined at as little cost as augmenting paths find."""
    found = defaultdict(list)
    for r in rows:
        found[r["grp"]].append((r["a"], r["b"], r["cost"]))
    for grp, points in _vectors(sf).items():
        cost = {(a, b) if a % 2 == 0 else (b, a): d for a, b, d in _pairs(points, 0.1) if a % 2 != b % 2}
        own = found.get(grp, [])
        assert all(abs(cost[a, b] - c) < 2e-6 for a, b, c in own)
        assert len({a for a, _, _ in own}) == len(own) == len({b for _, b, _ in own})
        want = _least_cost_matching(cost)
        assert len(own) == len(want) and abs(sum(c for _, _, c in own) - sum(cost[p] for p in want)) < 1e-5


def _least_cost_matching(cost):
    """The cheapest of the largest matchings, by cheapest augmenting paths (Bellman-Ford)."""
    match = {}
    while True:
        undone, best, come = {a: b for b, a in match.items()}, {}, {}
        for (a, b), c in cost.items():
            if a not in undone and c < best.get(b, math.inf):
                best[b], come[b] = c, a
        changed = True
        while changed:
            changed = False
            for (a, b), c in cost.items():
                # a is matched with some other point, from which it can be taken.
                old = undone.get(a)
                if old is not None and old != b and old in best and best[old] - cost[a, old] + c < best.get(b, math.inf) - 1e-12:
                    best[b], come[b], changed = best[old] - cost[a, old] + c, a, True
        free = [b for b in best if b not in match]
        if not free:
            return {(a, b) for b, a in match.items()}
        b = min(free, key=best.get)
        while b is not None:
            a = come[b]
            match[b] = a
            b = undone.get(a)


def _parts(nodes, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for n in sorted(nodes):
        if n not in seen:
            part, waiting = set(), [n]
            while waiting:
                i = waiting.pop()
                if i not in part:
                    part.add(i)
                    waiting += near[i] - part
            seen |= part
            out.append(part)
    return out


def _edges(points, reach, cosine):
    out = {}
    for a, b, d in _pairs(points, reach):
        c = abs(math.cos(points[a][2] - points[b][2]))
        if c > cosine:
            out[a, b] = d / c
    return out


def _modularity(edges, member, resolution):
    total, strength, inside = sum(edges.values()), defaultdict(float), 0.0
    for (a, b), w in edges.items():
        strength[member[a]] += w
        strength[member[b]] += w
        inside += w if member[a] == member[b] else 0.0
    return inside / total - resolution * sum(s * s for s in strength.values()) / (4 * total * total)


def communities(rows, sf):
    """Communities are connected, named by their smallest id, and no single move or merger raises modularity."""
    found = defaultdict(dict)
    for r in rows:
        found[r["grp"]][r["id"]] = r["community"]
    for grp, points in _vectors(sf).items():
        edges = _edges(points, 0.1, 0.65)
        member = found.get(grp, {})
        assert set(member) == set(itertools.chain.from_iterable(edges))
        if not edges:
            continue
        groups = defaultdict(set)
        for i, c in member.items():
            groups[c].add(i)
        for c, ids in groups.items():
            assert min(ids) == c and len(_parts(ids, [p for p in edges if set(p) <= ids])) == 1
        now = _modularity(edges, member, 0.5)
        for i in member:
            for c in groups:
                assert _modularity(edges, member | {i: c}, 0.5) <= now + 1e-9
        assert now >= _modularity(edges, {i: i for i in member}, 0.5)


def agglomeration(rows, sf):
    """Clusters of plain average linkage over all pairs of a key's lines."""
    found = defaultdict(lambda: defaultdict(set))
    for r in rows:
        found[r["grp"]][r["cluster"]].add(r["id"])
    for grp, points in _vectors(sf).items():
        lines = defaultdict(list)
        for i, p in points.items():
            lines[i % 5].append(p)

        def far(a, b):
            return max(min(math.hypot(p[0] - q[0], p[1] - q[1]) for q in b) for p in a)

        d = {frozenset(k): max(far(lines[k[0]], lines[k[1]]), far(lines[k[1]], lines[k[0]])) for k in itertools.combinations(lines, 2)}
        clusters = [frozenset([k]) for k in lines]
        while len(clusters) > 1:
            mean = {(a, b): np.mean([d[frozenset((i, j))] for i in a for j in b]) for a, b in itertools.combinations(clusters, 2)}
            a, b = min(mean, key=mean.get)
            if mean[a, b] >= 0.3:
                break
            clusters = [c for c in clusters if c not in (a, b)] + [a | b]
        assert {frozenset(c) for c in found[grp].values()} == set(clusters)


def _grown(points, share, persistence, reach, n_min):
    """seed -> ids of the line grown from it, by measuring the distance to every vector in each step; seeds are drawn as the operator draws them."""
    ids = sorted(points)
    y, x, t, size = (np.array([points[i][c] for i in ids]) for c in range(4))
    out = {}
    for seed in np.random.default_rng(0).choice(len(ids), max(1, int(share * len(ids))), replace=False).tolist():
        line, heading, going = [seed], [t[seed], t[seed] + math.pi], [True, True]
        while any(going):
            for side in (0, 1):
                if not going[side]:
                    continue
                tail = line[-persistence:] if side == 0 else line[:persistence]
                mean = sum(complex(math.cos(2 * t[i]), math.sin(2 * t[i])) for i in tail)
                h = math.atan2(mean.imag, mean.real) / 2
                heading[side] = h + math.pi if math.cos(h - heading[side]) < 0 else h
                end, step = line[-1 if side == 0 else 0], sum(size[i] for i in tail) / len(tail)
                d = np.hypot(y - y[end] - math.sin(heading[side]) * step, x - x[end] - math.cos(heading[side]) * step)
                d[line] = math.inf
                best = int(d.argmin())
                if d[best] <= reach:
                    line = [*line, best] if side == 0 else [best, *line]
                else:
                    going[side] = False
        if len(line) >= n_min:
            out[ids[seed]] = [ids[i] for i in line]
    return out


def line_growth(rows, sf):
    """Every line, vector by vector."""
    found = defaultdict(dict)
    for r in rows:
        found[r["grp"], r["line"]][r["pos"]] = r["id"]
    want = {(grp, seed): line for grp, points in _vectors(sf).items() for seed, line in _grown(points, 0.5, 3, 0.1, 3).items()}
    assert {k: [v[p] for p in range(len(v))] for k, v in found.items()} == want and want


def _lines_are_lines(rows, vectors, reach, n_min):
    lines = defaultdict(dict)
    for grp, line, pos, i in rows:
        lines[grp, line][pos] = i
    for (grp, _), line in lines.items():
        ids = [line[p] for p in range(len(line))]
        assert len(ids) >= n_min and len(set(ids)) == len(ids)
        points = vectors[grp]
        for a, b in itertools.pairwise(ids):
            longest = max(points[i][3] for i in ids)
            assert math.hypot(points[a][0] - points[b][0], points[a][1] - points[b][1]) <= longest + reach + 1e-9
    return lines


def _tiles(sf):
    n = defaultdict(lambda: np.zeros((64, 64)))
    for o in _table(sf, "orders"):
        n[o["o_orderpriority"], o["o_orderdate"].year - 1990][o["o_custkey"] % 64, 4 + 16 * (o["o_orderkey"] % 4) + o["o_custkey"] % 3] += 1
    return {k: 0.05 + 0.95 * v / v.max() for k, v in n.items()}


def image_regions(rows, sf):
    """Regions by flood fill: areas, means and numbers."""
    found = defaultdict(list)
    for r in rows:
        found[r["file_id"], r["frame"]].append((r["area"], r["mean_intensity"]))
    want = {}
    for key, img in _tiles(sf).items():
        on = {tuple(p) for p in np.argwhere(img > 0.15).tolist()}
        pairs = [(p, q) for p in on for q in itertools.product(range(p[0] - 1, p[0] + 2), range(p[1] - 1, p[1] + 2)) if q in on]
        want[key] = [(float(len(part)), round(float(np.mean([img[p] for p in part])), 6)) for part in _parts(on, pairs)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items() if v}


def wavelet_vectors(rows, sf):
    """Lengths and angles are of the scan without its guards; counts are those of the scan on plain arrays."""
    grid = np.arange(1.6 - 0.1, 2.2 + 0.15, 0.1)
    angles = np.deg2rad(np.arange(-90, 90, 30.0))
    want = defaultdict(int)
    for key, img in _tiles(sf).items():
        score, n, t = images.best_wavelet(images.double_wavelets(img, grid / 0.12, angles, 0.3 / 0.12, 0.15 / 0.12))
        for y, x in np.argwhere((score >= 0.2 * score.max()) & (n > 0) & (n < len(grid) - 1) & (score > 0)):
            want[(*key, round(float(grid[n[y, x]]), 6), round(float(np.mod(angles[t[y, x]], np.pi)), 6))] += 1
    assert {(r["file_id"], r["frame"], r["len"], r["angle"]): r["n"] for r in rows} == dict(want)


def vector_domains(rows, sf):
    """Communities of vectors through near ends: connected by such links, named by their smallest vector."""
    found = defaultdict(lambda: defaultdict(set))
    for r in rows:
        found[r["frame"]][r["community"]].add(r["vec_id"])
    for grp, points in _vectors(sf).items():
        ends = {2 * i + e: (p[0] + (e - 0.5) * p[3] * math.sin(p[2]), p[1] + (e - 0.5) * p[3] * math.cos(p[2]), p[2]) for i, p in points.items() for e in (0, 1)}
        links = {(a // 2, b // 2) for a, b in _edges(ends, 0.1, 0.65) if a // 2 != b // 2}
        assert set(itertools.chain.from_iterable(found[grp].values())) == set(itertools.chain.from_iterable(links))
        for c, ids in found[grp].items():
            assert min(ids) == c and len(_parts(ids, [p for p in links if set(p) <= ids])) == 1


def lines_of_interest(rows, sf):
    """Grown lines of 3 to 49 vectors, joined while two of a cluster lie within the Hausdorff distance; of each cluster the longest, of those four."""
    best = []
    for grp, points in _vectors(sf).items():
        lines = {s: ids for s, ids in _grown(points, 0.5, 3, 0.1, 3).items() if 3 <= len(ids) < 50}
        distance = lambda a, b: max(max(min(math.dist(points[i][:2], points[j][:2]) for j in q) for i in p) for p, q in ((a, b), (b, a)))
        d = {frozenset(p): distance(lines[p[0]], lines[p[1]]) for p in itertools.combinations(sorted(lines), 2)}
        clusters = _parts(set(lines), [p for p in itertools.combinations(sorted(lines), 2) if distance(lines[p[0]], lines[p[1]]) < 0.2])
        length = {s: sum(points[i][3] for i in ids) for s, ids in lines.items()}
        for c in clusters:
            s = min(c, key=lambda s: (-length[s], s))
            best.append((-length[s], grp, s, len(lines[s])))
    want = [(grp, s, n, round(-m, 6)) for m, grp, s, n in sorted(best)[:4]]
    assert [(r["grp"], r["line"], r["n"], r["length"]) for r in rows] == want


def band_lateral_links(rows, sf):
    """Links join ends of different bands within reach whose directions fit; an end has one link at most, so a band has two."""
    vectors, degree = _vectors(sf), defaultdict(int)
    for r in rows:
        points = vectors[r["frame"]]
        ends = {}
        for i in (r["a"], r["b"]):
            y, x, t, n = points[i]
            ends[i] = [(y + (e - 0.5) * n * math.sin(t), x + (e - 0.5) * n * math.cos(t)) for e in (0, 1)]
        d = [math.hypot(p[0] - q[0], p[1] - q[1]) for p in ends[r["a"]] for q in ends[r["b"]]]
        assert r["a"] < r["b"] and r["alignment"] >= 0.3 - 1e-6 and r["dist"] <= 0.1 and min(abs(x - r["dist"]) for x in d) < 2e-6
        for i in (r["a"], r["b"]):
            degree[r["frame"], i] += 1
    assert max(degree.values(), default=0) <= 2


def extracted_vectors(rows, sf):
    """Vectors start on midlines of rows that have an order, point along the rows, and their lengths are distances of bars."""
    tiles = _tiles(sf)
    for r in rows:
        y, t = round(r["y"] / 0.12), tiles[r["file_id"], r["frame"]]
        assert t[y].max() > 0.06 and r["angle"] == 0 and 1.0 <= r["len"] <= 3.0
        assert min(abs(r["len"] / 0.12 - n) for n in (14, 15, 16, 17, 18)) < 1
    assert {(r["file_id"], r["frame"]) for r in rows} <= set(tiles)


def grown_line_shapes(rows, sf):
    assert all(0 <= r["straightness"] <= 1 and r["bending"] >= 0 and r["n"] >= 3 for r in rows)


def lines_by_fit(rows, sf):
    assert len(rows) <= 10
    lengths = [math.hypot(r["x1"] - r["x0"], r["y1"] - r["y0"]) for r in rows]
    assert all(a >= b - 0.2 for a, b in itertools.pairwise(lengths)) and all(abs(10 * r[c] - round(10 * r[c])) < 1e-6 for r in rows for c in ("x0", "y0", "x1", "y1"))


def frame_structure(rows, sf):
    tiles = _tiles(sf)
    assert {(r["file_id"], r["frame"]) for r in rows} == set(tiles) and len(rows) == len(tiles)
    for r in rows:
        t = tiles[r["file_id"], r["frame"]]
        assert abs(r["cell_mask_area"] - (t > 0.1).sum() * 0.0144) < 1e-5 and abs(r["z_mask_area"] - (t > 0.5).sum() * 0.0144) < 1e-5
        assert abs(r["sarcomere_area"] - 64 * 51 * 0.0144) < 1e-5


def ttest_p(rows, sf):
    """Tails of Student's density by Simpson's rule."""
    assert rows
    for r in rows:
        n = r["freedom"]
        scale = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
        x = np.linspace(0, abs(r["t"]), 20_001)
        y = scale * (1 + x * x / n) ** (-(n + 1) / 2)
        inside = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3
        assert abs(r["p_value"] - (1 - 2 * inside)) < 1e-5


def ks_geom_p(rows, sf):
    for r in rows:
        x = (math.sqrt(r["n"]) + 0.12 + 0.11 / math.sqrt(r["n"])) * r["ks"]
        want = 1.0 if x < 0.2 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 60))
        assert abs(r["p_value"] - min(1.0, max(0.0, want))) < 1e-4


def _movies(sf):
    """file, frame -> image of 40 x 56 pixels."""
    out = defaultdict(lambda: np.zeros((40, 56)))
    for o in _table(sf, "orders"):
        out[o["o_custkey"] // 300, o["o_orderdate"].year - 1992][o["o_custkey"] % 40, o["o_orderkey"] % 56] += o["o_totalprice"] / 1e3
    return out


def _mirror(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def _b_spline(order, x):
    """The recursion of de Boor, on half-open intervals."""
    if order == 0:
        return 1.0 if -0.5 <= x < 0.5 else 0.0
    half = (order + 1) / 2
    return ((half + x) * _b_spline(order - 1, x + 0.5) + (half - x) * _b_spline(order - 1, x - 0.5)) / order


def _kymograph_of(order):
    def check(rows, sf):
        """Dense systems for the coefficients of whole images, then the sum over all pixels in reach."""
        def matrix(n):
            m = np.zeros((n, n))
            for i in range(n):
                for j in range(i - order, i + order + 1):
                    m[i, _mirror(j, n)] += _b_spline(order, i - j)
            return m

        a, b = matrix(40), matrix(56)
        coefficients = {k: np.linalg.solve(b, np.linalg.solve(a, v).T).T for k, v in _movies(sf).items()}
        want = {}
        for s in _table(sf, "supplier"):
            k = s["s_suppkey"]
            points = [(k % 40, 1.5), (s["s_nationkey"] / 2 + 20, 28.25), (39 - k % 40, 57.0)]
            pos = 0
            for (y0, x0), (y1, x1) in itertools.pairwise(points):
                n, t = math.ceil(math.hypot(y1 - y0, x1 - x0) + 1), math.atan2(y1 - y0, x1 - x0)
                for i in range(n):
                    weights = np.zeros((40, 56))
                    for o in (-1, 0, 1):
                        y, x = y0 + (y1 - y0) * i / (n - 1) + o * math.cos(t), x0 + (x1 - x0) * i / (n - 1) - o * math.sin(t)
                        ys = [(_mirror(j, 40), _b_spline(order, y - j)) for j in range(math.floor(y) - order, math.floor(y) + order + 2)]
                        xs = [(_mirror(j, 56), _b_spline(order, x - j)) for j in range(math.floor(x) - order, math.floor(x) + order + 2)]
                        for u, p in ys:
                            for v, q in xs:
                                weights[u, v] += p * q / 3
                    for (f, frame), c in coefficients.items():
                        if f == k // 20:
                            want[f, k, frame, pos] = float((weights * c).sum())
                    pos += 1
        _same({(r["file_id"], r["line"], r["frame"], r["pos"]): r["v"] for r in rows}, want, 1e-5)

    check.__name__ = f"kymograph_order_{order}"
    return check


def tiled_wavelets(rows, sf):
    """Products of two Gaussian bars around each pixel, summed term by term on whole images."""
    grid, angles = [0.8 + 0.2 * i for i in range(6)], [math.radians(a) for a in range(-90, 90, 30)]
    half = int(math.ceil((max(grid) / 2 + 0.6) / 0.12))
    y, x = np.mgrid[-half : half + 1, -half : half + 1].astype(float)
    found = defaultdict(dict)
    for r in rows:
        found[r["file_id"], r["frame"]][r["y"], r["x"]] = r
    key = sorted(found)[0]
    image = np.pad(_movies(sf)[key], half)
    scores = np.zeros((len(grid), len(angles), 40, 56))
    for i, n in enumerate(grid):
        for j, t in enumerate(angles):
            along, across = x * math.cos(t) + y * math.sin(t), -x * math.sin(t) + y * math.cos(t)
            both = []
            for sign in (-0.5, 0.5):
                k = np.exp(-((along - sign * n / 0.12) ** 2) / (2 * (0.15 / 0.12) ** 2) - across**2 / (2 * (0.2 / 0.12) ** 2))
                k /= k.sum()
                both.append(sum(k[a, b] * image[a : a + 40, b : b + 56] for a in range(2 * half + 1) for b in range(2 * half + 1)))
            scores[i, j] = np.maximum(both[0], 0) * np.maximum(both[1], 0)
    best = scores.max(axis=(0, 1))
    sure = 0
    for a in range(40):
        for b in range(56):
            order = np.sort(scores[:, :, a, b].ravel())
            i, j = np.unravel_index(scores[:, :, a, b].argmax(), scores.shape[:2])
            inside = 0 < i < len(grid) - 1 and best[a, b] > 0
            # Near the threshold, or where two are all but equal, rounding decides.
            if abs(best[a, b] - 0.2 * best.max()) < 1e-6 or order[-1] - order[-2] < 1e-6 * max(best[a, b], 1e-9):
                continue
            sure += 1
            assert ((a, b) in found[key]) == (inside and best[a, b] > 0.2 * best.max()), (a, b)
            if (a, b) in found[key]:
                r = found[key][a, b]
                assert abs(r["len"] - grid[i]) < 1e-5 and abs(r["angle"] - angles[j] % math.pi) < 1e-5 and abs(r["score"] - best[a, b]) < 1e-4 * max(1, best[a, b])
    assert sure > 1500


def _drawn_vectors(sf):
    """frame -> pixel -> (weight, angle, side) of every vector over it."""
    out = defaultdict(lambda: defaultdict(list))
    for o in _table(sf, "orders"):
        y, x, t, n, w = o["o_custkey"] % 40 + 0.5, o["o_orderkey"] % 56 + 0.25, math.fmod(o["o_totalprice"], 3.14159), 3.0 + o["o_orderkey"] % 7, 1 + o["o_custkey"] % 3
        frame = out[o["o_custkey"] // 300, o["o_orderdate"].year - 1992]
        (a, b), (c, d) = ((math.trunc(y + s * math.sin(t) * n / 2), math.trunc(x + s * math.cos(t) * n / 2)) for s in (-1, 1))
        if min(a, c) >= 0 and max(a, c) < 40 and min(b, d) >= 0 and max(b, d) < 56:
            p = images.line_pixels(a, b, c, d).tolist()
            for i, (u, v) in enumerate(p):
                frame[u, v].append((w, t, -1 if i < len(p) // 2 else 1))
    return out


def vector_label_maps(rows, sf):
    found = {(r["file_id"], r["frame"], r["y"], r["x"]): r for r in rows}
    want = {(*k, *p): v for k, frame in _drawn_vectors(sf).items() for p, v in frame.items()}
    assert set(found) == set(want)
    for k, drawn in want.items():
        one = sum(w * s * complex(math.cos(t), math.sin(t)) for w, t, s in drawn)
        two = sum(w * complex(math.cos(2 * t), math.sin(2 * t)) for w, t, _ in drawn)
        total = sum(w for w, _, _ in drawn)
        r = found[k]
        assert r["n"] == len(drawn) and r["weight"] == total and abs(r["strength"] - abs(two) / total) < 2e-6
        assert abs(one) < 1e-4 or abs(math.sin(r["direction"] - math.atan2(one.imag, one.real))) < 1e-4
        assert abs(two) < 1e-4 or abs(math.sin(r["axis"] - math.atan2(two.imag, two.real) / 2)) < 1e-4


def vector_mask_area(rows, sf):
    want = _drawn_vectors(sf)
    for r in rows:
        frame = want[r["file_id"], r["frame"]]
        near, labelled = set(), set()
        for y, x in frame:
            near |= {(y + a, x + b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4 and 0 <= y + a < 40 and 0 <= x + b < 56}
            labelled |= {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= y + a < 40 and 0 <= x + b < 56}
        assert (r["area"], r["labelled"]) == (len(near), len(labelled)) and abs(r["s2"]) <= 1
    assert {(r["file_id"], r["frame"]) for r in rows} == set(_movies(sf))


def event_time_tracking(rows, sf):
    """The batch linking of the sorted table, frame by frame; tracks of the stream are numbered by their first frames."""
    frames = defaultdict(lambda: defaultdict(set))
    for e in _table(sf, "events"):
        seconds = (e["ts"] - datetime.datetime(1970, 1, 1)).total_seconds()
        frames[e["user_id"] % 10][int(seconds // 21600)].add(e["value"])
    found = defaultdict(dict)
    for r in rows:
        found[r["loi"]][r["frame"], r["x"]] = r["track"]
    assert set(found) == set(frames)
    for loi, own in frames.items():
        first = min(own)
        xs = [np.array(sorted(own.get(f, ()))) for f in range(first, max(own) + 1)]
        want = {(first + f, round(x, 6)): t for f, (p, ts) in enumerate(zip(xs, signals.linked(xs, 20.0, 2))) for x, t in zip(p.tolist(), ts.tolist())}
        assert set(found[loi]) == set(want)
        numbers = {t: i for i, t in enumerate(sorted(set(found[loi].values())))}
        assert {k: numbers[t] for k, t in found[loi].items()} == want


CHECKS = {
    f.__name__: f
    for f in (
        low_pass, gap_fill_cubic, peaks, tracking, assignment, communities, agglomeration, line_growth, image_regions, wavelet_vectors,
        vector_domains, lines_of_interest, band_lateral_links, extracted_vectors, grown_line_shapes, lines_by_fit, frame_structure, ttest_p, ks_geom_p,
        *map(_kymograph_of, range(2, 6)), tiled_wavelets, vector_label_maps, vector_mask_area, event_time_tracking,
    )
}
