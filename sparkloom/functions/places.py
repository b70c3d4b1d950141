"""Nearest points in the plane and sets of points within a Hausdorff distance, exactly.

Points that lie together are blocks; blocks meet by their boxes, and points only where the boxes allow it, so that the work grows with
the points and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points of a block that asks, of a block that is asked, and distances held at once.
ASKING, ASKED, TOGETHER = 32, 32, 1 << 20


def packed(y: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """An order of the points in which `size` that follow each other lie together: strips along y, cut across."""
    strips = max(1, int(np.sqrt(len(y) / size)))
    strip = np.empty(len(y), np.int64)
    strip[np.argsort(x, kind="stable")] = np.arange(len(y)) * strips // max(len(y), 1)
    return np.lexsort((y, strip))


def _distances(y: np.ndarray, x: np.ndarray, py: np.ndarray, px: np.ndarray) -> np.ndarray:
    dy, dx = y[:, None] - py[None], x[:, None] - px[None]
    return np.sqrt(dy * dy + dx * dx)


def nearest(y: np.ndarray, x: np.ndarray, py: np.ndarray, px: np.ndarray, limit: float = np.inf, own: np.ndarray | None = None, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each point (y, x) the distance of the nearest point (py, px) within the limit, infinite if there is none, and its name: the smallest of equally near ones.

    `own` are the points' own names, of which they don't find a point.  All places are finite.
    """
    found, name = np.full(len(y), np.inf), np.full(len(y), -1)
    if not len(y) or not len(py):
        return found, name
    order = packed(py, px, ASKED)
    py, px = py[order], px[order]
    names = np.zeros(len(py), np.int64) if names is None else names[order]
    first = np.arange(0, len(py), ASKED)
    (low_y, high_y), (low_x, high_x) = ((np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)) for c in (py, px))
    order = packed(y, x, ASKING)
    for at in range(0, len(y), ASKING):
        rows = order[at : at + ASKING]
        qy, qx = y[rows], x[rows]
        gap_y, gap_x = (np.maximum(0.0, np.maximum(low - q.max(), q.min() - high)) for low, high, q in ((low_y, high_y, qy), (low_x, high_x, qx)))
        far_y, far_x = (np.maximum(high - q.min(), q.max() - low) for low, high, q in ((low_y, high_y, qy), (low_x, high_x, qx)))
        gap, far = np.sqrt(gap_y * gap_y + gap_x * gap_x), np.sqrt(far_y * far_y + far_x * far_x)
        # One block holds a point as near as this; of names of their own, two do, and what they don't settle is held against all.
        needed = 0 if own is None else 1
        reach = min(limit, float(np.partition(far, needed)[needed])) if len(far) > needed else limit
        while True:
            near, of = np.full(len(rows), np.inf), np.full(len(rows), -1)
            blocks = np.flatnonzero(gap <= reach)
            step = max(1, TOGETHER // (ASKING * ASKED))
            for k in range(0, len(blocks), step):
                places = (first[blocks[k : k + step], None] + np.arange(ASKED)).ravel()
                places = places[places < len(py)]
                d = _distances(qy, qx, py[places], px[places])
                if own is not None:
                    d[own[rows][:, None] == names[places][None]] = np.inf
                least = d.min(axis=1)
                if own is None:
                    near = np.minimum(near, least)
                    continue
                tied = np.where(d == least[:, None], names[places][None], np.iinfo(np.int64).max).min(axis=1)
                of = np.where(least < near, tied, np.where(least == near, np.minimum(of, tied), of))
                near = np.minimum(near, least)
            if reach >= limit or (near <= reach).all():
                break
            reach = limit
        within = (near <= limit) & np.isfinite(near)
        found[rows[within]], name[rows[within]] = near[within], of[within]
    return found, name


def near_pairs(y: np.ndarray, x: np.ndarray, py: np.ndarray, px: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Points (y, x), points (py, px) and distances of all pairs within reach, those of a point in one part; parts are of points that lie together.  All places are finite."""
    if not len(y) or not len(py):
        return
    strip = np.floor(py / reach)
    by = np.lexsort((px, strip))
    py, px, strip = py[by], px[by], strip[by]
    names = np.unique(strip)
    ends = np.append(np.searchsorted(strip, names), len(strip)).tolist()
    order = packed(y, x, ASKING)
    for at in range(0, len(y), ASKING):
        rows = order[at : at + ASKING]
        qy, qx = y[rows], x[rows]
        low, high = qx.min() - reach * (1 + 1e-9), qx.max() + reach * (1 + 1e-9)
        first, last = np.searchsorted(names, (np.floor(qy.min() / reach) - 1, np.floor(qy.max() / reach) + 2))
        parts = [ends[s] + np.searchsorted(px[ends[s] : ends[s + 1]], (low, high)) for s in range(int(first), min(int(last), len(names)))]
        there = np.concatenate([np.empty(0, np.int64), *(np.arange(a, b) for a, b in parts)])
        found = []
        for part in np.split(there, range(TOGETHER // ASKING, len(there), TOGETHER // ASKING)):
            d = _distances(qy, qx, py[part], px[part])
            i, j = np.nonzero(d <= reach)
            found.append((rows[i].astype(np.int32), by[part[j]].astype(np.int32), d[i, j]))
        yield tuple(np.concatenate(c) for c in zip(*found))


def to_set(y: np.ndarray, x: np.ndarray, py: np.ndarray, px: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest of a set; places that are no numbers are farther than any other."""
    out = np.full(len(y), np.nan)
    fine, there = np.isfinite(y) & np.isfinite(x), np.isfinite(py) & np.isfinite(px)
    if there.any():
        out[fine] = nearest(y[fine], x[fine], py[there], px[there])[0]
    with np.errstate(invalid="ignore"):
        for rows, cols in ((np.flatnonzero(fine), np.flatnonzero(~there)), (np.flatnonzero(~fine), np.arange(len(py)))):
            for i in range(0, len(cols), 1024):
                for j in range(0, len(rows), 1024):
                    part = rows[j : j + 1024]
                    out[part] = np.fmin(out[part], np.fmin.reduce(_distances(y[part], x[part], py[cols[i : i + 1024]], px[cols[i : i + 1024]]), axis=1))
    return out


def linked_sets(sets: np.ndarray, y: np.ndarray, x: np.ndarray, cut: float) -> np.ndarray:
    """sets: 0, 0, 1, ... ascending, for each point the set that it is of -> for each set the smallest set that it reaches over pairs nearer than `cut` by their Hausdorff distance.

    A set that is reached is asked for no more, so a cluster costs what is outside of it.  The extents of two sets in any direction differ
    by their Hausdorff distance at most, which leaves out pairs before their points meet.
    """
    first = np.flatnonzero(np.append(True, sets[1:] != sets[:-1])) if len(sets) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(sets)))
    turned = (y, x, (y + x) * np.sqrt(0.5), (y - x) * np.sqrt(0.5))
    extent = np.stack([f.reduceat(c, first) for c in turned for f in (np.minimum, np.maximum)], axis=1) if len(first) else np.empty((0, 8))
    slack = cut + 1e-9 * (1 + np.abs(extent[np.isfinite(extent)]).max(initial=0.0))
    left = np.argsort(extent[:, 0], kind="stable")
    label = np.full(len(first), -1)

    def within(i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are nearer than the cut to set i."""
        own = slice(first[i], first[i] + count[i])
        out = np.zeros(len(others), dtype=bool)
        parts = np.cumsum(count[others]) * count[i] // TOGETHER
        for part in np.split(np.arange(len(others)), np.flatnonzero(np.diff(parts)) + 1):
            n = count[others[part]]
            begin = np.cumsum(n) - n
            places = np.repeat(first[others[part]] - begin, n) + np.arange(n.sum())
            if len(places) * count[i] > 4 * TOGETHER:
                for k in part.tolist():
                    there = slice(first[others[k]], first[others[k]] + count[others[k]])
                    out[k] = all((to_set(y[a], x[a], y[b], x[b]) < cut).all() for a, b in ((own, there), (there, own)))
                continue
            d = _distances(y[own], x[own], y[places], x[places])
            there = np.logical_and.reduceat((d < cut).any(axis=0), begin)
            here = np.logical_or.reduceat(d < cut, begin, axis=1).all(axis=0)
            out[part] = there & here
        return out

    while len(left):
        start, left = int(left[0]), left[1:]
        label[start], waiting, reached = start, [start], [start]
        edge, there = extent[left, 0], extent[left]
        while waiting and len(left):
            i = waiting.pop()
            a, b = np.searchsorted(edge, (extent[i, 0] - slack, extent[i, 0] + slack))
            near = left[a:b][(np.abs(there[a:b] - extent[i]) <= slack).all(axis=1)]
            if len(near) and (hit := near[within(i, near)]).size:
                label[hit] = start
                waiting += hit.tolist()
                reached.append(hit)
                keep = label[left] < 0
                left, edge, there = left[keep], edge[keep], there[keep]
        members = np.concatenate([np.atleast_1d(r) for r in reached])
        label[members] = members.min()
    return label
