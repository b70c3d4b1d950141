"""Largest matchings of rows and columns and of those the cheapest, exactly, with few of the allowed pairs at hand.

The pairs come in chunks as often as they are asked for.  A matching is made on the cheapest pairs of each end; all pairs are then held
against it, and those that would make it larger or cheaper join in, until there are none, which proves it best among all pairs.

Rows that a largest matching can leave out, columns that it can leave out, and the others are three parts: partners lie in one part, and
in each all of one side have partners, so that costs are compared among pairs only and no price is put on an end that stays alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np

#: Pairs of an end that a matching begins with, and that join in at once.
CHEAPEST = 96
#: If there are no more pairs than this a matching is made on all of them, else they are found anew for each scan; so many are held before those of columns are thinned out.
HELD, THINNED = 6 << 20, 1 << 21
#: Rounds of bids without fewer open ends after which the rest is matched one by one.
PATIENCE = 300

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Links:
    """Pairs by their first end."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, cost: np.ndarray):
        order = np.lexsort((b, a))
        a, self.other, self.cost = a[order], b[order], cost[order]
        self.bounds = np.searchsorted(a, np.arange(n + 1))

    def of(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pairs of some ends, where each end's begin, and how many there are."""
        count = self.bounds[ends + 1] - self.bounds[ends]
        begin = np.cumsum(count) - count
        return np.repeat(self.bounds[ends] - begin, count) + np.arange(count.sum()), begin, count


def _least(end: np.ndarray, by: np.ndarray, limit: int) -> np.ndarray:
    """Places of each end's least pairs, `limit` at most."""
    order = np.lexsort((by, end))
    sorted_end = end[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_end, sorted_end) < limit]


def _once(pairs: list[Pairs]) -> Pairs:
    """Pairs put together, each once, at its least cost."""
    a, b, cost = (np.concatenate(c) for c in zip(*pairs))
    order = np.argsort(a * (np.int64(b.max(initial=0)) + 1) + b, kind="stable")
    a, b, cost = a[order], b[order], cost[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
    return (a, b, cost) if len(first) == len(a) else (a[first], b[first], np.minimum.reduceat(cost, first))


def _begun(m: int, chunks: Callable[[], Iterable[Pairs]]) -> Pairs:
    """The cheapest pairs of each end."""
    by_row, by_column, held, bar = [], [], 0, np.full(m, np.inf)

    def thinned() -> list[Pairs]:
        a, b, cost = (np.concatenate(c) for c in zip(*by_column))
        keep = _least(b, cost, CHEAPEST)
        a, b, cost = a[keep], b[keep], cost[keep]
        full = np.bincount(b, minlength=m) == CHEAPEST
        dearest = np.full(m, -np.inf)
        np.maximum.at(dearest, b, cost)
        bar[full] = dearest[full]
        return [(a, b, cost)]

    for a, b, cost in chunks():
        keep = _least(a, cost, CHEAPEST)
        by_row.append((a[keep], b[keep], cost[keep]))
        keep = cost < bar[b]
        by_column.append((a[keep], b[keep], cost[keep]))
        held += int(keep.sum())
        if held > THINNED:
            by_column, held = thinned(), 0
    return _once(by_row + thinned()) if by_row else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _enlarged(links: _Links, mate: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Makes a matching as large as can be, by alternating paths from all open rows at once; gives the columns that rows left open reach."""
    seen, root = np.zeros(len(owner), dtype=bool), np.empty(len(owner), np.int64)
    came, done = np.empty(len(owner), np.int64), np.zeros(len(mate), dtype=bool)
    while True:
        seen[:], done[:] = False, False
        rows = np.flatnonzero(mate < 0)
        origin, found = rows, False
        while len(rows):
            at, _, count = links.of(rows)
            which = np.repeat(np.arange(len(rows)), count)
            columns = links.other[at]
            new = np.flatnonzero(~seen[columns])
            columns, which = columns[new], which[new]
            came[columns] = np.arange(len(columns))
            last = came[columns] == np.arange(len(columns))
            columns, which = columns[last], which[last]
            seen[columns], came[columns], root[columns] = True, rows[which], origin[which]
            for j in columns[owner[columns] < 0].tolist():
                if not done[root[j]]:
                    done[root[j]], found = True, True
                    while j >= 0:
                        i = owner[j] = came[j]
                        j, mate[i] = int(mate[i]), j
            # Columns of trees that have led to a path are given up in this round.
            columns = columns[~done[root[columns]]]
            rows, origin = owner[columns], root[columns]
        if not found:
            return seen


def _reached(links: _Links, mate: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that alternating paths from open columns reach; `links` are by columns."""
    columns, rows = owner < 0, np.zeros(len(mate), dtype=bool)
    level = np.flatnonzero(columns)
    while len(level):
        found = np.unique(links.other[links.of(level)[0]])
        found = found[~rows[found]]
        rows[found] = True
        level = mate[found]
        columns[level] = True
    return rows, columns


def _bids(links: _Links, mate: np.ndarray, owner: np.ndarray, v: np.ndarray) -> None:
    """Matches most ends by bids: each open end takes its best other at the price at which its second best is as good, and puts out who held it.

    Who holds an other finds none better at the prices then, and others that nobody holds have no price.
    """
    most = 1e3 * (1 + np.abs(links.cost).max(initial=0.0))
    open_ends = np.flatnonzero(mate < 0)
    fewest, stale = len(open_ends) + 1, 0
    while len(open_ends) and stale < PATIENCE:
        at, begin, count = links.of(open_ends)
        value = links.cost[at] - v[links.other[at]]
        best = np.minimum.reduceat(value, begin)
        hit = np.flatnonzero(value == np.repeat(best, count))
        who = np.searchsorted(begin, hit, "right")
        hit = hit[np.append(True, who[1:] != who[:-1])]
        value[hit] = np.inf
        second = np.minimum(np.minimum.reduceat(value, begin), best + most)
        j = links.other[at[hit]]
        bid = v[j] - (second - best)
        order = np.lexsort((bid, j))
        won = order[np.append(True, j[order][1:] != j[order][:-1])]
        j, bid = j[won], bid[won]
        out = owner[j]
        out = out[out >= 0]
        mate[out] = -1
        owner[j], mate[open_ends[won]], v[j] = open_ends[won], j, bid
        open_ends = np.concatenate([np.delete(open_ends, won), out])
        stale = 0 if len(open_ends) < fewest else stale + 1
        fewest = min(fewest, len(open_ends))


def cheapest(n: int, m: int, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest matching in which each of n ends has one of m others, which must exist along the pairs (a, b), each once.

    Gives each end's other and prices of ends and others: no pair costs less than its two prices, matched ones just that, and others without an end have none.
    """
    links = _Links(n, a, b, cost)
    mate, owner, v = np.full(n, -1), np.full(m, -1), np.zeros(m)
    _bids(links, mate, owner, v)
    bounds, other, cost = links.bounds.tolist(), links.other, links.cost
    u = np.minimum.reduceat(cost - v[other], links.bounds[:-1]) if n else np.zeros(0)
    least, came = np.full(m, np.inf), np.full(m, -1)
    for start in np.flatnonzero(mate < 0).tolist():
        # The shortest path over what pairs cost beyond their prices, to an other without an end.
        shortest, free, row, base = np.inf, -1, start, 0.0
        heap, touched, done = [], [], []
        while True:
            own = slice(bounds[row], bounds[row + 1])
            to = other[own]
            d = base + np.maximum(cost[own] - u[row] - v[to], 0.0)
            better = (d < least[to]) & (d < shortest)
            to, d = to[better], d[better]
            least[to], came[to] = d, row
            touched.append(to)
            taken = owner[to] >= 0
            if not taken.all():
                k = int(np.where(taken, np.inf, d).argmin())
                shortest, free = float(d[k]), int(to[k])
                taken &= d < shortest
                to, d = to[taken], d[taken]
            for pair in zip(d.tolist(), to.tolist()):
                heapq.heappush(heap, pair)
            while heap and heap[0][0] > least[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= shortest:
                break
            base, j = heapq.heappop(heap)
            done.append(j)
            row = int(owner[j])
        if free < 0:
            raise ValueError("an end has no other left")
        u[start] += shortest
        at = np.array(done, np.int64)
        u[owner[at]] += shortest - least[at]
        v[at] -= shortest - least[at]
        j = free
        while j >= 0:
            i = owner[j] = came[j]
            j, mate[i] = int(mate[i]), j
        for to in touched:
            least[to] = np.inf
    return mate, u, v


def best_matching(n: int, m: int, chunks: Callable[[], Iterable[Pairs]]) -> Pairs:
    """The matching of n rows and m columns with as many pairs as can be, and of those the cheapest: its rows, columns and costs.

    `chunks` gives all pairs (row, column, cost) anew each time it is called, the pairs of a row in one chunk.
    """
    held, total = [], 0
    for chunk in chunks():
        held.append(chunk)
        total += len(chunk[0])
        if total > HELD:
            break
    mate, owner = np.full(n, -1), np.full(m, -1)
    if total <= HELD:
        kept = _once(held) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        a, b, cost = kept
        for few in (CHEAPEST // 8, CHEAPEST // 2):
            few = _least(a, cost, few)
            _enlarged(_Links(n, a[few], b[few], cost[few]), mate, owner)
        chunks = list
    else:
        kept = _begun(m, chunks)
    held = []
    while True:
        a, b, cost = kept
        open_columns = _enlarged(_Links(n, a, b, cost), mate, owner)
        # 1: rows that may stay open and the columns they reach; 2: columns that may stay open and the rows they reach.
        rows, columns = np.zeros(n, np.int8), np.where(open_columns, 1, 0).astype(np.int8)
        rows[mate < 0], rows[owner[open_columns]] = 1, 1
        for side, reached in zip((rows, columns), _reached(_Links(m, b, a, cost), mate, owner)):
            side[reached] = 2
        more = []
        for a, b, cost in chunks():
            for part, end in ((1, a), (2, b)):
                at = np.flatnonzero((rows[a] == 1) & (columns[b] != 1) if part == 1 else (rows[a] != 2) & (columns[b] == 2))
                at = at[_least(end[at], cost[at], CHEAPEST)]
                more.append((a[at], b[at], cost[at]))
                # What the pairs reach counts at once, so that a scan finds more of them.
                if part == 1:
                    columns[b[at]] = 1
                    rows[owner[b[at]][owner[b[at]] >= 0]] = 1
                else:
                    rows[a[at]] = 2
                    columns[mate[a[at]][mate[a[at]] >= 0]] = 2
        if not sum(len(p[0]) for p in more):
            break
        kept = _once([kept, *more])
    found, u, v = np.full(n, -1), np.zeros(n), np.zeros(m)
    parts = {0, 1, 2}
    while parts:
        a, b, cost = kept
        for part in sorted(parts):
            on = (rows[a] == part) & (columns[b] == part)
            if not on.any():
                continue
            i, j = np.flatnonzero(rows == part), np.flatnonzero(columns == part)
            at = np.searchsorted(i, a[on]), np.searchsorted(j, b[on])
            if part == 1:
                to, v[j], u[i] = cheapest(len(j), len(i), at[1], at[0], cost[on])
                found[i] = -1
                found[i[to]] = j
            else:
                to, u[i], v[j] = cheapest(len(i), len(j), *at, cost[on])
                found[i] = j[to]
        more, parts = [], set()
        for a, b, cost in chunks():
            gain = cost - u[a] - v[b]
            at = np.flatnonzero((gain < -1e-11) & (rows[a] == columns[b]))
            if len(at):
                parts |= set(rows[a[at]].tolist())
                at = at[_least(a[at], gain[at], CHEAPEST)]
                more.append((a[at], b[at], cost[at]))
        if more:
            before = len(kept[0])
            kept = _once([kept, *more])
            if len(kept[0]) == before:
                # What is left is rounding: these pairs were at hand.
                break
    on = np.flatnonzero(found >= 0)
    a, b, cost = kept
    return on, found[on], cost[np.searchsorted(a * np.int64(m) + b, on * np.int64(m) + found[on])]
