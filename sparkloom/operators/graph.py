"""Graphs: components, single linkage, matching, communities, line growth."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching, places, signals
from ..sources.staging import stage
from . import components as linked


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """nodes(keys, id), edges(keys, a, b) -> (keys, id, component): the smallest id reachable; nodes without edges are their own."""
    k = list(keys)
    found = linked.components(edges.select(*k, "a", "b"), k)
    return nodes.select(*k, "id").distinct().join(found, [*k, "id"], "left").select(*k, "id", F.coalesce("label", "id").alias("component"))


def group_features(members: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """members(keys, id, component, length), links(keys, a, b, dist, alignment) -> per component: size, link distances plus member lengths,
    and the alignments at all members over the size (a link counts at both ends)."""
    k = list(keys)
    inside = links.join(members.select(*k, F.col("id").alias("a"), "component"), [*k, "a"]).groupBy(*k, "component").agg(F.sum("dist").alias("dist"), F.sum("alignment").alias("al"))
    sizes = members.groupBy(*k, "component").agg(F.count("*").alias("size"), F.sum("length").alias("length"))
    out = sizes.join(inside, [*k, "component"], "left")
    return out.select(*k, "component", "size", (F.col("length") + F.coalesce("dist", F.lit(0.0))).alias("length"), (2 * F.coalesce("al", F.lit(0.0)) / F.col("size")).alias("alignment"))


def single_linkage(distances: DataFrame, nodes: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Clusters of single-linkage agglomeration cut at the threshold: components of pairs nearer than it."""
    return components(nodes, distances.where(F.col("d") < threshold), keys)


def linked_lines(points: DataFrame, keys: Sequence[str], line: str, threshold: float) -> DataFrame:
    """points(keys, line, y, x) -> (keys, id, component): single linkage of lines by their Hausdorff distances, cut at the threshold, without the table of all pairs.

    A key is one task.  Lines without a place have no row.
    """
    kind = dict(points.dtypes)
    present = F.col(line).isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    p = points.where(present).select(*keys, F.col(line).alias("__line"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))

    def run(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lines, code = np.unique(rows.column("__line").to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        y, x = (rows.column(c).to_numpy()[order] for c in ("y", "x"))
        found = places.linked_sets(code[order], y, x, threshold)
        ends = [pa.array(c, rows.schema.field("__line").type) for c in (lines, lines[found])]
        return pa.Table.from_arrays([*(pa.repeat(k, len(lines)) for k in name), *ends], [*keys, "id", "component"])

    schema = ", ".join(f"`{c}` {kind[c]}" for c in keys) + f", id {kind[line]}, component {kind[line]}"
    return p.groupBy(*keys).applyInArrow(run, schema)


def _agglomerated(pdf: pd.DataFrame, threshold: float, linkage: str) -> pd.DataFrame:
    ids = np.array(sorted(set(pdf["a"]) | set(pdf["b"])))
    place = {v: i for i, v in enumerate(ids)}
    d = np.full((len(ids), len(ids)), np.inf)
    for a, b, x in zip(pdf["a"], pdf["b"], pdf["d"]):
        d[place[a], place[b]] = d[place[b], place[a]] = x
    label, size = np.arange(len(ids)), np.ones(len(ids))
    # Each cluster's nearest one is kept, and looked for again only where that was merged.
    nearest = d.argmin(axis=1) if len(ids) else label
    least = d[label, nearest]
    while len(ids) > 1:
        i = int(least.argmin())
        if not least[i] < threshold:
            break
        i, j = sorted((i, int(nearest[i])))
        new = {"complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]), "single": np.minimum(d[i], d[j])}[linkage]
        d[i], d[:, i] = new, new
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        column = d[i]
        again = np.flatnonzero((nearest == i) | (nearest == j))
        nearest[(column < least) | ((column == least) & np.isfinite(column) & (i < nearest))] = i
        least = np.minimum(least, column)
        for k in {*again.tolist(), i, j}:
            nearest[k] = d[k].argmin()
            least[k] = d[k, nearest[k]]
    return pd.DataFrame({"id": ids, "cluster": ids[label]})


def agglomerated(distances: DataFrame, key: str, threshold: float, linkage: str) -> DataFrame:
    """distances(key, a, b, d) of all pairs of a key -> (key, id, cluster); linkage single, complete or average."""
    if linkage not in ("single", "complete", "average"):
        raise ValueError(linkage)
    kind = dict(distances.dtypes)

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _agglomerated(pdf, threshold, linkage)
        out.insert(0, key, group[0])
        return out

    return distances.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, id {kind['a']}, cluster {kind['a']}")


#: Pairs of each end that a matching begins with, its cheapest; of the others those are added that would make it cheaper.
CHEAPEST = 32


def matched(costs: DataFrame, key: str, forbidden: float = 1e6) -> DataFrame:
    """costs(key, a, b, cost) of allowed pairs -> the least-cost matching of a's and b's of each key, without forbidden pairs: as many pairs as can be, and of those matchings the cheapest.

    A key's matching is one task on the cheapest pairs of each end.  Its prices are then held against all pairs, on all tasks; pairs that
    are cheaper than the prices of their ends join in, until there are none, which proves the matching best among all pairs.
    `costs` is read once a round.
    """
    kind = dict(costs.dtypes)
    costs = costs.where(F.col("cost") < forbidden).select(key, "a", "b", F.col("cost").cast("double").alias("cost"))

    def cheapest(df: DataFrame, end: str, by: str) -> DataFrame:
        other = "b" if end == "a" else "a"
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(key, end).orderBy(by, other))).where(F.col("__n") <= CHEAPEST).select(key, "a", "b", "cost")

    def run(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby(["a", "b"], as_index=False)["cost"].min()
        (a, at_a), (b, at_b) = (np.unique(pdf[c], return_inverse=True) for c in ("a", "b"))
        mate, u, v = signals.sparse_matching(len(a), len(b), at_a, at_b, pdf["cost"].to_numpy(), forbidden)
        on = pd.Series(mate[at_a] == at_b)
        out = pd.concat([pdf[on.to_numpy()], pd.DataFrame({"a": a, "dual": u}), pd.DataFrame({"b": b, "dual": v})], ignore_index=True)
        out.insert(0, key, name[0])
        return out.astype({"a": object, "b": object}).where(out.notna(), None)

    schema = f"{key} {kind[key]}, a {kind['a']}, b {kind['b']}, cost double, dual double"
    kept = stage(cheapest(costs, "a", "cost").unionByName(cheapest(costs, "b", "cost")).distinct(), "pairs")
    while True:
        solved = stage(kept.groupBy(key).applyInPandas(run, schema), "matching")
        u, v = (solved.where(f"{o} is null").select(key, e, F.col("dual").alias(n)) for e, o, n in (("a", "b", "__u"), ("b", "a", "__v")))
        gain = F.col("cost") - F.col("__u") - F.col("__v")
        better = costs.join(u, [key, "a"]).join(v, [key, "b"]).withColumn("__gain", gain).where(F.col("__gain") < -1e-8)
        more = stage(cheapest(better, "a", "__gain").join(kept, [key, "a", "b", "cost"], "left_anti"), "pairs")
        if not more.limit(1).count():
            return solved.where("dual is null").select(key, "a", "b", "cost")
        kept = kept.unionByName(more)


#: Tasks over which keys are dealt; a number given is not lowered, however small the tables of points are.
KEY_TASKS = 256


def matched_near(points: DataFrame, keys: str | Sequence[str], id_col: str, d_max: float, cost: Callable | None = None, side: str | None = None) -> DataFrame:
    """points(keys, id, y, x, ...) -> (keys, a, b, cost): of each key the least-cost matching of points within d_max, as many pairs as can be, and of those matchings the cheapest.

    a's are points whose `side` is 0, b's those of another; without `side` each point is both, and none has itself.  A pair costs its
    distance, or what `cost(p, i, j, d)` gives for places i and j in the arrays of the key's columns p; infinite costs are not allowed.
    One key is one task, which holds its points and some pairs of each and finds the others from the places; no table of pairs is made.
    """
    k = [keys] if isinstance(keys, str) else list(keys)
    kind = dict(points.dtypes)
    fine = F.col(id_col).isNotNull()
    for c in k:
        fine = fine & F.col(c).isNotNull()
    for c in ("y", "x"):
        fine = fine & (F.abs(c) < float("inf"))
    p = points.where(fine).withColumns({c: F.col(c).cast("double") for c in ("y", "x")})

    def run(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(id_col, "ascending"), ("y", "ascending"), ("x", "ascending")])
        p = {c: rows.column(c).to_numpy() for c in rows.column_names if c not in k}
        ids, node = np.unique(p[id_col], return_inverse=True)
        left, right = (np.arange(len(node)),) * 2 if side is None else (np.flatnonzero(p[side] == 0), np.flatnonzero(p[side] != 0))

        def chunks() -> Iterator[matching.Pairs]:
            for i, j, d in places.near_pairs(p["y"][left], p["x"][left], p["y"][right], p["x"][right], d_max):
                i, j = left[i], right[j]
                c = d if cost is None else cost(p, i, j, d)
                on = (c < np.inf) & (node[i] != node[j])
                yield node[i[on]].astype(np.int32), node[j[on]].astype(np.int32), c[on]

        a, b, c = matching.best_matching(len(ids), len(ids), chunks)
        ends = [pa.array(ids[e], rows.schema.field(id_col).type) for e in (a, b)]
        return pa.Table.from_arrays([*(pa.repeat(v, len(a)) for v in name), *ends, pa.array(c, pa.float64())], [*k, "a", "b", "cost"])

    schema = ", ".join(f"`{c}` {kind[c]}" for c in k) + f", a {kind[id_col]}, b {kind[id_col]}, cost double"
    return p.repartition(KEY_TASKS, *k).groupBy(*k).applyInArrow(run, schema)


class Adjacency:
    """Links of nodes 0 ... n - 1 in arrays: `other` and `weight` of a node's links lie between its two bounds, by ascending neighbour; `loops` are links to itself.

    Twelve bytes a link and end, so that a key of some ten million links fits a worker.
    """

    def __init__(self, bounds: np.ndarray, other: np.ndarray, weight: np.ndarray, loops: np.ndarray):
        self.bounds, self.other, self.weight, self.loops = bounds, other, weight, loops
        self.strength = np.array([weight[i:j].sum() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]) + 2 * loops

    def __len__(self) -> int:
        return len(self.loops)

    @staticmethod
    def of(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> Adjacency:
        """From links in any order, which may repeat."""
        a, b, w = (np.asarray(x) for x in (a, b, w))
        loops = np.bincount(a[a == b], weights=w[a == b], minlength=n).astype(float)
        if len(a) and not ((a < b).all() and ((a[1:] > a[:-1]) | ((a[1:] == a[:-1]) & (b[1:] > b[:-1]))).all()):
            low, high, w = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], w[a != b]
            order = np.lexsort((high, low))
            a, b, w = _added_up(low[order], high[order], w[order])
        # Of a node the links to smaller neighbours come first.
        up, down = np.bincount(a, minlength=n), np.bincount(b, minlength=n)
        bounds = np.concatenate([[0], np.cumsum(up + down)])
        other, weight = np.empty(2 * len(a), np.int32), np.empty(2 * len(a))
        by_high = np.argsort(b, kind="stable")
        for ends, far, shift, order in ((b, a, bounds[:-1] - np.cumsum(down) + down, by_high), (a, b, bounds[:-1] + down - np.cumsum(up) + up, None)):
            for at in range(0, len(a), 1 << 20):
                part = slice(at, at + (1 << 20)) if order is None else order[at : at + (1 << 20)]
                here = ends[part]
                place = np.arange(at, at + len(here)) + shift[here]
                other[place], weight[place] = far[part], w[part]
        return Adjacency(bounds, other, weight, loops)

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.other[self.bounds[i] : self.bounds[i + 1]], self.weight[self.bounds[i] : self.bounds[i + 1]]

    def sums(self, group: np.ndarray, count: int) -> np.ndarray:
        """The weight of the links of each group with each node."""
        out = np.empty((count, len(self)))
        for i in range(len(self)):
            near, w = self.near(i)
            out[:, i] = np.bincount(group[near], weights=w, minlength=count)
        return out

    def contracted(self, group: np.ndarray) -> Adjacency:
        """The groups as nodes."""
        count = int(group.max()) + 1
        members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group, minlength=count))[:-1])
        loops = np.bincount(group, weights=self.loops, minlength=count)
        others, weights = [], []
        for p, nodes in enumerate(members):
            links = [self.near(i) for i in nodes.tolist()]
            found, x = _sums(group[np.concatenate([o for o, _ in links])], np.concatenate([v for _, v in links]), count)
            loops[p] += x[found == p].sum() / 2
            others.append(found[found != p].astype(np.int32))
            weights.append(x[found != p])
        bounds = np.concatenate([[0], np.cumsum([len(o) for o in others])])
        return Adjacency(bounds, np.concatenate(others), np.concatenate(weights), loops)


def _added_up(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted links, repeated ones as one of their summed weight."""
    if not len(a):
        return a, b, w
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return (a, b, w) if len(first) == len(a) else (a[first], b[first], np.add.reduceat(w, first))


def _sums(group: np.ndarray, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups that occur with some weight, ascending, and the sum of x of each."""
    if 32 * len(group) > count:
        sums = np.bincount(group, weights=x, minlength=count)
        found = np.flatnonzero(sums)
        return found, sums[found]
    found, at = np.unique(group, return_inverse=True)
    return found, np.bincount(at, weights=x, minlength=len(found))


#: Numbers held at once: of nodes by groups in moves and contraction, and of points by points in blocks.
TABLE, BLOCK = 1 << 24, 1 << 17


class PointLinks:
    """Links of nodes 0 ... n - 1 by their points, found from the places each time they are asked for.

    Two points of different nodes that lie within reach and whose angles' |cos| exceeds `cosine_min` are a link of weight distance / |cos|; several between two nodes add up.  Only the points are held, so that memory does not grow with the links.
    """

    #: Strips of a reach; a strip's points lie by ascending x.
    STRIPS = 4

    def __init__(self, n: int, node: np.ndarray, y: np.ndarray, x: np.ndarray, angle: np.ndarray, reach: float, cosine_min: float):
        self.n, self.reach, self.cosine_min = n, reach, cosine_min
        side = reach / self.STRIPS
        strip = np.floor(y / side)
        order = np.lexsort((x, strip))
        strip, self.node, self.angle = strip[order], node[order].astype(np.int32), angle[order]
        self.place = np.stack([y[order], x[order], np.cos(self.angle), np.sin(self.angle)])
        # Where the points that may be within reach of a point begin and end, in its own strip and those around it.
        first = np.flatnonzero(np.append(True, strip[1:] != strip[:-1])) if len(strip) else np.empty(0, np.int64)
        names, ends = strip[first], np.append(first, len(strip)).tolist()
        self.low, self.high = (np.zeros((len(strip), 2 * self.STRIPS + 1), np.int32) for _ in range(2))
        slack = 1e-9 * (reach + np.abs(self.place[0]) + np.abs(self.place[1]))
        for s, name in enumerate(names.tolist()):
            own = slice(ends[s], ends[s + 1])
            around = name + np.arange(-self.STRIPS, self.STRIPS + 1)
            at = np.searchsorted(names, around)
            for j in np.flatnonzero((at < len(names)) & np.append(True, around[1:] != around[:-1])).tolist():
                o = int(at[j])
                if names[o] != around[j]:
                    continue
                gap = np.maximum(0.0, np.maximum(names[o] * side - self.place[0, own], self.place[0, own] - (names[o] + 1) * side) - slack[own])
                half = np.sqrt(np.maximum(0.0, reach * reach - gap * gap)) + slack[own]
                there, here = self.place[1, ends[o] : ends[o + 1]], self.place[1, own]
                self.low[own, j] = ends[o] + np.searchsorted(there, here - half)
                self.high[own, j] = ends[o] + np.searchsorted(there, here + half, "right")
        self.points = np.argsort(self.node, kind="stable")
        self.bounds = np.searchsorted(self.node[self.points], np.arange(n + 1))
        self.strength = self.sums(np.zeros(n, np.int64), 1)[0]

    def __len__(self) -> int:
        return self.n

    def _weights(self, rows: np.ndarray, place: np.ndarray, angle: np.ndarray) -> np.ndarray:
        """Weights of the links of points with the places, rows by places; zero where there is none."""
        y, x = (place[i] - self.place[i, rows, None] for i in (0, 1))
        y *= y
        x *= x
        y += x
        np.sqrt(y, out=y)
        c = np.matmul(self.place[2:, rows].T, place[2:], out=x)
        np.abs(c, out=c)
        there = c > self.cosine_min + 1e-12
        close = c > self.cosine_min - 1e-12
        if np.count_nonzero(close) > np.count_nonzero(there):
            # Rounding may have put these on the other side: they are taken from the difference of the angles.
            r, k = np.nonzero(close & ~there)
            c[r, k] = np.abs(np.cos(self.angle[rows[r]] - angle[k]))
            there[r, k] = c[r, k] > self.cosine_min
        there &= y <= self.reach
        far = np.logical_not(there, out=close)
        np.putmask(c, far, 1.0)
        y /= c
        np.putmask(y, far, 0.0)
        return y

    def linked(self) -> np.ndarray:
        """Whether a node has links."""
        out = self.strength > 0
        for i in np.flatnonzero(~out).tolist():
            out[i] = len(self.near(i)[0]) > 0
        return out

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes linked with a node and the weights; a node comes as often as there are links to it."""
        nodes, weights = [], []
        for p in self.points[self.bounds[i] : self.bounds[i + 1]].tolist():
            parts = [slice(a, b) for a, b in zip(self.low[p].tolist(), self.high[p].tolist()) if a < b]
            y, x, c, s = np.concatenate([self.place[:, q] for q in parts], axis=1)
            node = np.concatenate([self.node[q] for q in parts])
            py, px, pc, ps = self.place[:, p].tolist()
            y -= py
            x -= px
            y *= y
            x *= x
            y += x
            np.sqrt(y, out=y)
            c *= pc
            s *= ps
            c += s
            np.abs(c, out=c)
            ok = (y <= self.reach) & (c > self.cosine_min - 1e-12) & (node != i)
            y, c, node = y[ok], c[ok], node[ok]
            if len(c) and c.min() < self.cosine_min + 1e-12:
                angle = np.concatenate([self.angle[q] for q in parts])[ok]
                c = np.where(c < self.cosine_min + 1e-12, np.abs(np.cos(self.angle[p] - angle)), c)
                ok = c > self.cosine_min
                y, c, node = y[ok], c[ok], node[ok]
            nodes.append(node)
            weights.append(y / c)
        return (nodes[0], weights[0]) if len(nodes) == 1 else (np.concatenate(nodes), np.concatenate(weights))

    def _blocks(self, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Nodes of points that lie together, the groups within their reach, and the weights of their links to those."""
        size = np.cumsum((self.high - self.low).sum(axis=1, dtype=np.int64))
        at = 0
        while at < len(self.node):
            end = min(at + 32, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK))))
            rows = np.arange(at, end)
            # The rows' ranges, as one where they overlap.
            low, high = self.low[rows].ravel(), self.high[rows].ravel()
            order = np.argsort(low, kind="stable")
            low, high = low[order][high[order] > low[order]], high[order][high[order] > low[order]]
            reached = np.maximum.accumulate(high)
            new = np.flatnonzero(np.append(True, low[1:] > reached[:-1]))
            last = np.append(new[1:], len(low)) - 1
            found = np.concatenate([np.arange(a, b) for a, b in zip(low[new].tolist(), reached[last].tolist())])
            of = group[self.node[found]]
            order = np.argsort(of, kind="stable")
            found, of = found[order], of[order]
            w = self._weights(rows, self.place[:, found], self.angle[found])
            np.putmask(w, self.node[rows, None] == self.node[None, found], 0.0)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            yield self.node[rows], of[first], np.add.reduceat(w, first, axis=1)
            at = end

    def sums(self, group: np.ndarray, count: int) -> np.ndarray:
        """The weight of the links of each group with each node."""
        out = np.zeros((count, self.n))
        for nodes, groups, w in self._blocks(group):
            np.add.at(out, (groups[None], nodes[:, None]), w)
        return out

    def contracted(self, group: np.ndarray) -> Adjacency:
        """The groups as nodes."""
        count = int(group.max()) + 1
        if count * count <= TABLE:
            table = np.zeros((count, count))
            for nodes, groups, w in self._blocks(group):
                np.add.at(table, (group[nodes][:, None], groups[None]), w)
            rows = iter(table)
        else:
            members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group, minlength=count))[:-1])
            rows = (sum(np.bincount(group[o], weights=w, minlength=count) for o, w in map(self.near, nodes.tolist())) for nodes in members)
        loops, others, weights = np.zeros(count), [], []
        for p, row in enumerate(rows):
            loops[p], row[p] = row[p] / 2, 0.0
            others.append(np.flatnonzero(row).astype(np.int32))
            weights.append(row[others[-1]])
        return Adjacency(np.concatenate([[0], np.cumsum([len(o) for o in others])]), np.concatenate(others), np.concatenate(weights), loops)


def modularity_communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, seed: int) -> np.ndarray:
    """Communities by passes of local moves, refinement and contraction until a pass changes nothing; order of moves by the seed.

    At the end each community is connected and no node's move raises modularity.
    """
    return _communities(Adjacency.of(n, a, b, w), resolution, seed)


def _communities(links: Adjacency | PointLinks, resolution: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    total = float(links.strength.sum())
    group = np.arange(len(links))
    while total > 0:
        new = _pass(links, group, resolution, total, rng)
        if (new == group).all():
            break
        group = new
    return group


def _pass(links: Adjacency | PointLinks, start: np.ndarray, resolution: float, total: float, rng: np.random.Generator) -> np.ndarray:
    """One pass from the groups of `start`; groups are numbered in the order of their first nodes.

    Before each contraction every community is refined: its nodes start alone
    and join, in that community only, the neighbour group that raises
    modularity most.  Refined groups are contracted, and start the next round
    in their community.
    """
    first_links, group, member = links, start.copy(), np.arange(len(links))
    while True:
        size, strength = len(links), links.strength

        def best_group(i: int, groups: np.ndarray, mass: np.ndarray, inside: np.ndarray | None = None) -> int:
            """The neighbouring group whose share of modularity with node i is highest; its own on ties."""
            own = groups[i]
            near, x = links.near(i)
            if inside is not None:
                here = inside[near] == inside[i]
                near, x = near[here], x[here]
            found, x = _sums(groups[near], x, len(mass))
            gain = x - resolution * strength[i] * (mass[found] - np.where(found == own, strength[i], 0.0)) / total
            at = int(np.searchsorted(found, own))
            stays = gain[at] if at < len(found) and found[at] == own else -resolution * strength[i] * (mass[own] - strength[i]) / total
            best = int(gain.argmax()) if len(found) else 0
            return int(found[best]) if len(found) and gain[best] > stays + 1e-12 * (1 + strength[i]) else int(own)

        moved = True
        while moved:
            _, group = np.unique(group, return_inverse=True)
            mass = np.bincount(group, weights=strength)
            if size * len(mass) <= TABLE:
                _settled(links, group, mass, resolution, total, rng)
                break
            moved = False
            for i in rng.permutation(size).tolist():
                best = best_group(i, group, mass)
                if best != group[i]:
                    mass[group[i]] -= strength[i]
                    mass[best] += strength[i]
                    group[i], moved = best, True
        refined, mass = np.arange(size), strength.copy()
        alone = np.ones(size, dtype=bool)
        for i in rng.permutation(size).tolist():
            if alone[i]:
                best = best_group(i, refined, mass, group)
                if best != refined[i]:
                    mass[refined[i]] -= strength[i]
                    mass[best] += strength[i]
                    alone[[i, best]] = False
                    refined[i] = best
        _, refined = np.unique(refined, return_inverse=True)
        count = int(refined.max()) + 1
        if count == size:
            return _connected(first_links, group[member])
        member = refined[member]
        new_group = np.zeros(count, dtype=np.int64)
        new_group[refined] = group
        _, group = np.unique(new_group, return_inverse=True)
        links = links.contracted(refined)


def _settled(links: Adjacency | PointLinks, group: np.ndarray, mass: np.ndarray, resolution: float, total: float, rng: np.random.Generator) -> None:
    """Moves nodes between the groups until no move to a neighbouring one raises modularity.

    The weights of each node's links to all groups are held, and only nodes that would move are visited; a move costs the node's links.
    """
    strength = links.strength
    held = links.sums(group, len(mass))

    def gains(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best group of nodes and what the move there adds."""
        own, at, x = group[i], np.arange(len(i)), held[:, i]
        gain = x - mass[:, None] * (resolution * strength[i] / total)
        stays = gain[own, at] + resolution * strength[i] ** 2 / total
        # Sums that links were taken from keep a rest of rounding, which is no neighbour.
        gain[x <= 1e-9 * strength[i]] = -np.inf
        gain[own, at] = stays
        best = gain.argmax(axis=0)
        return best, gain[best, at] - stays - 1e-12 * (1 + strength[i])

    step = max(1, BLOCK // max(len(mass), 1))
    while True:
        ready = np.concatenate([np.empty(0, np.int64), *(at + np.flatnonzero(gains(np.arange(at, min(at + step, len(group))))[1] > 0) for at in range(0, len(group), step))])
        if not len(ready):
            return
        for i in rng.permutation(ready).tolist():
            best, more = gains(np.array([i]))
            if more[0] > 0:
                old, new = group[i], int(best[0])
                mass[old] -= strength[i]
                mass[new] += strength[i]
                group[i] = new
                near, w = links.near(i)
                np.subtract.at(held[old], near, w)
                np.add.at(held[new], near, w)


def _connected(links: Adjacency | PointLinks, group: np.ndarray) -> np.ndarray:
    """Groups cut into their connected parts, which never lowers modularity."""
    part, left = np.full(len(links), -1), np.bincount(group).tolist()
    for start in range(len(links)):
        if part[start] < 0:
            own = int(group[start])
            part[start], waiting, left[own] = start, [start], left[own] - 1
            while waiting and left[own]:
                near = links.near(waiting.pop())[0]
                near = np.unique(near[(part[near] < 0) & (group[near] == own)])
                part[near] = start
                left[own] -= len(near)
                waiting += near.tolist()
    return np.unique(part, return_inverse=True)[1]


def communities(edges: DataFrame, keys: str | Sequence[str], resolution: float = 0.06, seed: int = 42) -> DataFrame:
    """edges(keys, a, b, weight) -> (keys, id, community): the community's smallest id; nodes without edges have no row.

    One key is one task, which reads its edges, sorted by Spark, batch by batch into arrays.
    """
    k = [keys] if isinstance(keys, str) else list(keys)
    kind = dict(edges.dtypes)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[list] = [[], [], []]
        for batch in batches:
            for held, x in zip(ends, _added_up(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "weight")))):
                held.append(np.array(x))
        ids = np.unique(np.concatenate([np.unique(x) for x in (*ends[0], *ends[1])]))
        coded = [np.concatenate([np.searchsorted(ids, ends[e].pop(0)).astype(np.int32) for _ in range(len(ends[e]))]) for e in (0, 1)]
        found = modularity_communities(len(ids), *coded, np.concatenate(ends.pop()).astype(float), resolution, seed)
        first = pd.Series(ids).groupby(found).transform("min")
        columns = [pa.array([x.as_py()] * len(ids), x.type) for x in key] + [pa.array(ids), pa.array(first.to_numpy())]
        yield pa.RecordBatch.from_arrays(columns, [*k, "id", "community"])

    ordered = edges.where("a is not null and b is not null").select(*k, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight"))
    ordered = ordered.repartition(*k).sortWithinPartitions(*k, "a", "b", "weight")
    return ordered.groupBy(*k).applyInArrow(run, ", ".join(f"{c} {kind[c]}" for c in k) + f", id {kind['a']}, community {kind['a']}")


def near_communities(points: DataFrame, keys: str | Sequence[str], id_col: str, d_max: float, cosine_min: float, resolution: float = 0.06, seed: int = 42) -> DataFrame:
    """points(keys, id, y, x, angle), several of an id or one -> (keys, id, community): as `communities` of the links that `spatial.cosine_edges` finds between points of different ids, which add up.

    One key is one task, which holds its points and finds their links from the places; no table of links is made.
    """
    k = [keys] if isinstance(keys, str) else list(keys)
    kind = dict(points.dtypes)
    fine = F.col(id_col).isNotNull()
    for c in k:
        fine = fine & F.col(c).isNotNull()
    for c in ("y", "x", "angle"):
        fine = fine & (F.abs(c) < float("inf"))
    p = points.where(fine).select(*k, F.col(id_col).alias("__id"), *(F.col(c).cast("double").alias(c) for c in ("y", "x", "angle")))

    def run(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids, node = np.unique(rows.column("__id").to_numpy(), return_inverse=True)
        y, x, angle = (rows.column(c).to_numpy() for c in ("y", "x", "angle"))
        order = np.lexsort((angle, x, y, node))
        links = PointLinks(len(ids), node[order], y[order], x[order], angle[order], d_max, cosine_min)
        found = _communities(links, resolution, seed)
        linked = links.linked()
        first = np.full(int(found.max(initial=0)) + 1, len(ids))
        np.minimum.at(first, found, np.arange(len(ids)))
        ends = [pa.array(c[linked], rows.schema.field("__id").type) for c in (ids, ids[first[found]])]
        return pa.Table.from_arrays([*(pa.repeat(v, int(linked.sum())) for v in name), *ends], [*k, id_col, "community"])

    schema = ", ".join(f"`{c}` {kind[c]}" for c in (*k, id_col)) + f", community {kind[id_col]}"
    return p.repartition(KEY_TASKS, *k).groupBy(*k).applyInArrow(run, schema)


class Neighbourhood:
    """Points by square cells of side `reach` and, where those are full, of halved sides; those used up are left out until they are freed."""

    #: Points that a cell of the finest side holds on average, seen from a point, and the halvings at most.
    FULL, HALVINGS = 8, 12

    def __init__(self, y: np.ndarray, x: np.ndarray, reach: float):
        self.y, self.x, self.reach = y, x, reach
        self.free = np.ones(len(y), dtype=bool)
        fine = np.flatnonzero(np.isfinite(y) & np.isfinite(x))
        #: Sides and cells, the finest first.
        self.levels: list[tuple[float, dict[tuple[int, int], np.ndarray]]] = []
        for halved in range(self.HALVINGS + 1):
            side = reach / 2**halved
            cy, cx = np.floor(y[fine] / side).astype(np.int64), np.floor(x[fine] / side).astype(np.int64)
            order = np.lexsort((cx, cy))
            cy, cx = cy[order], cx[order]
            first = np.flatnonzero((np.diff(cy, prepend=cy[:1] - 1) != 0) | (np.diff(cx, prepend=cx[:1] - 1) != 0))
            parts = np.split(fine[order], first[1:])
            self.levels.insert(0, (side, dict(zip(zip(cy[first].tolist(), cx[first].tolist()), parts))))
            if not len(fine) or sum(len(p) ** 2 for p in parts) <= self.FULL * len(fine):
                break

    def nearest(self, y: float, x: float) -> int | None:
        """The nearest free point within reach, of equally near ones the first; None if there is none."""
        if not (np.isfinite(y) and np.isfinite(x)):
            return None
        for side, cells in self.levels:
            a, b = int(np.floor(y / side)), int(np.floor(x / side))
            found = [p for c in range(a - 1, a + 2) for d in range(b - 1, b + 2) if (p := cells.get((c, d))) is not None]
            if not found:
                continue
            at = np.concatenate(found)
            at = at[self.free[at]]
            if not len(at):
                continue
            d = np.hypot(self.y[at] - y, self.x[at] - x)
            least = d.min()
            # Nearer than a side, all as near lie in these cells; else the next coarser cells are asked.
            if least < side * (1 - 1e-9) or (side == self.reach and least <= side):
                return int(at[d == least].min())
        return None


def axial_mean_toward(angle: np.ndarray, heading: float) -> float:
    """Mean axis of angles, as the one of its two directions that is nearer to a heading: how a line goes on from its last vectors."""
    t = np.angle(np.exp(2j * angle).mean()) / 2
    return t + np.pi if np.cos(t - heading) < 0 else t


def grow_line(seed: int, y: np.ndarray, x: np.ndarray, angle: np.ndarray, length: np.ndarray, persistence: int, reach: float, near: Neighbourhood | None = None) -> list[int]:
    """Places of the vectors on a line from the seed: both ends step by their mean length along their mean axis to the nearest unused vector within reach."""
    near = near or Neighbourhood(y, x, reach)
    near.free[seed] = False
    # The seed and what follows it, and what comes before it from the seed on.
    back, front = [seed], []
    heading, open_ends = [angle[seed], angle[seed] + np.pi], [True, True]
    while any(open_ends):
        for side in (0, 1):
            if not open_ends[side]:
                continue
            own, other = (back, front) if side == 0 else (front, back)
            tail = own[-persistence:]
            tail = tail + other[: persistence - len(tail)]
            heading[side] = axial_mean_toward(angle[tail], heading[side])
            step = length[tail].mean()
            end = own[-1] if own else seed
            best = near.nearest(y[end] + np.sin(heading[side]) * step, x[end] + np.cos(heading[side]) * step)
            if best is None:
                open_ends[side] = False
                continue
            near.free[best] = False
            own.append(best)
    line = front[::-1] + back
    near.free[line] = True
    return line


def grown_lines(vectors: DataFrame, key: str, share: float = 0.1, persistence: int = 3, reach: float = 0.5, n_min: int = 4, seed: int = 0) -> DataFrame:
    """vectors(key, id, y, x, angle, len) -> lines(key, line, pos, id) of n_min vectors at least, from max(1, share * n) seeds a key.

    One key (a frame of a file) is one task.  A line never visits a vector
    twice, so closed rings end.
    """
    kind = dict(vectors.dtypes)

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, y, x, t, n = (pdf[c].to_numpy() for c in ("id", "y", "x", "angle", "len"))
        chosen = np.random.default_rng(seed).choice(len(ids), max(1, int(share * len(ids))), replace=False)
        rows, near = [], Neighbourhood(y, x, reach)
        for s in chosen:
            line = grow_line(int(s), y, x, t, n, persistence, reach, near)
            if len(line) >= n_min:
                rows += [(group[0], ids[s], p, ids[i]) for p, i in enumerate(line)]
        return pd.DataFrame(rows, columns=[key, "line", "pos", "id"])

    return vectors.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, line {kind['id']}, pos int, id {kind['id']}")
