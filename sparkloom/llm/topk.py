"""Exact top-k inner products: ball trees over shards, branch and bound.

Candidates are dealt into shards by their nearest pivot (large ones by the hash
of their id as well); a task builds a ball tree over its shard and streams the
queries past it.  A ball of centre c and radius r holds no inner product with q
above q.c + |q| r; balls below the query's current kth score are left out, the
others visited from the highest bound down.  Shards are balls too: in rounds,
each query goes to the shard of the highest bound, then to the next FAN, then to
the rest, each time only where the bound reaches its kth score so far.  Scores
that equal the bound stay in, so ties are broken by id among all candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, shuffle_partitions, small_table, stage, unit

#: Candidates of a shard at most (expected) and at least, where there are enough for all shuffle partitions; candidates of a leaf.
SHARD_ROWS, LEAST_ROWS, LEAF = 32_768, 512, 128
#: Pivots of a dimension at most, and vectors of the sample (expected number) in which they are found; any sample gives the same results.
PIVOTS, PIVOT_SAMPLE = 256, 4096
#: Shards of a query's second round.
FAN = 3
QUERIES_AT_ONCE = 512
NONE = np.iinfo(np.int64).max


class BallTree:
    """A balanced binary tree, level by level: centres, radii and the range of rows of each node; leaves are the last level."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.arange(len(ids))
        bounds = [np.array([0, len(ids)])]
        while np.diff(bounds[-1]).max(initial=0) > LEAF:
            cuts = [0]
            for a, b in zip(bounds[-1], bounds[-1][1:]):
                part = x[order[a:b]]
                # Split across the line between two distant rows.
                far = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                other = part[((part - far) ** 2).sum(axis=1).argmax()]
                side = part @ (far - other)
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(side, middle)] if b - a > 1 else order[a:b]
                cuts += [int(a) + middle, int(b)]
            bounds.append(np.array(cuts))
        self.ids, self.x, self.levels = ids[order], x[order], []
        for cut in bounds:
            centres = np.stack([self.x[a:b].mean(axis=0) if b > a else np.zeros(x.shape[1]) for a, b in zip(cut, cut[1:])])
            radii = np.array([math.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) if b > a else 0.0 for a, b, c in zip(cut, cut[1:], centres)])
            self.levels.append((centres, radii))
        self.leaves = bounds[-1]
        self.largest = float(np.abs(x).max(initial=0.0))

    def _leaf_bounds(self, q: np.ndarray, length: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """queries x leaves: the highest possible score, -inf where an ancestor's bound is below the query's kth score."""
        upper = np.full((len(q), 1), np.inf)
        for depth, (centres, radii) in enumerate(self.levels):
            if depth:
                upper = np.repeat(upper, 2, axis=1)
            open_rows = np.flatnonzero((upper > -np.inf).any(axis=1))
            own = np.full_like(upper, -np.inf)
            if len(open_rows):
                value = q[open_rows] @ centres.T + length[open_rows, None] * radii
                own[open_rows] = value + 1e-9 * (np.abs(value) + length[open_rows, None] * self.largest + 1)
            upper = np.minimum(upper, own)
            upper[upper < kth[:, None]] = -np.inf
        return upper

    def search(self, query_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best scores of at least kth (int64, -2^63: none) and their ids, best first, smaller ids first."""
        top = np.full((len(q), k), np.iinfo(np.int64).min)
        top_ids = np.full((len(q), k), NONE)
        kth = kth.astype(np.float64)
        length = np.sqrt((q * q).sum(axis=1))
        exact = float(np.abs(q).max(initial=0.0)) * self.largest * q.shape[1] < 2.0**52
        upper = self._leaf_bounds(q, length, kth)
        order = np.argsort(-upper, axis=1, kind="stable")
        for turn in range(order.shape[1]):
            leaf = order[:, turn]
            bound = upper[np.arange(len(q)), leaf]
            active = np.flatnonzero((bound > -np.inf) & (bound >= kth))
            if not len(active):
                break
            by_leaf = active[np.argsort(leaf[active], kind="stable")]
            for rows in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                a, b = self.leaves[leaf[rows[0]]], self.leaves[leaf[rows[0]] + 1]
                ids = self.ids[a:b]
                if exact:
                    scores = (q[rows] @ self.x[a:b].T).astype(np.int64)
                else:
                    wide = np.vectorize(int, otypes=[object])
                    product = wide(q[rows]) @ wide(self.x[a:b]).T
                    scores = np.vectorize(lambda v: max(-(1 << 63) + 1, min((1 << 63) - 1, v)), otypes=[np.int64])(product)
                use = (scores >= kth[rows, None]) & (ids != query_ids[rows, None])
                some = use.any(axis=1)
                if not some.any():
                    continue
                rows, scores, use = rows[some], scores[some], use[some]
                s = np.concatenate([top[rows], np.where(use, scores, np.iinfo(np.int64).min)], axis=1)
                i = np.concatenate([top_ids[rows], np.where(use, ids, NONE)], axis=1)
                best = np.lexsort((i, ~s), axis=1)[:, :k]
                top[rows], top_ids[rows] = np.take_along_axis(s, best, axis=1), np.take_along_axis(i, best, axis=1)
                full = top_ids[rows, -1] != NONE
                kth[rows[full]] = np.maximum(kth[rows[full]], top[rows[full], -1])
        return top, top_ids


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, as integers of 1/64."""
    flat = column.flatten() if isinstance(column, pa.Array) else pa.chunked_array([c.flatten() for c in column.chunks], pa.float64())
    return np.floor(64.0 * flat.to_numpy().astype(np.float64)).reshape(len(column), -1)


def _search(k: int):
    """Rows (shard, kind, id, kth, v) sorted by shard and kind (0: candidates first) -> query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            key = 2 * batch.column("shard").to_numpy() + batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            for a, b in zip(cuts, [*cuts[1:], len(key)]):
                part = batch.slice(a, b - a)
                if key[a] >> 1 != shard:
                    shard, held, tree = key[a] >> 1, [], None
                if not key[a] & 1:
                    held.append(part)
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    tree = BallTree(np.concatenate([x.column("id").to_numpy() for x in held]), _matrix(pa.chunked_array([x.column("v") for x in held])))
                    held = []
                for at in range(0, part.num_rows, QUERIES_AT_ONCE):
                    some = part.slice(at, QUERIES_AT_ONCE)
                    ids = some.column("id").to_numpy()
                    score, found = tree.search(ids, _matrix(some.column("v")), some.column("kth").to_numpy(), k)
                    there = found != NONE
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(axis=1))), pa.array(found[there]), pa.array(score[there])], ["query_id", "vec_id", "score"])

    return run


def _pivots(rows: DataFrame, sizes: dict[int, int], want: int) -> dict[int, np.ndarray]:
    """Pivots of each dimension: means of a sample's groups (k-means from farthest points)."""
    rates = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, PIVOT_SAMPLE / n))])
    sample = rows.where(unit(10_007, F.col("id")) < F.element_at(rates, F.col("dim"))).select("dim", "id", "v").toArrow()
    out = {}
    dims = sample.column("dim").to_numpy()
    for d, n in sizes.items():
        part = sample.filter(pa.array(dims == d))
        x = _matrix(part.column("v")) if part.num_rows else np.zeros((1, d))
        x = x[np.lexsort(x.T[::-1])]
        centres = [x.mean(axis=0)]
        far = ((x - centres[0]) ** 2).sum(axis=1)
        for _ in range(min(PIVOTS, max(1, n // LEAST_ROWS), want) - 1):
            centres.append(x[far.argmax()])
            far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        centres = np.stack(centres)
        for _ in range(5):
            near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
            centres = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        out[d] = centres
    return out


def _near_pivots(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows(id, v, dim, asks) + the nearest pivot's number and the distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.column("dim").unique().to_pylist():
                part = batch.filter(pc.equal(batch.column("dim"), d))
                x, centres = _matrix(part.column("v")), shared.value[d]
                near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
                dist = np.sqrt(((x - centres[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(dist)], [*part.schema.names, "pivot", "dist"])

    return rows.mapInArrow(run, "id bigint, v array<double>, dim int, asks boolean, pivot int, dist double")


class Balls:
    """The shards as balls, for routing: of each dimension their numbers, pivots and radii."""

    def __init__(self, pivots: dict[int, np.ndarray], shards: list[tuple[int, int, int, float]]):
        self.pivots, self.by_dim = pivots, {}
        for d in pivots:
            own = sorted((s, p, r) for s, dim, p, r in shards if dim == d)
            self.by_dim[d] = tuple(np.array(c) for c in zip(*own))

    def bounds(self, d: int, q: np.ndarray) -> np.ndarray:
        """queries x shards: the highest inner product that the shard can hold."""
        _, pivot, radius = self.by_dim[d]
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        value = (q @ self.pivots[d].T)[:, pivot]
        return value + length * radius + 1e-9 * (np.abs(value) + length * (radius + np.abs(self.pivots[d]).max(initial=0.0)) + 1)


def _routed(queries: DataFrame, balls: Balls, first: int, last: int | None) -> DataFrame:
    """queries(id, v, dim, kth) -> (shard, id, kth, v) for the shards from place `first` to before `last` in the order of bounds that reach kth."""
    shared = queries.sparkSession.sparkContext.broadcast(balls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.column("dim").unique().to_pylist():
                part = batch.filter(pc.equal(batch.column("dim"), d))
                for at in range(0, part.num_rows, QUERIES_AT_ONCE):
                    some = part.slice(at, QUERIES_AT_ONCE)
                    upper = shared.value.bounds(d, _matrix(some.column("v")))
                    order = np.argsort(-upper, axis=1, kind="stable")[:, first:last]
                    reach = np.take_along_axis(upper, order, axis=1) >= some.column("kth").to_numpy().astype(np.float64)[:, None]
                    query, place = np.nonzero(reach)
                    for cut in range(0, len(query), 16 * QUERIES_AT_ONCE):
                        rows = query[cut : cut + 16 * QUERIES_AT_ONCE]
                        to = shared.value.by_dim[d][0][order[rows, place[cut : cut + 16 * QUERIES_AT_ONCE]]]
                        sent = some.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), sent.column("id"), sent.column("kth"), sent.column("v")], ["shard", "id", "kth", "v"])

    return queries.select("id", "v", "dim", "kth").mapInArrow(run, "shard int, id bigint, kth bigint, v array<double>")


def _over_shards(candidates: DataFrame, asked: DataFrame, shards: int, parts: int, k: int) -> DataFrame:
    """Each shard is one partition's, of as few shards as there can be; shards that nothing asks stay away."""
    there = F.broadcast(asked.select("shard").distinct()) if shards <= 1 << 18 else asked.select("shard").distinct()
    both = candidates.join(there, "shard", "left_semi").select("shard", F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("kth"), "v")
    both = both.unionByName(asked.select("shard", F.lit(1).alias("kind"), "id", "kth", "v"))
    both = both.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "kind")
    return both.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: "F.Column", k: int = 20) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score: each query's k highest inner products of floor(64 * x).

    A query's own vec_id is no candidate of its; null ids, null vectors, empty
    ones and those with a null or non-finite component take no part.  Vectors
    of different lengths don't meet.  Scores beyond 64 bits are the largest or
    smallest of them.  Rows of one vec_id are candidates each; as queries they
    are one query only if equal, else their best scores are taken together.
    """
    spark = vectors.sparkSession
    good = F.expr("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))")
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim"), is_query.alias("asks"))
    rows = stage(rows, "vectors")
    sizes = {r.dim: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    want = shuffle_partitions(spark)
    pivots = _pivots(rows, sizes, want)
    rows = stage(_near_pivots(rows, pivots), "near")
    # Shards: each pivot's vectors, cut by the hash of the id where they are too many for one task.
    most = {d: max(LEAST_ROWS, min(SHARD_ROWS, math.ceil(n / want))) for d, n in sizes.items()}
    homes, n_shards = [], 0
    for dim, pivot, n in sorted(tuple(r) for r in rows.groupBy("dim", "pivot").agg(F.count("*")).collect()):
        cuts = math.ceil(n / most[dim])
        homes.append({"dim": dim, "pivot": pivot, "first": n_shards, "cuts": cuts})
        n_shards += cuts
    homes = small_table(spark, homes, "dim int, pivot int, first int, cuts int")
    placed = rows.join(F.broadcast(homes), ["dim", "pivot"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("cuts"))).cast("int"))
    candidates = placed.select("shard", "id", "v")
    balls = Balls(pivots, [tuple(r) for r in placed.groupBy("shard", "dim", "pivot").agg(F.max("dist")).collect()])
    queries = rows.where("asks").select("id", "v", "dim").dropDuplicates(["id", "v"])
    parts = min(n_shards, 16 * want)
    none = F.lit(-(1 << 63)).cast("long")
    found, cuts = None, [0, 1, 1 + FAN, None]
    for first, last in zip(cuts, cuts[1:]):
        if found is None:
            asked = queries.withColumn("kth", none)
        else:
            bounds = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
            asked = queries.join(bounds, "id", "left").withColumn("kth", F.coalesce("kth", none))
        if first < n_shards:
            asked = stage(_routed(asked, balls, first, last), "asked")
            new = _over_shards(candidates, asked, n_shards, parts, k)
            old = found.select("query_id", "vec_id", "score") if found is not None else None
            found = stage(_best(new if old is None else old.unionByName(new), k), "found")
            drop_staged(asked)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for each embedding whose vec_id is divisible by 20.

    Null vectors and those with null or non-finite components take no part; equal scores go by vec_id; rows of one vec_id are candidates
    each, and queries each where their vectors differ; fewer than 20 candidates are all returned; an empty table has no rows.
    """
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
