"""Joins by distance: range pairs, nearest neighbours, Hausdorff distances, line features, profile sampling.

Distances never go through a cross join: points meet by grid cells of the
search radius, so a pair costs what its neighbourhood holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places
from ..functions.angles import signed_difference


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def _around(df: DataFrame, size: float) -> DataFrame:
    """Each row in its own cell and the eight around it."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    df = df.withColumn("__o", steps)
    return df.withColumn("__cy", _cell("y", size) + F.col("__o.a")).withColumn("__cx", _cell("x", size) + F.col("__o.b")).drop("__o")


def _distance(a: str, b: str) -> Column:
    dy, dx = F.col(f"{a}.y") - F.col(f"{b}.y"), F.col(f"{a}.x") - F.col(f"{b}.x")
    return F.sqrt(dy * dy + dx * dx)


def range_pairs(points: DataFrame, keys: Sequence[str], id_col: str, d_max: float, d_min: float = 0.0, extra: Sequence[str] = ()) -> DataFrame:
    """points(keys, id, y, x) -> unordered pairs (a < b) at a distance in [d_min, d_max]; extra columns come as a_..., b_..."""
    left = points.withColumn("__cy", _cell("y", d_max)).withColumn("__cx", _cell("x", d_max)).alias("a")
    right = _around(points, d_max).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "__cy", "__cx")]
    on.append(F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    pairs = left.join(right, condition).withColumn("dist", _distance("a", "b")).where(F.col("dist").between(d_min, d_max))
    more = [F.col(f"{s}.{e}").alias(f"{s}_{e}") for e in extra for s in ("a", "b")]
    return pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{id_col}").alias("a"), F.col(f"b.{id_col}").alias("b"), "dist", *more)


def cosine_edges(vectors: DataFrame, keys: Sequence[str], id_col: str, d_max: float, cosine_min: float) -> DataFrame:
    """Proximity edges of axes: pairs within d_max whose |cos| of the angles' difference exceeds cosine_min; weight = distance / |cos|."""
    pairs = range_pairs(vectors, keys, id_col, d_max, extra=["angle"])
    pairs = pairs.withColumn("cosine", F.abs(F.cos(F.col("a_angle") - F.col("b_angle")))).where(F.col("cosine") > cosine_min)
    return pairs.select(*keys, "a", "b", "dist", "cosine", (F.col("dist") / F.col("cosine")).alias("weight"))


def ends_of(vectors: DataFrame) -> DataFrame:
    """Both ends of each vector (y, x, angle, len): end 0 and 1, at half the length along (sin, cos)."""
    sign = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.lit(-0.5).alias("s")), F.struct(F.lit(1).alias("end"), F.lit(0.5).alias("s"))))
    df = vectors.withColumn("__e", sign)
    step = F.col("__e.s") * F.col("len")
    return df.select("*", F.col("__e.end").alias("end"), (F.col("y") + step * F.sin("angle")).alias("__y"), (F.col("x") + step * F.cos("angle")).alias("__x")).drop("y", "x", "__e").withColumnsRenamed({"__y": "y", "__x": "x"})


def nearest(points: DataFrame, keys: Sequence[str], id_col: str, limit: float) -> DataFrame:
    """Each point's nearest other point within `limit`, the smaller id of equals; points without one have no row.

    A cell of side `limit` and the eight around it are a group, in which blocks of points are compared by their boxes.
    """
    kind = dict(points.dtypes)
    place = (F.abs("y") < float("inf")) & (F.abs("x") < float("inf")) & F.col(id_col).isNotNull()
    for k in keys:
        place = place & F.col(k).isNotNull()
    around = _around(points.where(place).select(*keys, F.col(id_col).alias("__id"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")), limit)
    around = around.withColumn("__own", (_cell("y", limit) == F.col("__cy")) & (_cell("x", limit) == F.col("__cx")))
    out = [*keys, id_col, "neighbour", "dist"]

    def run(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids, code = np.unique(rows.column("__id").to_numpy(), return_inverse=True)
        y, x, own = (rows.column(c).to_numpy() for c in ("y", "x", "__own"))
        dist, other = places.nearest(y[own], x[own], y, x, limit, code[own], code)
        found = np.isfinite(dist)
        ends = [pa.array(ids[c], rows.schema.field("__id").type) for c in (code[own][found], other[found])]
        return pa.Table.from_arrays([*(pa.repeat(k, int(found.sum())) for k in name[: len(keys)]), *ends, pa.array(dist[found])], out)

    schema = ", ".join(f"`{c}` {kind[c]}" for c in (*keys, id_col)) + f", neighbour {kind[id_col]}, dist double"
    best = around.groupBy(*keys, "__cy", "__cx").applyInArrow(run, schema).groupBy(*keys, id_col).agg(F.min(F.struct("dist", "neighbour")).alias("m"))
    return best.select(*keys, id_col, "m.neighbour", "m.dist")


#: Points of a key from which on its lines are asked for in several tasks, and the tasks of a key at most.
POINTS_A_TASK, TASKS_A_KEY = 4096, 16


def hausdorff(points: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """points(keys, line, y, x) -> for each pair of lines a < b of a key the larger of the two directed Hausdorff distances.

    Each point's distance to every other line of its key is found, by blocks of near points.  The lines of a large key are dealt over
    tasks, each of which holds its lines and the key's points.
    """
    kind = dict(points.dtypes)
    present = F.col(line).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    p = points.where(present).select(*keys, F.col(line).alias("__line"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    sizes = p.groupBy(*keys).agg(F.least(F.lit(TASKS_A_KEY), 1 + F.expr(f"count(*) div {POINTS_A_TASK}")).cast("int").alias("__n"))
    dealt = p.join(sizes, list(keys)).withColumn("__own", F.pmod(F.xxhash64("__line"), F.col("__n")).cast("int")).withColumn("__task", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    dealt = dealt.select(*keys, "__task", "__line", "y", "x", (F.col("__own") == F.col("__task")).alias("__asked"))

    def run(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lines, code = np.unique(rows.column("__line").to_numpy(), return_inverse=True)
        y, x, asked = (rows.column(c).to_numpy() for c in ("y", "x", "__asked"))
        there = pc.and_(rows.column("y").is_valid(), rows.column("x").is_valid()).to_numpy()
        order = np.argsort(code, kind="stable")
        y, x, there, asked, code = (c[order] for c in (y, x, there, asked, code))
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        far: list[list] = [[], [], []]
        for b in np.flatnonzero(asked[first]).tolist():
            own = (code == b) & there
            d = np.full(len(y), -np.inf)
            if own.any():
                d[there] = places.to_set(y[there], x[there], y[own], x[own])
            others = np.flatnonzero(np.arange(len(lines)) != b)
            for held, c in zip(far, (others, np.full(len(others), b), np.maximum.reduceat(d, first)[others])):
                held.append(c)
        la, lb, d = (np.concatenate([np.empty(0, t), *held]) for t, held in zip((np.int64, np.int64, float), far))
        ends = [pa.array(lines[c], rows.schema.field("__line").type) for c in (la, lb)]
        return pa.Table.from_arrays([*(pa.repeat(k, len(d)) for k in name[: len(keys)]), *ends, pa.array(d, mask=d == -np.inf)], [*keys, "la", "lb", "d"])

    schema = ", ".join(f"`{c}` {kind[c]}" for c in keys) + f", la {kind[line]}, lb {kind[line]}, d double"
    directed = dealt.groupBy(*keys, "__task").applyInArrow(run, schema)
    both = directed.withColumn("a", F.least("la", "lb")).withColumn("b", F.greatest("la", "lb"))
    return both.groupBy(*keys, "a", "b").agg(F.max("d").alias("hausdorff"))


def straightness(points: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """1 - largest distance from the chord / chord; 1 for fewer than two points, 0 for a chord below 1e-9."""
    ends = points.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(F.struct("y", "x"), order).alias("p"), F.max_by(F.struct("y", "x"), order).alias("q"))
    df = points.join(ends, list(keys))
    dy, dx = F.col("q.y") - F.col("p.y"), F.col("q.x") - F.col("p.x")
    chord = F.sqrt(dy * dy + dx * dx)
    off = F.abs(dx * (F.col("y") - F.col("p.y")) - dy * (F.col("x") - F.col("p.x")))
    per = df.groupBy(*keys).agg(F.max("n").alias("n"), F.max(chord).alias("chord"), F.max(off).alias("off"))
    value = F.when(F.col("n") < 2, 1.0).when(F.col("chord") < 1e-9, 0.0).otherwise(1 - F.try_divide(F.try_divide("off", "chord"), F.col("chord")))
    return per.select(*keys, "n", value.alias("straightness"))


def bending(points: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Mean square of the wrapped turning angles; 0 for one segment or none."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = points.withColumn("dir", F.atan2(F.col("y") - F.lag("y").over(w), F.col("x") - F.lag("x").over(w)))
    df = df.withColumn("turn", signed_difference(F.col("dir"), F.lag("dir").over(w)))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.col("turn") * F.col("turn")), F.lit(0.0)).alias("bending"))


def line_features(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """lines(keys, pos, len, midline_len) -> number, length and statistics of lengths and midline lengths."""
    return lines.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("len").alias("length"), F.avg("len").alias("len_mean"), F.stddev_pop("len").alias("len_std"),
        F.avg("midline_len").alias("midline_mean"), F.stddev_pop("midline_len").alias("midline_std"), F.min("midline_len").alias("midline_min"),
    )


def sampled_profiles(lines: DataFrame, pixels: DataFrame, keys: Sequence[str], line: str, width: int) -> DataFrame:
    """lines(keys, line, y0, x0, y1, x1) and pixels(keys, y, x, v) -> profile(keys, line, pos, v): one sample a pixel of length,
    nearest pixel, averaged over `width` parallel lines; samples outside the image are missing."""
    length = F.sqrt(F.pow(F.col("y1") - F.col("y0"), 2) + F.pow(F.col("x1") - F.col("x0"), 2))
    df = lines.withColumn("__n", F.greatest(F.ceil(length).cast("int"), F.lit(1))).withColumn("__l", length)
    df = df.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("__n")))).withColumn("off", F.explode(F.array(*[F.lit(i - (width - 1) / 2) for i in range(width)])))
    t = F.col("pos") / F.col("__n")
    uy, ux = F.try_divide(F.col("y1") - F.col("y0"), F.col("__l")), F.try_divide(F.col("x1") - F.col("x0"), F.col("__l"))
    y = F.col("y0") + t * (F.col("y1") - F.col("y0")) + F.col("off") * F.coalesce(ux, F.lit(0.0))
    x = F.col("x0") + t * (F.col("x1") - F.col("x0")) - F.col("off") * F.coalesce(uy, F.lit(0.0))
    df = df.select(*keys, line, "pos", F.bround(y, 0).cast("int").alias("y"), F.bround(x, 0).cast("int").alias("x"))
    return df.join(pixels.select(*keys, "y", "x", "v"), [*keys, "y", "x"], "left").groupBy(*keys, line, "pos").agg(F.avg("v").alias("v"))


def kymograph(polyline: DataFrame, pixels: DataFrame, width: int) -> DataFrame:
    """polyline(line, pos, y, x) in pixels and pixels(frame, y, x, v) -> (line, frame, profile array): the width-averaged profile along the polyline of each frame."""
    w = Window.partitionBy("line").orderBy("pos")
    seg = polyline.select("line", "pos", F.col("y").alias("y0"), F.col("x").alias("x0"), F.lead("y").over(w).alias("y1"), F.lead("x").over(w).alias("x1")).where("y1 is not null")
    seg = seg.withColumnRenamed("pos", "seg").withColumn("__line", F.struct("line", "seg"))
    length = F.sqrt(F.pow(F.col("y1") - F.col("y0"), 2) + F.pow(F.col("x1") - F.col("x0"), 2))
    seg = seg.withColumn("__n", F.greatest(F.ceil(length).cast("int"), F.lit(1))).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    seg = seg.withColumn("off", F.explode(F.array(*[F.lit(i - (width - 1) / 2) for i in range(width)])))
    t = F.col("pos") / F.col("__n")
    uy, ux = F.coalesce(F.try_divide(F.col("y1") - F.col("y0"), length), F.lit(0.0)), F.coalesce(F.try_divide(F.col("x1") - F.col("x0"), length), F.lit(0.0))
    y = F.col("y0") + t * (F.col("y1") - F.col("y0")) + F.col("off") * ux
    x = F.col("x0") + t * (F.col("x1") - F.col("x0")) - F.col("off") * uy
    points = seg.select("line", "seg", "pos", F.bround(y, 0).cast("int").alias("y"), F.bround(x, 0).cast("int").alias("x"))
    means = points.join(pixels, ["y", "x"]).groupBy("line", "frame", "seg", "pos").agg(F.avg("v").alias("v"))
    return means.groupBy("line", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("seg", "pos", "v"))), lambda s: s["v"]).alias("profile"))
