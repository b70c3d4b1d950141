"""Kymographs along polylines by B-splines of order 0 to 5, on tiled movies.

Samples lie along every segment, a pixel apart at most, on `width` parallel lines; each is worth the spline through the image's pixels
there, mirrored beyond the borders.  A sample goes to the tile that holds it; the tile's window is turned into spline coefficients by
the recursive filter, along its columns and then its rows.  What a window's border changes decays with the filter's pole, so a halo
of some pixels makes it equal to the whole image.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiled

#: The poles of the recursive filters by order (roots of the B-splines' sampled polynomials inside the unit circle).
POLES = {
    0: (), 1: (), 2: (math.sqrt(8) - 3,), 3: (math.sqrt(3) - 2,),
    4: (math.sqrt(664 - math.sqrt(438976)) + math.sqrt(304) - 19, math.sqrt(664 + math.sqrt(438976)) - math.sqrt(304) - 19),
    5: (math.sqrt(67.5 - math.sqrt(4436.25)) + math.sqrt(26.25) - 6.5, math.sqrt(67.5 + math.sqrt(4436.25)) - math.sqrt(26.25) - 6.5),
}
#: What a window's border may change at most, as a share of the values.
EXACT = 1e-13
#: Samples that a window's row holds, about.
PART = 8192


def halo_of(order: int) -> int:
    """Pixels around a tile that its samples need: the spline's support and the filter's memory."""
    memory = max((math.ceil(math.log(EXACT) / math.log(abs(z))) for z in POLES[order]), default=0)
    return memory + order // 2 + 2


def coefficients(window: np.ndarray, order: int) -> np.ndarray:
    """B-spline coefficients of an image mirrored at its borders."""
    out = window.astype(float).copy()
    for axis in (0, 1):
        c = np.moveaxis(out, axis, 0)
        n = len(c)
        for z in POLES[order]:
            c *= (1 - z) * (1 - 1 / z)
            k = np.arange(n)
            weights = (z ** (k + 1.0) + z ** (2.0 * n - k)) / (1 - z ** (2.0 * n))
            c[0] += np.tensordot(weights, c, axes=(0, 0))
            for i in range(1, n):
                c[i] += z * c[i - 1]
            c[n - 1] *= z / (z - 1)
            for i in range(n - 2, -1, -1):
                c[i] = z * (c[i + 1] - c[i])
    return out


def basis(order: int, x: np.ndarray) -> np.ndarray:
    """The centred B-spline of an order at x."""
    if order == 0:
        return ((x >= -0.5) & (x < 0.5)).astype(float)
    half = (order + 1) / 2
    total = sum((-1) ** k * math.comb(order + 1, k) * np.maximum(x + half - k, 0) ** order for k in range(order + 2))
    return total / math.factorial(order)


def sampled(c: np.ndarray, y: np.ndarray, x: np.ndarray, order: int) -> np.ndarray:
    """Values of the spline with these coefficients; the support of all places must lie inside."""
    shift = 0.5 if order % 2 == 0 else 0.0
    first = [np.floor(a + shift).astype(np.int64) - order // 2 for a in (y, x)]
    weights = [[basis(order, a - (f + j)) if order else np.ones(len(a)) for j in range(order + 1)] for a, f in zip((y, x), first)]
    out = np.zeros(len(y))
    for i in range(order + 1):
        for j in range(order + 1):
            out += weights[0][i] * weights[1][j] * c[first[0] + i, first[1] + j]
    return out


def _mirrored(c: Column, n: Column) -> Column:
    """The place inside the image, from -0.5 to n - 0.5, that holds the value of a place anywhere."""
    turned = F.pmod(c + 0.5, 2.0 * n)
    return F.when(turned < n, turned).otherwise(2.0 * n - turned) - 0.5


def samples(lines: DataFrame, width: int) -> DataFrame:
    """lines(file_id, line, pos, y, x), in pixels -> (file_id, line, pos, off, y, x): sample `pos` along the whole polyline on parallel line `off`.

    A segment of length l has ceil(l + 1) samples, both its ends among them; a polyline of one point has none.
    """
    w = Window.partitionBy("file_id", "line").orderBy("pos")
    d = [(F.lead(c).over(w) - F.col(c)).alias(f"d{c}") for c in ("y", "x")]
    seg = lines.select("file_id", "line", "pos", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), *d).where("dy is not null and dx is not null")
    seg = seg.withColumn("n", F.ceil(F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) + 1).cast("int"))
    seg = seg.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seg = seg.withColumn("turn", F.atan2("dy", "dx")).withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    seg = seg.withColumn("off", F.explode(F.array(*[F.lit(i) for i in range(width)])))
    t = F.coalesce(F.try_divide(F.col("i"), F.col("n") - 1), F.lit(0.0))
    aside = F.col("off") - (width - 1) / 2
    y = F.col("y") + t * F.col("dy") + aside * F.cos("turn")
    x = F.col("x") + t * F.col("dx") - aside * F.sin("turn")
    return seg.select("file_id", "line", (F.col("before") + F.col("i")).alias("pos"), "off", y.alias("y"), x.alias("x"))


def kymograph(tiles: DataFrame, lines: DataFrame, width: int = 1, order: int = 0) -> DataFrame:
    """tiles (see `tiled`), lines(file_id, line, pos, y, x) -> (file_id, line, frame, pos, v): each frame's profile along each line, averaged over `width` parallel lines.

    Missing pixels count as 0.  Only tiles that hold samples are read beyond the exchange of halos.
    """
    if order not in POLES:
        raise ValueError("order must be 0 to 5")
    halo = halo_of(order)
    sizes = tiles.groupBy("file_id").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"), F.max("step").alias("step"))
    # The planner takes the samples for as small as the table of lines that they are made of, so no side of these joins may be broadcast.
    at = samples(lines, width).join(sizes.hint("merge"), "file_id")
    at = at.withColumn("y", _mirrored(F.col("y"), F.col("rows"))).withColumn("x", _mirrored(F.col("x"), F.col("cols")))
    corner = [F.expr(f"cast(least(greatest(floor({a}), 0), {n} - 1) as int)") for a, n in (("y", "rows"), ("x", "cols"))]
    at = at.select("file_id", *[(c - F.pmod(c, F.col("step"))).cast("int").alias(f"{a}0") for c, a in zip(corner, ("y", "x"))], "line", "pos", "y", "x")
    # A tile's samples are dealt into parts of about PART, so that no row grows with the lines.
    here = F.count("*").over(Window.partitionBy("file_id", "y0", "x0"))
    at = at.withColumn("part", F.pmod(F.xxhash64("line", "pos"), F.ceil(here / PART)))
    listed = at.groupBy("file_id", "y0", "x0", "part").agg(F.collect_list(F.struct("line", "pos", "y", "x")).alias("samples"))
    wide = tiled.windows(tiles, halo).join(listed.hint("merge"), ["file_id", "y0", "x0"]).select(*tiled.TILE, "samples", "strips")
    kind = dict(lines.dtypes)["line"]
    schema = f"file_id {dict(tiles.dtypes)['file_id']}, line {kind}, frame {dict(tiles.dtypes)['frame']}, pos bigint, v double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.select(tiled.TILE).to_pylist()
            for i, (row, found, strips) in enumerate(zip(heads, batch.column("samples"), batch.column("strips"))):
                c = coefficients(np.nan_to_num(tiled.padded(row, strips, halo, "reflect")), order)
                p = found.values
                v = sampled(c, p.field("y").to_numpy() - row["y0"] + halo, p.field("x").to_numpy() - row["x0"] + halo, order)
                ids = [batch.column(k).take(pa.array(np.full(len(p), i))) for k in ("file_id", "frame")]
                yield pa.RecordBatch.from_arrays([ids[0], p.field("line"), ids[1], p.field("pos").cast(pa.int64()), pa.array(v)], ["file_id", "line", "frame", "pos", "v"])

    return wide.mapInArrow(run, schema).groupBy("file_id", "line", "frame", "pos").agg(F.avg("v").alias("v"))
