"""Queries on tiled movies: kymographs by splines, filters on windows, wavelets, maps of vectors.

A movie is a file of 300 customers and a frame of it a year; an order lights a pixel by its price.  Movies, frames and lines grow with the tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import splines, tiled
from ..sources import tiff
from ..sources.staging import scratch_folder, stage
from .inputs import rounded, table

ROWS, COLS, STEP, PIXEL = 40, 56, 16, 0.12
SMOOTHING = tiled.gaussian(1.0)
WIDTH = 3


def _orders(spark, sf):
    """file_id, frame and place of each order."""
    o = table(spark, sf, "orders")
    place = [F.expr(f"cast(o_custkey % {ROWS} as int)").alias("y"), F.expr(f"cast(o_orderkey % {COLS} as int)").alias("x")]
    return o.select(F.expr("cast(o_custkey div 300 as int)").alias("file_id"), (F.year("o_orderdate") - 1992).alias("frame"), *place, "o_orderkey", "o_custkey", "o_totalprice")


def movies(spark, sf):
    """Tiles of all movies, and their frames with sizes."""
    o = _orders(spark, sf)
    px = o.groupBy("file_id", "frame", "y", "x").agg((F.sum("o_totalprice") / 1e3).alias("v"))
    frames = o.select("file_id", "frame").distinct().select("*", F.lit(ROWS).alias("rows"), F.lit(COLS).alias("cols"))
    return tiled.from_pixels(px, frames, STEP), frames


def drawn_lines(spark, sf):
    """A bent line for each supplier, through the movie of its number; its last point lies outside the image."""
    s = table(spark, sf, "supplier")
    points = [(F.expr(f"s_suppkey % {ROWS}"), 1.5), (F.col("s_nationkey") / 2 + 20, 28.25), (F.expr(f"{ROWS - 1} - s_suppkey % {ROWS}"), COLS + 1.0)]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), y.cast("double").alias("y"), F.lit(x).alias("x")) for i, (y, x) in enumerate(points)])
    return s.select(F.expr("cast(s_suppkey div 20 as int)").alias("file_id"), F.col("s_suppkey").alias("line"), F.explode(rows).alias("p")).select("file_id", "line", "p.*")


def _kymograph(order):
    def query(spark, sf):
        return rounded(splines.kymograph(movies(spark, sf)[0], drawn_lines(spark, sf), WIDTH, order), "v")

    return query


def tiled_convolution(spark, sf):
    """Gaussian smoothing of all movies, mirrored at the borders."""
    return rounded(tiled.to_pixels(tiled.convolved(movies(spark, sf)[0], SMOOTHING)), "v")


def tiled_medians(spark, sf):
    return rounded(tiled.to_pixels(tiled.medians(movies(spark, sf)[0], 3)), "v")


def tiled_wavelets(spark, sf):
    """Vectors of a double-wavelet scan of all movies."""
    return rounded(tiled.wavelet_vectors(movies(spark, sf)[0], PIXEL, (1.0, 1.6, 0.2), 30.0, width=0.2), "len", "angle", "score")


def drawn_vectors(spark, sf):
    """A vector for each order: its angle and weight by its price, its length by its number."""
    o = _orders(spark, sf)
    angle, weight = F.pmod(F.col("o_totalprice"), F.lit(3.14159)), 1 + F.expr("o_custkey % 3")
    return o.select("file_id", "frame", (F.col("y") + 0.5).alias("y"), (F.col("x") + 0.25).alias("x"), angle.alias("angle"), (3.0 + F.expr("o_orderkey % 7")).alias("len"), weight.cast("double").alias("weight"))


def vector_label_maps(spark, sf):
    """Directions and axes of all pixels under vectors."""
    found = tiled.label_maps(drawn_vectors(spark, sf), movies(spark, sf)[1])
    return rounded(found, "weight", "direction", "axis", "strength")


def vector_mask_area(spark, sf):
    """Pixels within two of a vector, and smoothed directions, a frame."""
    vectors, frames = drawn_vectors(spark, sf), movies(spark, sf)[1]
    # Read twice, for the mask and for the directions.
    labels = stage(tiled.label_maps(vectors, frames).select("file_id", "frame", "y", "x", "direction"), "labels")
    mask = tiled.vector_mask(labels, frames, STEP, 2)
    area = mask.groupBy("file_id", "frame").agg(F.sum(F.aggregate("data", F.lit(0.0), lambda a, v: a + v)).alias("area"))
    smooth = tiled.smoothed_directions(labels, frames, STEP).groupBy("file_id", "frame").agg(F.count("*").alias("labelled"), F.avg(F.sin(2 * F.col("direction"))).alias("s2"))
    return rounded(area.join(smooth, ["file_id", "frame"]), "s2")


def tiff_pages(spark, sf):
    """All movies written as TIFF files and read back: sums of the second to fourth page of each."""
    path = scratch_folder(spark)
    frames = tiled.whole(movies(spark, sf)[0]).withColumn("path", F.format_string("%d/movie.tif", "file_id"))
    tiff.write_pages(frames, path)
    pages = tiff.read_pages(spark, path).where("frame between 1 and 3")
    found = pages.select(F.regexp_extract("path", r"(\d+)/movie", 1).cast("int").alias("file_id"), "frame", F.aggregate("data", F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max("data").alias("most"))
    return rounded(found, "total", "most")


QUERIES = {f"kymograph_order_{n}": _kymograph(n) for n in range(6)} | {f.__name__: f for f in (tiled_convolution, tiled_medians, tiled_wavelets, vector_label_maps, vector_mask_area, tiff_pages)}

_MOVIE = (
    f"lit AS (SELECT CAST(o_custkey // 300 AS INTEGER) AS file_id, CAST(year(o_orderdate) - 1992 AS INTEGER) AS frame, o_custkey % {ROWS} AS y, o_orderkey % {COLS} AS x, sum(o_totalprice) / 1e3 AS v FROM orders GROUP BY ALL), "
    f"fr AS (SELECT DISTINCT file_id, frame FROM lit), px AS (SELECT file_id, frame, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, coalesce(v, 0.0) AS v FROM fr CROSS JOIN range(0, {ROWS}) a(gy) CROSS JOIN range(0, {COLS}) b(gx) LEFT JOIN lit ON lit.file_id = fr.file_id AND lit.frame = fr.frame AND lit.y = gy AND lit.x = gx)"
).replace("SELECT file_id, frame, CAST(gy", "SELECT fr.file_id, fr.frame, CAST(gy")


def _mirror(c: str, n: int) -> str:
    """A place of the image's mirror images, as a place of the image."""
    turned = f"((({c}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"(CASE WHEN {turned} < {n} THEN {turned} ELSE {2 * n - 1} - {turned} END)"


_SAMPLES = (
    f"pts AS (SELECT CAST(s_suppkey // 20 AS INTEGER) AS file_id, s_suppkey AS line, pos, CASE pos WHEN 0 THEN s_suppkey % {ROWS} WHEN 1 THEN s_nationkey / 2 + 20 ELSE {ROWS - 1} - s_suppkey % {ROWS} END AS y, CASE pos WHEN 0 THEN 1.5 WHEN 1 THEN 28.25 ELSE {COLS}.0 + 1 END::DOUBLE AS x FROM supplier, range(0, 3) r(pos)), "
    "sg AS (SELECT *, lead(y) OVER w - y AS dy, lead(x) OVER w - x AS dx FROM pts WINDOW w AS (PARTITION BY line ORDER BY pos)), "
    "sn AS (SELECT *, CAST(ceil(sqrt(dy * dy + dx * dx) + 1) AS BIGINT) AS n FROM sg WHERE dy IS NOT NULL), "
    "sb AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, atan2(dy, dx) AS turn FROM sn), "
    "si AS (SELECT *, unnest(range(n)) AS i FROM sb), "
    f"sm AS (SELECT file_id, line, CAST(before + i AS BIGINT) AS pos, y + CASE WHEN n > 1 THEN i / (n - 1) ELSE 0 END * dy + (o - 1) * cos(turn) AS y, x + CASE WHEN n > 1 THEN i / (n - 1) ELSE 0 END * dx - (o - 1) * sin(turn) AS x FROM si, range(0, {WIDTH}) r(o))"
)
_WEIGHTS = ", ".join(f"({i - len(SMOOTHING) // 2}, {j - len(SMOOTHING) // 2}, CAST({float(SMOOTHING[i, j])!r} AS DOUBLE))" for i, j in np.ndindex(*SMOOTHING.shape))
_CORNERS = f"cs AS (SELECT *, CAST(floor(y) AS BIGINT) + a AS cy, CAST(floor(x) AS BIGINT) + b AS cx, (1 - abs(y - floor(y) - a)) * (1 - abs(x - floor(x) - b)) AS w FROM sm, range(0, 2) p(a), range(0, 2) q(b)), cm AS (SELECT file_id, line, pos, w, {_mirror('cy', ROWS)} AS my, {_mirror('cx', COLS)} AS mx FROM cs)"
ORACLE_SQL = {
    "kymograph_order_0": f"WITH {_MOVIE}, {_SAMPLES}, nm AS (SELECT file_id, line, pos, {_mirror('CAST(floor(y + 0.5) AS BIGINT)', ROWS)} AS my, {_mirror('CAST(floor(x + 0.5) AS BIGINT)', COLS)} AS mx FROM sm) SELECT nm.file_id, line, frame, pos, round(avg(v), 6) AS v FROM nm JOIN px ON px.file_id = nm.file_id AND px.y = my AND px.x = mx GROUP BY ALL",
    "kymograph_order_1": f"WITH {_MOVIE}, {_SAMPLES}, {_CORNERS} SELECT cm.file_id, line, frame, pos, round(sum(w * v) / {WIDTH}, 6) AS v FROM cm JOIN px ON px.file_id = cm.file_id AND px.y = my AND px.x = mx GROUP BY ALL",
    "tiff_pages": f"WITH {_MOVIE}, n AS (SELECT file_id, frame, CAST(row_number() OVER (PARTITION BY file_id ORDER BY frame) - 1 AS INTEGER) AS page FROM fr) SELECT file_id, page AS frame, round(sum(v), 6) AS total, round(max(v), 6) AS most FROM px JOIN n USING (file_id, frame) WHERE page BETWEEN 1 AND 3 GROUP BY ALL",
    "tiled_convolution": f"WITH {_MOVIE}, k(a, b, w) AS (VALUES {_WEIGHTS}), s AS (SELECT file_id, frame, y, x, w, {_mirror('y - a', ROWS)} AS my, {_mirror('x - b', COLS)} AS mx FROM px, k) SELECT s.file_id, s.frame, s.y, s.x, round(sum(w * px.v), 6) AS v FROM s JOIN px ON px.file_id = s.file_id AND px.frame = s.frame AND px.y = my AND px.x = mx GROUP BY ALL",
    "tiled_medians": f"WITH {_MOVIE}, s AS (SELECT file_id, frame, y, x, y + a AS my, x + b AS mx FROM px, range(-1, 2) p(a), range(-1, 2) q(b)) SELECT s.file_id, s.frame, s.y, s.x, round(median(px.v), 6) AS v FROM s JOIN px ON px.file_id = s.file_id AND px.frame = s.frame AND px.y = my AND px.x = mx GROUP BY ALL",
}
