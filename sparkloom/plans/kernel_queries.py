"""Queries on numpy kernels: smoothing, peaks, spectra, tracking, matching, communities, images.  SQL has no counterpart; tests hold them against closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import graph, raster, signal, spatial
from .inputs import TRACES, rounded, table, traces, vectors
from .series_queries import DT, THRESHOLD


def savgol_velocity(spark, sf):
    smooth = signal.smoothed(traces(spark, sf), ["series"], "frame", "y", "smooth", 13, 5)
    return rounded(smooth.select("series", "frame", "smooth"), "smooth")


def low_pass(spark, sf):
    return rounded(signal.low_passed(traces(spark, sf), ["series"], "frame", "y", "low").select("series", "frame", "low"), "low")


def gap_fill_cubic(spark, sf):
    holes = traces(spark, sf).withColumn("y", F.when((F.col("frame") + F.col("series")) % 5 != 0, F.col("y")))
    return rounded(signal.filled(holes, ["series"], "frame", "y", "filled", 3).select("series", "frame", "filled"), "filled")


def _kymograph(spark, sf):
    rows = traces(spark, sf).groupBy(F.expr("series % 10").alias("loi"), "frame").agg(F.sort_array(F.collect_list(F.struct("series", "y"))).alias("r"))
    return rows.select("loi", "frame", F.transform("r", lambda x: x["y"]).alias("profile"), F.transform("r", lambda x: x["series"].cast("double")).alias("x_pos"))


def peaks(spark, sf):
    found = signal.detected_peaks(_kymograph(spark, sf), 0.2, 14.0, 5.0)
    return rounded(found.select("loi", "frame", F.posexplode("peaks").alias("place", "x")), "x")


def tracking(spark, sf):
    p = signal.detected_peaks(_kymograph(spark, sf), 0.2, 14.0, 5.0).select("loi", "frame", F.explode("peaks").alias("x"))
    return rounded(signal.tracked(p, "loi", 20.0, 10), "x")


def cwt_spectrum(spark, sf):
    df = traces(spark, sf).withColumn("state", (F.col("y") > THRESHOLD).cast("int"))
    spec = signal.spectrum(df, ["series"], "frame", "y", "state", DT, 20, 2.0, 20.0)
    return rounded(spec, "scale", "frequency", "magnitude")


def spectrum_peaks(spark, sf):
    df = traces(spark, sf).withColumn("state", (F.col("y") > THRESHOLD).cast("int"))
    spec = signal.spectrum(df, ["series"], "frame", "y", "state", DT, 20, 2.0, 20.0)
    return rounded(signal.spectrum_peaks(spec, ["series"], 0.2), "frequency_1", "magnitude_1", "frequency_2", "magnitude_2")


def assignment(spark, sf):
    v = vectors(spark, sf).select("grp", "id", "y", "x", (F.col("id") % 2).alias("odd"))
    return rounded(graph.matched_near(v, "grp", "id", 0.1, side="odd"), "cost")


def communities(spark, sf):
    return graph.near_communities(vectors(spark, sf), "grp", "id", 0.1, 0.65, 0.5)


def agglomeration(spark, sf):
    points = vectors(spark, sf).withColumn("line", F.col("id") % 5)
    return graph.agglomerated(spatial.hausdorff(points, ["grp"], "line").withColumnRenamed("hausdorff", "d"), "grp", 0.3, "average")


def line_growth(spark, sf):
    return graph.grown_lines(vectors(spark, sf), "grp", 0.5, 3, 0.1, 3)


SIDE = 64


def _tiles(spark, sf):
    """64 x 64 images of all orders: a file a priority, a frame a year; orders fall on four bars of three columns and light their pixels by their number."""
    x = 4 + 16 * (F.col("o_orderkey") % 4) + F.col("o_custkey") % 3
    i = (F.col("o_custkey") % SIDE * SIDE + x).cast("int")
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("file_id"), (F.year("o_orderdate") - 1990).alias("frame"), i.alias("i"))
    tile = o.groupBy("file_id", "frame", "i").agg(F.count("*").alias("n")).groupBy("file_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("lit"), F.max("n").alias("most"))
    value = lambda i: 0.05 + 0.95 * F.coalesce(F.try_element_at("lit", i), F.lit(0)) / F.col("most")
    return tile.select("file_id", "frame", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), value).alias("data"))


def image_regions(spark, sf):
    return rounded(raster.segmented(_tiles(spark, sf)).select("file_id", "frame", "label", "area", "perimeter", "convex_area", "feret", "mean_intensity", "length"), "area", "perimeter", "convex_area", "feret", "mean_intensity")


def cell_mask(spark, sf):
    px = raster.pixels(_tiles(spark, sf))
    return rounded(raster.mask_features(px, px, 0.1, 0.1).select("file_id", "frame", "area", "area_ratio", "intensity"), "area", "area_ratio", "intensity")


def clip_normalization(spark, sf):
    px = raster.clip_normalized(raster.pixels(_tiles(spark, sf)))
    return rounded(px.groupBy("file_id", "frame").agg(F.avg("v").alias("mean"), F.max("v").alias("high")), "mean", "high")


def wavelet_vectors(spark, sf):
    found = raster.wavelet_vectors(_tiles(spark, sf), 0.12, (1.6, 2.2, 0.1), 30.0)
    return rounded(found.groupBy("file_id", "frame", "len", "angle").agg(F.count("*").alias("n")), "len", "angle")


QUERIES = {
    f.__name__: f
    for f in (savgol_velocity, low_pass, gap_fill_cubic, peaks, tracking, cwt_spectrum, spectrum_peaks, assignment, communities, agglomeration, line_growth, image_regions, cell_mask, clip_normalization, wavelet_vectors)
}

_TILE = (
    f"lit AS (SELECT o_orderpriority AS file_id, CAST(year(o_orderdate) - 1990 AS INTEGER) AS frame, o_custkey % {SIDE} * {SIDE} + 4 + 16 * (o_orderkey % 4) + o_custkey % 3 AS i, count(*) AS n FROM orders GROUP BY ALL), "
    "tl AS (SELECT file_id, frame, max(n) AS most FROM lit GROUP BY ALL), "
    f"px AS (SELECT file_id, frame, i, CAST(0.05 AS DOUBLE) + CAST(0.95 AS DOUBLE) * coalesce(n, 0) / most AS v FROM tl CROSS JOIN range(0, {SIDE * SIDE}) r(i) LEFT JOIN lit USING (file_id, frame, i))"
)


def _smoothing_weights(window: int, order: int) -> str:
    """VALUES (place in the window, sample, weight) of the least-squares polynomial."""
    basis = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    hat = basis @ np.linalg.pinv(basis)
    return ", ".join(f"({r}, {j}, CAST({hat[r, j]!r} AS DOUBLE))" for r in range(window) for j in range(window)).replace("np.float64(", "(")


_SCALES = ", ".join(f"(CAST({float(x)!r} AS DOUBLE))" for x in np.geomspace(2.0, 20.0, 20))
# The transform as a sum over pairs of frames within reach of the wavelet.
_SPECTRUM = (
    f"{TRACES}, m AS (SELECT series, frame, y - avg(y) OVER (PARTITION BY series) AS d, y > {THRESHOLD} AS st FROM t), sc(scale) AS (VALUES {_SCALES}), "
    "c AS (SELECT a.series, scale, a.frame, abs(sum(b.d * exp(-pow((a.frame - b.frame) / scale, 2) / 2) * cos(5 * (a.frame - b.frame) / scale) / sqrt(scale))) AS mag "
    "FROM m a JOIN m b ON a.series = b.series CROSS JOIN sc WHERE a.st AND abs(a.frame - b.frame) <= ceil(4 * scale) GROUP BY ALL), "
    f"f AS (SELECT series, scale, 5 / (2 * pi() * scale * {DT}) AS frequency, avg(mag) AS magnitude FROM c GROUP BY ALL), "
    "z AS (SELECT u.series, sc.scale, "
    f"5 / (2 * pi() * sc.scale * {DT}) AS frequency, magnitude FROM (SELECT DISTINCT series FROM t) u CROSS JOIN sc LEFT JOIN f ON f.series = u.series AND f.scale = sc.scale)"
)
ORACLE_SQL = {
    "savgol_velocity": f"WITH {TRACES}, w(r, j, w) AS (VALUES {_smoothing_weights(13, 5)}), n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM t), p AS (SELECT *, CASE WHEN frame < 6 THEN 0 WHEN frame >= n - 6 THEN n - 13 ELSE frame - 6 END AS a FROM n) "
    "SELECT p.series, p.frame, round(CASE WHEN any_value(p.n) < 13 THEN any_value(p.y) ELSE sum(w.w * q.y) END, 6) AS smooth FROM p LEFT JOIN t q ON q.series = p.series AND p.n >= 13 AND q.frame BETWEEN p.a AND p.a + 12 LEFT JOIN w ON w.r = p.frame - p.a AND w.j = q.frame - p.a GROUP BY p.series, p.frame",
    "cwt_spectrum": f"WITH {_SPECTRUM} SELECT series, round(scale, 6) AS scale, round(frequency, 6) AS frequency, round(magnitude, 6) AS magnitude FROM z",
    "spectrum_peaks": f"WITH {_SPECTRUM}, e AS (SELECT series, arg_max(frequency, magnitude) FILTER (frequency < 0.2) AS f1, max(magnitude) FILTER (frequency < 0.2) AS m1, arg_max(frequency, magnitude) FILTER (frequency >= 0.2) AS f2, max(magnitude) FILTER (frequency >= 0.2) AS m2, min(frequency) FILTER (frequency >= 0.2) AS edge FROM z WHERE magnitude IS NOT NULL GROUP BY series) "
    "SELECT series, round(f1, 6) AS frequency_1, round(m1, 6) AS magnitude_1, round(CASE WHEN f2 > edge THEN f2 END, 6) AS frequency_2, round(CASE WHEN f2 > edge THEN m2 END, 6) AS magnitude_2 FROM e",
    "cell_mask": f"WITH {_TILE} SELECT file_id, frame, round(count(*) FILTER (v > CAST(0.1 AS DOUBLE)) * CAST(0.1 AS DOUBLE) * CAST(0.1 AS DOUBLE), 6) AS area, round(count(*) FILTER (v > CAST(0.1 AS DOUBLE)) / count(*), 6) AS area_ratio, round(avg(v) FILTER (v > CAST(0.1 AS DOUBLE)), 6) AS intensity FROM px GROUP BY file_id, frame",
    "clip_normalization": f"WITH {_TILE}, p AS (SELECT file_id, frame, min(v) AS a, quantile_cont(v, 0.9998) AS b FROM px GROUP BY file_id, frame) SELECT file_id, frame, round(avg(least(greatest((v - a) / (b - a), 0), 1)), 6) AS mean, round(max(least(greatest((v - a) / (b - a), 0), 1)), 6) AS high FROM px JOIN p USING (file_id, frame) GROUP BY file_id, frame",
}
