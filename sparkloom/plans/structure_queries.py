"""Queries on tiles and on files: the structure chain, vectors, masks, profiles along lines, names, texts and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, pipelines, raster, spatial, structure, tables
from ..sources import files
from ..sources.staging import scratch_folder, stage
from .inputs import rounded, table
from .kernel_queries import _TILE, SIDE, _tiles

PIXEL = 0.12


def _drawn(tiles, value):
    """Tiles of the same frames with value(column number, lit pixel's value)."""
    pixels = F.transform("data", lambda v, i: value(i % SIDE, v))
    return tiles.select("file_id", "frame", "h", "w", pixels.alias("data"))


def _all_tiles(spark, sf):
    """Bars as bands; midlines between them in each row that has an order; angles along the rows; the strip between the outer edges as sarcomeres."""
    bars = stage(_tiles(spark, sf), "tiles")
    lit = F.transform("data", lambda v, i: F.exists(F.slice("data", (F.floor(i / SIDE) * SIDE).cast("int") + 1, SIDE), lambda x: x > 0.06))
    rows = bars.select("file_id", "frame", "h", "w", lit.alias("lit"))
    middle = rows.select("file_id", "frame", "h", "w", F.transform("lit", lambda v, i: F.when((i % SIDE).isin(13, 29, 45) & v, 1.0).otherwise(0.0)).alias("data"))
    flat = lambda x: _drawn(bars, lambda c, v: F.lit(x))
    return {
        "image": bars, "zbands": bars, "cell_mask": bars, "midlines": middle, "sine": flat(0.0), "cosine": flat(1.0),
        "sarcomere_mask": _drawn(bars, lambda c, v: F.when(c.between(4, 54), 1.0).otherwise(0.0)),
    }


def frame_structure(spark, sf):
    out = structure.structure(_all_tiles(spark, sf), PIXEL, (SIDE, SIDE), area_min=1.0, growth={"share": 0.2, "reach": 0.5, "n_min": 3})
    return rounded(out, *[f.name for f in out.schema if f.dataType.typeName() == "double"])


def extracted_vectors(spark, sf):
    t = _all_tiles(spark, sf)
    v = raster.extracted_vectors(t["midlines"], t["zbands"], raster.orientation_angles(t["sine"], t["cosine"]), PIXEL)
    return rounded(v, "y", "x", "angle", "len", "midline_len")


def band_mask(spark, sf):
    """Area of the bands above half of the highest value, as a share of the cell's, and the image's mean there."""
    px = raster.pixels(_tiles(spark, sf))
    z, cell = raster.mask_features(px, px, 0.5, PIXEL), raster.mask_features(px, px, 0.1, PIXEL)
    both = z.join(cell.select("file_id", "frame", F.col("area").alias("cell")), ["file_id", "frame"])
    return rounded(both.select("file_id", "frame", F.col("area").alias("z_mask_area"), F.try_divide("area", "cell").alias("z_mask_area_ratio"), F.col("intensity").alias("z_mask_intensity")), "z_mask_area", "z_mask_area_ratio", "z_mask_intensity")


def tile_kymograph(spark, sf):
    """The profile along row 20 of each tile, averaged over three rows."""
    px = raster.pixels(_tiles(spark, sf)).select(F.concat_ws("/", "file_id", "frame").alias("frame"), "y", "x", "v")
    line = spark.range(1).select(F.lit(0).alias("line"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit(20.0).alias("y"), F.lit(0.0).alias("x")), F.struct(F.lit(1).alias("pos"), F.lit(20.0).alias("y"), F.lit(float(SIDE - 1)).alias("x")))).alias("p"))
    k = spatial.kymograph(line.select("line", "p.pos", "p.y", "p.x"), px, 3)
    return rounded(k.select("frame", F.posexplode("profile").alias("place", "v")).withColumn("place", F.col("place").cast("long")), "v")


def smoothed_tiles(spark, sf):
    """Medians of three by three pixels, summed a frame."""
    t = raster.nan_median(_tiles(spark, sf), 3)
    return rounded(t.select("file_id", "frame", F.aggregate("data", F.lit(0.0), lambda a, v: a + v).alias("total")), "total")


def grown_line_shapes(spark, sf):
    """Lines grown through the extracted vectors, with their shapes."""
    v = extracted_vectors(spark, sf).withColumn("k", F.concat_ws("/", "file_id", "frame"))
    v = stage(v, "vectors")
    lines = stage(graph.grown_lines(v.select("k", F.col("vec_id").alias("id"), "y", "x", "angle", "len"), "k", 0.2, 3, 0.5, 3), "lines")
    points = lines.join(v.select("k", F.col("vec_id").alias("id"), "y", "x"), ["k", "id"])
    shapes = spatial.straightness(points, ["k", "line"], "pos").join(spatial.bending(points, ["k", "line"], "pos"), ["k", "line"])
    return rounded(shapes, "straightness", "bending")


def file_names(spark, sf):
    o = table(spark, sf, "orders")
    path = F.concat(F.lit("/a/b/scan_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), "o_orderkey", F.lit(".ome.tif"))
    loi = files.loi_name(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") + 5, F.col("o_custkey") + 7, F.lit(3))
    return o.select("o_orderkey", files.base_name(path).alias("name"), files.date_in_name(path).cast("string").alias("day"), loi.alias("loi"))


def series_as_text(spark, sf):
    path = scratch_folder(spark)
    files.write_series(table(spark, sf, "orders"), path, "o_orderkey", "o_totalprice")
    return rounded(files.read_series(spark, path).select(F.col("frame").cast("long").alias("frame"), "y"), "y")


def exported_csv(spark, sf):
    path = scratch_folder(spark)
    n = table(spark, sf, "nation")
    files.export(n.select("n_nationkey", "n_name", F.array("n_regionkey", "n_nationkey").alias("pair")), path, "csv")
    return spark.read.option("header", "true").schema("n_nationkey bigint, n_name string, pair string").option("escape", '"').csv(path)


def flattened_cells(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.array(F.slice("embedding", 1, 3), F.slice("embedding", 4, 2)).alias("cells"))
    flat = tables.flattened(e).select("vec_id", F.posexplode("cells").alias("place", "v"))
    return rounded(flat.select("vec_id", F.col("place").cast("long").alias("place"), F.col("v").cast("double").alias("v")), "v")


def lines_by_fit(spark, sf):
    """Lines of interest as straight lines fitted through clusters of grown lines."""
    v = extracted_vectors(spark, sf).select(F.concat_ws("/", "file_id", "frame").alias("k"), F.col("vec_id").alias("id"), "y", "x", "angle", "len", "midline_len")
    out = pipelines.lines_of_interest(stage(v, "vectors"), "k", "fit_straight_line", 10, {"n": (3, 1000)}, 3.0, share=0.2, persistence=3, reach=0.5, n_min=3)
    return out.select("k", "cluster", "x0", "y0", "x1", "y1")


QUERIES = {
    f.__name__: f
    for f in (frame_structure, extracted_vectors, band_mask, tile_kymograph, smoothed_tiles, grown_line_shapes, file_names, series_as_text, exported_csv, flattened_cells, lines_by_fit)
}

_P = f"CAST({PIXEL} AS DOUBLE) * CAST({PIXEL} AS DOUBLE)"
ORACLE_SQL = {
    "band_mask": f"WITH {_TILE} SELECT file_id, frame, round(count(*) FILTER (v > 0.5) * {_P}, 6) AS z_mask_area, round(count(*) FILTER (v > 0.5) / count(*) FILTER (v > CAST(0.1 AS DOUBLE)), 6) AS z_mask_area_ratio, round(avg(v) FILTER (v > 0.5), 6) AS z_mask_intensity FROM px GROUP BY file_id, frame",
    "tile_kymograph": f"WITH {_TILE} SELECT file_id || '/' || frame AS frame, i % {SIDE} AS place, round(avg(v), 6) AS v FROM px WHERE i // {SIDE} BETWEEN 19 AND 21 AND i % {SIDE} < {SIDE - 1} GROUP BY ALL",
    "smoothed_tiles": f"WITH {_TILE}, m AS (SELECT a.file_id, a.frame, a.i, median(b.v) AS v FROM px a JOIN px b ON a.file_id = b.file_id AND a.frame = b.frame AND abs(a.i // {SIDE} - b.i // {SIDE}) <= 1 AND abs(a.i % {SIDE} - b.i % {SIDE}) <= 1 AND b.i BETWEEN a.i - {SIDE + 1} AND a.i + {SIDE + 1} GROUP BY ALL) SELECT file_id, frame, round(sum(v), 6) AS total FROM m GROUP BY ALL",
    "file_names": "SELECT o_orderkey, 'scan_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey || '.ome' AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey || '_' || o_custkey || '_' || (o_orderkey + 5) || '_' || (o_custkey + 7) || '_3_loi' AS loi FROM orders",
    "series_as_text": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS frame, round(o_totalprice, 6) AS y FROM orders",
    "exported_csv": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, '[' || n_regionkey || ',' || n_nationkey || ']' AS pair FROM nation",
    "flattened_cells": "SELECT vec_id, p AS place, round(CAST(embedding[p + 1] AS DOUBLE), 6) AS v FROM embeddings, range(0, 5) r(p)",
}
