"""The structure of frames from tiles to one row a frame: cell mask, bands, vectors, lines, domains.

Tiles are tables (file_id, frame, h, w, data).  Lengths are in the unit of pixelsize.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from . import graph, pipelines, raster, spatial
from .pipelines import FRAME


def cell_features(cell_mask: DataFrame, image: DataFrame, pixelsize: float, threshold: float = 0.1) -> DataFrame:
    """Area of the cell mask, its share of the image and the image's mean inside, a frame."""
    f = raster.mask_features(raster.pixels(cell_mask), raster.pixels(image), threshold, pixelsize)
    return f.select(*FRAME, F.col("area").alias("cell_mask_area"), F.col("area_ratio").alias("cell_mask_area_ratio"), F.col("intensity").alias("cell_mask_intensity"))


def bands_and_ends(zbands: DataFrame, image: DataFrame, directions: DataFrame, pixelsize: float, threshold: float = 0.15, min_length: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Band maps, images and angle tiles -> bands(file_id, frame, band, length, straightness, intensity, orientation) and ends(file_id, frame, band, end, y, x, dir).

    A band is a region of the map above the threshold whose skeleton is
    min_length long at least; straightness is its share of its convex hull.  An
    end's direction is across the angle there, out of the band.  Bands whose
    skeleton has not two ends have none.
    """
    found = raster.segmented(zbands, threshold, image=image).where(F.col("length") * pixelsize >= min_length)
    found = stage(found.withColumnRenamed("label", "band"), "bands")
    bands = found.select(*FRAME, "band", (F.col("length") * pixelsize).alias("length"), F.try_divide("area", "convex_area").alias("straightness"), F.col("mean_intensity").alias("intensity"), "orientation")
    both = found.where("ends is not null").join(directions.select(*FRAME, "w", F.col("data").alias("a")), FRAME)
    at = F.transform("ends", lambda e: F.struct(e[0].alias("y"), e[1].alias("x"), F.get("a", e[0] * F.col("w") + e[1]).alias("a")))
    end = both.select(*FRAME, "band", "cy", "cx", F.posexplode(at).alias("end", "e"))
    across = F.col("e.a") + math.pi / 2
    out = F.atan2(F.col("e.y") - F.col("cy"), F.col("e.x") - F.col("cx"))
    across = F.when(F.cos(across - out) < 0, across + math.pi).otherwise(across)
    return bands, end.select(*FRAME, "band", "end", (F.col("e.y") * pixelsize).alias("y"), (F.col("e.x") * pixelsize).alias("x"), F.atan2(F.sin(across), F.cos(across)).alias("dir"))


def mask_area(tiles: DataFrame, pixelsize: float, threshold: float) -> DataFrame:
    """(file_id, frame, area): the area of each tile's pixels above the threshold."""
    above = F.size(F.filter("data", lambda v: v > threshold))
    return tiles.select(*FRAME, (above * pixelsize**2).alias("area"))


def line_features(vectors: DataFrame, pixelsize: float, shape: tuple[int, int], median: int = 5, **growth) -> DataFrame:
    """Lines grown through the vectors of each frame -> one row a frame: weighted lengths, straightness and bending of its lines."""
    key = F.to_json(F.struct(*FRAME))
    v = vectors.withColumn("k", key)
    grown = stage(graph.grown_lines(v.select("k", F.col("vec_id").alias("id"), "y", "x", "angle", "len"), "k", **growth), "lines")
    names = v.select("k", *FRAME).distinct()
    points = grown.join(v.select("k", F.col("vec_id").alias("id"), "y", "x"), ["k", "id"])
    shapes = spatial.straightness(points, ["k", "line"], "pos").join(spatial.bending(points, ["k", "line"], "pos"), ["k", "line"])
    own = shapes.groupBy("k").agg(
        F.avg("straightness").alias("myof_straightness_mean"), F.stddev_pop("straightness").alias("myof_straightness_std"),
        F.avg("bending").alias("myof_bending_mean"), F.stddev_pop("bending").alias("myof_bending_std"), F.count("*").alias("n_lines"),
    )
    lengths = raster.line_length_statistics(grown.join(names, "k").select(*FRAME, "line", "id"), vectors, shape, pixelsize, median)
    lengths = lengths.select(*FRAME, *[F.col(f"length_{s}").alias(f"myof_length_{s}") for s in ("mean", "std", "max")])
    return own.join(names, "k").drop("k").join(lengths, FRAME, "left")


def domain_features(vectors: DataFrame, pixelsize: float, shape: tuple[int, int], area_min: float = 20.0, **options) -> DataFrame:
    """Communities of the vectors of each frame -> one row a frame: domains, their areas and order."""
    members = pipelines.domains(vectors, **options).join(vectors, [*FRAME, "vec_id"])
    return raster.domain_features(members, shape, pixelsize, area_min).groupBy(*FRAME).agg(
        F.count("*").alias("n_domains"), F.avg("area").alias("domain_area_mean"), F.stddev_pop("area").alias("domain_area_std"), F.avg("oop").alias("domain_oop_mean"), F.stddev_pop("oop").alias("domain_oop_std")
    )


def structure(tiles: dict[str, DataFrame], pixelsize: float, shape: tuple[int, int], length_limits: tuple[float, float] = (1.0, 3.0), radius: int = 0, area_min: float = 20.0, growth: dict | None = None) -> DataFrame:
    """tiles: image, zbands, midlines, sine, cosine, cell_mask, sarcomere_mask -> one row a frame of image with the features of all stages.

    Areas of bands and sarcomeres are also given as shares of the cell mask's.
    A frame without bands, vectors, lines or domains has NULL there, and 0 as their numbers.
    """
    image, zbands = tiles["image"], tiles["zbands"]
    directions = stage(raster.orientation_angles(tiles["sine"], tiles["cosine"], radius), "directions")
    cell = cell_features(tiles["cell_mask"], image, pixelsize)
    z = raster.mask_features(raster.pixels(zbands), raster.pixels(image), 0.5, pixelsize).select(*FRAME, F.col("area").alias("z_mask_area"), F.col("intensity").alias("z_mask_intensity"))
    bands, ends = bands_and_ends(zbands, image, directions, pixelsize)
    links = stage(pipelines.band_links(ends), "links")
    vectors = stage(raster.extracted_vectors(tiles["midlines"], zbands, directions, pixelsize, length_limits), "vectors")
    sarcomeres = mask_area(tiles["sarcomere_mask"], pixelsize, 0.1).withColumnRenamed("area", "sarcomere_area")
    out = image.select(*FRAME)
    for part in (
        cell, z, pipelines.band_features(bands, links), pipelines.vector_features(vectors), sarcomeres,
        line_features(vectors, pixelsize, shape, **(growth or {})), domain_features(vectors, pixelsize, shape, area_min),
    ):
        out = out.join(part, FRAME, "left")
    out = out.withColumns({f"{c}_area_ratio": F.try_divide(f"{c}_area", "cell_mask_area") for c in ("z_mask", "sarcomere")})
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_zbands", "n_vectors", "n_mbands", "n_lines", "n_domains")})
