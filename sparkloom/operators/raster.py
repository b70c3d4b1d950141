"""Images as tiles: one image (key, map, frame) is one row with its pixels as an array; kernels run a row at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images

KEYS = "file_id string, frame int"


def _image(data, h: int, w: int) -> np.ndarray:
    return np.asarray(data, dtype=float).reshape(h, w)


def pixels(tiles: DataFrame) -> DataFrame:
    """tiles(file_id, frame, h, w, data) -> pixels(file_id, frame, y, x, v)."""
    p = tiles.select("file_id", "frame", "w", F.posexplode("data").alias("i", "v"))
    return p.select("file_id", "frame", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), F.pmod(F.col("i"), F.col("w")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def mask_features(mask: DataFrame, image: DataFrame, threshold: float, pixelsize: float) -> DataFrame:
    """Area of pixels above the threshold (strictly), its share of the image, and the image's mean there, a frame."""
    m = mask.withColumnRenamed("v", "m")
    joined = m.join(image, ["file_id", "frame", "y", "x"], "left")
    on = F.col("m") > threshold
    return joined.groupBy("file_id", "frame").agg(
        (F.count_if(on) * pixelsize**2).alias("area"), F.try_divide(F.count_if(on), F.count("*")).alias("area_ratio"), F.avg(F.when(on, F.col("v"))).alias("intensity")
    )


def clip_normalized(px: DataFrame, scope: str = "single", low: float = 0.0, high: float = 99.98) -> DataFrame:
    """v scaled to [0, 1] between two percentiles of each frame (single), of the first frame (first) or of all frames of a file (all)."""
    keys = ["file_id", "frame"] if scope == "single" else ["file_id"]
    if scope not in ("single", "first", "all"):
        raise ValueError(scope)
    base = px.join(px.groupBy("file_id").agg(F.min("frame").alias("frame")), ["file_id", "frame"]) if scope == "first" else px
    p = base.groupBy(*keys).agg(F.percentile("v", low / 100).alias("a"), F.percentile("v", high / 100).alias("b"))
    v = F.try_divide(F.col("v") - F.col("a"), F.col("b") - F.col("a"))
    return px.join(p, keys).withColumn("v", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).drop("a", "b")


def segmented(tiles: DataFrame, threshold: float = 0.15, min_area: float = 0.0, image: DataFrame | None = None) -> DataFrame:
    """Regions of each tile above the threshold: one row a region with its features; intensities are the tile's own, or those of image."""
    fields = "label int, area double, y0 int, x0 int, y1 int, x1 int, cy double, cx double, orientation double, perimeter double, convex_area double, feret double, mean_intensity double, length int, ends array<array<int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file_id", "frame", *[f.split()[0] for f in fields.split(", ")]]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                img = _image(r.raw, r.h, r.w)
                labels = images.label(_image(r.data, r.h, r.w) > threshold)
                skel = images.skeleton(labels > 0)
                lengths = np.bincount(labels[skel], minlength=labels.max() + 1)
                ends: dict[int, list] = {}
                for e in images.skeleton_ends(skel):
                    ends.setdefault(int(labels[tuple(e)]), []).append(e.tolist())
                for region in images.regions(labels, img):
                    if region["area"] >= min_area:
                        own = ends.get(region["label"], [])
                        rows.append({"file_id": r.file_id, "frame": r.frame, **region, "length": int(lengths[region["label"]]), "ends": own if len(own) == 2 else None})
            yield pd.DataFrame(rows, columns=names)

    both = tiles.withColumn("raw", F.col("data")) if image is None else tiles.join(image.select("file_id", "frame", F.col("data").alias("raw")), ["file_id", "frame"])
    return both.select("file_id", "frame", "h", "w", "data", "raw").mapInPandas(run, f"{KEYS}, {fields}")


def mapped(tiles: DataFrame, kernel) -> DataFrame:
    """tiles with data = kernel(image), for kernels that keep the shape."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf["data"] = [np.asarray(kernel(_image(d, h, w)), dtype=float).ravel().tolist() for d, h, w in zip(pdf["data"], pdf["h"], pdf["w"])]
            yield pdf

    return tiles.select("file_id", "frame", "h", "w", F.col("data").cast("array<double>").alias("data")).mapInPandas(run, f"{KEYS}, h int, w int, data array<double>")


def nan_median(tiles: DataFrame, size: int) -> DataFrame:
    return mapped(tiles, lambda x: images.nan_median_filter(x, size))


def phase_corrected(tiles: DataFrame, most: int) -> DataFrame:
    return mapped(tiles, lambda x: images.phase_corrected(x, most))


def holes_filled(tiles: DataFrame, most: int) -> DataFrame:
    return mapped(tiles, lambda x: images.filled_holes(x, most))


def orientation_angles(sine: DataFrame, cosine: DataFrame, radius: int = 0) -> DataFrame:
    """Two tile tables -> tiles of angles in [0, pi), on request smoothed."""
    both = sine.select("file_id", "frame", "h", "w", F.col("data").alias("s")).join(cosine.select("file_id", "frame", F.col("data").alias("c")), ["file_id", "frame"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [images.orientation_map(np.stack([_image(s, h, w), _image(c, h, w)]), radius).ravel().tolist() for s, c, h, w in zip(pdf["s"], pdf["c"], pdf["h"], pdf["w"])]
            yield pd.DataFrame({"file_id": pdf["file_id"], "frame": pdf["frame"], "h": pdf["h"], "w": pdf["w"], "data": data})

    return both.select("file_id", "frame", "h", "w", "s", "c").mapInPandas(run, f"{KEYS}, h int, w int, data array<double>")


def extracted_vectors(midlines: DataFrame, zbands: DataFrame, angles: DataFrame, pixelsize: float, limits: tuple[float, float] = (1.0, 3.0), threshold: float = 0.5, width: int = 1) -> DataFrame:
    """Tiles of midline mask, band map and angles -> vectors(file_id, frame, vec_id, y, x, angle, len, midline_id, midline_len).

    Each pixel of the midlines' skeletons gives a profile of the band map along
    its angle, 1.3 times the upper limit long; its band spacing is the length,
    and the position moves by minus the offset.  Pixels without spacing give none.
    """
    from ..functions.signals import band_spacing

    fields = "vec_id int, y double, x double, angle double, len double, midline_id int, midline_len double"
    both = midlines.select("file_id", "frame", "h", "w", F.col("data").alias("m")).join(zbands.select("file_id", "frame", F.col("data").alias("z")), ["file_id", "frame"]).join(angles.select("file_id", "frame", F.col("data").alias("a")), ["file_id", "frame"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                z, a = _image(r.z, r.h, r.w), _image(r.a, r.h, r.w)
                skel = images.skeleton(_image(r.m, r.h, r.w) > threshold)
                labels = images.label(skel)
                sizes = np.bincount(labels.ravel())
                reach = int(math.ceil(1.3 * limits[1] / 2 / pixelsize))
                steps, sides = np.arange(-reach, reach + 1), np.arange(width) - (width - 1) / 2
                for y, x in np.argwhere(skel):
                    t = a[y, x]
                    py = np.rint(y + steps[:, None] * math.sin(t) + sides[None] * math.cos(t)).astype(int)
                    px = np.rint(x + steps[:, None] * math.cos(t) - sides[None] * math.sin(t)).astype(int)
                    profile = z[np.clip(py, 0, r.h - 1), np.clip(px, 0, r.w - 1)].mean(axis=1)
                    gap, off = band_spacing(profile, pixelsize, limits)
                    if not math.isnan(gap):
                        k = int(labels[y, x])
                        rows.append((r.file_id, r.frame, len(rows), (y * pixelsize) - off * math.sin(t), (x * pixelsize) - off * math.cos(t), t, gap, k, float(sizes[k] * pixelsize)))
            yield pd.DataFrame(rows, columns=["file_id", "frame", "vec_id", "y", "x", "angle", "len", "midline_id", "midline_len"])

    return both.select("file_id", "frame", "h", "w", "m", "z", "a").mapInPandas(run, f"{KEYS}, {fields}")


def _per_frame(vectors: DataFrame, kernel, schema: str) -> DataFrame:
    return vectors.groupBy("file_id", "frame").applyInPandas(kernel, schema)


def vector_masks(vectors: DataFrame, shape: tuple[int, int], pixelsize: float, radius: float) -> DataFrame:
    """Tiles (0 or 1) of rasterised vectors, widened by a radius, a frame."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = images.vector_mask(shape, pdf["y"] / pixelsize, pdf["x"] / pixelsize, pdf["angle"], pdf["len"] / pixelsize, int(round(radius / pixelsize)))
        return pd.DataFrame([(*key, *shape, m.astype(float).ravel().tolist())], columns=["file_id", "frame", "h", "w", "data"])

    return _per_frame(vectors, run, f"{KEYS}, h int, w int, data array<double>")


def distance_maps(vectors: DataFrame, shape: tuple[int, int], pixelsize: float) -> DataFrame:
    """Tiles of the distance along vectors: 0 at their ends, 1 in the middle, NaN elsewhere."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = images.distance_map(shape, pdf["y"] / pixelsize, pdf["x"] / pixelsize, pdf["angle"], pdf["len"] / pixelsize)
        return pd.DataFrame([(*key, *shape, d.ravel().tolist())], columns=["file_id", "frame", "h", "w", "data"])

    return _per_frame(vectors, run, f"{KEYS}, h int, w int, data array<double>")


def line_length_statistics(lines: DataFrame, vectors: DataFrame, shape: tuple[int, int], pixelsize: float, size: int) -> DataFrame:
    """Each vector of each line drawn with its line's length, overlaps averaged, smoothed by a nan-median; mean and deviation with weights 1 / length, and the largest."""
    length = lines.join(vectors.select("file_id", "frame", F.col("vec_id").alias("id"), "len"), ["file_id", "frame", "id"]).groupBy("file_id", "frame", "line").agg(F.sum("len").alias("line_len"))
    drawn = lines.join(length, ["file_id", "frame", "line"]).join(vectors.withColumnRenamed("vec_id", "id"), ["file_id", "frame", "id"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, count = np.zeros(shape), np.zeros(shape)
        for r in pdf.itertuples():
            m = images.vector_mask(shape, [r.y / pixelsize], [r.x / pixelsize], [r.angle], [r.len / pixelsize], 0)
            total[m] += r.line_len
            count[m] += 1
        v = images.nan_median_filter(np.where(count > 0, total / np.maximum(count, 1), np.nan), size).ravel()
        v = v[~np.isnan(v)]
        w = 1 / v
        mean = float((w * v).sum() / w.sum()) if len(v) else None
        std = float(math.sqrt((w * (v - mean) ** 2).sum() / w.sum())) if len(v) else None
        return pd.DataFrame([(*key, mean, std, float(v.max()) if len(v) else None)], columns=["file_id", "frame", "length_mean", "length_std", "length_max"])

    return drawn.groupBy("file_id", "frame").applyInPandas(run, f"{KEYS}, length_mean double, length_std double, length_max double")


def domain_features(members: DataFrame, shape: tuple[int, int], pixelsize: float, area_min: float = 20.0, radius: float = 0.3, n_min: int = 10) -> DataFrame:
    """members(file_id, frame, community, y, x, angle, len) -> domains of more than n_min vectors and area_min at least: area, order parameter, mean axis, mean and deviation of lengths."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pdf) > n_min:
            m = images.vector_mask(shape, pdf["y"] / pixelsize, pdf["x"] / pixelsize, pdf["angle"], pdf["len"] / pixelsize, int(round(radius / pixelsize)))
            area, z = float(m.sum()) * pixelsize**2, np.exp(2j * pdf["angle"].to_numpy()).mean()
            if area >= area_min:
                rows.append((*key, len(pdf), area, float(abs(z)), float(np.angle(z) / 2), float(pdf["len"].mean()), float(pdf["len"].std(ddof=0))))
        return pd.DataFrame(rows, columns=["file_id", "frame", "community", "n", "area", "oop", "orientation", "len_mean", "len_std"])

    kind = dict(members.dtypes)["community"]
    return members.groupBy("file_id", "frame", "community").applyInPandas(run, f"{KEYS}, community {kind}, n int, area double, oop double, orientation double, len_mean double, len_std double")


def wavelet_vectors(tiles: DataFrame, pixelsize: float, lengths: tuple[float, float, float] = (1.45, 2.7, 0.05), angle_step: float = 10.0, score_threshold: float = 0.2, width: float = 0.3, sigma: float = 0.15, shape: str = "gaussian") -> DataFrame:
    """Double-wavelet scan (shape: gaussian, half_gaussian or binary bars): the best (length, angle) of each pixel whose score is at least a share of the image's highest; guard lengths at both ends are dropped."""
    grid = np.arange(lengths[0] - lengths[2], lengths[1] + 1.5 * lengths[2], lengths[2])
    angles = np.deg2rad(np.arange(-90, 90, angle_step))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                score, n, t = images.best_wavelet(images.double_wavelets(_image(r.data, r.h, r.w), grid / pixelsize, angles, width / pixelsize, sigma / pixelsize, shape))
                ok = (score >= score_threshold * score.max()) & (n > 0) & (n < len(grid) - 1) & (score > 0)
                rows += [(r.file_id, r.frame, int(y), int(x), float(grid[n[y, x]]), float(np.mod(angles[t[y, x]], np.pi)), float(score[y, x])) for y, x in np.argwhere(ok)]
            yield pd.DataFrame(rows, columns=["file_id", "frame", "y", "x", "len", "angle", "score"])

    return tiles.select("file_id", "frame", "h", "w", "data").mapInPandas(run, f"{KEYS}, y int, x int, len double, angle double, score double")
