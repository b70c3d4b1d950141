"""Images in tiles: windows with a halo of the neighbouring tiles' pixels, and filters on them that equal those of the whole image.

A tile is a row (file_id, frame, y0, x0, rows, cols, step, h, w, data): its corner in an image of rows x cols pixels that is cut every
`step` pixels, its own height and width, and its pixels row by row (missing ones NULL).  A window is a tile and the `halo` pixels around
it.  Each tile sends the strips that other windows need, as array slices in the plan; one shuffle brings a window's strips together; so
a task holds windows, never images, and images of any size are spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..sources.staging import stage

TILE = ["file_id", "frame", "y0", "x0", "rows", "cols", "step", "h", "w"]


def _slice(y: str, x: str, h: str, w: str) -> str:
    """The part of a tile's pixels that begins at image place (y, x), as an expression."""
    return f"flatten(transform(sequence(0, {h} - 1), r -> slice(data, ({y} - y0 + r) * w + ({x} - x0) + 1, {w})))"


def cut(frames: DataFrame, step: int) -> DataFrame:
    """frames(file_id, frame, h, w, data) -> tiles."""
    df = frames.select("file_id", "frame", F.col("h").cast("int").alias("rows"), F.col("w").cast("int").alias("cols"), "data")
    df = df.withColumn("y0", F.explode(F.expr(f"sequence(0, rows - 1, {step})"))).withColumn("x0", F.explode(F.expr(f"sequence(0, cols - 1, {step})")))
    df = df.withColumn("step", F.lit(step)).withColumn("h", F.expr(f"least({step}, rows - y0)")).withColumn("w", F.expr(f"least({step}, cols - x0)"))
    return df.withColumn("data", F.expr("flatten(transform(sequence(0, h - 1), r -> slice(data, (y0 + r) * cols + x0 + 1, w)))")).select(*TILE, "data")


def whole(tiles: DataFrame) -> DataFrame:
    """tiles -> frames(file_id, frame, h, w, data); a frame must fit into one row."""
    rows = tiles.select(*TILE, F.posexplode(F.sequence(F.lit(0), F.col("h") - 1)).alias("r", "__"), "data")
    rows = rows.select("file_id", "frame", "rows", "cols", (F.col("y0") + F.col("r")).alias("y"), "x0", F.expr("slice(data, r * w + 1, w)").alias("data"))
    found = rows.groupBy("file_id", "frame", "rows", "cols").agg(F.sort_array(F.collect_list(F.struct("y", "x0", "data"))).alias("s"))
    return found.select("file_id", "frame", F.col("rows").alias("h"), F.col("cols").alias("w"), F.flatten(F.transform("s", lambda s: s["data"])).alias("data"))


def from_pixels(pixels: DataFrame, frames: DataFrame, step: int, fill: float | None = 0.0) -> DataFrame:
    """pixels(file_id, frame, y, x, v), each place once, and frames(file_id, frame, rows, cols) -> tiles; other places hold `fill`."""
    grid = frames.select("file_id", "frame", F.col("rows").cast("int").alias("rows"), F.col("cols").cast("int").alias("cols"))
    grid = grid.withColumn("y0", F.explode(F.expr(f"sequence(0, rows - 1, {step})"))).withColumn("x0", F.explode(F.expr(f"sequence(0, cols - 1, {step})")))
    corner = [F.expr(f"cast({a} - pmod({a}, {step}) as int)").alias(f"{a}0") for a in ("y", "x")]
    place = F.expr(f"cast(pmod(y, {step}) * {step} + pmod(x, {step}) as int)").alias("i")
    lit = pixels.select("file_id", "frame", *corner, place, F.col("v").cast("double").alias("v")).groupBy("file_id", "frame", "y0", "x0").agg(F.collect_list(F.struct("i", "v")).alias("lit"))
    # Pixels that a plan makes (of vectors, say) look small to the planner, so it would broadcast all tiles.
    df = grid.join(lit.hint("merge"), ["file_id", "frame", "y0", "x0"], "left").withColumn("step", F.lit(step))
    df = df.withColumn("h", F.expr(f"least({step}, rows - y0)")).withColumn("w", F.expr(f"least({step}, cols - x0)")).select(*TILE, "lit")
    empty = np.nan if fill is None else fill

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for h, w, lit in zip(batch.column("h").to_pylist(), batch.column("w").to_pylist(), batch.column("lit")):
                tile = np.full((step, step), empty)
                if lit.is_valid:
                    tile.ravel()[lit.values.field("i").to_numpy()] = lit.values.field("v").to_numpy(zero_copy_only=False)
                made.append(tile[:h, :w].ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _arrays(made)], [*TILE, "data"])

    return df.mapInArrow(place_all, _schema(df))


def to_pixels(tiles: DataFrame) -> DataFrame:
    """tiles -> pixels(file_id, frame, y, x, v)."""
    df = tiles.select("file_id", "frame", "y0", "x0", "w", F.posexplode("data").alias("i", "v"))
    return df.select("file_id", "frame", F.expr("cast(y0 + i div w as int)").alias("y"), F.expr("cast(x0 + i % w as int)").alias("x"), "v")


def _arrays(made: list[np.ndarray]) -> pa.Array:
    """A list column of double arrays; NaN as NULL."""
    bounds = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
    flat = np.concatenate([np.empty(0), *made])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.float64(), mask=np.isnan(flat)))


def _schema(tiles: DataFrame) -> str:
    kinds = dict(tiles.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in TILE) + ", data array<double>"


def windows(tiles: DataFrame, halo: int) -> DataFrame:
    """tiles -> (TILE, strips): for each tile the parts of tiles, its own one too, that lie in its window."""
    kinds = dict(tiles.dtypes)
    df = tiles.select(*TILE, "data")
    for a, size, n in (("y", "h", "rows"), ("x", "w", "cols")):
        first, last = f"greatest(0, floor(({a}0 - {halo}) / step))", f"least(floor(({n} - 1) / step), floor(({a}0 + {size} - 1 + {halo}) / step))"
        df = df.withColumn(f"t{a}", F.explode(F.expr(f"transform(sequence(cast({first} as int), cast({last} as int)), t -> t * step)")))
        df = df.withColumn(f"s{a}", F.expr(f"greatest({a}0, t{a} - {halo})"))
        df = df.withColumn(f"s{size}", F.expr(f"least({a}0 + {size}, least(t{a} + step, {n}) + {halo}) - s{a}"))
    strip = F.struct(F.col("sy").alias("y"), F.col("sx").alias("x"), F.col("sh").alias("h"), F.col("sw").alias("w"), F.expr(_slice("sy", "sx", "sh", "sw")).cast("array<double>").alias("data"))
    df = df.where("sh > 0 and sw > 0").select("file_id", "frame", "ty", "tx", "rows", "cols", "step", strip.alias("strip"))
    df = df.groupBy("file_id", "frame", "ty", "tx", "rows", "cols", "step").agg(F.collect_list("strip").alias("strips"))
    df = df.withColumnsRenamed({"ty": "y0", "tx": "x0"}).withColumn("h", F.expr("least(step, rows - y0)")).withColumn("w", F.expr("least(step, cols - x0)"))
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in TILE], "strips")


def padded(row: dict, strips: pa.StructScalar, halo: int, edge: str) -> np.ndarray:
    """One window; beyond the image `edge`: reflect (its last rows and columns mirrored, the outermost twice), zero or nan."""
    h, w = row["h"] + 2 * halo, row["w"] + 2 * halo
    top, left = row["y0"] - halo, row["x0"] - halo
    out = np.full((h, w), 0.0 if edge == "zero" else np.nan)
    flat = strips.values
    data = flat.field("data")
    # flatten() gives this window's pixels only; .values are those of the whole batch, copied for each window if one is missing.
    values, bounds = data.flatten().to_numpy(zero_copy_only=False), data.offsets.to_numpy()
    bounds = bounds - bounds[0] if len(bounds) else bounds
    for i, (y, x, sh, sw) in enumerate(zip(*(flat.field(c).to_numpy() for c in ("y", "x", "h", "w")))):
        out[y - top : y - top + sh, x - left : x - left + sw] = values[bounds[i] : bounds[i] + sh * sw].reshape(sh, sw)
    if edge == "reflect":
        out = out[_mirrored(np.arange(top, top + h), row["rows"]) - top][:, _mirrored(np.arange(left, left + w), row["cols"]) - left]
    return out


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Places inside 0 ... n - 1 that hold the values of places outside, mirrored at the borders."""
    i = np.mod(i, 2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def over_windows(tiles: DataFrame, halo: int, kernel: Callable[[np.ndarray], np.ndarray], edge: str = "reflect") -> DataFrame:
    """kernel(window) on each tile's window -> tiles; the kernel gives an array of the window's shape, of which the tile's part is kept."""
    if edge not in ("reflect", "zero", "nan"):
        raise ValueError(f"unknown edge {edge!r}")
    schema = _schema(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            heads = batch.select(TILE).to_pylist()
            for row, strips in zip(heads, batch.column("strips")):
                found = kernel(padded(row, strips, halo, edge))
                made.append(found[halo : halo + row["h"], halo : halo + row["w"]].ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _arrays(made)], [*TILE, "data"])

    return windows(tiles, halo).mapInArrow(run, schema)


def correlate(window: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of weights x pixels around each pixel, term by term in one order, so that any tiling gives the same bits; zero beyond the window."""
    a, b = weights.shape
    wide = np.pad(window, ((a // 2, a - 1 - a // 2), (b // 2, b - 1 - b // 2)))
    out = np.zeros(window.shape)
    for i in range(a):
        for j in range(b):
            if weights[i, j]:
                out += weights[i, j] * wide[i : i + window.shape[0], j : j + window.shape[1]]
    return out


def gaussian(sigma: float, reach: float = 3.0) -> np.ndarray:
    """Weights of a Gaussian of sum 1."""
    n = int(math.ceil(reach * sigma))
    k = np.exp(-(np.arange(-n, n + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    return np.outer(k, k)


def convolved(tiles: DataFrame, weights: np.ndarray, edge: str = "reflect") -> DataFrame:
    """Convolution with a kernel of odd sides."""
    turned = np.ascontiguousarray(weights[::-1, ::-1])
    return over_windows(tiles, max(weights.shape) // 2, lambda window: correlate(window, turned), edge)


def medians(tiles: DataFrame, size: int) -> DataFrame:
    """Median of the present pixels in a square window of odd size; nothing is beyond the image."""
    return over_windows(tiles, size // 2, lambda window: images.nan_median_filter(window, size), "nan")


def wavelet_maps(tiles: DataFrame, pixelsize: float, lengths: Sequence[float], angles: Sequence[float], width: float = 0.3, sigma: float = 0.15, shape: str = "gaussian") -> DataFrame:
    """Double-wavelet scan tile by tile: tiles with `data` the best score, and `length`, `angle`: which of the lengths (µm) and angles gives it.  Beyond the image is 0."""
    grid, turns = np.asarray(lengths, dtype=float), np.asarray(angles, dtype=float)
    halo = int(math.ceil((grid.max() / 2 + 3 * max(width, sigma)) / pixelsize)) + 1
    schema = _schema(tiles) + ", length array<double>, angle array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: tuple[list, list, list] = ([], [], [])
            for row, strips in zip(batch.select(TILE).to_pylist(), batch.column("strips")):
                window = padded(row, strips, halo, "zero")
                score, n, t = images.best_wavelet(images.double_wavelets(window, grid / pixelsize, turns, width / pixelsize, sigma / pixelsize, shape))
                for out, found in zip(made, (score, grid[n], turns[t])):
                    out.append(found[halo : halo + row["h"], halo : halo + row["w"]].ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(_arrays, made)], [*TILE, "data", "length", "angle"])

    return windows(tiles, halo).mapInArrow(run, schema)


def wavelet_vectors(tiles: DataFrame, pixelsize: float, lengths: tuple[float, float, float] = (1.45, 2.7, 0.05), angle_step: float = 10.0, score_threshold: float = 0.2, width: float = 0.3, sigma: float = 0.15, shape: str = "gaussian") -> DataFrame:
    """Vectors (file_id, frame, y, x, len, angle, score) at pixels whose best score is at least a share of the frame's highest; the guard lengths at both ends are left out."""
    grid = np.arange(lengths[0] - lengths[2], lengths[1] + 1.5 * lengths[2], lengths[2])
    # Read twice, for the scores and for each frame's highest.
    maps = stage(wavelet_maps(tiles, pixelsize, grid, np.deg2rad(np.arange(-90, 90, angle_step)), width, sigma, shape), "maps")
    px = maps.select("file_id", "frame", "y0", "x0", "w", F.posexplode(F.arrays_zip("data", "length", "angle")).alias("i", "p"))
    px = px.select("file_id", "frame", F.expr("cast(y0 + i div w as int)").alias("y"), F.expr("cast(x0 + i % w as int)").alias("x"), F.col("p.length").alias("len"), F.pmod("p.angle", F.lit(math.pi)).alias("angle"), F.col("p.data").alias("score"))
    highest = maps.groupBy("file_id", "frame").agg(F.max(F.array_max("data")).alias("__most"))
    inside = (F.col("score") > 0) & (F.col("score") >= score_threshold * F.col("__most")) & (F.col("len") > float(grid[0])) & (F.col("len") < float(grid[-1]))
    return px.join(highest, ["file_id", "frame"]).where(inside).drop("__most")


def vector_pixels(vectors: DataFrame, frames: DataFrame) -> DataFrame:
    """vectors(file_id, frame, y, x, angle, len, weight), all in pixels, along (sin, cos), and frames(file_id, frame, rows, cols) ->
    (file_id, frame, y, x, side, angle, weight): every pixel on each vector, with the side of the vector's middle that it lies on (-1, 1).

    Vectors that leave the image have none.
    """
    schema = "file_id {file_id}, frame {frame}, y int, x int, side int, angle double, weight double".format(**dict(vectors.dtypes))
    joined = vectors.join(frames, ["file_id", "frame"]).select("file_id", "frame", "y", "x", "angle", "len", "weight", "rows", "cols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, x, t, n, rows, cols = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "angle", "len", "rows", "cols"))
            dy, dx = np.sin(t) * n / 2, np.cos(t) * n / 2
            ends = [np.trunc(e).astype(np.int64) for e in (y - dy, x - dx, y + dy, x + dx)]
            inside = (np.minimum(ends[0], ends[2]) >= 0) & (np.maximum(ends[0], ends[2]) < rows) & (np.minimum(ends[1], ends[3]) >= 0) & (np.maximum(ends[1], ends[3]) < cols)
            drawn = np.flatnonzero(inside)
            line, ys, xs = images.lines_pixels(*(e[drawn] for e in ends))
            sizes = np.bincount(line, minlength=len(drawn))
            sides = np.where(np.arange(len(line)) - (np.cumsum(sizes) - sizes)[line] < sizes[line] // 2, -1, 1)
            rows_of = pa.array(drawn[line])
            found = [pa.array(c.astype(np.int32)) for c in (ys, xs, sides)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_of), batch.column(1).take(rows_of), *found, batch.column("angle").take(rows_of), batch.column("weight").take(rows_of)], ["file_id", "frame", "y", "x", "side", "angle", "weight"])

    return joined.mapInArrow(run, schema)


def label_maps(vectors: DataFrame, frames: DataFrame) -> DataFrame:
    """vectors and frames as in `vector_pixels` -> (file_id, frame, y, x, n, weight, direction, axis, strength) of every pixel under a vector.

    direction: the weighted mean of the vectors' unit vectors, which point from a vector's middle to its ends; axis: the mean of the
    doubled angles, in [0, pi), the same on both sides; strength: the length of that mean.
    """
    px = vector_pixels(vectors, frames)
    w, t, s = F.col("weight"), F.col("angle"), F.col("side")
    total = lambda c: F.sum(w * c)
    sums = px.groupBy("file_id", "frame", "y", "x").agg(
        F.count("*").alias("n"), F.sum(w).alias("weight"), total(s * F.sin(t)).alias("s1"), total(s * F.cos(t)).alias("c1"), total(F.sin(2 * t)).alias("s2"), total(F.cos(2 * t)).alias("c2"),
    )
    strength = F.try_divide(F.sqrt(F.col("s2") * F.col("s2") + F.col("c2") * F.col("c2")), "weight")
    return sums.select("file_id", "frame", "y", "x", "n", "weight", F.atan2("s1", "c1").alias("direction"), F.pmod(F.atan2("s2", "c2") / 2, F.lit(math.pi)).alias("axis"), strength.alias("strength"))


def vector_mask(labels: DataFrame, frames: DataFrame, step: int, radius: int) -> DataFrame:
    """Tiles of 1 where a pixel under a vector lies within the radius, 0 elsewhere."""
    tiles = from_pixels(labels.select("file_id", "frame", "y", "x", F.lit(1.0).alias("v")), frames, step)
    return over_windows(tiles, radius, lambda window: images.dilated(window, radius).astype(float), "zero")


def smoothed_directions(labels: DataFrame, frames: DataFrame, step: int, size: int = 3) -> DataFrame:
    """Pixels (file_id, frame, y, x, direction): angle of the medians of the directions' sines and cosines in a square window, wherever that holds a label."""
    tiles = from_pixels(labels.select("file_id", "frame", "y", "x", F.col("direction").alias("v")), frames, step, fill=None)
    place = ["file_id", "frame", "y0", "x0"]
    s, c = (medians(tiles.withColumn("data", F.transform("data", f)), size).select(*place, "w", F.col("data").alias(name)) for name, f in (("s", F.sin), ("c", F.cos)))
    # Tiles meet, not their pixels, and never by broadcast.
    both = s.join(c.drop("w").hint("merge"), place)
    px = both.select("file_id", "frame", "y0", "x0", "w", F.posexplode(F.arrays_zip("s", "c")).alias("i", "p")).where("p.s is not null")
    return px.select("file_id", "frame", F.expr("cast(y0 + i div w as int)").alias("y"), F.expr("cast(x0 + i % w as int)").alias("x"), F.atan2("p.s", "p.c").alias("direction"))
