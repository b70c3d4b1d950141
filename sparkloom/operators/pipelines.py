"""Chains of operators: structure of frames, lines of interest, motion of a line, many files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles, nulls
from ..sources import files
from . import cycles, graph, series, signal, spatial, splines, stats, tables

FRAME = ["file_id", "frame"]


def vector_features(vectors: DataFrame) -> DataFrame:
    """vectors(file_id, frame, vec_id, y, x, angle, len, midline_id, ...) -> one row a frame: counts, lengths, order, mean direction (circular and axial)."""
    a = F.col("angle")
    return vectors.groupBy(*FRAME).agg(
        F.count("*").alias("n_vectors"),
        F.countDistinct("midline_id").alias("n_mbands"),
        F.avg("len").alias("sarcomere_length_mean"),
        F.stddev_pop("len").alias("sarcomere_length_std"),
        angles.order_parameter(a).alias("sarcomere_oop"),
        angles.circular_mean(a).alias("sarcomere_orientation_mean"),
        angles.circular_std(a).alias("sarcomere_orientation_std"),
        angles.axial_mean(a).alias("sarcomere_axis"),
    )


def band_links(ends: DataFrame, d_max: float = 3.0, d_min: float = 0.0, least: float = 0.4, a_min: float = 0.3) -> DataFrame:
    """ends(file_id, frame, band, end, y, x, dir) with outward directions -> links(file_id, frame, a, b, dist, alignment) of bands.

    Allowed pairs of ends of different bands, by distance and alignment, compete
    in a least-cost matching of cost 1 - alignment, in which an end has one link.
    """
    kind = dict(ends.dtypes)["band"]
    e = ends.withColumn("id", F.col("band") * 2 + F.col("end"))

    def cost(p: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
        (yi, xi, ti), (yj, xj, tj) = (tuple(p[c][at] for c in ("y", "x", "dir")) for at in (i, j))
        if "cos" not in p:
            p["cos"], p["sin"] = np.cos(p["dir"]), np.sin(p["dir"])
        # Most pairs fail by far; those near the limits or within them are measured as alignment_index does.
        along = [t * ((p["cos"][at] * (xj - xi)) + p["sin"][at] * (yj - yi)) for t, at in ((1, i), (-1, j))]
        maybe = np.flatnonzero((p["cos"][i] * p["cos"][j] + p["sin"][i] * p["sin"][j] < 1e-9) & (along[0] > least * d - 1e-9) & (along[1] > least * d - 1e-9) & (d >= d_min) & (p["band"][i] != p["band"][j]))
        yi, xi, ti, yj, xj, tj = (c[maybe] for c in (yi, xi, ti, yj, xj, tj))
        facing, a, b = np.cos(ti - tj + np.pi), np.cos(ti - np.arctan2(yj - yi, xj - xi)), np.cos(tj - np.arctan2(yi - yj, xi - xj))
        alignment = facing * a * b
        out, on = np.full(len(d), np.inf), (facing > 0) & (a > least) & (b > least) & (alignment >= a_min)
        out[maybe[on]] = 1 - alignment[on]
        return out

    # The matching is one of ends with ends; a link stands if it is chosen either way.
    chosen = graph.matched_near(e.where("dir is not null").select(*FRAME, "id", "y", "x", "band", "dir"), FRAME, "id", d_max, cost).select(*FRAME, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for s in ("a", "b"):
        chosen = chosen.join(e.select(*FRAME, F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("band", "dir", "y", "x"))), [*FRAME, s])
    dy, dx = F.col("b_y") - F.col("a_y"), F.col("b_x") - F.col("a_x")
    to_j, to_i = F.atan2(dy, dx), F.atan2(F.col("a_y") - F.col("b_y"), F.col("a_x") - F.col("b_x"))
    links = chosen.withColumn("dist", F.sqrt(dy * dy + dx * dx)).withColumn("alignment", angles.alignment_index(F.col("a_dir"), F.col("b_dir"), to_j, to_i, least))
    links = links.where(F.col("dist").between(d_min, d_max) & (F.col("alignment") >= a_min))
    return links.select(*FRAME, F.least("a_band", "b_band").cast(kind).alias("a"), F.greatest("a_band", "b_band").cast(kind).alias("b"), "dist", "alignment")


def band_features(bands: DataFrame, links: DataFrame) -> DataFrame:
    """bands(file_id, frame, band, length, straightness, intensity, orientation), links -> one row a frame: bands, neighbours, distances, alignments, groups."""
    ends = links.select(*FRAME, F.col("a").alias("band")).unionByName(links.select(*FRAME, F.col("b").alias("band")))
    near = bands.join(ends.groupBy(*FRAME, "band").agg(F.count("*").alias("n")), [*FRAME, "band"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = near.groupBy(*FRAME).agg(
        F.count("*").alias("n_zbands"), F.avg("length").alias("z_length_mean"), F.stddev_pop("length").alias("z_length_std"), F.max("length").alias("z_length_max"),
        F.avg("straightness").alias("z_straightness_mean"), F.stddev_pop("straightness").alias("z_straightness_std"), F.avg("intensity").alias("z_intensity_mean"), F.stddev_pop("intensity").alias("z_intensity_std"),
        angles.order_parameter(F.col("orientation")).alias("z_oop"), F.avg("n").alias("z_lat_neighbors_mean"), F.stddev_pop("n").alias("z_lat_neighbors_std"),
    )
    across = links.groupBy(*FRAME).agg(F.avg("dist").alias("z_lat_dist_mean"), F.stddev_pop("dist").alias("z_lat_dist_std"), F.avg("alignment").alias("z_lat_alignment_mean"), F.stddev_pop("alignment").alias("z_lat_alignment_std"))
    parts = graph.components(bands.select(*FRAME, F.col("band").alias("id")), links, FRAME)
    members = parts.join(bands.select(*FRAME, F.col("band").alias("id"), "length"), [*FRAME, "id"])
    groups = graph.group_features(members, links, FRAME).groupBy(*FRAME).agg(
        *[f(c).alias(f"z_lat_{c}_groups_{n}") for c in ("size", "length", "alignment") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    return own.join(across, FRAME, "left").join(groups, FRAME, "left")


def domains(vectors: DataFrame, d_max: float = 3.0, cosine_min: float = 0.65, resolution: float = 0.06, seed: int = 42) -> DataFrame:
    """vectors -> (file_id, frame, vec_id, community): communities of vectors whose ends are near and whose axes agree.

    Pairs of ends within d_max give edges of distance over |cos|; the ends of a
    vector are one node.  A frame is one task, which holds its ends and no pairs.
    """
    ends = spatial.ends_of(vectors.select(*FRAME, "vec_id", "y", "x", "angle", "len"))
    return graph.near_communities(ends, FRAME, "vec_id", d_max, cosine_min, resolution, seed)


def lines_of_interest(vectors: DataFrame, key: str, mode: str = "longest_in_cluster", n: int | None = 4, limits: dict | None = None, cut: float = 40.0, linkage: str = "single", extend: float = 2.0, seed: int = 0, **growth) -> DataFrame:
    """vectors(key, id, y, x, angle, len, midline_len) -> lines chosen by mode.

    Lines are grown, filtered by half-open limits of their features, clustered by
    Hausdorff distance (key, cluster), and chosen: fit_straight_line (a line a
    cluster, extended, rounded to tenths, the n longest), longest_in_cluster,
    random_in_cluster, random_line.
    """
    grown = graph.grown_lines(vectors, key, seed=seed, **growth)
    points = grown.join(vectors.select(key, "id", "y", "x", "len", "midline_len"), [key, "id"])
    features = tables.half_open(spatial.line_features(points.drop("id"), [key, "line"]), limits or {})
    kept = features.select(key, "line")
    points = points.join(kept, [key, "line"])
    nodes = kept.withColumnRenamed("line", "id")
    if linkage == "single":
        found = graph.linked_lines(points, [key], "line", cut).withColumnRenamed("component", "cluster")
    else:
        found = graph.agglomerated(spatial.hausdorff(points, [key], "line").withColumnRenamed("hausdorff", "d"), key, cut, linkage)
    clusters = nodes.join(found, [key, "id"], "left").withColumn("cluster", F.coalesce("cluster", "id"))
    lines = features.join(clusters.withColumnRenamed("id", "line"), [key, "line"])
    if mode == "fit_straight_line":
        fit = stats.line_fit(points.join(clusters.withColumnRenamed("id", "line"), [key, "line"]), [key, "cluster"], "x", "y", extend)
        fit = fit.withColumn("length", F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)))
        return tables.longest(fit.withColumns({c: F.round(c, 1) for c in ("x0", "y0", "x1", "y1")}), "length", n, [key, "cluster"])
    lines = lines.withColumn("__c", F.struct(key, "cluster"))
    if mode == "longest_in_cluster":
        return tables.longest_in_cluster(lines, "__c", "length", n, [key, "line"]).drop("__c")
    if mode == "random_in_cluster":
        return tables.random_in_cluster(lines, "__c", n, seed, [key, "line"]).drop("__c")
    if mode == "random_line":
        out = lines.drop("__c").orderBy(F.xxhash64(F.lit(seed), F.col(key), F.col("line")), key, "line")
        return out if n is None else out.limit(n)
    raise ValueError(mode)


def band_tracks(kymograph: DataFrame, dt: float, search_range: float = 2.0, memory: int = 10, fill: int = 3, least_seconds: float = 1.0, smooth: tuple[int, int] = (13, 7)) -> DataFrame:
    """kymograph(loi, frame, x_pos, profile) -> traj(loi, band, frame, z): tracked bands that begin in the first frame, filled, smoothed, longer than `least_seconds`; bands are numbered along the line."""
    peaks = signal.detected_peaks(kymograph).select("loi", "frame", F.explode("peaks").alias("x"))
    found = signal.tracked(peaks, "loi", search_range, memory, first_frame_only=True)
    grid = kymograph.select("loi", "frame").join(found.select("loi", "track").distinct(), "loi")
    whole = grid.join(found, ["loi", "track", "frame"], "left")
    z = signal.filled(whole.select("loi", "track", "frame", "x"), ["loi", "track"], "frame", "x", "z", fill)
    enough = z.groupBy("loi", "track").agg(F.count("z").alias("n"), F.min_by("z", F.when(F.col("z").isNotNull(), F.col("frame"))).alias("first")).where(F.col("n") > int(least_seconds / dt))
    bands = enough.withColumn("band", (F.row_number().over(Window.partitionBy("loi").orderBy("first")) - 1).cast("long")).select("loi", "track", "band")
    named = z.join(bands, ["loi", "track"]).select("loi", "band", "frame", "z")
    return signal.smoothed(named, ["loi", "band"], "frame", "z", "s", *smooth).select("loi", "band", "frame", F.col("s").alias("z"))


def spacings_of(traj: DataFrame, low: float = 1.2, high: float = 3.0) -> DataFrame:
    """Distances of neighbouring bands of a frame, as series numbered by the lower band; outside [low, high] missing."""
    w = Window.partitionBy("loi", "frame").orderBy("band")
    gap = F.lead("z").over(w) - F.col("z")
    df = traj.withColumn("y", nulls.within(gap, low, high)).withColumn("__next", F.lead("band").over(w))
    return df.where("__next is not null").select("loi", "band", "frame", "y")


def created_lines(tiles: DataFrame, lines: DataFrame, pixelsize: float, width: float = 0.65, order: int = 0) -> DataFrame:
    """tiles of a movie, lines(file_id, line, pos, y, x) in pixels -> (file_id, line, name, length, frame, x_pos array, profile array).

    A line may have any number of points; width in µm is cut to whole pixels (one at least); length is the polyline's in µm, x_pos runs
    evenly from 0 to it; the name is that of the line's file.
    """
    at = Window.partitionBy("file_id", "line").orderBy("pos")
    steps = lines.select("file_id", "line", "pos", "y", "x", F.sqrt(F.pow(F.lead("y").over(at) - F.col("y"), 2) + F.pow(F.lead("x").over(at) - F.col("x"), 2)).alias("step"))
    first, last = (f(F.struct("y", "x"), "pos").alias(n) for f, n in ((F.min_by, "a"), (F.max_by, "b")))
    shapes = steps.groupBy("file_id", "line").agg((F.coalesce(F.sum("step"), F.lit(0.0)) * pixelsize).alias("length"), first, last)
    name = files.loi_name(F.col("a.y"), F.col("a.x"), F.col("b.y"), F.col("b.x"), F.lit(width))
    samples = splines.kymograph(tiles, lines, max(int(width / pixelsize), 1), order)
    rows = samples.groupBy("file_id", "line", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("profile"))
    found = rows.join(shapes.select("file_id", "line", "length", name.alias("name")).hint("merge"), ["file_id", "line"])
    n = F.size("profile")
    x = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.coalesce(F.try_divide(F.col("length"), n - 1), F.lit(0.0)))
    return found.select("file_id", "line", "name", "length", "frame", x.alias("x_pos"), "profile")


def contraction_states(slen: DataFrame, below: float = 0.1, least: int = 4) -> DataFrame:
    """Default state of a frame: 1 where the bands' mean spacing is more than `below` under its median over the line's frames, and `least` are present.

    Any other source of states with columns (loi, frame, state) does as well.
    """
    means = slen.groupBy("loi", "frame").agg(F.avg("y").alias("m"), F.count("y").alias("n"))
    rest = means.groupBy("loi").agg(F.median("m").alias("rest"))
    return means.join(rest, "loi").select("loi", "frame", F.when((F.col("m") < F.col("rest") - below) & (F.col("n") >= least), 1).otherwise(0).alias("state"))


def motion(kymograph: DataFrame, dt: float, states: DataFrame | None = None, merge: float = 0.05, shortest: float = 0.2, buffer: int = 3, rest: tuple[float, float] = (1.5, 2.3), pop: float = 0.25) -> dict[str, DataFrame]:
    """The whole analysis of lines: traj, state, cycles, quiet, rates, features, popping."""
    slen = spacings_of(band_tracks(kymograph, dt))
    state = cycles.cleaned_state(states if states is not None else contraction_states(slen), max(1, int(merge / dt)), max(1, int(shortest / dt)), buffer)
    smooth = signal.smoothed(slen, ["loi", "band"], "frame", "y", "s", 13, 5).select("loi", "band", "frame", F.col("s").alias("y"))
    traj = cycles.trajectories(smooth, cycles.with_cycles(state), dt, *rest)
    contr, quiet = (series.run_table(state, ["loi"], "frame", c, dt) for c in ("contr", "quiet"))
    features = cycles.cycle_features(cycles.in_cycles(traj), dt)
    return {"traj": traj, "state": state, "cycles": contr, "quiet": quiet, "rates": cycles.rate_and_variability(contr, ["loi"]), "features": features, "popping": cycles.popping(features, pop)}


def each_file(files: Sequence, analyse: Callable[[object], DataFrame], **conditions) -> tuple[DataFrame | None, list[tuple[object, str]]]:
    """Result rows of all files that could be analysed, with conditions, and the errors of the others."""
    done, failed = [], []
    for f in files:
        try:
            done.append(tables.with_conditions(analyse(f), **conditions))
        except Exception as e:
            failed.append((f, f"{type(e).__name__}: {e}"))
    return (tables.appended(done) if done else None), failed
