"""Contraction cycles of lines of bands: state, cycle table, per-cycle features, popping, correlations.

Tables: traj(loi, band, frame, y), state(loi, frame, contr), cycles(loi, cycle, start_frame, frames, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series


def state_of(traj: DataFrame, threshold: float, least: int = 4) -> DataFrame:
    """State of each frame: 1 if the bands' mean exceeds the threshold and `least` of them are present."""
    mean = F.avg("y") > threshold
    return traj.groupBy("loi", "frame").agg(F.when(mean & (F.count("y") >= least), 1).otherwise(0).alias("state"))


def cleaned_state(state: DataFrame, close: int, open_: int, buffer: int) -> DataFrame:
    """Closed, opened, without runs at the borders: contr; and quiet, its complement without runs at the borders."""
    df = series.opened_and_closed(state, ["loi"], "frame", "state", close, open_, "contr")
    df = series.cleared_border(df, ["loi"], "frame", "contr", buffer, "contr")
    df = df.withColumn("quiet", 1 - F.col("contr"))
    return series.cleared_border(df, ["loi"], "frame", "quiet", buffer, "quiet")


def rate_and_variability(cycles: DataFrame, keys: list[str]) -> DataFrame:
    """Cycles, 1 / mean distance of starts, its population deviation, mean and deviation of durations. NULL rates below two cycles."""
    w = Window.partitionBy(*keys).orderBy("start")
    df = cycles.withColumn("gap", F.col("start") - F.lag("start").over(w))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_cycles"), F.try_divide(F.lit(1.0), F.avg("gap")).alias("rate"), F.stddev_pop("gap").alias("variability"), F.avg("duration").alias("duration_mean"), F.stddev_pop("duration").alias("duration_std")
    )


def periods(contr: DataFrame, quiet: DataFrame, keys: list[str]) -> DataFrame:
    """Duration of contraction k plus that of quiet period k, joined by number."""
    q = quiet.select(*keys, "run", F.col("duration").alias("quiet_duration"))
    return contr.join(q, [*keys, "run"]).select(*keys, F.col("run").alias("cycle"), (F.col("duration") + F.col("quiet_duration")).alias("period"))


def with_cycles(state: DataFrame) -> DataFrame:
    """state(loi, frame, contr, ...) -> + cycle: the number of the frame's run of contr, NULL outside."""
    return series.runs(state, ["loi"], "frame", "contr", "cycle")


def trajectories(traj: DataFrame, state: DataFrame, dt: float, low: float, high: float, dilate: int = 0) -> DataFrame:
    """Velocity, resting value (median where the state, dilated by `dilate` frames, is 0; NULL outside [low, high]) and delta of each band.

    A state table with cycles gives its rows' cycles along; the state is joined once.
    """
    w = Window.partitionBy("loi", "band").orderBy("frame")
    rest_state = F.col("contr")
    if dilate > 1:
        state = state.withColumn("__wide", series.dilated(F.col("contr"), series.over(["loi"], ["frame"]), dilate))
        rest_state = F.col("__wide")
    own = [c for c in ("loi", "frame", "contr", "cycle", "__wide") if c in state.columns]
    df = traj.join(state.select(*own), ["loi", "frame"]).withColumn("vel", series.central_difference("y", w, dt))
    # The velocity's shuffle serves the median too.
    df = df.withColumn("rest", F.median(F.when(rest_state == 0, F.col("y"))).over(Window.partitionBy("loi", "band")))
    df = df.withColumn("rest", F.when(F.col("rest").between(low, high), F.col("rest"))).drop("__wide")
    return df.withColumn("delta", F.col("y") - F.col("rest"))


def in_cycles(traj: DataFrame) -> DataFrame:
    """Rows of traj that have a cycle, with their place in it (from 0)."""
    df = traj.where("cycle is not null")
    return df.withColumn("place", F.col("frame") - F.min("frame").over(Window.partitionBy("loi", "cycle")))


def cycle_features(inside: DataFrame, dt: float) -> DataFrame:
    """inside(loi, band, cycle, place, delta, vel) -> extrema, time to the least delta and from there to the end; times are NULL if a sample is missing."""
    whole = F.count_if(F.col("delta").isNull()) == 0
    least = F.min_by("place", F.struct("delta", "place"))
    return inside.groupBy("loi", "band", "cycle").agg(
        F.min("delta").alias("contr_max"),
        F.max("delta").alias("elong_max"),
        F.min("vel").alias("vel_contr_max"),
        F.max("vel").alias("vel_elong_max"),
        F.when(whole, least * dt).alias("time_to_peak"),
        F.when(whole, (F.count("*") - least) * dt).alias("time_to_relax"),
    )


def percent_time(inside: DataFrame, p0: float, p1: float, dt: float) -> DataFrame:
    """Time between the samples nearest to p0 and p1 percent of the least delta.

    p0 < p1 looks at samples up to the least, p0 > p1 from it on; p0 = 0 is the
    branch's beginning, p1 = 0 in relaxation its length.  0 if a sample is missing.
    """
    if p0 == p1:
        raise ValueError("p0 and p1 must differ")
    w = Window.partitionBy("loi", "band", "cycle")
    df = inside.withColumn("low", F.min("delta").over(w)).withColumn("gone", F.count_if(F.col("delta").isNull()).over(w))
    df = df.withColumn("at", F.min_by("place", F.struct("delta", "place")).over(w))
    rising = p0 > p1
    df = df.withColumn("x", F.col("place") - F.col("at") if rising else F.col("place"))
    use = F.col("x") >= 0 if rising else F.col("place") <= F.col("at")

    def nearest(p: float) -> Column:
        return F.min_by(F.when(use, F.col("x")), F.when(use, F.struct(F.abs(F.col("delta") - F.col("low") * (p / 100)), F.col("x"))))

    t0 = F.lit(0) if p0 == 0 else nearest(p0)
    t1 = F.count_if(use) if rising and p1 == 0 else nearest(p1)
    return df.groupBy("loi", "band", "cycle").agg(F.when(F.max("gone") == 0, (t1 - t0) * dt).otherwise(0.0).alias("percent_time"))


def surplus_motion(inside: DataFrame, dt: float) -> DataFrame:
    """Per line: mean over (band, cycle) of the sum of |vel| dt, over the mean over cycles of that of the bands' mean vel. A band with a missing sample has no sum."""
    single = inside.groupBy("loi", "band", "cycle").agg(F.when(F.count_if(F.col("vel").isNull()) == 0, F.sum(F.abs("vel")) * dt).alias("s"))
    mean = inside.groupBy("loi", "cycle", "frame").agg(F.avg("vel").alias("v")).groupBy("loi", "cycle").agg((F.sum(F.abs("v")) * dt).alias("s"))
    a = single.groupBy("loi").agg(F.avg("s").alias("a"))
    return a.join(mean.groupBy("loi").agg(F.avg("s").alias("b")), "loi").select("loi", F.try_divide("a", "b").alias("smi"))


def popping(features: DataFrame, threshold: float) -> DataFrame:
    """Marks each (loi, band, cycle) whose largest elongation exceeds the threshold; missing counts as not popping."""
    return features.select("loi", "band", "cycle", F.coalesce((F.col("elong_max") > threshold).cast("int"), F.lit(0)).alias("pops"))


def popping_gaps(marked: DataFrame) -> DataFrame:
    """Distances between popping bands in a cycle (kind dist) and between popping cycles of a band (kind tau)."""
    only = marked.where("pops = 1")
    only = only.withColumn("dist", F.col("band") - F.lag("band").over(Window.partitionBy("loi", "cycle").orderBy("band")))
    only = only.withColumn("tau", F.col("cycle") - F.lag("cycle").over(Window.partitionBy("loi", "band").orderBy("cycle")))
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("gap")) for k in ("dist", "tau")])
    return only.withColumn("g", F.explode(both)).select("loi", "g.kind", "band", "cycle", "g.gap").where("gap is not null")


def popping_rates(marked: DataFrame) -> DataFrame:
    """Mean of pops for each line (kind all), each of its bands and each of its cycles; one pass over the rows."""
    sets = marked.groupingSets([["loi"], ["loi", "band"], ["loi", "cycle"]], "loi", "band", "cycle").agg(F.grouping("band").alias("gb"), F.grouping("cycle").alias("gc"), F.avg("pops").alias("rate"))
    kind = F.when(F.col("gb") == 0, "band").when(F.col("gc") == 0, "cycle").otherwise("all")
    return sets.select("loi", kind.alias("kind"), F.coalesce("band", "cycle").alias("item"), "rate")


def correlations(traj: DataFrame, cycles: DataFrame, value: str = "delta") -> DataFrame:
    """Pearson's r of segments (band, cycle) from each cycle's start; the last cycle is left out.

    All segments of a line have the whole frames of its cycles' median duration.
    Pairs (i, k), (j, l) with i >= j, k >= l, not identical, inside one line.  Segments are arrays, so a pair is one row.
    """
    lines = cycles.groupBy("loi").agg(F.max("run").alias("__last"), F.floor(F.median("frames")).cast("int").alias("length"))
    c = cycles.join(lines, "loi").where(F.col("run") < F.col("__last")).select("loi", F.col("run").alias("cycle"), "start_frame", "length")
    spread = c.select("loi", "cycle", "length", F.explode(F.sequence(F.col("start_frame"), F.col("start_frame") + F.col("length") - 1)).alias("frame"))
    seg = traj.select("loi", "band", "frame", value).join(spread, ["loi", "frame"]).groupBy("loi", "band", "cycle", "length").agg(F.sort_array(F.collect_list(F.struct("frame", F.col(value).alias("v")))).alias("s"))
    seg = seg.select("loi", "band", "cycle", "length", F.transform("s", lambda x: x["v"]).alias("v")).where((F.size("v") == F.col("length")) & ~F.exists("v", lambda x: x.isNull()))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("length")
    seg = seg.withColumn("v", F.transform("v", lambda x: x - mean))
    seg = seg.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    a, b = seg.alias("a"), seg.alias("b")
    on = (F.col("a.loi") == F.col("b.loi")) & (F.col("a.band") >= F.col("b.band")) & (F.col("a.cycle") >= F.col("b.cycle"))
    other = (F.col("a.band") != F.col("b.band")) | (F.col("a.cycle") != F.col("b.cycle"))
    dot = F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, on & other).select(
        F.col("a.loi").alias("loi"), F.col("a.band").alias("i"), F.col("a.cycle").alias("k"), F.col("b.band").alias("j"), F.col("b.cycle").alias("l"), F.try_divide(dot, F.col("a.norm") * F.col("b.norm")).alias("r")
    )


def serial_and_mutual(pairs: DataFrame, mutual: str = "same_cycle") -> DataFrame:
    """Mean r of a band with itself over cycles, of different bands in one cycle, and their ratio (mutual over serial).

    mutual="crossed" takes j = k instead of k = l, for comparison with older results.
    """
    where = F.col("k") == F.col("l") if mutual == "same_cycle" else F.col("j") == F.col("k")
    serial, other = F.avg(F.when(F.col("i") == F.col("j"), F.col("r"))), F.avg(F.when(where & (F.col("i") > F.col("j")), F.col("r")))
    return pairs.groupBy("loi").agg(serial.alias("serial"), other.alias("mutual"), F.try_divide(other, serial).alias("ratio"))
