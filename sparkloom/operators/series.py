"""Series: differences, binary morphology, runs, edges, chunks.

A series is the rows of one key in the order of a frame column.  Frames are
taken as neighbours if they follow each other in that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "frame") -> DataFrame:
    """Frame numbers from 0 in the given order."""
    return df.withColumn(out, (F.row_number().over(over(keys, order)) - 1).cast("long"))


def difference(y: str, w: WindowSpec) -> Column:
    """y minus the value before it; NULL at the first."""
    return F.col(y) - F.lag(y).over(w)


def central_difference(y: str, w: WindowSpec, dt: float) -> Column:
    """(next - previous) / (2 dt); one-sided at the ends of the series, which are known by row number, not by missing values."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.row_number().over(w) == 1, F.row_number().over(w) == F.count(F.lit(1)).over(whole)
    after, before, here = F.lead(y).over(w), F.lag(y).over(w), F.col(y)
    return F.when(first & last, None).when(first, (after - here) / dt).when(last, (here - before) / dt).otherwise((after - before) / (2 * dt))


def dilated(state: Column, w: WindowSpec, size: int) -> Column:
    """1 where a centred window of `size` has a 1 (an even one reaches further ahead)."""
    return F.max(state).over(w.rowsBetween(-(size - 1 - size // 2), size // 2))


def eroded(state: Column, w: WindowSpec, size: int) -> Column:
    """1 where the whole window is 1; outside the series is 0."""
    frame = w.rowsBetween(-(size // 2), size - 1 - size // 2)
    return F.when(F.count(F.lit(1)).over(frame) < size, 0).otherwise(F.min(state).over(frame))


def opened_and_closed(df: DataFrame, keys: Sequence[str], frame: str, state: str, close: int, open_: int, out: str) -> DataFrame:
    """Closing by `close` frames (fills gaps), then opening by `open_` frames (drops short runs). state: 0 or 1, no NULL."""
    w = over(keys, [frame])
    df = df.withColumn("__c", dilated(F.col(state), w, close)).withColumn("__c", eroded(F.col("__c"), w, close))
    df = df.withColumn("__c", eroded(F.col("__c"), w, open_)).withColumn(out, dilated(F.col("__c"), w, open_).cast("int"))
    return df.drop("__c")


def runs(df: DataFrame, keys: Sequence[str], frame: str, state: str, out: str = "run") -> DataFrame:
    """Numbers runs of state = 1 from 1 in each series; NULL elsewhere."""
    w = over(keys, [frame])
    starts = F.when((F.col(state) == 1) & (F.coalesce(F.lag(state).over(w), F.lit(0)) == 0), 1).otherwise(0)
    df = df.withColumn("__s", starts)
    return df.withColumn(out, F.when(F.col(state) == 1, F.sum("__s").over(w).cast("long"))).drop("__s")


def cleared_border(df: DataFrame, keys: Sequence[str], frame: str, state: str, buffer: int, out: str) -> DataFrame:
    """state without runs that touch the first or last `buffer` frames."""
    whole = Window.partitionBy(*keys)
    df = runs(df, keys, frame, state, "__r")
    run = Window.partitionBy(*keys, "__r")
    df = df.withColumn("__a", F.min(frame).over(run)).withColumn("__b", F.max(frame).over(run))
    inside = (F.col("__a") - F.min(frame).over(whole) >= buffer) & (F.max(frame).over(whole) - F.col("__b") >= buffer)
    return df.withColumn(out, F.when(F.col("__r").isNotNull() & inside, 1).otherwise(0)).drop("__r", "__a", "__b")


def run_table(df: DataFrame, keys: Sequence[str], frame: str, state: str, dt: float) -> DataFrame:
    """One row a run of state = 1: number from 1, frame before its first, start in seconds, frames, duration in seconds."""
    found = runs(df, keys, frame, state).where("run is not null")
    return found.groupBy(*keys, "run").agg(
        (F.min(frame) - 1).alias("start_frame"), ((F.min(frame) - 1) * dt).alias("start"), F.count("*").alias("frames"), (F.count("*") * dt).alias("duration")
    )


def rising_edges(df: DataFrame, keys: Sequence[str], frame: str, state: str) -> DataFrame:
    """Frames of state 0 that a frame of state 1 follows."""
    return df.withColumn("__n", F.lead(state).over(over(keys, [frame]))).where((F.col(state) == 0) & (F.col("__n") == 1)).drop("__n")


def run_distance(df: DataFrame, keys: Sequence[str], frame: str, state: str, out: str) -> DataFrame:
    """Inside runs: distance to the nearest frame outside, over the run's largest; 0 elsewhere."""
    df = runs(df, keys, frame, state, "__r")
    run = Window.partitionBy(*keys, "__r")
    near = F.least(F.col(frame) - F.min(frame).over(run) + 1, F.max(frame).over(run) - F.col(frame) + 1)
    df = df.withColumn("__d", F.when(F.col("__r").isNotNull(), near))
    return df.withColumn(out, F.coalesce(F.col("__d") / F.max("__d").over(run), F.lit(0.0))).drop("__r", "__d")


def filtered_intervals(df: DataFrame, keys: Sequence[str], frame: str, y: str, threshold: float, out: str, least: int = 4, area: float = 3.0, close: int = 3) -> DataFrame:
    """Runs above the threshold of `least` frames and `area` (absolute sum of y less the run's minimum) at least, then closed by `close` frames."""
    df = runs(df.withColumn("__t", (F.col(y) > threshold).cast("int")), keys, frame, "__t", "__r")
    run = Window.partitionBy(*keys, "__r")
    size = F.abs(F.sum(y).over(run) - F.min(y).over(run) * F.count(F.lit(1)).over(run))
    keep = F.col("__r").isNotNull() & (F.count(F.lit(1)).over(run) >= least) & (size >= area)
    df = df.withColumn("__k", F.when(keep, 1).otherwise(0))
    w = over(keys, [frame])
    df = df.withColumn("__k", dilated(F.col("__k"), w, close))
    return df.withColumn(out, eroded(F.col("__k"), w, close).cast("int")).drop("__t", "__r", "__k")


def chunks(df: DataFrame, frame: str, size: int) -> DataFrame:
    """chunk and place in it, for pieces of `size` frames."""
    return df.withColumn("chunk", F.floor(F.col(frame) / size)).withColumn("place", F.pmod(F.col(frame), F.lit(size)))


def filled_gaps(df: DataFrame, keys: Sequence[str], frame: str, y: str, limit: int, out: str) -> DataFrame:
    """Linear fill of inner gaps: the first `limit` missing frames of each gap."""
    w = over(keys, [frame])
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(y).isNotNull(), F.col(frame))
    df = df.withColumn("__a", F.last(at, True).over(back)).withColumn("__b", F.first(at, True).over(ahead))
    df = df.withColumn("__ya", F.last(y, True).over(back)).withColumn("__yb", F.first(y, True).over(ahead))
    line = F.col("__ya") + (F.col("__yb") - F.col("__ya")) * F.try_divide(F.col(frame) - F.col("__a"), F.col("__b") - F.col("__a"))
    return df.withColumn(out, F.when(F.col(y).isNotNull(), F.col(y)).when(F.col(frame) - F.col("__a") <= limit, line)).drop("__a", "__b", "__ya", "__yb")


def closest(df: DataFrame, keys: Sequence[str], frame: str, y: str, target: Column) -> DataFrame:
    """Of each series the frame whose y is nearest to the target, the first of equals."""
    return df.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(F.col(frame).alias("frame"), F.col(y).alias("y")), F.struct(F.abs(F.col(y) - target), F.col(frame))).alias("c")).select(*keys, "c.frame", "c.y")
