"""Signal operators that need a numpy kernel: one series or profile is one call."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import signals


def per_series(df: DataFrame, keys: Sequence[str], order: str, y: str, out: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds out = kernel(y in order), for each key; NULL is NaN on the way in and out.

    Series travel as arrays through one grouping, so Python sees a row a series
    and only this column; the rows' other columns stay where they are in the JVM.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), *[F.col(c) for c in rest]))).alias("__rows"))

    @pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda a: [None if np.isnan(x) else float(x) for x in kernel(np.array([np.nan if x is None else x for x in a], dtype=float))])

    packed = packed.withColumn("__v", run(F.transform("__rows", lambda r: r[y].cast("double"))))
    rows = packed.withColumn("__r", F.explode(F.arrays_zip("__rows", "__v")))
    return rows.select(*keys, *[F.col(f"__r.__rows.{c}").alias(c) for c in rest], F.col("__r.__v").alias(out))


def smoothed(df: DataFrame, keys: Sequence[str], order: str, y: str, out: str, window: int = 13, polyorder: int = 5) -> DataFrame:
    return per_series(df, keys, order, y, out, lambda x: signals.nan_savgol(x, window, polyorder))


def low_passed(df: DataFrame, keys: Sequence[str], order: str, y: str, out: str, n: int = 6, cutoff: float = 0.25, least: int = 31) -> DataFrame:
    return per_series(df, keys, order, y, out, lambda x: signals.nan_low_pass(x, n, cutoff, least))


def filled(df: DataFrame, keys: Sequence[str], order: str, y: str, out: str, limit: int = 3) -> DataFrame:
    return per_series(df, keys, order, y, out, lambda x: signals.fill_gaps(x, limit))


def detected_peaks(kymograph: DataFrame, threshold: float = 0.2, min_distance: float = 1.4, width: float = 0.5) -> DataFrame:
    """kymograph(..., x_pos array, profile array) -> + peaks array of positions; distances in the unit of x_pos."""

    @pandas_udf("array<double>")
    def run(x: pd.Series, v: pd.Series) -> pd.Series:
        def one(a, b):
            a, b = np.asarray(a, dtype=float), np.array([np.nan if i is None else i for i in b], dtype=float)
            step = a[1] - a[0] if len(a) > 1 else 1.0
            return signals.band_positions(a, b, threshold, int(round(min_distance / step)), int(round(width / step))).tolist()

        return pd.Series([one(a, b) for a, b in zip(x, v)])

    return kymograph.withColumn("peaks", run("x_pos", "profile"))


def spacings(profiles: DataFrame, pixelsize: float, low: float = 1.0, high: float = 3.0, factor: int = 0) -> DataFrame:
    """profiles(..., profile array) -> + spacing, offset (NULL outside [low, high])."""

    @pandas_udf("struct<spacing double, offset double>")
    def run(v: pd.Series) -> pd.DataFrame:
        found = [signals.band_spacing(np.asarray(a, dtype=float), pixelsize, (low, high), factor=factor) for a in v]
        return pd.DataFrame([(None if np.isnan(s) else s, None if np.isnan(o) else o) for s, o in found], columns=["spacing", "offset"])

    return profiles.withColumn("__s", run("profile")).select("*", "__s.spacing", "__s.offset").drop("__s")


def tracked(peaks: DataFrame, key: str, search_range: float = 2.0, memory: int = 10, first_frame_only: bool = False) -> DataFrame:
    """peaks(key, frame, x) -> + track; first_frame_only: without tracks that begin later. One key is one task."""
    kind = dict(peaks.dtypes)

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "x"])
        frames = np.arange(pdf["frame"].min(), pdf["frame"].max() + 1)
        found = np.split(pdf["x"].to_numpy(), np.searchsorted(pdf["frame"].to_numpy(), frames[1:]))
        tracks = np.concatenate(signals.linked(found, search_range, memory))
        out = pd.DataFrame({key: group[0], "frame": pdf["frame"].to_numpy(), "x": pdf["x"].to_numpy(), "track": tracks})
        return out[out["track"] < len(found[0])] if first_frame_only else out

    return peaks.select(key, "frame", "x").groupBy(key).applyInPandas(run, f"{key} {kind[key]}, frame {kind['frame']}, x double, track bigint")


def spectrum(df: DataFrame, keys: Sequence[str], order: str, y: str, state: str, dt: float, n_scales: int = 60, low: float = 6.0, high: float = 180.0) -> DataFrame:
    """Mean Morlet magnitude over frames of state 1, for each key and frequency: (keys, scale, frequency, magnitude)."""
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(y).cast("double").alias("v"), F.col(state).cast("int").alias("s")))).alias("r"))
    scales = np.geomspace(low, high, n_scales)

    @pandas_udf("array<struct<scale double, frequency double, magnitude double>>")
    def run(v: pd.Series, s: pd.Series) -> pd.Series:
        def one(a, b):
            m, f = signals.morlet(np.array([np.nan if i is None else i for i in a], dtype=float), dt, scales)
            on = np.array(b) == 1
            mean = m[:, on].mean(axis=1) if on.any() else np.full(len(scales), np.nan)
            return [{"scale": float(x), "frequency": float(q), "magnitude": None if np.isnan(z) else float(z)} for x, q, z in zip(scales, f, mean)]

        return pd.Series([one(a, b) for a, b in zip(v, s)])

    found = packed.withColumn("p", F.explode(run(F.transform("r", lambda x: x["v"]), F.transform("r", lambda x: x["s"]))))
    return found.select(*keys, "p.scale", "p.frequency", "p.magnitude")


def spectrum_summary(spec: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spec(keys, ..., scale, frequency, magnitude) of many series -> (keys, scale, frequency, n, magnitude_mean, magnitude_std): over the series, missing magnitudes left out."""
    return spec.groupBy(*keys, "scale", "frequency").agg(F.count("magnitude").alias("n"), F.avg("magnitude").alias("magnitude_mean"), F.stddev_pop("magnitude").alias("magnitude_std"))


def spectrum_peaks(spec: DataFrame, keys: Sequence[str], split: float) -> DataFrame:
    """Frequency and magnitude of the highest value below and above the split frequency; the second is missing where it sits on the split's edge."""
    present = spec.where("magnitude is not null")
    edge = present.where(F.col("frequency") >= split).groupBy(*keys).agg(F.min("frequency").alias("edge"))
    best = present.groupBy(*keys).agg(
        F.max_by(F.struct("frequency", "magnitude"), F.when(F.col("frequency") < split, F.col("magnitude"))).alias("a"), F.max_by(F.struct("frequency", "magnitude"), F.when(F.col("frequency") >= split, F.col("magnitude"))).alias("b")
    )
    out = best.join(edge, list(keys), "left")
    second = F.when(F.col("b.frequency") > F.col("edge"), F.col("b"))
    return out.select(*keys, F.col("a.frequency").alias("frequency_1"), F.col("a.magnitude").alias("magnitude_1"), second["frequency"].alias("frequency_2"), second["magnitude"].alias("magnitude_2"))
