"""Helpers that the corpus operators share: the shared folder, staged tables and small literal tables."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import clean, drop_staged, shared_folder, sized, stage

__all__ = ["clean", "drop_staged", "shared_folder", "sized", "stage"]

#: A word of the size and shingle contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of one Arrow batch at most: texts travel whole, and both sides of the pipe hold a batch or two.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's limit for Arrow batches to BATCH_BYTES, for operators whose Python side reads texts; gives df back."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.match(r"\d+", conf.get(key))
    if not found or not 0 < int(found[0]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A DataFrame of a few driver-side rows, made by JSON parsing in the plan: no RDD, no Python worker."""
    if not rows:
        return spark.createDataFrame([], schema)
    literal = F.lit(json.dumps(rows))
    return spark.range(1).select(F.explode(F.from_json(literal, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit(seed: int, *columns) -> "F.Column":
    """A uniform number in [0, 1) that the columns' values decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) * F.lit(2.0**-53)


def finite(x: float) -> float:
    return x if math.isfinite(x) else 0.0
