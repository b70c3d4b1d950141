"""Roles of the driver's tables: series and lines of bands from events, vectors from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series = user, frame = number in time, y = value."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), "ts", "event_id", F.col("value").alias("y"))
    return series.numbered(e, ["series"], ["ts", "event_id"]).select("series", "frame", "y")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loi = user mod 10, band = user div 10, frame = number in time, y = value."""
    return traces(spark, sf_dir).select(F.expr("series % 10").alias("loi"), F.expr("series div 10").alias("band"), "frame", "y")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp = label, id, position, angle and length from the first components."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("e"))
    return d.select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("e")[0].alias("y"), F.col("e")[1].alias("x"), F.atan2(F.col("e")[3], F.col("e")[2]).alias("angle"), F.abs(F.col("e")[4]).alias("len"))


#: The same roles as SQL for the oracle, as parts of a WITH list.
TRACES = "t AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS y FROM events)"
BANDS = "b AS (SELECT user_id % 10 AS loi, user_id // 10 AS band, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS y FROM events)"
VECTORS = (
    "v AS (SELECT label AS grp, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) AS x, "
    "atan2(CAST(embedding[4] AS DOUBLE), CAST(embedding[3] AS DOUBLE)) AS angle, abs(CAST(embedding[5] AS DOUBLE)) AS len FROM embeddings)"
)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, so that sums in another order compare equal; minus zero as zero."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})
