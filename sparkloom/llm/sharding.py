"""Uniform sharding through a hypergeometric communication matrix.

A uniform random permutation of N rows that is cut into shards of fixed sizes
sends to shard j, from an input block of n rows, a multivariate hypergeometric
number of rows.  So the counts are drawn first, exactly, on the driver; each
block is permuted locally and cut by its row of the matrix; rows then travel
once, and each shard is permuted again.  Shard sizes hold exactly.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_table, stage

#: Entries of the communication matrix that the driver draws and broadcasts, at most.
MATRIX_ENTRIES = 1 << 20
#: Slots of a shard are found in this many pieces at least, so that no task has a whole shard.
MIN_PIECES = 64
ROWS_A_PIECE = 1 << 20


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement come from the good ones; any size.

    numpy draws up to 1e9 rows; beyond, the distribution is inverted over all
    numbers whose probability a double can hold (40 standard deviations hold
    them).  Either way the law is exact but for the rounding of doubles.
    """
    low, high = max(0, n - bad), min(n, good)
    if low >= high:
        return low
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    sd = math.sqrt(max(mean * (bad / total) * (total - n) / (total - 1), 1.0))
    first, last = max(low, int(mean - 40 * sd)), min(high, int(mean + 40 * sd) + 1)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Counts from each block to each shard: rows sum to block_rows, columns to shard_rows, drawn as a uniform permutation would have them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = list(shard_rows)
    out = np.zeros((len(block_rows), len(shard_rows)), dtype=np.int64)
    for b, rows in enumerate(block_rows):
        rest = sum(left)
        for j, room in enumerate(left):
            rest -= room
            take = draw_hypergeometric(rng, room, rest, rows)
            out[b, j] = take
            rows -= take
        left = [x - int(t) for x, t in zip(left, out[b])]
    return out


def even_sizes(rows: int, n_shards: int) -> list[int]:
    return [rows // n_shards + (j < rows % n_shards) for j in range(n_shards)]


def hypergeometric_shuffle(df: DataFrame, n_shards: int, seed: int = 20_117) -> DataFrame:
    """df's rows, uniformly permuted into n_shards shards whose counts differ by one at most.

    Adds `shard` (int, from 0) and `slot` (long, gapless from 0 in each shard).
    Input columns of those names, or that start with `__sl_`, are replaced.
    Nulls in any column and repeated rows are rows like any other; an empty
    table gives an empty result.  Cost: one written copy of the given columns
    (permuted blocks), one shuffle of it, and a broadcast of at most
    MATRIX_ENTRIES counts, whatever the input.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    spark: SparkSession = df.sparkSession
    own = [c for c in df.columns if c not in ("shard", "slot") and not c.startswith("__sl_")]
    blocks = max(1, MATRIX_ENTRIES // n_shards)
    low = F.lit((1 << 33) - 1)
    # Local permutation: each input partition is sorted by a random key; a row's place is its local row number.
    permuted = (
        df.select(*[F.col(f"`{c}`") for c in own])
        .coalesce(blocks)
        .withColumn("__sl_row", F.monotonically_increasing_id())
        .withColumn("__sl_block", F.spark_partition_id())
        .sortWithinPartitions(F.xxhash64(F.lit(seed), F.col("__sl_row")), "__sl_row")
        .withColumn("__sl_rank", F.monotonically_increasing_id().bitwiseAND(low))
        .drop("__sl_row")
    )
    permuted = stage(permuted, "permuted")
    counts = sorted(permuted.groupBy("__sl_block").agg(F.max("__sl_rank") + 1).collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], even_sizes(total, n_shards), seed)
    cuts = [{"__sl_block": b, "__sl_cuts": np.cumsum(row).tolist()} for (b, _), row in zip(counts, matrix)]
    cuts = small_table(spark, cuts, "__sl_block int, __sl_cuts array<bigint>")
    bits = max(MIN_PIECES, math.ceil(total / n_shards / ROWS_A_PIECE)).bit_length() - 1
    key = F.xxhash64(F.lit(seed + 1), F.col("__sl_block"), F.col("__sl_rank"))
    dealt = (
        permuted.join(F.broadcast(cuts), "__sl_block")
        .withColumn("shard", F.expr("size(filter(__sl_cuts, c -> c <= __sl_rank))"))
        .drop("__sl_cuts")
        .withColumn("__sl_key", key)
        .withColumn("__sl_piece", F.shiftrightunsigned("__sl_key", 64 - bits).cast("int"))
    )
    before = Window.partitionBy("shard").orderBy("__sl_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "__sl_piece").agg(F.count("*").alias("__sl_n"))
    starts = starts.select("shard", "__sl_piece", F.coalesce(F.sum("__sl_n").over(before), F.lit(0)).alias("__sl_start"))
    # Second permutation: pieces follow each other by the key's high bits, rows in a piece by the whole key.
    inside = Window.partitionBy("shard", "__sl_piece").orderBy("__sl_key", "__sl_block", "__sl_rank")
    return (
        dealt.withColumn("__sl_at", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "__sl_piece"])
        .withColumn("slot", F.col("__sl_start") + F.col("__sl_at") - 1)
        .select(*[F.col(f"`{c}`") for c in own], "shard", "slot")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their texts, into shards 0 to 39 under the law `rows`; size and text_crc32 are those of the sharded texts.

    Size: UTF-8 bytes (null: 0) plus 16; a null text has a null text_crc32.  Rows that repeat, of a null doc_id too, are rows like any other and
    have slots of their own; an empty table has no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return hypergeometric_shuffle(docs, 40).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
