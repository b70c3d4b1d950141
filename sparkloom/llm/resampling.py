"""Importance resampling of documents towards a target distribution, over hashed word runs.

Features are runs of words; each falls into one of `buckets` by its crc32.  A
first pass gives one vector of counts a partition, merged by treeReduce, for the
documents and for the target; a bucket's gain is the log ratio of its smoothed
shares.  A second pass sums each document's gains, read from a broadcast vector.
The documents of the highest gain plus Gumbel noise are drawn, which is sampling
without replacement by the weights exp(gain).
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches, small_table, stage
from .shingles import bounded, text_bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]
#: Bytes of words: digits, small letters and all bytes of characters beyond ASCII.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
#: Longer features are hashed one by one, shorter ones byte by byte of all at once.
LONG = 48


def _crc_table() -> np.ndarray:
    """The byte table of the reflected polynomial that crc32 uses."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table.astype(np.uint32)


CRC = _crc_table()


def span_crc32(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of the byte ranges [begin, end)."""
    lengths = ends - begins
    out = np.zeros(len(begins), dtype=np.uint32)
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = zlib.crc32(data[begins[i] : ends[i]])
    short = np.where(lengths > LONG, 0, lengths).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    longer = len(short) - np.cumsum(np.bincount(short, minlength=LONG + 1))
    at, crc = begins[order], np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(LONG):
        n = int(longer[j])
        if not n:
            break
        crc[:n] = CRC[(crc[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    n = int(longer[0])
    out[order[:n]] = ~crc[:n]
    return out


def features(column: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of every run of 1 to `longest` words of a string column, the number of the text of each, and how many words each text has."""
    data, starts = text_bytes(column)
    data = LOWER[data]
    inside = IN_WORD[data]
    # A word keeps the byte behind it, as a space: then the words of a text lie joined by one space.
    stop = np.zeros(len(data), dtype=bool)
    stop[1:] = inside[:-1] & ~inside[1:]
    data[stop] = 32
    keep = inside | stop
    data, stop = data[keep], stop[keep]
    ends = np.flatnonzero(stop)
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(ends)].astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(keep)])
    first = np.searchsorted(begins, kept[starts])
    text = np.repeat(np.arange(len(column)), np.diff(first))
    crcs, texts = [], []
    for n in range(1, longest + 1):
        at = np.arange(max(len(begins) - n + 1, 0))
        at = at[text[at] == text[at + n - 1]]
        crcs.append(span_crc32(data, begins[at], ends[at + n - 1]))
        texts.append(text[at])
    return np.concatenate(crcs), np.concatenate(texts), np.diff(first)


def bucket_counts(df: DataFrame, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts (first column) fall into each bucket: a vector a partition, merged by treeReduce.

    Null texts have none; an empty table counts none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in bounded(batch, 0):
                total += np.bincount(features(part.column(0), longest)[0] % np.uint32(buckets), minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = small_batches(df).mapInArrow(count, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], dtype=np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, dtype=np.int64)
    return vectors.treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [(float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_features, weight: the sum of the gains of all features of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = ("doc_id", "n_words", "n_features", "weight")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)
        for batch in batches:
            for part in bounded(batch, 1):
                crc, text, words = features(part.column(1), longest)
                # Sums of integers below 2^53 are exact.
                weight = np.bincount(text, weights=gain[crc % np.uint32(len(gain))], minlength=part.num_rows)
                found = np.bincount(text, minlength=part.num_rows)
                columns = [part.column(0).cast(pa.int64())] + [pa.array(x.astype(np.int64)) for x in (words, found, weight)]
                yield pa.record_batch(columns, names=list(names))

    return small_batches(docs.select("doc_id", "text")).mapInArrow(weigh, ", ".join(f"{c} bigint" for c in names))


def drawn(scored: DataFrame, order: list, draw: int, out: str) -> DataFrame:
    """Adds `out`: 1, 2, 3 ... for the first `draw` rows of a stored table by `order` (which must tell all rows apart), null for the others.

    Rows are dealt by ranges of the order; one number a range reaches the driver, and only ranges that hold drawn rows are sorted.
    """
    spark = scored.sparkSession
    dealt = scored.repartitionByRange(shuffle_partitions(spark), *order).withColumn("__sl_part", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    sizes = sorted(dealt.groupBy("__sl_part").count().collect())
    before = list(itertools.accumulate((n for _, n in sizes), initial=0))
    reached = [{"__sl_part": p, "__sl_before": b} for (p, _), b in zip(sizes, before) if b < draw]
    reached = F.broadcast(small_table(spark, reached, "__sl_part int, __sl_before bigint"))
    number = F.row_number().over(Window.partitionBy("__sl_part").orderBy(*order)) + F.col("__sl_before")
    top = dealt.join(reached, "__sl_part").withColumn(out, number)
    top = top.withColumn(out, F.when(F.col(out) <= draw, F.col(out)).cast("long")).drop("__sl_before")
    rest = dealt.join(reached, "__sl_part", "left_anti").withColumn(out, F.lit(None).cast("long"))
    return top.unionByName(rest).drop("__sl_part")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score, rank.

    Of the documents with `least_words` words, floor(percent * N / 100) are drawn; others have a null rank.  Null and empty texts have
    no features and weight 0; an empty target or an empty table of documents gives gains of the smoothing alone; rows of a null doc_id
    draw the noise of an empty id, come last among ties; rows of one doc_id and score are ranked in some order; other columns are left out.
    """
    gain = gains(bucket_counts(docs.select("text"), longest, buckets), bucket_counts(target.select("text"), longest, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise)
    scored = stage(scored.withColumn("__sl_row", F.monotonically_increasing_id()), "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    draw = fit.count() * percent // 100
    ranked = drawn(fit, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__sl_row")], draw, "rank")
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(short).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of those with 20 words drawn towards the benchmark's texts, by single words in 10,000 buckets.

    Nulls, empty texts, ties, repeated rows and empty tables as in `resampled`.
    """
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
