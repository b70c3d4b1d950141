"""Winnowing fingerprints in DataFrame expressions.

A text is lower-cased and cut into tokens (words of letters, digits and marks,
in pieces of eight at most; other visible characters one by one).  Each run of
`k` tokens has a Karp-Rabin hash; four empty tokens precede the first, so that
short texts have runs too.  From each window of `w` successive hashes the
smallest is kept, of equal ones the rightmost; the first windows are those that
end at the first, second ... hash, so a text's beginning always leaves a mark.
Any passage of w + k - 1 tokens that two texts share leaves a common hash in
both fingerprints.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_table

TOKEN = r"[\p{L}\p{N}\p{M}]{1,8}|[^\s\p{L}\p{N}\p{M}]"
#: Modulus (2^31 - 1) and base of the rolling hash; a product stays below 2^62.
MODULUS = 2147483647
BASE = 1103515245
PLACE = 2147483648
_NEVER = (1 << 63) - 1


def _run_hashes(df: DataFrame, tokens: str, k: int, out: str) -> DataFrame:
    """tokens: array<bigint> below MODULUS -> out: the hash of each run of k, by doubling: hash(2n)[i] = hash(n)[i] * B^n + hash(n)[i + n]."""

    def shifted(c: str, n: int) -> str:
        return f"slice({c}, {n + 1}, greatest(size({c}) - {n}, 0))"

    have, df = 1, df.withColumn(out, F.col(tokens))
    for bit in bin(k)[3:]:
        power = pow(BASE, have, MODULUS)
        df = df.withColumn(out, F.expr(f"zip_with(slice({out}, 1, greatest(size({out}) - {have}, 0)), {shifted(out, have)}, (a, b) -> (a * {power}L + b) % {MODULUS}L)"))
        have *= 2
        if bit == "1":
            df = df.withColumn(out, F.expr(f"zip_with(slice({out}, 1, greatest(size({out}) - 1, 0)), slice({tokens}, {have + 1}, greatest(size({tokens}) - {have}, 0)), (a, b) -> (a * {BASE}L + b) % {MODULUS}L)"))
            have += 1
    return df


def winnow(df: DataFrame, text: str, out: str, k: int = 5, w: int = 8) -> DataFrame:
    """Adds `out`, array<bigint>: hash * 2^31 + (2^31 - 1 - place) of each kept run, in order of places (tokens before the run's last).

    A null text counts as empty; a text without tokens has an empty array.  w is a power of two.
    """
    if w & (w - 1) or w < 1 or k < 1:
        raise ValueError("w must be a power of two, k 1 or more")
    t, h = f"__sl_{out}_t", f"__sl_{out}_h"
    df = df.withColumn(t, F.expr(f"regexp_extract_all(lower(coalesce({text}, '')), '{TOKEN}', 0)".replace("\\", "\\\\")))
    df = df.withColumn(t, F.expr(f"if(size({t}) = 0, cast(array() as array<bigint>), concat(array_repeat(0L, {k - 1}), transform({t}, x -> pmod(xxhash64(x), {MODULUS}L))))"))
    df = _run_hashes(df, t, k, h)
    df = df.withColumn(h, F.expr(f"transform({h}, (x, i) -> x * {PLACE}L + ({PLACE - 1}L - i))"))
    df = df.withColumn(t, F.expr(f"size({h})")).withColumn(h, F.expr(f"concat(array_repeat({_NEVER}L, {w - 1}), {h})"))
    n = 1
    while n < w:
        df = df.withColumn(h, F.expr(f"zip_with({h}, slice({h}, {n + 1}, greatest(size({h}) - {n}, 0)), (a, b) -> if(b < a, b, a))"))
        n *= 2
    return df.withColumn(out, F.expr(f"array_distinct(slice({h}, 1, {t}))")).drop(t, h)


def hashes(kept: str) -> Column:
    return F.expr(f"array_distinct(transform({kept}, v -> shiftright(v, 31)))")


def as_string(kept: str) -> Column:
    """`hash@place` of each kept run, by spaces; the hash in hexadecimal."""
    return F.expr(f"array_join(transform({kept}, v -> concat(hex(shiftright(v, 31)), '@', {PLACE - 1}L - (v & {PLACE - 1}L))), ' ')")


def likeness(a: str, b: str) -> Column:
    """Dice coefficient of two arrays of distinct hashes; 1 if both are empty."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, 2D * size(array_intersect({a}, {b})) / greatest(size({a}) + size({b}), 1))")


def _bounds(df: DataFrame, place: Column, n: int) -> list[tuple[int, int]]:
    """Quantiles of `place` that cut df into about n parts of equal rows, ascending, and how many of the quantiles each one is."""
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = df.agg(F.percentile_approx(place, probs, F.lit(10 * n))).first()[0] or []
    return sorted(Counter(found).items())


def _literal(values: list, kind: str) -> Column:
    """A constant array, as one literal in the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def with_next(df: DataFrame, key: str, bucket: str, guest: str) -> DataFrame:
    """Deals rows into buckets of successive keys (descending, null last), so that a window over a bucket (inside_bucket) sees each row's successor.

    The head of each bucket is also put, as guest, behind the rows of the
    bucket before (the first one's behind the last).  Buckets follow quantiles
    of the key: two numbers each reach the driver, and a table of one row each
    (8 times the shuffle partitions at most) is broadcast.  Rows of one key are
    in the order of a hash of their places in the input; a key that is several
    quantiles, as one of many rows is, has so many buckets by that hash.  df
    must have the same partitions each time it is computed, as a stored table has.
    """
    spark = df.sparkSession
    place = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    df = df.withColumn("__sl_row", F.monotonically_increasing_id()).withColumn("__sl_place", place)
    df = df.withColumn("__sl_h", F.xxhash64(F.lit(3_001), "__sl_row"))
    found = _bounds(df, F.col("__sl_place"), 8 * shuffle_partitions(spark))
    if found:
        width = math.isqrt(len(found)) + 1
        values = [v for v, _ in found]
        groups = _literal([values[i : i + width] for i in range(0, len(values), width)], "array<array<bigint>>")
        tops = _literal(values[::width], "array<bigint>")
        # Bounds up to the place: whole groups, then those of the last group.
        group = F.size(F.filter(tops, lambda x: x <= F.col("__sl_place")))
        inside = F.size(F.filter(F.element_at(groups, group), lambda x: x <= F.col("__sl_place")))
        df = df.withColumn("__sl_at", F.when(group == 0, 0).otherwise((group - 1) * width + inside))
        at = F.greatest("__sl_at", F.lit(1))
        bound, times = F.element_at(_literal(values, "array<bigint>"), at), F.element_at(_literal([n for _, n in found], "array<int>"), at)
        hot = (F.col("__sl_at") > 0) & (bound == F.col("__sl_place")) & (times > 1)
        part = F.when(hot, 1 + F.floor((F.shiftrightunsigned("__sl_h", 11) * F.lit(2.0**-53)) * times)).otherwise(0)
        # The hash orders rows as a signed number, its parts are those of the unsigned one: flipping the sign bit makes both the same.
        df = df.withColumn(bucket, (F.lit(len(found)) - F.col("__sl_at")).cast("long") * (1 << 20) + part)
        df = df.withColumn("__sl_h", F.col("__sl_h").bitwiseXOR(F.lit(-(1 << 63)))).drop("__sl_at")
    else:
        df = df.withColumn(bucket, F.lit(0).cast("long"))
    first = F.max(F.struct("__sl_place", F.bitwise_not("__sl_h").alias("h"), (-F.col("__sl_row")).alias("row"))).alias("head")
    heads = sorted(df.groupBy(bucket).agg(first).select(bucket, -F.col("head.row")).collect())
    seats = [{bucket: b, "__sl_head": row, "__sl_before": heads[i - 1][0]} for i, (b, row) in enumerate(heads)]
    seats = small_table(spark, seats, f"{bucket} bigint, __sl_head bigint, __sl_before bigint")
    df = df.join(F.broadcast(seats), bucket, "left")
    own = F.struct(F.col(bucket).alias("b"), F.lit(False).alias("g"))
    also = F.struct(F.col("__sl_before").alias("b"), F.lit(True).alias("g"))
    df = df.withColumn("__sl_seat", F.explode(F.when(F.col("__sl_row") == F.col("__sl_head"), F.array(own, also)).otherwise(F.array(own))))
    return df.withColumn(bucket, F.col("__sl_seat.b")).withColumn(guest, F.col("__sl_seat.g")).drop("__sl_seat", "__sl_head", "__sl_before")


def inside_bucket(bucket: str, guest: str) -> WindowSpec:
    """The window in which each row of with_next's buckets is followed by its successor."""
    return Window.partitionBy(bucket).orderBy(guest, F.desc("__sl_place"), "__sl_h", "__sl_row")


def fingerprint_documents(docs: DataFrame, k: int = 5, w: int = 8) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likenesses (see op3).

    Needs doc_id (integer) and text; other columns are left out.  Null texts
    count as empty, rows of a null doc_id come last; rows of one doc_id follow
    each other in any order; a single row's next is itself; no rows give none.
    docs is a stored table, or one that is computed alike each time.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(df, "doc_id", "__sl_b", "__sl_g")
    order = inside_bucket("__sl_b", "__sl_g")
    df = df.withColumn("__sl_next", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text").cast("long"))
    df = winnow(df, "text", "__sl_fp", k, w).withColumn("__sl_f", hashes("__sl_fp"))
    df = df.withColumn("__sl_fn", F.lead("__sl_f").over(order)).where(~F.col("__sl_g"))
    df = df.withColumn("__sl_m", F.expr("cast(n_chars div 3 as int)"))
    df = df.withColumn("__sl_e", F.expr("concat(substring(text, 1, cast(n_chars as int) - __sl_m), substring(coalesce(__sl_next, ''), 1, __sl_m))"))
    df = winnow(df, "__sl_e", "__sl_ep", k, w).withColumn("__sl_ef", hashes("__sl_ep"))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("__sl_e"), 256).alias("edited_sha256"),
        as_string("__sl_fp").alias("fingerprint"),
        as_string("__sl_ep").alias("edited_fingerprint"),
        likeness("__sl_f", "__sl_ef").alias("near_edited"),
        likeness("__sl_f", "__sl_fn").alias("near_next"),
    )


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of all documents and of their edited texts: five tokens a run, eight runs a window.

    Nulls, empty and long texts, rows of one doc_id and empty tables as in `fingerprint_documents`; equal hashes in a window keep the rightmost.
    """
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
