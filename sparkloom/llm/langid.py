"""Language identification with a bit-sliced Bloom filter of n-grams.

Each slot of the filter is a bitmask with one bit a language.  An n-gram's
slots, taken together by AND, name all languages whose training texts have it.
A text's n-grams are looked up and their bits counted by language; from each
count the false positives to be expected at that language's fill are taken off,
and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, unit
from .shingles import bounded, text_bytes

#: Training texts a language, drawn by their ids' hash (expected number), and n-grams a language, the most frequent.
TRAIN_TEXTS = 2000
TRAIN_GRAMS = 60_000
N = 5
SLOT_BITS = 20
HASHES = 3
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
#: ASCII letters stay, other ASCII is a gap; bytes of other characters stay.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' n-grams (N bytes of lower case, each gap one space, as uint64) and where each text's begin (one more entry for the end)."""
    out, starts = _grams(column)
    # Runs over a text's end belong to the text that they begin in: its last letters and the next text's first are apart by a space.
    return out, np.minimum(starts, len(out))


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """grams, with the places of the texts' bytes, which reach N - 1 further."""
    data, starts = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    data = _FOLD[data]
    gap = data == 32
    keep = np.concatenate([[True], ~(gap[1:] & gap[:-1])]) if len(data) else gap
    place = np.concatenate([[0], np.cumsum(keep)])
    data, starts = data[keep], place[starts]
    if len(data) < N:
        return np.empty(0, np.uint64), starts
    wide = data.astype(np.uint64)
    out = wide[: len(data) - N + 1].copy()
    for j in range(1, N):
        out |= wide[j : len(data) - N + 1 + j] << np.uint64(8 * j)
    return out, starts


def slots(x: np.ndarray) -> list[np.ndarray]:
    return [((x * m) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in _MULTIPLIERS[:HASHES]]


class Filter:
    """languages, and for each 64 of them (fewer: a narrower type) a mask for each slot."""

    def __init__(self, languages: list[str], grams_by_language: dict[str, np.ndarray]):
        self.languages = sorted(languages)
        kinds = [(8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)]
        self.slices: list[np.ndarray] = []
        for at in range(0, len(self.languages), 64):
            part = self.languages[at : at + 64]
            kind = next(t for n, t in kinds if len(part) <= n)
            masks = np.zeros(1 << SLOT_BITS, dtype=kind)
            for bit, language in enumerate(part):
                for s in slots(grams_by_language.get(language, np.empty(0, np.uint64))):
                    masks[s] |= kind(1 << bit)
            self.slices.append(masks)
        self.false = np.array([self._false(i) for i in range(len(self.languages))])

    def _false(self, i: int) -> float:
        masks = self.slices[i // 64]
        return float(np.mean((masks >> masks.dtype.type(i % 64)) & masks.dtype.type(1))) ** HASHES

    def counts(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """texts x languages: how many of each text's n-grams are in the language's filter."""
        out = np.zeros((len(starts) - 1, len(self.languages)))
        at = slots(x)
        for k, masks in enumerate(self.slices):
            found = masks[at[0]]
            for s in at[1:]:
                found &= masks[s]
            for bit in range(min(64, len(self.languages) - 64 * k)):
                ones = (found >> masks.dtype.type(bit)) & masks.dtype.type(1)
                sums = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
                out[:, 64 * k + bit] = sums[starts[1:]] - sums[starts[:-1]]
        return out

    def decide(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the best corrected count's share of the best two; `und`, 0 for null texts and texts without a letter."""
        return self.judge(column)[:2]

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """decide's language and score, and known: the share of the text's own n-grams that are in that language, corrected alike.

        known is 0 for `und`, and 1 for texts with a letter that are too short for an n-gram.
        """
        column = column.cast(pa.large_string()).fill_null("")
        letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
        if not self.languages:
            return ["und"] * len(column), np.zeros(len(column)), np.zeros(len(column))
        x, starts = _grams(column)
        # Runs over a text's end hold the next text's letters: they count for the language, but not for known.
        begins, ends = np.minimum(starts[:-1], len(x)), np.minimum(starts[1:], len(x))
        inside = np.maximum(starts[1:] - (N - 1), begins)
        parts = self.counts(x, np.concatenate([np.stack([begins, inside], axis=1).ravel(), ends[-1:]])) if len(begins) else np.zeros((0, len(self.languages)))
        counts = parts[0::2] + parts[1::2]
        n = (ends - begins)[:, None]
        right = np.maximum((counts - self.false * n) / (1 - np.minimum(self.false, 0.999)), 0.0) + 1e-9
        order = np.sort(right, axis=1)
        second = order[:, -2] if right.shape[1] > 1 else np.zeros(len(right))
        score = np.where(letters, order[:, -1] / (order[:, -1] + second), 0.0)
        best = right.argmax(axis=1)
        rows, own, false = np.arange(len(best)), inside - begins, self.false[best]
        known = (parts[0::2][rows, best] - false * own) / (1 - np.minimum(false, 0.999)) / np.maximum(own, 1)
        known = np.where(letters, np.where(own > 0, np.clip(known, 0.0, 1.0), 1.0), 0.0)
        return [self.languages[b] if has else "und" for b, has in zip(best, letters)], np.clip(score, 0.0, 1.0), known


def learn(docs: DataFrame, seed: int = 4_001) -> Filter:
    """docs(doc_id, text, lang): from rows with a language, about TRAIN_TEXTS texts of each by the hash of doc_id; n-grams by their number there.

    The driver gets one row a language and at most about TRAIN_GRAMS n-grams of each.
    """
    rows = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filter([], {})
    rates = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, TRAIN_TEXTS / n))])
    sample = rows.where(unit(seed, F.col("doc_id")) < F.element_at(rates, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                texts = batch.filter(pc.equal(batch.column("lang"), lang)).column("text")
                found, times = np.unique(grams(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(times, pa.int64())], ["lang", "gram", "n"])

    counted = small_batches(sample).mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    levels: dict[str, list[tuple[int, int]]] = {}
    for r in counted.groupBy("lang", F.least(F.col("n"), F.lit(5000)).alias("times")).agg(F.count("*").alias("c")).collect():
        levels.setdefault(r.lang, []).append((r.times, r.c))
    least = {}
    for lang, ls in levels.items():
        kept = 0
        for times, c in sorted(ls, reverse=True):
            if kept and kept + c > TRAIN_GRAMS:
                break
            kept, least[lang] = kept + c, times
    floor = F.create_map(*[F.lit(v) for lang, n in least.items() for v in (lang, n)])
    table = counted.where(F.col("n") >= F.element_at(floor, F.col("lang"))).select("lang", "gram").toArrow()
    counted.unpersist()
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    values = table.column("gram").to_numpy().view(np.uint64)
    return Filter(list(sizes), {lang: values[langs == lang] for lang in sizes})


def predict(docs: DataFrame, model: Filter, columns: list[str], names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The given columns of docs(..., text), and each text's language and score (with three names: and known) under `names`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("__sl_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + f", {names[0]} string, " + ", ".join(f"{name} double" for name in names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, batch.num_columns - 1):
                langs, *numbers = shared.value.judge(part.column(part.num_columns - 1))
                found = [pa.array(langs, pa.string()), *[pa.array(x, pa.float64()) for x in numbers[: len(names) - 1]]]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], [*part.schema.names[:-1], *names])

    return small_batches(kept).mapInArrow(run, schema)


def fold(modulus: int) -> "F.Column":
    """crc32 of doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from documents outside the fold 2 of 4.

    Null texts and texts without a letter are `und` with score 0; a null doc_id is in no fold and teaches.  Equal texts have one answer, and of
    tied languages the first by name; rows may repeat; texts of any length are read whole; without a learned language all are `und`; an
    empty table has no rows.
    """
    docs = held_out(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return predict(docs, learn(docs.where("not held_out")), ["doc_id", "held_out"])
