"""Document quality by hierarchical empirical Bayes.

A logistic regression on byte and word statistics gives each document evidence:
the log-likelihood ratio of good to bad.  Sites have two levels, hosts and the
paths below them.  A host's rate of good documents has a Beta prior whose mean
and strength come from all hosts' rates (method of moments); a path's rate has
one around its host's posterior mean.  Sparse sites thus shrink towards their
host, sparse hosts towards the corpus.  A document's posterior odds are its
path's odds times its evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage, unit
from .mixing import BROADCAST_SOURCES
from .shingles import bounded, spans, text_bytes, word_spans
from .toxicity import logistic

#: Labelled rows of each label that training reads (expected number, by the hash of doc_id).
TRAIN_ROWS = 4000
#: Weight in a site's rate of an unlabelled document's own posterior, against 1 for a label.
SOFT = 0.1
#: Bounds of a prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", bytes(range(65, 91)), b"0123456789", b" ", b"\n", b".,;:", b"!?", b"#$%&*@^~\\", b"|", b"<>{}[]()=/_+-\"'", bytes(range(128, 256))]


def features(column: pa.Array) -> np.ndarray:
    """texts x (2 * classes + 5): shares of byte classes and their square roots; logs of bytes and words, mean word length, share of distinct words, words a line."""
    data, starts = text_bytes(column)
    n = len(starts) - 1
    length = np.maximum(np.diff(starts) - 1, 1)
    kind = np.full(256, len(_CLASSES), dtype=np.int64)
    for i, chars in enumerate(_CLASSES):
        kind[list(chars)] = i
    text = np.repeat(np.arange(n), np.diff(starts))
    counts = np.bincount(text * (len(_CLASSES) + 1) + kind[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)[:, : len(_CLASSES)].astype(float)
    counts[:, 3] -= 1
    shares = np.clip(counts / length[:, None], 0, 1)
    begins, ends = word_spans(data)
    where = np.searchsorted(starts, begins, side="right") - 1
    words = np.bincount(where, minlength=n)
    codes, _ = pd.factorize(spans(data, begins, ends)) if len(begins) else (np.empty(0, np.int64), None)
    distinct = np.bincount(pd.unique(where * (len(codes) + 1) + codes) // (len(codes) + 1), minlength=n)
    one = np.maximum(words, 1)
    more = [np.log1p(length), np.log1p(words), np.minimum(np.bincount(where, weights=ends - begins, minlength=n) / one, 30) / 10, distinct / one, np.log1p(words / (counts[:, 4] + 1))]
    return np.column_stack([shares, np.sqrt(shares), *more])


class Evidence:
    """Standardised logistic regression; base: the training label's rate, which the evidence leaves out."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, base: float):
        self.mean, self.scale, self.weights, self.base = mean, scale, weights, base

    def ratio(self, column: pa.Array) -> np.ndarray:
        """Log-likelihood ratio of each text, within 8 either way."""
        x = (features(column) - self.mean) / self.scale
        return np.clip(x @ self.weights[:-1] + self.weights[-1] - np.log(self.base / (1 - self.base)), -8, 8)


def learn(docs: DataFrame, labels: DataFrame, seed: int = 7_001) -> Evidence:
    """docs(doc_id, text), labels(doc_id, label) of one row a document: from about TRAIN_ROWS rows of each label; without both labels no evidence."""
    sizes = {r.label: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    width = 2 * len(_CLASSES) + 5
    if len(sizes) < 2:
        return Evidence(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.5)
    rate = {y: min(1.0, TRAIN_ROWS / n) for y, n in sizes.items()}
    chosen = labels.where(unit(seed, F.col("doc_id")) < F.when(F.col("label") == 1, rate[1]).otherwise(rate[0]))
    sample = docs.join(F.broadcast(chosen), "doc_id").select("label", "text")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(features(part.column(1))), pa.list_(pa.float64()))], ["label", "x"])

    table = small_batches(sample).mapInArrow(described, "label int, x array<double>").toArrow()
    y = table.column("label").to_numpy()
    if not len(y) or y.min() == y.max():
        return Evidence(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.5)
    x = np.stack(table.column("x").to_numpy(zero_copy_only=False))
    order = np.lexsort((*x.T[::-1], y))
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Evidence(mean, scale, logistic((x - mean) / scale, y.astype(float), np.ones(len(y))), float(y.mean()))


def _joined(df: DataFrame, table: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Null keys meet null keys."""
    right = table.select(*[F.col(k).alias(f"__sl_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__sl_{k}")) for k in keys]
    return df.join(F.broadcast(right) if rows <= BROADCAST_SOURCES else right, on, "left").drop(*[f"__sl_{k}" for k in keys])


def _strength(n: Column, rate: Column, centre: Column) -> Column:
    """Beta prior strength by moments: spread of the sites' rates around their centre, less what their counts explain; sites weigh as their counts."""
    weight = F.sum(n)
    spread = F.sum(n * (rate - centre) * (rate - centre)) / weight
    mid = F.sum(n * centre) / weight
    noise = F.sum(centre * (1 - centre)) / weight
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.greatest(mid * (1 - mid) / between - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def posteriors(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, label) -> doc_id, evidence, host_rate, path_rate, score, kept (score >= 0.5).

    host and path: expressions of docs' columns; null is a site like any other.  A document's rates are those of the other documents of its host and path.
    Null and empty texts have the evidence of their statistics (zeros); rows of
    one doc_id share its label; a label other than 0 and 1 is none.
    """
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    model = learn(docs.select("doc_id", "text"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 3):
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(shared.value.ratio(part.column(3)))], ["doc_id", "host", "path", "evidence"])

    sites = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    told = small_batches(sites).mapInArrow(score, "doc_id bigint, host string, path string, evidence double")
    p = 1 / (1 + F.exp(-F.col("evidence") - F.lit(float(np.log(model.base / (1 - model.base))))))
    weight = F.when(F.col("label").isNotNull(), 1.0).otherwise(SOFT).alias("__sl_w")
    told = told.join(labels, "doc_id", "left").select("doc_id", "host", "path", "evidence", weight, F.coalesce(F.col("label").cast("double"), p).alias("__sl_v"))
    told = stage(told, "evidence")
    paths = told.groupBy("host", "path").agg(F.sum("__sl_w").alias("n"), F.sum(F.col("__sl_w") * F.col("__sl_v")).alias("k"))
    paths = stage(paths, "paths")
    hosts = stage(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk")), "hosts")
    n_hosts, n_paths = hosts.count(), paths.count()
    total = hosts.agg(F.sum("hk") / F.sum("hn")).first()[0]
    centre = F.lit(float(min(max(total if total is not None else 0.5, 1e-4), 1 - 1e-4)))
    own = F.col("hk") / F.col("hn")
    strength = hosts.agg(_strength(F.col("hn"), own, centre)).first()[0] or LEAST_STRENGTH

    def shrunk(k: Column, n: Column, around: Column, by: float) -> Column:
        return (F.greatest(k, F.lit(0.0)) + by * around) / (F.greatest(n, F.lit(0.0)) + by)

    paths = _joined(paths, hosts, ["host"], n_hosts)
    rate = shrunk(F.col("hk"), F.col("hn"), centre, strength)
    inner = paths.agg(_strength(F.col("n"), F.col("k") / F.col("n"), rate)).first()[0] or LEAST_STRENGTH
    out = _joined(told, stage(paths, "rates"), ["host", "path"], n_paths)
    # What a document says about its own site is no evidence about the document.
    w, mass = F.col("__sl_w"), F.col("__sl_w") * F.col("__sl_v")
    out = out.withColumn("host_rate", shrunk(F.col("hk") - mass, F.col("hn") - w, centre, strength))
    out = out.withColumn("path_rate", shrunk(F.col("k") - mass, F.col("n") - w, F.col("host_rate"), inner))
    odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    out = out.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: hosts are their sources, paths the sources' languages.

    Nulls, empty texts, repeated rows and other labels as in `posteriors`; an empty table has no rows; equal texts of one site have one score
    if their labels are equal too.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return posteriors(docs, labels, F.col("source"), F.col("lang"))
