"""Near-duplicate components by b-bit MinHash, confirmed on full shingle sets.

1.  Each text becomes a set of shingle hashes, a digest of the set, `BANDS` keys
    of `ROWS` minima each, and a signature of the lowest `BITS` bits of all
    minima.  Texts of one digest are a class; its smallest id stands for it.
2.  Representatives that share a band key are compared by their signatures:
    equal low bits, corrected for chance, estimate the similarity.  Pairs within
    MARGIN standard errors of the limit, or above it, join clusters.
3.  Inside clusters pairs are confirmed on full sets, unless a chain of
    confirmed links joins them already.  Components of confirmed links result.

Groups of any size are dealt out in blocks of bounded size.  Members first meet
in blocks; those that are not in a group's largest component then visit all its
other blocks, so that every pair in different components has been compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import drop_staged, sized, small_batches, stage
from .shingles import bounded, shingle_sets

#: 40 bands of 5 minima: a pair of similarity 0.8 shares no band once in 7 million pairs, one of 0.85 once in 15 billion.
BANDS, ROWS = 40, 5
BITS = 2
#: Pairs are confirmed on full sets if their estimate is less than so many standard errors below the limit.
MARGIN = 5.0
#: Sets of fewer shingles, whose estimates spread a little wider, get a wider margin.
SMALL_SET, SMALL_MARGIN = 64, 8.0
#: Members of a bucket or a cluster that one block holds.
BUCKET_BLOCK, CLUSTER_BLOCK = 1024, 128
_RNG = np.random.Generator(np.random.PCG64(0xB17))
MULTIPLIERS = (_RNG.integers(0, 1 << 31, size=BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
ADDENDS = _RNG.integers(0, 1 << 32, size=BANDS * ROWS, dtype=np.uint32)[:, None]
MIX = (_RNG.integers(0, 1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each permutation's values over a set: uint32[BANDS * ROWS]."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (MULTIPLIERS * x[None, i : i + 1024] + ADDENDS).min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, from its minima and its number."""
    with np.errstate(over="ignore"):
        x = (low.reshape(BANDS, ROWS).astype(np.uint64) * MIX).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def packed(low: np.ndarray) -> bytes:
    """The low BITS bits of the minima: bit planes one after another, each filled up to whole 64-bit words."""
    planes = []
    for b in range(BITS):
        bits = np.packbits(((low >> np.uint32(b)) & np.uint32(1)).astype(np.uint8))
        planes.append(bits.tobytes().ljust(-(-len(bits) // 8) * 8, b"\0"))
    return b"".join(planes)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (uint64[..., words]), corrected for equal bits by chance."""
    planes = (a ^ b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], BITS, -1)
    differ = planes[..., 0, :]
    for i in range(1, BITS):
        differ = differ | planes[..., i, :]
    equal = 1.0 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) / (BANDS * ROWS)
    chance = 0.5**BITS
    return (equal - chance) / (1.0 - chance)


def lowest_estimate(limit: float, margin: float = MARGIN) -> float:
    chance = 0.5**BITS
    p = chance + (1 - chance) * limit
    return limit - margin * math.sqrt(p * (1 - p) / (BANDS * ROWS)) / (1 - chance)


def _described(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 1):
                n, digests, signatures, bands = [], [], [], []
                for x in shingle_sets(part.column(1), k):
                    n.append(len(x))
                    digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                    low = minima(x) if len(x) else None
                    signatures.append(packed(low) if len(x) else None)
                    bands.append(band_keys(low) if len(x) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["id", "n", "digest", "sig", "bands"],
                )

    return run


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 1):
                sets = [x.tobytes() for x in shingle_sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sets, pa.binary())], ["id", "grp", "shingles"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _join_block(ids: np.ndarray, n: np.ndarray, sig: np.ndarray, labels: np.ndarray, visits: np.ndarray, sets: list | None, percent: int) -> np.ndarray:
    """Labels (places) after all pairs of the block of which one is at home were compared; equal labels first are not."""
    low = np.where(n < SMALL_SET, lowest_estimate(percent / 100, SMALL_MARGIN), lowest_estimate(percent / 100))
    root = np.unique(labels, return_inverse=True)[1]
    home = ~visits
    for i in range(len(ids)):
        other = root != root[i]
        if visits[i]:
            other &= home
        other[:i] &= visits[:i] if home[i] else False
        j = np.flatnonzero(other)
        if not len(j):
            continue
        j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
        if not len(j):
            continue
        est = estimate(sig[j], sig[i][None])
        likely = est >= np.minimum(low[j], low[i])
        j, est = j[likely], est[likely]
        for x in j[np.argsort(-est, kind="stable")]:
            if root[x] != root[i] and (sets is None or _linked(sets[i], sets[x], percent)):
                root[root == root[x]] = root[i]
    return root


def _block_links(percent: int, with_sets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, id, label, visits, n, sig[, shingles]) sorted by key -> links (a, b) from the smallest id of each joined part of a block."""
    words = BITS * -(-(BANDS * ROWS) // 64)

    def finish(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(rows)
        ids = t.column("id").to_numpy()
        if len(ids) < 2:
            return ids[:0], ids[:0]
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint64).reshape(len(ids), words)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").to_pylist()] if with_sets else None
        root = _join_block(ids, t.column("n").to_numpy(), sig, t.column("label").to_numpy(), t.column("visits").to_numpy(zero_copy_only=False), sets, percent)
        order = np.lexsort((ids, root))
        r, x = root[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        first = np.repeat(x[starts], np.diff(np.concatenate([starts, [len(x)]])))
        return first[first != x], x[first != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        last = None
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [np.empty(0, np.int64)])), pa.array(np.concatenate(b or [np.empty(0, np.int64)]))], ["a", "b"])
            a.clear()
            b.clear()
            return batch

        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
            for begin, end in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[begin] != last and rows:
                    x, y = finish(rows)
                    a.append(x)
                    b.append(y)
                    rows = []
                last = keys[begin]
                rows.append(batch.slice(begin, end - begin))
            if sum(map(len, a)) > 50_000:
                yield out()
        if rows:
            x, y = finish(rows)
            a.append(x)
            b.append(y)
        yield out()

    return run


def _in_blocks(dealt: DataFrame, percent: int, with_sets: bool) -> DataFrame:
    """dealt(key, id, label, visits, n, sig[, shingles]) -> links."""
    columns = ["key", "id", "label", "visits", "n", "sig"] + ["shingles"] * with_sets
    dealt = dealt.select(*columns).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_block_links(percent, with_sets), "a bigint, b bigint").where("a is not null")


def grouped_links(members: DataFrame, block: int, rounds: int, percent: int, with_sets: bool) -> DataFrame:
    """members(grp, id, n, sig[, shingles]), staged -> staged links whose components are those of all accepted pairs inside groups.

    Groups of more than `block` members are dealt into blocks, `rounds` times in
    different ways.  Members outside a group's largest component visit all its
    blocks afterwards, in chunks of `block` visitors.
    """
    sizes = stage(members.groupBy("grp").agg(F.count("*").alias("size")), "group-sizes")
    many = sizes.where(F.col("size") > block)
    large = many.count()
    blocks = F.ceil(F.col("size") / block).cast("int")
    payload = ["id", "n", "sig"] + ["shingles"] * with_sets
    if large:
        members = stage(members.join(sized(sizes, sizes.count()), "grp").withColumn("blocks", blocks), "sized")
    else:
        members = members.withColumn("blocks", F.lit(1))
    turns = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(1), F.lit(rounds))).otherwise(F.array(F.lit(0))))
    dealt = members.withColumn("turn", turns)
    slot = F.pmod(F.xxhash64("turn", "id"), F.col("blocks"))
    dealt = dealt.withColumn("key", F.xxhash64("grp", "turn", slot)).withColumn("label", F.col("id")).withColumn("visits", F.lit(False))
    links = stage(_in_blocks(dealt, percent, with_sets), "block-links")
    if not large:
        return links
    labels = components(links)
    rows = labels.count()
    at_large = members.where("blocks > 1").join(sized(labels.select("id", "label"), rows), "id", "left").withColumn("label", F.coalesce("label", "id"))
    shares = at_large.groupBy("grp", "label").agg(F.count("*").alias("c"))
    most = stage(shares.groupBy("grp").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all")), "most")
    most = most.select("grp", F.col("m.label").alias("most"), (F.col("all") - F.col("m.c")).alias("apart")).where("apart > 0")
    if not most.limit(1).count():
        return links
    at_large = at_large.join(sized(most, large), "grp")
    slot = F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.col("blocks"))
    chunks = F.ceil(F.col("apart") / block).cast("int")
    at_home = at_large.withColumn("place", slot).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("visits", F.lit(False))
    visitors = at_large.where("label <> most").withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), F.col("id")), chunks))
    visitors = visitors.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("place") != slot).withColumn("visits", F.lit(True))
    columns = ["grp", "place", "chunk", "label", "visits", *payload]
    dealt = at_home.select(*columns).unionByName(visitors.select(F.col("grp"), F.col("place").cast("long"), F.col("chunk").cast("int"), *columns[3:]))
    dealt = dealt.withColumn("key", F.xxhash64(F.lit("visit"), F.col("grp"), F.col("place"), F.col("chunk")))
    return links.unionByName(stage(_in_blocks(dealt, percent, with_sets), "visit-links"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept (doc_id = component_id), one row for each row.

    Shingles are runs of k words; texts link if 100 * intersection >= percent *
    union.  Texts without words, null texts and rows of a null doc_id link with
    nothing; the last keep a null component_id and are kept.  Rows of one
    doc_id are one document; of its rows all are kept or none.
    """
    if not 50 <= percent <= 100:
        raise ValueError("bands are laid out for similarities from 0.5 to 1")
    base = docs.select("doc_id", "text")
    told = stage(small_batches(base).mapInArrow(_described(k), "id bigint, n bigint, digest binary, sig binary, bands array<bigint>"), "described")
    linkable = told.where("digest is not null and id is not null")
    classes = stage(linkable.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    known = stage(
        linkable.join(classes, "digest").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("sig")).alias("sig"), F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")),
        "known",
    )
    rest = stage(told.where("digest is null or id is null").select("id", "n"), "rest")
    drop_staged(told)
    reps = known.where("sig is not null")
    banded = reps.select(F.explode("bands").alias("grp"), "id")
    shared = stage(banded.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").select("grp"), "buckets")
    n_shared = shared.count()
    members = banded.join(sized(shared, n_shared), "grp", "left_semi")
    members = stage(members.join(reps.select("id", "n", "sig"), "id"), "members")
    near = components(grouped_links(members, BUCKET_BLOCK, 1, percent, with_sets=False))
    near = near.select("id", F.col("label").alias("grp"))
    n_near = near.count()
    texts = base.withColumnRenamed("doc_id", "id").join(sized(near, n_near), "id")
    sets = small_batches(texts.select("id", "text", "grp")).mapInArrow(_sets(k), "id bigint, grp bigint, shingles binary")
    full = stage(sets.join(sized(near.select("id"), n_near).join(reps.select("id", "n", "sig"), "id"), "id"), "sets")
    links = grouped_links(full, CLUSTER_BLOCK, 2, percent, with_sets=True)
    # Rows of one id are one document: an id that stands in two classes links them.
    twice = known.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    final = components(links.unionByName(twice))
    found = known.join(sized(final, final.count()), known.rep == final.id, "left").select(known.id, "n", F.coalesce("label", "rep").alias("component_id"))
    found = found.unionByName(rest.withColumn("component_id", F.col("id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85.

    Null and empty texts and texts without words are linked with nothing; rows of one doc_id are one node and each has a row; equal texts are
    linked, copies of any number; rows of a null doc_id link with nothing; texts of any length are read whole; an empty table has no rows.
    """
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT a AS id, a AS r FROM (SELECT DISTINCT a FROM e) UNION SELECT e.b, r.r FROM r JOIN e ON r.id = e.a
), c AS (
  SELECT id, min(r) AS component_id FROM r GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.id
"""
