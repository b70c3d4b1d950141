"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import resampling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string, rank string, weight string, n_features string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(small)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def plain(docs, target, percent=10, least=20, longest=1, buckets=10_000):
    made = [(i, *plain_features(t, longest)) for i, t in docs]
    s = Counter(f % buckets for _, _, fs in made for f in fs)
    t = Counter(f % buckets for x in target for f in plain_features(x, longest)[1] for f in [f])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows = []
    for i, words, fs in made:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(f % buckets) for f in fs)
        rows.append([i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in rows), key=repr)


def test_crc_of_spans_of_any_length():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    begins = rng.integers(0, 4000, 900)
    ends = begins + np.concatenate([rng.integers(0, 120, 890), [0, 1, 47, 48, 49, 50, 254, 255, 256, 999]])
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(begins, ends)]
    assert resampling.span_crc32(data, begins, ends).tolist() == want


@pytest.mark.parametrize("longest", [1, 3])
def test_features_of_odd_texts(longest):
    texts = ["Don't 12,3 ÀÉİx a b", None, "", "...", "x", "a" * 300 + " b " + "漢" * 100, " lead and trail ", "A\x7fB\x80C"]
    crc, text, words = resampling.features(pa.array(texts, pa.string()), longest)
    for i, t in enumerate(texts):
        n, want = plain_features(t, longest)
        assert words[i] == n and Counter(crc[text == i].tolist()) == Counter(want)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_of_drawn_tables(spark, longest):
    """Ties, nulls, empty and very long texts, repeated rows, columns that clash."""
    rng = np.random.default_rng(longest)
    words = [f"w{i}" for i in range(60)] + ["Été", "ß", "7"]
    docs = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(0, 60, 400))]
    docs += [(1000, None), (1001, ""), (None, "w1 " * 30), (1002, "w2 w3 " * 40_000), (1003, "z" * 100_000)] + [docs[0]] * 3
    target = ["w1 w2 w3 " * 20, None, "", "Été ß"]
    frame = spark.createDataFrame([(*r, "en", "s", "r", "w", "n") for r in docs], SCHEMA).repartition(5)
    found = resampling.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(docs, target, longest=longest)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame([(i, "a b c d e " * 5, "", "", "", "", "") for i in range(20)], SCHEMA)
    assert resampling.resampled(none, docs).collect() == []
    found = resampling.resampled(docs, none.select("text")).collect()
    assert sorted(r.rank for r in found if r.rank) == [1, 2]
    assert sorted(map(tuple, found), key=repr) == plain([(i, "a b c d e " * 5) for i in range(20)], [])


def test_the_query_against_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = sorted(map(tuple, resampling.op11_resampling(spark, SF).collect()), key=repr)
    assert found == plain(docs, target)
    assert sum(r[4] is not None for r in found) > 10
