"""Language and quality against plain Python; edges that cross operators."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import langid, quality, sharding, token_files, topk

from .test_corpus_operators import _docs, _write


def _plain_grams(text):
    raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in (text.lower() + " ").encode())
    out = bytearray()
    for b in raw:
        if not (b == 32 and out and out[-1] == 32):
            out.append(b)
    return [int.from_bytes(out[i : i + 5], "little") for i in range(len(out) - 4)]


def test_bloom_counts_and_decisions_by_brute_force():
    texts = {"en": "The quick brown fox — it's 12 years old.", "de": "Der schnelle braune Fuchs über'm Zaun", "fr": "Le renard brun à côté d'une chèvre"}
    model = langid.Filter(list(texts), {k: np.array(_plain_grams(t), np.uint64) for k, t in texts.items()})
    slots = lambda g: [((g * int(m)) % (1 << 64)) >> (64 - langid.SLOT_BITS) for m in langid._MULTIPLIERS[: langid.HASHES]]
    bits = {k: {s for g in _plain_grams(t) for s in slots(g)} for k, t in texts.items()}
    false = {k: (len(b) / (1 << langid.SLOT_BITS)) ** langid.HASHES for k, b in bits.items()}
    for text in [*texts.values(), "the brown Fuchs à Zaun", "", None, "1234", "q", "schnelle braune", "x" * 5000, "é" * 40]:
        grams = _plain_grams(text or "")
        right = {k: max((sum(all(s in bits[k] for s in slots(g)) for g in grams) - false[k] * len(grams)) / (1 - false[k]), 0.0) + 1e-9 for k in sorted(texts)}
        best = max(sorted(right), key=lambda k: right[k])
        letters = any(c.isalpha() for c in text or "")
        top = sorted(right.values())
        lang, score = (x[0] for x in model.decide(pa.array([text], pa.string())))
        assert lang == (best if letters else "und")
        assert score == pytest.approx(top[-1] / (top[-1] + top[-2]) if letters else 0.0, abs=1e-9)


def test_posteriors_by_brute_force(spark):
    """Rates of hosts and paths and scores, from the evidence that the query returns, in plain Python."""
    rng = np.random.default_rng(8)
    rows = [(i, "x" if rng.random() < 0.3 else "good words here", ["de", "en", None][int(rng.integers(0, 3))], ["a", "b", None, "rare"][min(int(rng.exponential(1.2)), 3)]) for i in range(300)]
    labels = {i: int(rng.random() < 0.5 + 0.3 * (rows[i][3] == "a")) for i in range(0, 300, 2)}
    table = spark.createDataFrame(list(labels.items()), "doc_id long, label int")
    docs = _docs(spark, rows)
    out = {r.doc_id: r for r in quality.posteriors(docs, table, F.col("source"), F.col("lang")).collect()}
    base = quality.learn(docs.select("doc_id", "text"), table).base
    n, k, own = defaultdict(float), defaultdict(float), {}
    for i, _, lang, source in rows:
        w = 1.0 if i in labels else quality.SOFT
        p = labels.get(i, 1 / (1 + math.exp(-out[i].evidence - math.log(base / (1 - base)))))
        own[i] = w, w * p
        n[source, lang] += w
        k[source, lang] += w * p
    hn, hk = defaultdict(float), defaultdict(float)
    for (s, _), v in n.items():
        hn[s] += v
    for (s, _), v in k.items():
        hk[s] += v

    def strength(sites):
        """sites: (n, rate, centre)."""
        weight = sum(x for x, _, _ in sites)
        spread = sum(x * (r - c) ** 2 for x, r, c in sites) / weight
        mid, noise = sum(x * c for x, _, c in sites) / weight, sum(c * (1 - c) for _, _, c in sites) / weight
        return min(max(mid * (1 - mid) / max(spread - noise, 1e-9) - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    centre = sum(hk.values()) / sum(hn.values())
    outer = strength([(hn[s], hk[s] / hn[s], centre) for s in hn])
    host = {s: (hk[s] + outer * centre) / (hn[s] + outer) for s in hn}
    inner = strength([(n[p], k[p] / n[p], host[p[0]]) for p in n])
    for i, _, lang, source in rows:
        # The document itself is left out of both rates.
        w, mass = own[i]
        rate = (hk[source] - mass + outer * centre) / (hn[source] - w + outer)
        path = (k[source, lang] - mass + inner * rate) / (n[source, lang] - w + inner)
        score = 1 / (1 + math.exp(-out[i].evidence - math.log(path / (1 - path))))
        r = out[i]
        assert (r.host_rate, r.path_rate, r.score) == pytest.approx((rate, path, score), rel=1e-6) and r.kept == (r.score >= 0.5)


def test_sharding_of_very_long_and_repeated_texts(spark):
    rows = [(i, "word " * 200_000 if i == 7 else "same text", "en", None) for i in range(120)] + [(None, None), (7, "")]
    out = sharding.hypergeometric_shuffle(_docs(spark, rows), 7).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), len(r.text or "")) for r in out) == sorted(((r[0] is None, r[0] or 0), len(r[1] or "")) for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values()))[0] >= 17 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_top_k_of_repeated_ids_and_one_hot_vector(spark):
    """A third of all rows is one vector, ids repeat; every list equals a full search."""
    rng = np.random.default_rng(12)
    rows = [(int(i % 900), (rng.normal(size=6) if i % 3 else np.full(6, 0.5)).astype(np.float32).tolist()) for i in range(1800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, (_, v) in enumerate(rows)}
    want = {}
    for q in range(0, 900, 300):
        # Equal rows of one id are one query.
        asked = {tuple(x[a]) for a in x if rows[a][0] == q}
        found = sorted((-int(np.array(a) @ x[b]), rows[b][0]) for a in asked for b in x if rows[b][0] != q)
        want[q] = found[:20]
    out = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 300 == 0).orderBy("query_id", "rank").collect():
        out[r.query_id].append((-r.score, r.vec_id))
    assert {q: v for q, v in out.items()} == want


def test_token_files_of_many_rows_of_one_id(spark, tmp_path):
    rows = [(5, f"row {i}") for i in range(400)] + [(None, "none")] * 200 + [(9, None), (1, "x " * 50_000)]
    out = token_files.op1_token_files(spark, _write(_docs(spark, rows), tmp_path)).collect()
    assert len(out) == len(rows)
    order = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None] * 200 + [1] + [5] * 400 + [9] and order[-1].n_tokens == 1
    assert all(b.start == a.start + a.n_tokens for a, b in zip(order, order[1:]))
