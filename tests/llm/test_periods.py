"""Periodic runs against a plain scan over all periods."""

import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import periods

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_runs string, start string, period string, __sl_h string"


def plain_runs(words, least=12):
    """(begin, end, period) of all runs: for each period the stretches of equal words, of smallest period only."""
    found = []
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                piece = words[i : j + q]
                if not any(piece[r:] == piece[:-r] for r in range(1, q)):
                    found.append((i, j + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(((-(e - s), s, q) for s, e, q in runs), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def found_runs(symbols):
    """All runs of at least two periods of one sequence."""
    begin, end, period = periods.runs(np.append(np.array(symbols, dtype=np.int64) + 1, 0))
    return sorted(zip(begin.tolist(), end.tolist(), period.tolist()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_small_alphabets(symbols):
    assert found_runs(symbols) == plain_runs(symbols, least=2)


def test_runs_of_words_with_many_repeats():
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    thue = [bin(i).count("1") & 1 for i in range(256)]
    for symbols in (b, thue, [0] * 300, ([0, 1, 2] * 40 + [3]) * 3, [0, 0, 1] * 50 + [0, 0, 0, 1] * 30, []):
        assert found_runs(symbols) == plain_runs(symbols, least=2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=12), st.integers(0, 5))
def test_runs_of_several_texts(pieces, cut):
    """Texts of one batch don't mix; repeats too short for a run are left out."""
    words = [x for p, n in pieces for x in p * n]
    texts = [words[: len(words) // 2 + cut], words[len(words) // 2 + cut :], words[cut:]]
    ids = np.array([x for t in texts for x in t], dtype=np.int32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t)]
    assert [tuple(r) for r in periods.text_runs(ids, first).tolist()] == want


def test_rows_against_the_plain_scan(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = ["é", "à b", "x", "X", "漢字", "a" * 500]
    texts = [None, "", " \n", "a " * 5000, "a\x0bb\x0cc " * 9, "one", "the same line again \n" * 30]
    texts += [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(1, 300, 60)]
    texts += [t for t in texts[7:12] for _ in range(2)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b c " * 20), (3, "a " * 5000), (3, "a " * 5000)]
    spark.createDataFrame([(i, t, "en", "1", "2", "3", "4") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = periods.op13_periods(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert len({r for r in map(tuple, found) if r[0] == 3}) == 1


def test_an_empty_table_and_no_planting(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periods.periodic_runs(empty).collect() == []
    rows = [(i, "u v w " * (i + 1)) for i in range(30)]
    found = periods.periodic_runs(spark.createDataFrame([(*r, "", "", "", "", "") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, found)) == sorted(plain_row(*r, plant=False) for r in rows)


def test_real_documents_against_the_plain_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: tuple(r) for r in periods.op13_periods(spark, SF).collect()}
    short = [r for r in docs if len(r.text or "") < 6000]
    assert len(found) == len(docs) and len(short) > 150
    for r in short:
        assert found[r.doc_id] == plain_row(r.doc_id, r.text)


def test_a_long_text_takes_time_near_linear():
    """Two texts of long and short periods, the second ten times the first."""
    took = []
    for n in (20_000, 200_000):
        ids = np.concatenate([np.tile(np.arange(n // 20), 10), np.tile([1, 2, 1, 2, 3], n // 10)]).astype(np.int32)
        start = time.process_time()
        found = periods.text_runs(ids, np.array([0, len(ids)]))
        took.append(time.process_time() - start)
        assert found.tolist()[0] == [0, 0, n // 2, n // 20]
        assert [0, n // 2, n, 5] in found.tolist() or [0, n // 2 + 1, n, 5] in found.tolist() or any(r[3] == 5 and r[2] == n for r in found.tolist())
    assert took[1] < 30 * max(took[0], 0.05)
