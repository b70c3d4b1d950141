"""Long repeats against a count of all windows, maximal repeats against a plain search."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, spans string, r1 string, n string, digest string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "a", "b", "c", "d") for r in rows], SCHEMA)


def plain(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for s in range(len(t) - length + 1):
            if times[t[s : s + length]] > 1:
                gone[s : s + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def drawn_rows(rng, n, letters, passages):
    """Random texts with shared passages, runs and copies."""
    shared = ["".join(rng.choice(list(letters), int(k))) for k in rng.integers(8, 60, passages)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choice(list(letters), int(k))) for k in rng.integers(0, 30, 4)]
        parts += list(rng.choice(shared, 2))
        rng.shuffle(parts)
        rows.append((i, "".join(parts)))
    return rows + [(n + i, rows[i][1]) for i in range(5)]


@pytest.mark.parametrize("seed,letters,length", [(1, "abcdefgh", 10), (2, "ab", 12), (3, "é\x00aà", 11), (4, "abcdefghijklmnop", 25)])
def test_removal_against_all_windows(spark, seed, letters, length):
    rng = np.random.default_rng(seed)
    rows = drawn_rows(rng, 60, letters, 6)
    rows += [(900, None), (901, ""), (902, "a" * 500), (903, "ab" * 300), (None, rows[0][1]), (904, "x"), (905, "漢字" * 40)] + [rows[3]] * 3
    found = repeats.without_repeats(_docs(spark, rows).repartition(4), length)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, length)


@pytest.mark.parametrize("group", [1, 3, 20])
def test_grams_of_many_contexts_are_split(spark, monkeypatch, group):
    """A passage in all texts, with other neighbours in each."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = np.random.default_rng(group)
    rows = drawn_rows(rng, 50, "abcdefghijklmnop", 1) + drawn_rows(rng, 20, "xyz", 2)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    found = repeats.without_repeats(_docs(spark, rows), 16)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, 16)


@pytest.mark.parametrize("length,chunk", [(40, 64), (41, 1 << 20), (160, 300)])
def test_periodic_stretches(spark, monkeypatch, length, chunk):
    """Short periods of all lengths around the bounds, alone, beside each other and at the borders of texts and chunks; one length uses words of eight bytes."""
    rng = np.random.default_rng(length)
    seed = repeats.seed_of(length)
    rows = []
    for i in range(60):
        p = int(rng.integers(1, seed))
        unit = "".join(rng.choice(list("abcd"), p))
        run = (unit * (4 * length))[: int(length + rng.integers(-p, 3 * p + 2))]
        parts = ["".join(rng.choice(list("xyz"), int(rng.integers(0, 30)))) for _ in range(2)]
        rows.append((i, parts[0] + run + parts[1] * (i % 3 > 0) + run[: length // 2] * (i % 5 == 0)))
    rows += [(100, "ab" * length), (101, "ba" * length), (102, "a" * (length + 1)), (103, "a" * length), (104, "aab" * length + "aba" * length)]
    found = repeats.without_repeats(_docs(spark, rows), length)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, length)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    text = "".join(t + " " for _, t in rows).encode()
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in rows])])
    data = np.frombuffer(text, dtype=np.uint8)
    # Anchors and stretches of chunks cover what one chunk's do.
    gram = {bytes(data[p : p + seed]) for p in repeats._anchors(data, starts, length)[0]}
    monkeypatch.setattr(repeats, "CHUNK", 1 << 20)
    assert {bytes(data[p : p + seed]) for p in repeats._anchors(data, starts, length)[0]} <= gram


def test_stretches_are_found():
    rng = np.random.default_rng(0)
    for seed in (6, 29, 30, 80):
        data = rng.integers(97, 100, 3000).astype(np.uint8)
        for _ in range(20):
            p, n, at = int(rng.integers(1, seed // 2 + 1)), int(rng.integers(seed - 3, 3 * seed)), int(rng.integers(0, 2700))
            data[at : at + n] = np.resize(rng.integers(97, 123, p).astype(np.uint8), n)
        found = set(zip(*(x.tolist() for x in repeats._stretches(data, seed))))
        want = set()
        for p in range(1, seed // 2 + 1):
            same = np.concatenate([[False], data[:-p] == data[p:], [False]])
            edges = np.flatnonzero(np.diff(same.astype(int)))
            want |= {(a, b + p, p) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b + p - a >= seed}
        assert found == want and want


def test_kept_bytes_and_an_empty_table(spark):
    rows = [(1, "0123456789 one of them"), (2, "and 0123456789"), (3, None), (4, "0123456789"), (5, "alone")]
    found = {r.doc_id: r for r in repeats.without_repeats(_docs(spark, rows), 10, with_text=True).collect()}
    assert {i: bytes(r.kept) for i, r in found.items()} == {1: b" one of them", 2: b"and ", 3: b"", 4: b"", 5: b"alone"}
    assert found[1].n_spans == 1 and found[4].n_removed == 10
    assert repeats.without_repeats(_docs(spark, []), 10).collect() == []


def plain_contexts(texts, length):
    """Maximal repeats of at least `length` letters: strings that occur twice and can be extended to neither side without losing an occurrence."""
    places = defaultdict(set)
    for d, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + length, len(t) + 1):
                places[t[a:b]].add((d, a))
    found = {}
    for s, at in places.items():
        if len(at) < 2:
            continue
        before = {texts[d][a - 1] if a else (d, a, "^") for d, a in at}
        behind = {texts[d][a + len(s)] if a + len(s) < len(texts[d]) else (d, a, "$") for d, a in at}
        if len(before) > 1 and len(behind) > 1:
            found[s] = at
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=0, max_size=14), min_size=1, max_size=6), st.integers(2, 6))
def test_intervals_of_one_block_are_the_maximal_repeats(texts, length):
    """With one anchor in front of each text's middle, groups are the maximal repeats around anchors."""
    texts = [t for t in texts if t]
    contexts = sorted({(t, len(t) // 2) for t in texts})
    if len(contexts) < 2:
        return
    data = np.frombuffer("".join(t for t, _ in contexts).encode(), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t, _ in contexts])])
    wide = 20
    array = repeats.SuffixArray(np.zeros(len(contexts), dtype=np.int64), data, starts, np.array([b for _, b in contexts]), wide)
    found = {(left, right, tuple(sorted(m.tolist()))) for left, right, m in array.groups(length)}
    want = set()
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for t, at in contexts:
        for u, bt in contexts:
            if (t, at) < (u, bt):
                left, right = common(t[:at][::-1], u[:bt][::-1]), common(t[at:], u[bt:])
                if left + right >= length:
                    s = t[at - left : at + right]
                    want.add((left, right, tuple(i for i, (v, b) in enumerate(contexts) if v[b - left : b + right] == s and b >= left)))
    assert found == want


@pytest.mark.parametrize("group", [2, 1000])
def test_groups_hold_every_occurrence(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = np.random.default_rng(7)
    rows = [(i, t) for i, (_, t) in enumerate(drawn_rows(rng, 25, "abcdefgh", 3))]
    length = 12
    found = defaultdict(set)
    for r in repeats.repeat_groups(_docs(spark, rows), length).collect():
        found[(r.g1, r.g2, r.length)].add((r.doc_id, r.start))
    texts = dict(rows)
    covered = defaultdict(set)
    for (_, _, n), at in found.items():
        strings = {texts[i][a : a + n] for i, a in at}
        assert len(strings) == 1 and len(at) > 1 and n >= length
        s = strings.pop()
        assert at == {(i, a) for i, t in rows for a in range(len(t) - n + 1) if t[a : a + n] == s}
        for i, a in at:
            covered[i] |= set(range(a, a + n))
    want = {r[0]: r[2] for r in plain(rows, length)}
    assert {i: len(covered[i]) for i in texts} == want


def test_hashes_that_collide_do_not_make_repeats(spark):
    """Two different words whose polynomial hashes are equal whatever the base."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = "".join("ba"[bin(i).count("1") & 1] for i in range(2048))
    rows = [(1, "x" * 50 + word), (2, "y" * 70 + other), (3, "z" + word + other)]
    found = repeats.without_repeats(_docs(spark, rows), 400)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, 400)


def test_the_query_against_all_windows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(map(tuple, repeats.op12_repeats(spark, SF).collect()), key=repr)
    assert found == plain(rows, 400)
    assert sum(r[2] > 0 for r in found) > 10
