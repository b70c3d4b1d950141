"""Corpus operators against brute force, round trips and held-out rows; nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import folding, langid, minhash, mixing, pieces, quality, sharding, shingles, token_files, topk, toxicity, winnowing

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, score string, id string, label string, size string, rate string, __sl_x string"
ODD = ["Don't stop — 'tis «naïve» café's it's 'S 12,345.67 x²½ ÀÉÎ é Σίσυφος ΑΣ İst 漢字かな　ok z ﬁ K \x1c a\x85b", "", None, " ", "'", "''s s'", "a'b c'd E'F'g", "é–b, –x", "I'LL we'Ve'll 9'th", "x" * 5000, "word " * 3000, "漢字" * 900]


def _docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); the other columns clash with the operators' own names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, "a", "b", "c", "d", "e", "f", "g", "h") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def _write(df, tmp_path, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# 1 token files


def test_encoder_equals_the_library():
    e = token_files.Encoder(token_files.default_tokenizer())
    texts = ODD + ["foo<|endoftext|>bar <|ENDOFTEXT|> <|startoftext|>"]
    for part in (ODD, texts):
        ids, starts = e.encode(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert ids[starts[i] : starts[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_one_encoder_over_many_batches_in_any_order():
    """What an encoder has seen before doesn't change ids: whole stretches and letter runs of equal bytes are different units."""
    e = token_files.Encoder(token_files.default_tokenizer())
    assert e.by_units
    rng = np.random.default_rng(11)
    signs = [chr(c) for c in range(32, 127)] * 3 + list("“”‘’«»–—…€İıßẞſ\u212aÅéÉñÑüÜΣσςЖж漢字かなﬁ½²№\u0301\u0307\u00a0\u3000\x85\x1c\u200d\u200bꟑ🎉ʼ") * 2
    words = ["“Yes”", "he", "said", "“Yes”.", "TÜRKİ.", "İstanbul", "don't", "l’été", "'s", "…", "«", "–", "€"]
    texts = ["".join(rng.choice(signs, int(n))) for n in rng.integers(0, 40, 5000)]
    texts += [" ".join(w + s for w, s in zip(rng.choice(words, int(n)), rng.choice(["", ".", "!", "…", "”"], int(n)))) for n in rng.integers(1, 8, 5000)]
    texts += ["“Yes” he said"] * 20 + ["“Yes”. he said…! "] * 20
    want = {t: e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts}
    for _ in range(3):
        rng.shuffle(texts)
        for i in range(0, len(texts), 500):
            ids, starts = e.encode(pa.array(texts[i : i + 500]))
            for j, t in enumerate(texts[i : i + 500]):
                assert ids[starts[j] : starts[j + 1]].tolist() == want[t], t


_SIDES = ["".join(x[bin(i).count("1") & 1] for i in range(2048)) for x in ("ab", "ba")]


def test_words_that_every_polynomial_hash_confuses(spark, tmp_path):
    """The Thue-Morse word and its complement: equal under any polynomial hash modulo 2^64, different here, in ids, pieces and links."""
    rows = [(i, _SIDES[i % 2] + (" and more" if i > 19 else "")) for i in range(40)]
    sf = _write(_docs(spark, rows).repartition(1), tmp_path)
    e = token_files.Encoder(token_files.default_tokenizer())
    for r in token_files.op1_token_files(spark, sf).collect():
        ids = e.tokenizer.encode(rows[r.doc_id][1], add_special_tokens=False).ids + [2]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert all(r.round_trip for r in pieces.op8_pieces(spark, sf).collect())
    found = {r.doc_id: r.component_id for r in minhash.op9_minhash(spark, sf).collect()}
    assert found == {i: i % 2 if i < 20 else 20 + i % 2 for i in range(40)}


def test_span_hashes_depend_on_every_byte_and_the_key():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    for size in (0, 1, 7, 8, 9, 63, 255, 256, 257, 900):
        begins = np.array([0, 1000, 2000])
        data[1000 : 1000 + size] = data[:size]
        a, b, c = shingles.spans(data, begins, begins + size, exact=True).tolist()
        assert a == b and (size == 0 or a != c) and shingles.spans(data, begins, begins + size, exact=True, key=5)[0] != a
        for i in range(0, size, max(size // 40, 1)):
            other = data.copy()
            other[1000 + i] ^= 32
            assert shingles.spans(other, begins, begins + size, exact=True)[1] != a
            assert (shingles.spans(other, begins, begins + size)[1] == shingles.spans(data, begins, begins + size)[1]) == (chr(data[1000 + i]).isascii() and chr(data[1000 + i]).isalpha())


def test_two_kinds_of_quotes_through_the_query(spark, tmp_path):
    texts = ["“Yes” he said"] * 200 + ["“Yes”. he said…! "] * 200
    e = token_files.Encoder(token_files.default_tokenizer())
    for r in token_files.op1_token_files(spark, _write(_docs(spark, list(enumerate(texts))), tmp_path)).collect():
        ids = e.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert token_files.op1_token_files(spark, _write(_docs(spark, []).limit(0), tmp_path / "empty")).count() == 0


def test_other_tokenizer_files_are_used_text_by_text(tmp_path):
    spec = json.loads(token_files.Encoder(token_files.default_tokenizer()).tokenizer.to_str())
    spec["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    e = token_files.Encoder(str(path))
    ids, starts = e.encode(pa.array(["Some Words", None, "it's"]))
    assert not e.by_units and ids[starts[0] : starts[1]].tolist() == e.tokenizer.encode("Some Words", add_special_tokens=False).ids


def test_repair_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(4)
    phrases = [rng.integers(0, 3000, int(n)) for n in rng.integers(2, 60, 300)]
    docs = [np.concatenate([phrases[i] for i in rng.integers(0, 300, int(n))]).astype(np.uint32) for n in rng.integers(1, 20, 200)] + [np.full(5000, 9, np.uint32)]
    ids, starts = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    seq, at, rules, base = token_files.repair(ids, starts)
    left, used = Counter(), Counter(seq[seq >= base].tolist())
    for a, b in zip(at, at[1:]):
        document, i = seq[a:b].tolist(), 0
        runs = Counter()
        for x, y in zip(document, document[1:]):
            runs[x, y] += 1
        for (x, y), n in runs.items():
            left[x, y] += n if x != y else 0
    assert max(left.values()) < token_files.LEAST_PAIRS
    used.update(rules[rules >= base].tolist())
    assert len(seq) + 3 * len(rules) < len(ids) / 2 and token_files.expansion_lengths(rules, base).max() > 256
    assert all(used[base + i] >= 1 for i in range(len(rules)))
    shard = token_files.Shard(token_files.write_shard(np.arange(len(docs)), np.ones(len(docs), bool), ids, starts))
    assert np.array_equal(shard.all_ids(), ids) and all(np.array_equal(shard.tokens(d), docs[d]) for d in (0, 77, 200))


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 500, int(n)) for n in rng.integers(1, 9, 60)]
    docs = [np.concatenate([words[i] for i in rng.zipf(1.5, int(n)) % 60] or [np.empty(0, int)]).astype(np.uint32) for n in rng.integers(0, 90, 300)]
    docs[3] = np.full(1000, 7, np.uint32)
    ids, starts = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    raw = token_files.write_shard(np.arange(300), np.ones(300, bool), ids, starts)
    shard = token_files.Shard(raw)
    assert np.array_equal(shard.all_ids(), ids) and len(shard.rules) > 10 and len(shard.seq) < len(ids) / 2
    for d in (0, 3, 5, 299):
        assert np.array_equal(shard.tokens(d), docs[d])
        assert np.array_equal(shard.tokens(d, 3, 17), docs[d][3:17]) and np.array_equal(shard.tokens(d, -4), docs[d][-4:])
    assert token_files.Shard(token_files.write_shard(np.empty(0, int), np.empty(0, bool), np.empty(0, np.uint32), np.zeros(1, int))).n_ids == 0


def test_repair_rounds_leave_rare_pairs_out():
    """A passage that takes many rounds doesn't make each of them read a million ids without pairs that repeat."""
    took, lone = [], np.arange(1_000_000, dtype=np.uint32)
    for ids in (lone, np.concatenate([lone, np.tile(np.arange(1_000_000, 1_004_096, dtype=np.uint32), 4)])):
        start = time.process_time()
        seq, at, rules, base = token_files.repair(ids, np.array([0, len(ids)]))
        took.append(time.process_time() - start)
    assert len(seq) == 1_000_004 and len(set(seq[-4:].tolist())) == 1 and token_files.expansion_lengths(rules, base).max() == 4096
    assert took[1] < 6 * took[0]


def test_token_files_query(spark, tmp_path):
    rows = [(10 * i, t) for i, t in enumerate(ODD)] + [(5, "again"), (5, "again"), (None, "nobody")]
    out = token_files.op1_token_files(spark, _write(_docs(spark, rows), tmp_path)).collect()
    tok = token_files.Encoder(token_files.default_tokenizer()).tokenizer
    at = 0
    expected = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out), key=lambda r: r[1]) == expected


# 2 sharding


def test_communication_matrix_sums_and_law():
    m = sharding.communication_matrix([5, 0, 17, 8], sharding.even_sizes(30, 4), 3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 8] and m.sum(axis=0).tolist() == [8, 8, 7, 7]
    draws = np.array([sharding.communication_matrix([10, 20], [15, 15], s)[0, 0] for s in range(3000)])
    assert draws.mean() == pytest.approx(5, abs=0.12) and draws.var() == pytest.approx(10 * 0.25 * 20 / 29, rel=0.12)
    rng = np.random.default_rng(0)
    big = np.array([sharding.draw_hypergeometric(rng, 2 * 10**9, 6 * 10**9, 4000) for _ in range(400)])
    assert big.mean() == pytest.approx(1000, abs=6) and big.std() == pytest.approx(math.sqrt(750), rel=0.15)


def test_sharding_query(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(1003)] + [(None, None), (4, "text 4"), (4, "text 4")]
    sf = _write(_docs(spark, rows).repartition(5), tmp_path)
    out = sharding.op2_sharding(spark, sf).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, sharding.op2_sharding(spark, sf).collect()), key=str)


def test_sharding_keeps_columns_and_takes_empty_tables(spark):
    df = _docs(spark, [(i, "t") for i in range(10)])
    out = sharding.hypergeometric_shuffle(df, 3)
    assert out.columns == [c for c in df.columns if c not in ("shard", "slot", "__sl_x")] + ["shard", "slot"] and out.count() == 10
    assert sharding.hypergeometric_shuffle(df.limit(0), 3).count() == 0


def test_draws_of_very_many_rows():
    """Counts at 10^10 rows: sums hold exactly, means and variances are the law's, tails aren't cut."""
    rng = np.random.default_rng(3)
    good, bad, n = 4 * 10**9, 6 * 10**9, 10**6
    x = np.array([sharding.draw_hypergeometric(rng, good, bad, n) for _ in range(1500)])
    mean, variance = n * 0.4, n * 0.4 * 0.6 * (10**10 - n) / (10**10 - 1)
    assert abs(x.mean() - mean) < 4 * math.sqrt(variance / 1500) and 0.85 < x.var() / variance < 1.15
    blocks, shards = [2 * 10**9 + i for i in range(5)], [10**9 + 1] * 10
    shards[0] += sum(blocks) - sum(shards)
    matrix = sharding.communication_matrix(blocks, shards, 1)
    assert matrix.sum(axis=1).tolist() == blocks and matrix.sum(axis=0).tolist() == shards and (matrix > 0).all()

    class Least:
        """The least uniform number there is."""

        def random(self):
            return 1e-300

    assert sharding.draw_hypergeometric(Least(), good, bad, n) < mean - 30 * math.sqrt(variance)


# 3 winnowing


def _winnow(text, k=5, w=8):
    import regex
    import xxhash

    tokens = regex.findall(winnowing.TOKEN, text.lower())
    if not tokens:
        return []
    t = [0] * (k - 1) + [(xxhash.xxh64_intdigest(x.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63) for x in tokens]
    t = [x % winnowing.MODULUS for x in t]
    runs = []
    for i in range(len(tokens)):
        h = 0
        for x in t[i : i + k]:
            h = (h * winnowing.BASE + x) % winnowing.MODULUS
        runs.append(h)
    kept = []
    for end in range(1, len(runs) + 1):
        window = runs[max(0, end - w) : end]
        best = end - len(window) + max(j for j, h in enumerate(window) if h == min(window))
        if best not in kept:
            kept.append(best)
    return [(runs[i], i) for i in kept]


def _printed(kept):
    return " ".join(f"{h:X}@{i}" for h, i in kept)


def _dice(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_winnowing_query_equals_brute_force(spark, tmp_path):
    texts = ["one two three four five six seven eight nine ten eleven twelve", "One two, three FOUR five!", "", None, "a", "ab c", "same same same same same same same same same same same same same", "漢字かな" * 30, "  ", "x" * 100, "🙂 smile 🙂 end"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "twice"), (3, "twice"), (100, " ".join(str(i % 37) for i in range(3000)))]
    out = winnowing.op3_winnowing(spark, _write(_docs(spark, rows), tmp_path)).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for i, (d, t) in enumerate(order):
        if d == 3 or order[(i + 1) % len(order)][0] == 3:
            continue
        after = order[(i + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        r = by[d][0]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == _printed(_winnow(t)) and r.edited_fingerprint == _printed(_winnow(edited))
        assert r.near_edited == pytest.approx(_dice(_winnow(t), _winnow(edited))) and r.near_next == pytest.approx(_dice(_winnow(t), _winnow(after)))
    assert sorted(r.n_chars for r in by[3]) == [0, 5, 5]
    assert by[100][0].near_edited > 0.5


def test_winnowing_of_many_rows_of_one_id(spark, tmp_path):
    """A third of the rows without doc_id and a third of one doc_id spread over buckets, and each row's next is still its successor."""
    rows = [(None if i % 3 == 0 else 700 if i % 3 == 1 else i, f"text number {i} of many") for i in range(3000)]
    table = spark.read.parquet(f"{_write(_docs(spark, rows).repartition(6), tmp_path)}/documents.parquet")
    df = winnowing.with_next(table.select("doc_id", "text"), "doc_id", "b", "g").persist()
    assert df.where("not g").count() == 3000
    per = [r["n"] for r in df.where("not g").groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert len(per) > 30 and max(per) < 250
    seen = df.withColumn("next", F.lead(F.struct("doc_id", "text")).over(winnowing.inside_bucket("b", "g"))).where("not g").collect()
    # One cycle through all rows, in descending order of ids.
    step = {(r.doc_id, r.text): (r.next.doc_id, r.next.text) for r in seen}
    at, ids = max(step, key=lambda x: (x[0] is not None, x[0] or 0)), []
    for _ in range(3000):
        ids.append(at[0])
        at = step.pop(at)
    assert not step and ids == sorted((r[0] for r in rows), key=lambda d: (d is None, -(d or 0)))


def test_winnowing_guarantee_and_edges(spark, tmp_path):
    shared = " ".join(f"s{i}" for i in range(12))
    a, b = "p q r " + shared + " u v", "k " + shared + " w x y z"
    assert {h for h, _ in _winnow(a)} & {h for h, _ in _winnow(b)}
    one = winnowing.fingerprint_documents(_docs(spark, [(1, "only one text here")])).first()
    assert one.near_next == 1.0
    assert winnowing.fingerprint_documents(_docs(spark, []).limit(0)).count() == 0


# 4 language


@needs_tables
def test_language_of_held_out_documents(spark):
    out = langid.op4_language(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.collect())


def test_language_edges(spark, tmp_path):
    rows = [(i, t, lang) for i in range(40) for t, lang in ((f"the quick brown fox number {i} jumps over the lazy dog", "en"), ("", None))]
    rows += [(100 + i, f"der schnelle braune fuchs nummer {i} springt über den faulen hund", "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "1234 !!", "en"), (202, "", "de"), (203, "über den faulen fuchs", None), (None, "the lazy dog", "en"), (204, "x" * 300_000, None)]
    sf = _write(_docs(spark, rows), tmp_path)
    out = defaultdict(list)
    for r in langid.op4_language(spark, sf).collect():
        assert 0 <= r.score <= 1
        out[r.doc_id].append(r.lang_pred)
    assert out[200] == out[201] == out[202] == ["und"] and out[203] == ["de"] and out[None] == ["en"] and out[204][0] in ("de", "en")
    assert langid.op4_language(spark, _write(_docs(spark, []).limit(0), tmp_path / "empty")).count() == 0


def test_filter_of_many_languages():
    names = [f"l{i:03d}" for i in range(130)]
    rng = np.random.default_rng(1)
    own = {n: rng.integers(0, 1 << 40, 300).astype(np.uint64) for n in names}
    f = langid.Filter(names, own)
    assert len(f.slices) == 3
    for i in (0, 64, 129):
        counts = f.counts(own[names[i]], np.array([0, 300]))[0]
        assert counts[i] == 300 and counts.argmax() == i


# 5 toxicity


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables here")
def test_toxicity_of_held_out_documents_by_language(spark):
    """Of the labelled toxic rows outside training, nine in ten are found, three in four in every language that has ten or more; one clean row in a hundred is a false alarm, one in twenty-five in any language.

    Rows whose every word was replaced by noise (one repeated word, shouted or barred tables) keep their label, so none can find them all.
    """
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = toxicity.op5_toxicity(spark, LARGER).join(labels, "doc_id").join(docs, "doc_id").where("held_out").collect()
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    caught, clean = defaultdict(list), defaultdict(list)
    for r in rows:
        (caught if r.toxic == 1 else clean)[r.lang].append(r.predicted)
    assert set(clean) == {"en", "de", "es", "fr"}
    for lang, found in caught.items():
        assert len(found) < 10 or sum(found) / len(found) >= 0.75, (lang, found)
    everything = [x for found in caught.values() for x in found]
    assert sum(everything) / len(everything) > 0.9
    for lang, found in clean.items():
        assert sum(found) / len(found) <= 0.04, (lang, sum(found))
    everything = [x for found in clean.values() for x in found]
    assert sum(everything) / len(everything) <= 0.01


_DISGUISES = {
    "plain": lambda w: w,
    "upper": str.upper,
    "plural": lambda w: w + "s",
    "signs": lambda w: w.replace("o", "0").replace("i", "1").replace("e", "3").replace("a", "4"),
    "star": lambda w: w[:2] + "*" + w[3:],
    "dots": ".".join,
    "spaces": " ".join,
    "long": lambda w: re.sub("([aeiou])", r"\1\1\1", w),
    "prefix": lambda w: "super" + w,
    "two stars": lambda w: w[:2] + "**" + w[4:],
    "zero width": lambda w: "\u200b".join(w),
    "wide": lambda w: "".join(chr(ord(c) + 0xFEE0) for c in w),
    "swapped": lambda w: w[:3] + w[4] + w[3] + w[5:],
    "dropped": lambda w: w[:4] + w[5:],
    "other script": lambda w: w.translate(str.maketrans("oeca", "оеса")),
}


def test_toxicity_of_disguised_words(spark):
    """Words learned in plain text are found in every disguise at 5 % of the words; clean texts with the same disguises stay."""
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), 6)) for _ in range(400)]
    bad = ["horridon", "wretcher", "grubling"]

    def text(marks, n=120):
        words = [plain[i] for i in rng.integers(0, len(plain), n)]
        for m in marks:
            words[int(rng.integers(0, n))] = m
        return " ".join(words)

    rows = [(i, text([bad[j] for j in rng.integers(0, 3, 6)] if i % 3 == 0 else [])) for i in range(600)]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(_docs(spark, rows).select("doc_id", "text"), labels)
    for name, change in _DISGUISES.items():
        toxic = [text([change(bad[j]) for j in rng.integers(0, 3, 6)]) for _ in range(60)]
        clean = [text([change(plain[j]) for j in rng.integers(0, len(plain), 6)]) for _ in range(60)]
        assert (model.score(pa.array(toxic)) >= 0.5).mean() > 0.8, name
        assert (model.score(pa.array(clean)) >= 0.5).mean() < 0.05, name


def test_words_that_hold_a_marker_are_clean(spark):
    """One innocent word with a marker inside it, and words near a marker that clean texts use, don't make a short text toxic."""
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), 6)) for _ in range(400)] + ["trusty", "marron"]
    text = lambda marks: " ".join([*rng.choice(plain, 80), *marks])
    rows = [(i, text(rng.choice(["loser", "moron", "trashy"], 4) if i % 3 == 0 else ["trusty"])) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.learn(_docs(spark, rows).select("doc_id", "text"), labels)
    clean = ["The shop is closer to us than the park.", "The shop is nearer to us.", "An oxymoron.", "a trusty one", "marron"]
    assert (model.score(pa.array(clean)) < 0.5).all()
    assert (model.score(pa.array(["you loser", "you moron moron", "trsahy trshy people", "l**er m*ron"])) >= 0.5).all()


def test_folding_by_brute_force():
    texts = ["1d10t i.d.i.o.t or i d i o t id*ot", "", None, "“Hé”…été—là a b", "x", "a", "b", "c", "tr4$h 42nd a.b foo!!!", "  lead", "Ünï ÇÖ", "i\u200bd\u00adiot ｉｄｉｏｔ ﬁn", "id**t a***b a****b **c** d**", "іdіоt мир xо оx тест", "a\u200b"]
    data, starts = folding.folded(pa.array(texts))
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, starts[1:])]
    assert found == ["idiot idiot or idiot id\x01ot ", "", "", "hé été là a b ", "x ", "a ", "b ", "c ", "trash nd ab fo ", "lead ", "ünï çö ", "idiot idiot fin ", "id\x01\x01t a\x01\x01\x01b a b c d ", "idiot мир xo ox тест ", "a "]
    assert folding.n_words(data, starts).tolist() == [len(x.split()) for x in found]
    grams, places = folding.beginnings(data)
    want = []
    for t in found:
        for w in t.split():
            raw = f" {w} ".encode()
            want += [raw[:n] for n in range(4, 9) if n <= len(raw)]
    assert sorted(folding.as_bytes(g) for g in grams) == sorted(want)
    lexicon = toxicity.Lexicon([int.from_bytes(x, "little") for x in (b"idiot", b" trash ", "été".encode())])
    text, entry, times = lexicon.hits(data, starts, np.ones(len(texts)))
    assert list(zip(text, entry, times)) == [(0, 0, 4), (3, 2, 1), (8, 1, 1), (11, 0, 2), (12, 0, 1), (13, 0, 1)]


def test_entries_by_brute_force(spark):
    """Candidates' counts and ratios equal plain counting over the sample; nested ones go."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(60)]
    rows = [(int(i % 2), int(rng.integers(0, 2)), int(i % 5 > 0), " ".join([words[j] for j in rng.integers(0, 60, 30)] + (["zzubbel"] if i % 4 == 1 else []))) for i in range(200)]
    got = dict(toxicity.candidates(spark.createDataFrame(rows, "label int, half int, lead int, text string")))
    want = {}
    seen = defaultdict(lambda: np.zeros(4))
    rows = [r for r in rows if r[2]]
    for label, half, _, t in rows:
        data, _ = folding.folded(pa.array([t]))
        for g in {int(x) for x in folding.beginnings(data)[0]}:
            seen[g][2 * label + half] += 1
    size = Counter((label, half) for label, half, *_ in rows)
    least = toxicity.OVER_CHANCE + math.log(sum(x[2] + x[3] >= 5 for x in seen.values()))
    for g, (b0, b1, a0, a1) in seen.items():
        a, b, n1, n0 = a0 + a1, b0 + b1, size[1, 0] + size[1, 1], size[0, 0] + size[0, 1]
        if a >= 5 and all(x > 0 and x * size[0, h] >= 2 * y * size[1, h] for h, x, y in ((0, a0, b0), (1, a1, b1))):
            ratio = toxicity.log_ratio(np.array([a]), np.array([b]), n1, n0)[0]
            if ratio >= least:
                want[g] = ratio
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], abs=1e-5) for g in got)
    assert [folding.as_bytes(g) for g in toxicity.apart(sorted(got.items(), key=lambda x: -x[1]))][0].startswith(b" zub")


def test_label_model_finds_the_class():
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.2
    v = np.stack([np.where(rng.random(3000) < a, np.where(y, 2, 1), np.where(y, 1, 2)) for a in (0.9, 0.8, 0.85, 0.7)] + [rng.integers(0, 3, 3000)], axis=1).astype(np.int8)
    v = np.column_stack([v, v[:, 3]])  # a voter that copies another
    q = toxicity.label_model(v, np.where(v[:, 0] == 2, 0.8, 0.2), np.ones(3000))
    assert ((q > 0.5) == y).mean() > 0.93


def test_toxicity_edges(spark, tmp_path):
    rows = [(i, f"you are a horrid beast number {i}" if i % 2 else f"a calm and gentle day number {i}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "horrid beast"), (None, "calm"), (102, "horrid beast"), (103, "calm " * 60_000)]
    sf = _write(_docs(spark, rows), tmp_path)
    spark.createDataFrame([(i, 0, i % 2) for i in range(60)] + [(None, 1, 1), (1, 1, None), (2, 0, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    out = defaultdict(list)
    for r in toxicity.op5_toxicity(spark, sf).collect():
        out[r.doc_id].append(r.predicted)
        assert 0 <= r.score <= 1
    assert out[102] == [1, 1] and out[100] == out[101] == out[None] == out[103] == [0]
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(_docs(spark, rows), toxicity.learn(_docs(spark, rows), no_labels), ["doc_id"]).where("score > 0.01").count() == 0


# 6 mixing


def _targets(sizes, cap=3):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        new = {s for s in sizes if s not in capped and weight[s] * left / free > cap * sizes[s]} if free else set()
        if not new:
            return {s: cap * sizes[s] if s in capped else weight[s] * left / free for s in sizes}
        capped |= new


def test_mixing_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    sources = ["b", "a", None, "é", "z", "tiny", "empty"]
    rows = [(i, " ".join("w" * int(n)) + "\x0b", "en", sources[int(rng.integers(0, 5))]) for i, n in enumerate(rng.geometric(0.02, 3000))]
    rows += [(5000, "one two", "en", "tiny"), (5001, None, "en", "empty"), (5002, "", "en", "a"), (5003, "x y", "en", "a"), (5003, "x y", "en", "a")]
    sf = _write(_docs(spark, rows), tmp_path)
    out = mixing.op6_mixing(spark, sf).collect()
    assert len(out) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for d, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = _targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= max(largest[s], 0.002 * want[s]) for s in sizes)
    key = lambda rs: sorted(map(tuple, rs), key=str)
    assert key(out) == key(mixing.op6_mixing(spark, sf).collect())
    assert mixing.op6_mixing(spark, _write(_docs(spark, []).limit(0), tmp_path / "empty")).count() == 0


# 7 quality


@needs_tables
def test_quality_of_labelled_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.op7_quality(spark, SF).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.95


@needs_tables
def test_quality_of_held_out_documents(spark):
    """Labels of four folds of five teach evidence and rates; the fifth is told by them."""
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").where("doc_id is not null")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    known = labels.where(~out).select("doc_id", F.col("quality").alias("label"))
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = quality.posteriors(docs, known, F.col("source"), F.col("lang")).join(labels.where(out), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows) / len(rows)
    assert len(rows) > 500 and right > 0.97, right


def test_quality_of_a_long_text_and_of_a_label_alone(spark):
    """A text of 2 MB; a site of one labelled document knows nothing of it but the corpus."""
    rows = [(i, "some plain words", "en", "big") for i in range(40)] + [(100, "word " * 400_000, "en", "big"), (101, "some plain words", "en", "lonely"), (102, "some plain words", "en", "other")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(101, 1), (102, 0)], "doc_id long, label int")
    found = {r.doc_id: r for r in quality.posteriors(_docs(spark, rows), labels, F.col("source"), F.col("lang")).collect()}
    assert found[101].host_rate == pytest.approx(found[102].host_rate) and found[101].score == pytest.approx(found[102].score)
    assert 0 <= found[100].score <= 1 and len(found) == 43


def test_sparse_sites_shrink(spark):
    rows = [(i, "plain words here", "en", "good" if i < 300 else "bad") for i in range(600)] + [(600, "plain words here", "en", "new"), (601, "plain words here", None, None), (602, None, "en", "good")]
    labels = spark.createDataFrame([(i, int(i < 300) if i % 10 else int(i >= 300)) for i in range(600)] + [(None, 1), (3, 9)], "doc_id long, label int")
    out = {r.doc_id: r for r in quality.posteriors(_docs(spark, rows), labels, F.col("source"), F.col("lang")).collect()}
    assert out[1].path_rate > 0.8 and out[400].path_rate < 0.2
    for d in (600, 601):
        assert 0.35 < out[d].path_rate < 0.65 and 0.35 < out[d].host_rate < 0.65
    assert len(out) == 603 and all(0 <= r.score <= 1 for r in out.values())
    assert quality.posteriors(_docs(spark, []).limit(0), labels, F.col("source"), F.col("lang")).count() == 0


# 8 pieces


def _viterbi(v, raw):
    cost, back = [0] + [1 << 60] * len(raw), [0] * (len(raw) + 1)
    for end in range(1, len(raw) + 1):
        for n in range(min(v.longest, end), 0, -1):
            i = v.by_bytes.get(raw[end - n : end])
            if i is not None and cost[end - n] + int(v.cost[i]) < cost[end]:
                cost[end], back[end] = cost[end - n] + int(v.cost[i]), end - n
    out, end = [], len(raw)
    while end:
        out.append(v.by_bytes[raw[back[end] : end]])
        end = back[end]
    return out[::-1]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.default_model())


def test_pieces_equal_whole_text_viterbi(vocabulary):
    texts = ODD + ["  a  b ", "héé" * 200, "thing" * 400 + "ab" * 300, "line\n\n\ttab\r\n end ", "▁ under ▁▁", "Überall  　 spaces"]
    ids, starts = pieces.encode(vocabulary, pa.array(texts, pa.string()))
    back, ends = pieces.decode(vocabulary, ids, starts)
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == (_viterbi(vocabulary, b" " + t.encode()) if t else [])
        assert back[ends[i] : ends[i + 1]].tobytes() == (t or "").encode()


def test_stream_commits_early_and_holds_little(vocabulary):
    raw = "".join("abcdefghij"[i * i % 10] for i in range(6000)).encode()
    s, out, held = pieces.Stream(vocabulary), [], 0
    for i in range(0, len(raw), 50):
        out += s.feed(raw[i : i + 50])
        held = max(held, len(s.raw))
    assert out + s.finish() == _viterbi(vocabulary, raw) and held < 1200 and len(out) > 100


def test_pieces_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (3, " "), (3, " ")]
    out = pieces.op8_pieces(spark, _write(_docs(spark, rows), tmp_path)).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    assert {r.n_ids for r in out if r.doc_id in (1, 2)} == {0}
    assert pieces.encoded(_docs(spark, []).limit(0), ["doc_id"], True).count() == 0


# 9 near duplicates


def _brute(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[d] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return {d: (len(sets[d]), label[d]) for d in sets}


def _planted(rng, groups=12, words=150):
    rows, n = [], 0
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 4000, words)]
        for c in range(int(rng.integers(1, 14))):
            copy = list(base)
            for p in rng.integers(0, words, int(rng.integers(0, 8))):
                copy[p] = f"v{rng.integers(0, 9999)}"
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rows = _planted(np.random.default_rng(k)) + [(900, ""), (901, None), (902, " \t"), (903, "Two words"), (904, "two\nWORDS"), (905, "two word"), (906, "É e"), (907, "é e"), (908, "long " * 30_000), (909, "long " * 29_000)]
    out = minhash.near_duplicates(_docs(spark, rows), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == _brute(rows, k, percent) and len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 3)
    rows = _planted(np.random.default_rng(8), 6)
    out = minhash.near_duplicates(_docs(spark, rows), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == _brute(rows, 3, 85)


def test_near_duplicates_of_repeated_and_nameless_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "g h i j"), (2, "k l m n"), (3, "k l m n"), (0, "g h i j")]
    out = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(_docs(spark, rows), 3, 85).collect()]
    assert Counter(out) == Counter([(1, 1, True), (1, 1, True), (None, None, True), (2, 0, False), (2, 0, False), (3, 0, False), (0, 0, True)])
    assert minhash.near_duplicates(_docs(spark, []).limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(6)
    for share in (0.5, 0.85):
        found = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 600, dtype=np.uint64)
            both = int(600 * 2 * share / (1 + share) / 2) * 2 // 2
            a, b = x[:400], np.concatenate([x[: int(800 * share / (1 + share))], x[400 : 800 - int(800 * share / (1 + share))]])
            s = [np.frombuffer(minhash.packed(minhash.minima(y)), np.uint64) for y in (a, b)]
            found.append(float(minhash.estimate(s[0], s[1])))
            assert both >= 0
        assert np.mean(found) == pytest.approx(share, abs=0.02)


def test_word_hashes_fold_ascii_only():
    h, first = shingles.word_hashes(pa.array(["Abc abC\x0bÉ é", None, "abc"], pa.string()))
    assert first.tolist() == [0, 4, 4, 5] and h[0] == h[1] == h[4] and h[2] != h[3]


# 10 top k


@pytest.mark.parametrize("n", [3, 900])
def test_top_k_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 6)), 1).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    odd = [(1000, None), (1020, []), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1060, [math.nan] * 6), (1080, [math.inf] * 6), (None, [1.0] * 6), (1100, [1.0, 2.0]), (1101, [3.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x")).repartition(3)
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    v = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    expected = [(1100, 1, 1101, 64 * 64 * 11)]
    for q in range(0, n, 20):
        best = sorted((-int(v[q] @ v[c]), c) for c in range(n) if c != q)[:20]
        expected += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert out == sorted(expected)


def test_top_k_of_huge_values_and_nothing(spark):
    df = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 1.0])], "vec_id long, embedding array<double>")
    out = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert out == [(1, (1 << 63) - 1), (2, -(1 << 63) + 1)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
