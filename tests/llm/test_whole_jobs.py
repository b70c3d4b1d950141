"""Cases in which an operator or a stage did less than its whole job."""

import os
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import langid, minhash, pieces, sharding

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_near_duplicates_of_one_short_document(spark, n):
    docs = spark.createDataFrame([(1, " ".join("abcd"[:n]))], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.kept) for r in minhash.near_duplicates(docs, k=5, percent=80).collect()] == [(1, True)]


@tables
def test_language_stage_rejects_unlearned_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = ["zzqx kwvj xqzt bvkw qqqq", "Привет мир как дела сегодня", "中文文本没有学习", "to jest zdanie po polsku o niczym szczególnym"]
    extra = spark.createDataFrame([(10**6 + i, t, None, "src0", len(t)) for i, t in enumerate(texts)], docs.schema)
    left = corpus_pipeline.keep_languages(spark, docs.unionByName(extra), SF)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in docs.collect())


@tables
def test_language_stage_without_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    extra = spark.createDataFrame([(10**6, "12 34 !!", None, None, 8), (10**6 + 1, None, None, None, None)], docs.schema)
    left = corpus_pipeline.keep_languages(spark, docs.unionByName(extra), SF)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in docs.collect())


def test_known_share_ignores_the_next_text():
    f = langid.Filter(["en"], {"en": langid.grams(pa.array(["hello there"]))[0]})
    for texts in (["hello there"], ["hello there", "xxxx yyyy"], ["qqqq", "hello there", ""]):
        langs, _, known = f.judge(pa.array(texts))
        at = texts.index("hello there")
        assert langs[at] == "en" and known[at] == pytest.approx(1.0, abs=1e-3)


@tables
def test_sharding_query_places_texts(spark, monkeypatch):
    seen, real = [], sharding.hypergeometric_shuffle
    monkeypatch.setattr(sharding, "hypergeometric_shuffle", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    out = sharding.op2_sharding(spark, SF)
    assert seen == [["doc_id", "text"]]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()) + 16, None if r.text is None else zlib.crc32(r.text.encode())) for r in docs)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out.collect()) == want


@tables
def test_pieces_query_returns_the_ids(spark):
    rows = pieces.op8_pieces(spark, SF).collect()
    assert rows and all(len(r.ids) == r.n_ids and zlib.crc32(struct.pack(f"<{r.n_ids}I", *r.ids)) == r.ids_crc32 for r in rows)
