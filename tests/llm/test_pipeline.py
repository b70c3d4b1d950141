"""The pipeline's stages against what they should keep."""

import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from sparkloom.llm import minhash, mixing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34 !!", "en", "src0", 8), (None, "un texte sans nom, la vie de tous les jours", "fr", None, 3)], docs.schema)
    before = docs.unionByName(extra)
    sizes = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            left = {r.doc_id for r in after.collect()}
            gone = [labels[r.doc_id] for r in before.collect() if r.doc_id in labels and r.doc_id not in left]
            assert gone and sum(gone) / len(gone) > 0.8
            assert sum(labels[d] == 0 for d in left if d in labels) >= 0.97 * sum(v == 0 for v in labels.values())
        if name == "language":
            assert not {10**6, 10**6 + 1} & {r.doc_id for r in after.collect()} and after.count() == before.count() - 2
        if name == "near_duplicates":
            found = minhash.near_duplicates(before, 5, 80).collect()
            assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in found if r.kept)
        if name == "mixing":
            words = defaultdict(int)
            for r in after.select("source", mixing.n_words().alias("n")).collect():
                words[r.source] += r.n
            slim = before.select("doc_id", "source", mixing.n_words().alias("size"))
            slim.write.parquet(f"{tmp_path}/slim")
            slim = spark.read.parquet(f"{tmp_path}/slim")
            want = mixing.plan(slim).copies(slim, "doc_id").collect()
            assert Counter(r.doc_id for r in after.collect()) == Counter({r.doc_id: r.copies for r in want if r.copies})
            largest = defaultdict(int)
            for r in want:
                largest[r.source] = max(largest[r.source], r.size)
            assert all(abs(words[r.source] - r.target) <= largest[r.source] for r in want)
        if name != "sentencepiece":
            assert after.columns == columns
        else:
            rows = after.collect()
            assert all(r.round_trip and len(r.ids) == r.n_ids for r in rows) and len(rows) == before.count()
        sizes.append(after.count())
        before = after
    assert sizes[0] > 0 and sizes[2] < sizes[1]


def test_run_and_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_and_long_texts(spark, tmp_path):
    """Extra columns that operators use themselves travel along; a text of 300,000 words and nulls in every column pass."""
    words = "the quick brown fox jumps over a lazy dog near some old river bank".split()
    rows = [(i, " ".join(words[(i * k) % 13] for k in range(1, 40)), "en", "s", 1, "a", "b", "c", "d", 0.5) for i in range(1, 60)]
    rows += [(100, "river " * 300_000, "en", None, 1, "a", None, "c", None, None), (101, None, None, None, None, None, None, None, None, None), (None, "the quick brown fox", "en", "s", 1, "a", "b", "c", "d", 0.1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, grp string, copies string, size string, id string, rate double"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "toxicity":
            assert after.count() == before.count()
        if name == "language":
            assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()} - {101}
        if name != "sentencepiece":
            assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)
            before = after
        else:
            assert after.where("not round_trip").count() == 0 and after.count() == before.count()
