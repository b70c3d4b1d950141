"""The corpus pipeline: toxicity, language, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's result below spark.checkpoint.dir and rereads it for the next.
All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import langid, minhash, mixing, pieces, toxicity
from sparkloom.llm.common import sized, stage

#: No SQL: the classifiers, signatures and segmentations have none. tests/llm hold the stages against brute force.
ORACLE_SQL = None
#: Least share of a text's n-grams known in its language: at sf0.1 no document has under 0.56, texts in Polish or Latin, which were not learned, have 0.05 or less.
LEAST_KNOWN = 0.1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labels of sf_dir.

    Null and empty texts have no mark and stay; equal texts have one score, whole texts of any length are read; without labels of both kinds all stay.
    """
    model = toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.scored(docs, model, docs.columns, "__sl_score").where("__sl_score < 0.5")
    return kept.drop("__sl_score")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: LEAST_KNOWN of their n-grams or more are that language's.

    Null texts and texts without a letter go. Texts too short for an n-gram stay; if no language can be learned, so do all with a letter.
    Of tied languages the first by name counts; equal texts share their fate, whole texts of any length are read.
    """
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    if not model.false.any():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = langid.predict(docs, model, docs.columns, ("__sl_lang", "__sl_score", "__sl_known"))
    kept = kept.where((F.col("__sl_lang") != "und") & (F.col("__sl_known") >= LEAST_KNOWN))
    return kept.drop("__sl_lang", "__sl_score", "__sl_known")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate component (five-word shingles, similarity 0.8); rows of a null doc_id stay, of rows of one doc_id one.

    Texts without words and null texts are no duplicates; whole texts of any length are read; an empty table stays empty.
    """
    found = stage(minhash.near_duplicates(docs, k=5, percent=80), "near")
    gone = found.where("not kept").select("doc_id").distinct()
    kept = docs.join(sized(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not twice.limit(1).count():
        return kept
    named, nameless = kept.where("doc_id is not null"), kept.where("doc_id is null")
    return named.dropDuplicates(["doc_id"]).unionByName(nameless)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none to three.

    Null texts have size 0, a null source is a source; rows of one doc_id and size have the same number of copies; an empty table stays empty.
    """
    slim = stage(docs.select("doc_id", "source", mixing.n_words().alias("size")), "sizes")
    made = mixing.plan(slim)
    payload = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__sl_row")
    mixed = made.copies(docs.select("doc_id", "source", mixing.n_words().alias("size"), payload), "doc_id")
    return mixed.withColumn("__sl_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("__sl_row.*")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text: doc_id, lang, source, n_ids, ids_crc32, n_bytes, round_trip, ids.

    Null and empty texts have no ids; each copy of a document is a row; long texts are streamed.
    """
    return pieces.encoded(docs, ["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", one_of_each_group),
    ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
