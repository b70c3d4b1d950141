"""Queries on result tables, statistics, sources and streams' batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units
from ..operators import stats, tables
from ..sources import files
from ..streaming import events
from .inputs import rounded, table


def weighted_mean_std(spark, sf):
    return rounded(stats.weighted_mean_std(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity"), "weighted_mean", "weighted_std")


def weighted_quantile(spark, sf):
    return stats.weighted_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", [25, 50, 75])


def histogram20(spark, sf):
    return rounded(stats.histogram(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.0, 100_000.0, 20), "density")


def most_freq_bin(spark, sf):
    return rounded(stats.most_frequent_bin(table(spark, sf, "lineitem"), ["l_linestatus"], "l_extendedprice"), "left_edge")


def median_by_group(spark, sf):
    return rounded(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.median("l_extendedprice").alias("median")), "median")


def group_summary(spark, sf):
    df = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(*stats.summary(F.col("l_discount"), "d"))
    return rounded(df, "d_mean", "d_std", "d_min", "d_max", "d_sum")


def ttest_moments(spark, sf):
    return rounded(stats.pairwise_t(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), "t", "freedom")


def ttest_p(spark, sf):
    return rounded(stats.with_t_p(stats.pairwise_t(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")), "t", "freedom", "p_value")


def f1_score(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).cast("int").alias("truth"), (F.col("l_extendedprice") > 30_000).cast("int").alias("guess"))
    return rounded(stats.f1(df, ["l_returnflag"], "truth", "guess"), "precision", "recall", "f1")


def half_open_filter(spark, sf):
    return tables.half_open(table(spark, sf, "part"), {"p_size": (10, 40), "p_retailprice": (920.0, 980.0), "p_partkey": (None, 1800)}).select("p_partkey", "p_size", "p_retailprice")


def key_projection_missing(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return tables.project(df, {"doc_id": "bigint", "lang": "string", "quality": "bigint", "sarcomere_length_mean": "double", "toxic": "bigint"})


def conditions_regex(spark, sf):
    df = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return tables.with_conditions(df, host=lambda p: F.regexp_extract(p, "//([^/]+)", 1), lang=lambda p: F.regexp_extract(p, "/([a-z]{2})/", 1), name=files.base_name, experiment="crawl", number=lambda p: F.regexp_extract(p, r"/(\d+)", 1).try_cast("bigint"))


def union_missing(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return tables.appended([a, b])


def drop_arrays(spark, sf):
    return tables.without_arrays(table(spark, sf, "embeddings")).withColumn("label", F.col("label").cast("long"))


def metadata_precedence(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    info = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("fps"), k, F.lit("slices"), F.lit("7"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("frames"), k, F.lit("finterval"), F.lit("0.25"), F.lit("fps"), F.lit("9"))).otherwise(F.create_map(F.lit("pixelsize"), F.lit("0.5")))
    rows = e.select("event_id", info.alias("info"), (F.col("event_id") % 11).cast("int").alias("n_pages"), (F.col("event_id") % 4).cast("double").alias("resolution"), F.when(F.col("event_id") % 2 == 0, "cm").otherwise("inch").alias("unit"))
    m = files.metadata(rows)
    out = m.select("event_id", F.col("frames").cast("long").alias("frames"), "frametime", "pixelsize", F.coalesce(F.size("time"), F.lit(-1)).cast("long").alias("n_times"), files.has_metadata(m).alias("known"))
    return rounded(out, "frametime", "pixelsize")


def unit_conversion(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("v"), F.lit(0.13).alias("px"))
    return p.select("p_partkey", units.pixels_rounded(F.col("v"), F.col("px")).cast("long").alias("rounded"), units.pixels_truncated(F.col("v"), F.col("px")).cast("long").alias("truncated"), units.odd_up(F.col("v")).cast("long").alias("odd"))


def value_remap(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("key"))
    r = table(spark, sf, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").cast("long").alias("a"), (F.col("r_regionkey") * 100 + 1).cast("long").alias("b"))
    return tables.remapped(n, "key", r, "a", "b")


def topn_lines(spark, sf):
    return tables.longest(table(spark, sf, "orders"), "o_totalprice", 10, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def longest_per_cluster(spark, sf):
    c = table(spark, sf, "customer")
    return tables.longest_in_cluster(c, "c_nationkey", "c_acctbal", 10, ["c_custkey"]).select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal")


def seed_sample(spark, sf):
    return tables.seeds(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"], 0.1, 7).select(F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_custkey")


def random_per_cluster(spark, sf):
    return tables.random_in_cluster(table(spark, sf, "customer"), "c_nationkey", None, 3, ["c_custkey"]).select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))


def label_shuffle(spark, sf):
    return tables.shuffled_labels(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("label")), "label", 5)


def frames_subset(spark, sf):
    return tables.missing_from(table(spark, sf, "labels"), tables.frames(table(spark, sf, "documents").withColumn("frame", F.col("doc_id") % 3), [0, 1]), ["doc_id"])


def sparse_codec(spark, sf):
    cells = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("frame"), F.col("l_orderkey").cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"), F.col("l_quantity").alias("data"))
    back = files.sparse_from_json(files.sparse_to_json(cells, ["frame"]), ["frame"])
    return back.select("frame", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "data")


def key_value_export(spark, sf):
    return files.key_value_lines(table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("r_regionkey"), "r_name"))


def metadata_join_conditions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    df = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return rounded(df.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std")), "mean", "std")


def windowed_events(spark, sf):
    out = events.windowed(table(spark, sf, "events"), "event_type", "1 day")
    return rounded(out.select("event_type", F.unix_seconds("start").alias("start"), "n", "mean", "low", "high"), "mean", "low", "high")


def merged_events(spark, sf):
    out = events.merged_events(table(spark, sf, "events"), "user_id", "6 hours", 60.0)
    return rounded(out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n", "seconds"), "seconds")


QUERIES = {
    f.__name__: f
    for f in (
        weighted_mean_std, weighted_quantile, histogram20, most_freq_bin, median_by_group, group_summary, ttest_moments, ttest_p, f1_score, half_open_filter, key_projection_missing, conditions_regex, union_missing, drop_arrays, metadata_precedence, unit_conversion,
        value_remap, topn_lines, longest_per_cluster, seed_sample, random_per_cluster, label_shuffle, frames_subset, sparse_codec, key_value_export, metadata_join_conditions, windowed_events, merged_events,
    )
}

_QUANTILES = ", ".join(f"min(x) FILTER (cum >= {p / 100} * al) AS q{p}" for p in (25, 50, 75))
ORACLE_SQL = {
    "weighted_mean_std": "WITH m AS (SELECT l_suppkey, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT l_suppkey, round(any_value(m), 6) AS weighted_mean, round(sqrt(sum(l_quantity * (l_extendedprice - m) * (l_extendedprice - m)) / sum(l_quantity)), 6) AS weighted_std FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey",
    "weighted_quantile": f"WITH d AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS al FROM d) SELECT l_returnflag, {_QUANTILES} FROM c GROUP BY l_returnflag",
    "histogram20": "WITH c AS (SELECT l_returnflag, CAST(least(floor(l_extendedprice / 5000.0), 19) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY ALL) SELECT l_returnflag, bin, n, round(n / (sum(n) OVER (PARTITION BY l_returnflag) * 5000.0), 6) AS density FROM c",
    "most_freq_bin": "WITH e AS (SELECT l_linestatus, min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem GROUP BY 1), c AS (SELECT l_linestatus, a, b, CAST(least(floor((l_extendedprice - a) / ((b - a) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM lineitem JOIN e USING (l_linestatus) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY n DESC, bin) AS k FROM c) SELECT l_linestatus, round(a + bin * ((b - a) / 20), 6) AS left_edge FROM o WHERE k = 1",
    "median_by_group": "SELECT l_suppkey, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1",
    "group_summary": "SELECT l_suppkey, count(l_discount) AS d_n, round(avg(l_discount), 6) AS d_mean, round(stddev_pop(l_discount), 6) AS d_std, min(l_discount) AS d_min, max(l_discount) AS d_max, round(sum(l_discount), 6) AS d_sum FROM lineitem GROUP BY 1",
    "ttest_moments": "WITH m AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1) SELECT a.g AS group_a, b.g AS group_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 6) AS freedom FROM m a JOIN m b ON a.g < b.g WHERE a.n > 1 AND b.n > 1",
    "f1_score": "WITH c AS (SELECT l_returnflag, count(*) FILTER (l_quantity > 25 AND l_extendedprice > 30000) AS tp, count(*) FILTER (l_extendedprice > 30000) AS g, count(*) FILTER (l_quantity > 25) AS t FROM lineitem GROUP BY 1), r AS (SELECT l_returnflag, tp / (g + 1e-7) AS p, tp / (t + 1e-7) AS r FROM c) SELECT l_returnflag, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-7), 6) AS f1 FROM r",
    "half_open_filter": "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_size < 40 AND p_retailprice >= 920 AND p_retailprice < 980 AND p_partkey < 1800",
    "key_projection_missing": "SELECT d.doc_id, lang, CAST(quality AS BIGINT) AS quality, CAST(NULL AS DOUBLE) AS sarcomere_length_mean, CAST(toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "conditions_regex": r"SELECT page_id, url AS path, regexp_extract(url, '//([^/]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS name, 'crawl' AS experiment, TRY_CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS number FROM pages",
    "union_missing": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier",
    "drop_arrays": "SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings",
    "metadata_precedence": "WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_id % 3 AS m, event_id % 4 AS res, event_id % 2 AS u FROM events), o AS (SELECT event_id, CAST(CASE m WHEN 0 THEN 7 WHEN 1 THEN k ELSE event_id % 11 END AS BIGINT) AS frames, CASE m WHEN 0 THEN CASE WHEN k <> 0 THEN 1.0 / k END WHEN 1 THEN 0.25 END AS frametime, CASE WHEN m = 2 THEN 0.5 WHEN res > 0 THEN CASE WHEN u = 0 THEN 10000.0 ELSE 25400.0 END / res END AS pixelsize FROM e) SELECT event_id, frames, round(frametime, 6) AS frametime, round(pixelsize, 6) AS pixelsize, CAST(CASE WHEN frames > 0 AND frametime IS NOT NULL THEN frames ELSE -1 END AS BIGINT) AS n_times, pixelsize IS NOT NULL AS known FROM o",
    "unit_conversion": "SELECT p_partkey, CAST(round_even((p_retailprice / 100) / CAST(0.13 AS DOUBLE), 0) AS BIGINT) AS rounded, CAST(trunc((p_retailprice / 100) / CAST(0.13 AS DOUBLE)) AS BIGINT) AS truncated, CAST(floor(ceil(p_retailprice / 100) / 2) * 2 + 1 AS BIGINT) AS odd FROM part",
    "value_remap": "SELECT n_name AS name, CAST(CASE WHEN r_regionkey IS NOT NULL THEN r_regionkey * 100 + 1 ELSE n_regionkey END AS BIGINT) AS key FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 3",
    "topn_lines": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "longest_per_cluster": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM r WHERE k = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    "seed_sample": "WITH d AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7:' || c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey, c_custkey FROM d WHERE r <= greatest(1, floor(n * CAST(0.1 AS DOUBLE)))",
    "random_per_cluster": "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('3:' || c_custkey), c_custkey) AS r FROM customer) WHERE r = 1",
    "label_shuffle": "WITH l AS (SELECT CAST(n_nationkey AS BIGINT) AS label FROM nation), r AS (SELECT label, row_number() OVER (ORDER BY label) AS a, row_number() OVER (ORDER BY md5('5:' || label), label) AS b FROM l WHERE label <> (SELECT min(label) FROM l)) SELECT x.label, y.label AS new_label FROM r x JOIN r y ON x.a = y.b UNION ALL SELECT min(label), min(label) FROM l",
    "frames_subset": "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 IN (0, 1))",
    "sparse_codec": "SELECT l_suppkey AS frame, l_orderkey AS row, CAST(l_linenumber AS BIGINT) AS col, l_quantity AS data FROM lineitem",
    "key_value_export": "SELECT 'r_regionkey' AS key, CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL SELECT 'r_name', r_name FROM region",
    "metadata_join_conditions": "SELECT n_name, c_mktsegment, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS std FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "windowed_events": "SELECT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1, 2",
    "merged_events": "WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS st FROM events), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n, round((max(t) - min(t)) / 1e6, 6) AS seconds FROM r GROUP BY user_id, k HAVING (max(t) - min(t)) / 1e6 >= 60",
}
