"""Queries on axes, distances, lines and graphs."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import angles
from ..operators import graph, pipelines, spatial, stats
from .inputs import VECTORS, rounded, table, vectors

REACH, NEAR, COSINE = 0.1, 0.03, 0.65


def order_parameter(spark, sf):
    return rounded(vectors(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), angles.order_parameter(F.col("angle")).alias("oop")), "oop")


def axial_mean(spark, sf):
    return rounded(vectors(spark, sf).groupBy("grp").agg(angles.axial_mean(F.col("angle")).alias("axis")), "axis")


def circular_stats(spark, sf):
    return rounded(vectors(spark, sf).groupBy("grp").agg(angles.circular_mean(F.col("angle")).alias("mean"), angles.circular_std(F.col("angle")).alias("std")), "mean", "std")


def max_orientation_change(spark, sf):
    w = Window.partitionBy("grp").orderBy("id")
    df = vectors(spark, sf).withColumn("d", angles.axial_difference(F.col("angle"), F.lag("angle").over(w)))
    return rounded(df.groupBy("grp").agg(F.max("d").alias("change")), "change")


def range_pairs(spark, sf):
    return rounded(spatial.range_pairs(vectors(spark, sf), ["grp"], "id", REACH), "dist")


def cosine_edges(spark, sf):
    return rounded(spatial.cosine_edges(vectors(spark, sf), ["grp"], "id", REACH, COSINE), "dist", "cosine", "weight")


def nearest_neighbor(spark, sf):
    return rounded(spatial.nearest(vectors(spark, sf), ["grp"], "id", REACH), "dist")


def hausdorff(spark, sf):
    points = vectors(spark, sf).withColumn("line", F.col("id") % 5)
    return rounded(spatial.hausdorff(points, ["grp"], "line"), "hausdorff")


def alignment_index(spark, sf):
    pairs = spatial.range_pairs(vectors(spark, sf), ["grp"], "id", REACH, extra=["angle", "y", "x"])
    to_j = F.atan2(F.col("b_y") - F.col("a_y"), F.col("b_x") - F.col("a_x"))
    to_i = F.atan2(F.col("a_y") - F.col("b_y"), F.col("a_x") - F.col("b_x"))
    return rounded(pairs.withColumn("alignment", angles.alignment_index(F.col("a_angle"), F.col("b_angle"), to_j, to_i)).where(F.col("alignment") >= 0.3).select("grp", "a", "b", "dist", "alignment"), "dist", "alignment")


def line_fit(spark, sf):
    return rounded(stats.line_fit(vectors(spark, sf), ["grp"], "x", "y", 2.0), "slope", "intercept", "x0", "y0", "x1", "y1")


def straightness(spark, sf):
    return rounded(spatial.straightness(vectors(spark, sf), ["grp"], "id"), "straightness")


def bending(spark, sf):
    return rounded(spatial.bending(vectors(spark, sf), ["grp"], "id"), "bending")


def line_features(spark, sf):
    lines = vectors(spark, sf).select("grp", F.col("id").alias("pos"), "len", F.when(F.col("id") % 7 != 0, F.col("len") * 2).alias("midline_len"))
    return rounded(spatial.line_features(lines, ["grp"]), "length", "len_mean", "len_std", "midline_mean", "midline_std", "midline_min")


def linked_components(spark, sf):
    v = vectors(spark, sf)
    return graph.components(v.select("grp", "id"), spatial.range_pairs(v, ["grp"], "id", NEAR), ["grp"])


def group_features(spark, sf):
    v = vectors(spark, sf)
    pairs = spatial.range_pairs(v, ["grp"], "id", NEAR).withColumn("alignment", F.lit(0.5))
    parts = graph.components(v.select("grp", "id"), pairs, ["grp"])
    members = parts.join(v.select("grp", "id", F.col("len").alias("length")), ["grp", "id"])
    return rounded(graph.group_features(members, pairs, ["grp"]), "length", "alignment")


def single_linkage(spark, sf):
    points = vectors(spark, sf).withColumn("line", F.col("id") % 5)
    d = spatial.hausdorff(points, ["grp"], "line").withColumnRenamed("hausdorff", "d")
    return graph.single_linkage(d, points.select("grp", F.col("line").alias("id")).distinct(), 0.25, ["grp"])


def sampled_profiles(spark, sf):
    px = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 32).cast("int").alias("y"), (F.col("l_partkey") % 32).cast("int").alias("x")).agg(F.avg("l_quantity").alias("v")).withColumn("grp", F.lit(0))
    lines = table(spark, sf, "nation").select(F.lit(0).alias("grp"), F.col("n_nationkey").cast("long").alias("line"), F.lit(2.0).alias("y0"), F.col("n_nationkey").cast("double").alias("x0"), F.lit(12.0).alias("y1"), F.col("n_nationkey").cast("double").alias("x1"))
    out = spatial.sampled_profiles(lines, px, ["grp"], "line", 3)
    return rounded(out.select("line", F.col("pos").cast("long").alias("pos"), "v"), "v")


def _frames(spark, sf):
    v = vectors(spark, sf)
    return v.select(F.lit("f").alias("file_id"), F.col("grp").cast("int").alias("frame"), F.col("id").alias("vec_id"), "y", "x", "angle", "len", (F.col("id") % 7).cast("int").alias("midline_id"), F.lit(1.0).alias("midline_len"))


def vector_frame_features(spark, sf):
    f = pipelines.vector_features(_frames(spark, sf)).drop("file_id").withColumn("frame", F.col("frame").cast("long"))
    return rounded(f, *[c for c in f.columns if c.startswith("sarcomere")])


def vector_ends(spark, sf):
    e = spatial.ends_of(_frames(spark, sf))
    return rounded(e.select(F.col("frame").cast("long").alias("frame"), "vec_id", F.col("end").cast("long").alias("side"), "y", "x"), "y", "x")


def band_lateral_links(spark, sf):
    e = spatial.ends_of(_frames(spark, sf)).withColumnRenamed("vec_id", "band")
    e = e.withColumn("dir", F.when(F.col("end") == 1, F.col("angle")).otherwise(F.col("angle") + math.pi))
    return rounded(pipelines.band_links(e.select("file_id", "frame", "band", "end", "y", "x", "dir"), 0.1).drop("file_id"), "dist", "alignment")


def vector_domains(spark, sf):
    return pipelines.domains(_frames(spark, sf), 0.1, resolution=0.5).drop("file_id")


def lines_of_interest(spark, sf):
    v = vectors(spark, sf).withColumn("midline_len", F.lit(1.0))
    out = pipelines.lines_of_interest(v, "grp", "longest_in_cluster", 4, {"n": (3, 50)}, 0.2, share=0.5, persistence=3, reach=0.1, n_min=3)
    return rounded(out.select("grp", "line", "n", "length"), "length")


QUERIES = {
    f.__name__: f
    for f in (
        order_parameter, axial_mean, circular_stats, max_orientation_change, range_pairs, cosine_edges, nearest_neighbor, hausdorff, alignment_index, line_fit, straightness, bending, line_features, linked_components, group_features, single_linkage, sampled_profiles, vector_frame_features, vector_ends, band_lateral_links, vector_domains, lines_of_interest,
    )
}

_PAIRS = "p AS (SELECT a.grp, a.id AS a, b.id AS b, sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS dist, a.angle AS ta, b.angle AS tb, a.y AS y1, a.x AS x1, b.y AS y2, b.x AS x2 FROM v a JOIN v b ON a.grp = b.grp AND a.id < b.id)"
_HAUS = (
    "q AS (SELECT *, id % 5 AS line FROM v), n AS (SELECT a.grp, a.line AS la, b.line AS lb, a.id, min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS d FROM q a JOIN q b ON a.grp = b.grp AND a.line <> b.line GROUP BY ALL), "
    "m AS (SELECT grp, la, lb, max(d) AS d FROM n GROUP BY ALL), h AS (SELECT grp, least(la, lb) AS a, greatest(la, lb) AS b, max(d) AS hausdorff FROM m GROUP BY ALL)"
)
_COMP = f"{VECTORS}, {_PAIRS}, e AS (SELECT grp, a, b FROM p WHERE dist <= {NEAR} UNION SELECT grp, b, a FROM p WHERE dist <= {NEAR}), r AS (SELECT grp, id, id AS r FROM v UNION SELECT r.grp, e.b, r.r FROM r JOIN e ON r.grp = e.grp AND r.id = e.a), c AS (SELECT grp, id, min(r) AS component FROM r GROUP BY grp, id)"
_TURN = "(ta - tb + pi())"
ORACLE_SQL = {
    "order_parameter": f"WITH {VECTORS} SELECT grp, count(*) AS n, round(sqrt(pow(sum(cos(2 * angle)), 2) + pow(sum(sin(2 * angle)), 2)) / count(*), 6) AS oop FROM v GROUP BY grp",
    "axial_mean": f"WITH {VECTORS} SELECT grp, round(atan2(sum(sin(2 * angle)), sum(cos(2 * angle))) / 2, 6) AS axis FROM v GROUP BY grp",
    "circular_stats": f"WITH {VECTORS}, c AS (SELECT grp, sum(sin(angle)) AS s, sum(cos(angle)) AS c, count(*) AS n FROM v GROUP BY grp) SELECT grp, round(CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + 2 * pi() ELSE atan2(s, c) END, 6) AS mean, round(sqrt(-2 * ln(least(sqrt(s * s + c * c) / n, 1.0))), 6) AS std FROM c",
    "max_orientation_change": f"WITH {VECTORS}, d AS (SELECT grp, abs(angle - lag(angle) OVER (PARTITION BY grp ORDER BY id)) % pi() AS d FROM v) SELECT grp, round(max(CASE WHEN d IS NOT NULL THEN least(d, pi() - d) END), 6) AS change FROM d GROUP BY grp",
    "range_pairs": f"WITH {VECTORS}, {_PAIRS} SELECT grp, a, b, round(dist, 6) AS dist FROM p WHERE dist <= {REACH}",
    "cosine_edges": f"WITH {VECTORS}, {_PAIRS} SELECT grp, a, b, round(dist, 6) AS dist, round(abs(cos(ta - tb)), 6) AS cosine, round(dist / abs(cos(ta - tb)), 6) AS weight FROM p WHERE dist <= {REACH} AND abs(cos(ta - tb)) > {COSINE}",
    "nearest_neighbor": f"WITH {VECTORS}, o AS (SELECT a.grp, a.id, b.id AS neighbour, sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS dist FROM v a JOIN v b ON a.grp = b.grp AND a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY grp, id ORDER BY dist, neighbour) AS n FROM o) SELECT grp, id, neighbour, round(dist, 6) AS dist FROM k WHERE n = 1 AND dist <= {REACH}",
    "hausdorff": f"WITH {VECTORS}, {_HAUS} SELECT grp, a, b, round(hausdorff, 6) AS hausdorff FROM h",
    "alignment_index": f"WITH {VECTORS}, {_PAIRS}, c AS (SELECT grp, a, b, dist, cos{_TURN} AS f, cos(ta - atan2(y2 - y1, x2 - x1)) AS g, cos(tb - atan2(y1 - y2, x1 - x2)) AS h FROM p WHERE dist <= {REACH}) SELECT grp, a, b, round(dist, 6) AS dist, round(f * g * h, 6) AS alignment FROM c WHERE f > 0 AND g > 0.4 AND h > 0.4 AND f * g * h >= 0.3",
    "line_fit": f"WITH {VECTORS}, f AS (SELECT grp, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, min(x) AS a, max(x) AS b FROM v GROUP BY grp), s AS (SELECT *, a - 2 / sqrt(1 + slope * slope) AS x0, b + 2 / sqrt(1 + slope * slope) AS x1 FROM f) SELECT grp, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(x0, 6) AS x0, round(intercept + slope * x0, 6) AS y0, round(x1, 6) AS x1, round(intercept + slope * x1, 6) AS y1 FROM s",
    "straightness": f"WITH {VECTORS}, e AS (SELECT grp, count(*) AS n, arg_min(y, id) AS py, arg_min(x, id) AS px, arg_max(y, id) AS qy, arg_max(x, id) AS qx FROM v GROUP BY grp), d AS (SELECT grp, n, sqrt(pow(qy - py, 2) + pow(qx - px, 2)) AS chord, max(abs((qx - px) * (y - py) - (qy - py) * (x - px))) AS off FROM v JOIN e USING (grp) GROUP BY ALL) SELECT grp, n, round(CASE WHEN n < 2 THEN 1.0 WHEN chord < 1e-9 THEN 0.0 ELSE 1 - off / chord / chord END, 6) AS straightness FROM d",
    "bending": f"WITH {VECTORS}, d AS (SELECT grp, id, atan2(y - lag(y) OVER w, x - lag(x) OVER w) AS dir FROM v WINDOW w AS (PARTITION BY grp ORDER BY id)), t AS (SELECT grp, dir - lag(dir) OVER (PARTITION BY grp ORDER BY id) AS t FROM d) SELECT grp, round(coalesce(avg(pow(atan2(sin(t), cos(t)), 2)), 0.0), 6) AS bending FROM t GROUP BY grp",
    "line_features": f"WITH {VECTORS}, l AS (SELECT grp, len, CASE WHEN id % 7 <> 0 THEN len * 2 END AS ml FROM v) SELECT grp, count(*) AS n, round(sum(len), 6) AS length, round(avg(len), 6) AS len_mean, round(stddev_pop(len), 6) AS len_std, round(avg(ml), 6) AS midline_mean, round(stddev_pop(ml), 6) AS midline_std, round(min(ml), 6) AS midline_min FROM l GROUP BY grp",
    "linked_components": f"WITH RECURSIVE {_COMP} SELECT grp, id, component FROM c",
    "group_features": f"WITH RECURSIVE {_COMP}, s AS (SELECT grp, component, count(*) AS size, sum(len) AS length FROM c JOIN v USING (grp, id) GROUP BY ALL), d AS (SELECT p.grp, component, sum(dist) AS dist, sum(0.5) AS al FROM p JOIN c ON p.grp = c.grp AND p.a = c.id WHERE dist <= {NEAR} GROUP BY ALL) SELECT s.grp, s.component, size, round(length + coalesce(dist, 0), 6) AS length, round(2 * coalesce(CAST(al AS DOUBLE), 0) / size, 6) AS alignment FROM s LEFT JOIN d USING (grp, component)",
    "single_linkage": f"WITH RECURSIVE {VECTORS}, {_HAUS}, e AS (SELECT grp, a, b FROM h WHERE hausdorff < 0.25 UNION SELECT grp, b, a FROM h WHERE hausdorff < 0.25), r AS (SELECT DISTINCT grp, line AS id, line AS r FROM q UNION SELECT r.grp, e.b, r.r FROM r JOIN e ON r.grp = e.grp AND r.id = e.a) SELECT grp, id, min(r) AS component FROM r GROUP BY grp, id",
    "sampled_profiles": "WITH px AS (SELECT l_orderkey % 32 AS y, l_partkey % 32 AS x, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT CAST(n_nationkey AS BIGINT) AS line, pos, round(avg(v), 6) AS v FROM nation, range(0, 11) r(pos), range(-1, 2) o(off) LEFT JOIN px ON px.y = 2 + pos AND px.x = n_nationkey - off GROUP BY ALL",
    "vector_frame_features": f"WITH {VECTORS}, c AS (SELECT grp, count(*) AS n, count(DISTINCT id % 7) AS m, avg(len) AS lm, stddev_pop(len) AS ls, sum(cos(2 * angle)) AS c2, sum(sin(2 * angle)) AS s2, sum(cos(angle)) AS c, sum(sin(angle)) AS s FROM v GROUP BY grp) "
    "SELECT CAST(grp AS BIGINT) AS frame, n AS n_vectors, m AS n_mbands, round(lm, 6) AS sarcomere_length_mean, round(ls, 6) AS sarcomere_length_std, round(sqrt(c2 * c2 + s2 * s2) / n, 6) AS sarcomere_oop, round(CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + 2 * pi() ELSE atan2(s, c) END, 6) AS sarcomere_orientation_mean, round(sqrt(-2 * ln(least(sqrt(s * s + c * c) / n, 1.0))), 6) AS sarcomere_orientation_std, round(atan2(s2, c2) / 2, 6) AS sarcomere_axis FROM c",
    "vector_ends": f"WITH {VECTORS} SELECT CAST(grp AS BIGINT) AS frame, id AS vec_id, side, round(y + (side - 0.5) * len * sin(angle), 6) AS y, round(x + (side - 0.5) * len * cos(angle), 6) AS x FROM v, (VALUES (0::BIGINT), (1::BIGINT)) e(side)",
}
