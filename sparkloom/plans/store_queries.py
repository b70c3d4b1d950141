"""Queries on stored maps, cached results, predictors, densities, created lines and tracking on event time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import pipelines, predict, signal, stats, tables, tiled
from ..sources import files, maps
from ..sources.staging import scratch_folder, stage
from ..streaming import tracking
from .image_queries import _MOVIE, _SAMPLES, COLS, PIXEL, ROWS, SMOOTHING, _WEIGHTS, _mirror, drawn_lines, movies
from .inputs import TRACES, rounded, table, traces
from .kernel_queries import _SPECTRUM, THRESHOLD
from .series_queries import DT


def maps_by_name(spark, sf):
    """Movies stored as images and, smoothed, as bands; both read back by name, the bands' copy as midlines deleted."""
    store = maps.MapStore(spark, scratch_folder(spark))
    store.write("image", movies(spark, sf)[0])
    store.write("zbands", tiled.convolved(store.view("image"), SMOOTHING))
    store.write("mbands", store.view("zbands"))
    store.delete_derived(["mbands"])
    total = F.sum(F.aggregate("data", F.lit(0.0), lambda a, v: a + v)).alias("total")
    found = [store.view(n).groupBy("file_id", "frame").agg(total).withColumn("map", F.lit(n)) for n in store.names()]
    return rounded(tables.appended(found).select("map", "file_id", "frame", "total"), "total")


def cached_results(spark, sf):
    """Prices of each customer group as text files, summed through a cache that is refreshed again after half of the files were doubled."""
    folder = scratch_folder(spark)
    o = table(spark, sf, "orders").select(F.expr("cast(o_custkey div 300 as int)").alias("grp"), F.col("o_totalprice").cast("string").alias("value"))
    o.repartition("grp").sortWithinPartitions("grp").write.partitionBy("grp").text(f"{folder}/in")
    cache = maps.ResultCache(spark, f"{folder}/cache")

    def sums(df):
        rows = df.select("path", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("v")).where("v <> ''")
        return rows.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("double")).alias("total"))

    cache.refresh(f"{folder}/in", sums, "*.txt")
    o.where("grp % 2 = 1").repartition("grp").write.mode("append").partitionBy("grp").text(f"{folder}/in")
    found = cache.refresh(f"{folder}/in", sums, "*.txt")
    grp = F.regexp_extract("path", r"grp=(\d+)", 1).cast("int").alias("grp")
    return rounded(found.groupBy(grp).agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "total")


def _smoother():
    """A predictor: means of three samples."""
    return lambda x: np.convolve(x.astype(float), np.full(3, 1 / 3), "same")


def predicted_states(spark, sf):
    """All series through a predictor that the caller brings, thresholded to states."""
    whole = traces(spark, sf).withColumn("y", F.floor("y"))
    found = predict.predicted(whole, ["series"], "frame", "y", _smoother, ["score"])
    return rounded(found.withColumn("state", (F.col("score") > THRESHOLD).cast("int")), "score")


def value_density(spark, sf):
    """Kernel density of the events' values by type."""
    return rounded(stats.density(table(spark, sf, "events"), ["event_type"], "value", 64), "x", "density")


def spectrum_mean_std(spark, sf):
    """Mean and deviation of the magnitudes over the series of a line, by frequency."""
    df = traces(spark, sf).withColumn("state", (F.col("y") > THRESHOLD).cast("int"))
    spec = signal.spectrum(df, ["series"], "frame", "y", "state", DT, 20, 2.0, 20.0).withColumn("loi", F.expr("series % 10"))
    return rounded(signal.spectrum_summary(spec, ["loi"]), "scale", "frequency", "magnitude_mean", "magnitude_std")


def created_lines(spark, sf):
    """Lines of interest through three points each, with length, name and profiles of all frames."""
    found = pipelines.created_lines(movies(spark, sf)[0], drawn_lines(spark, sf), PIXEL, 3 * PIXEL + 0.01)
    rows = found.select("file_id", "line", "name", "length", "frame", F.posexplode(F.arrays_zip("x_pos", "profile")).alias("place", "p"))
    return rounded(rows.select("file_id", "line", "name", "length", "frame", F.col("place").cast("long").alias("place"), F.col("p.x_pos").alias("x_pos"), F.col("p.profile").alias("v")), "length", "x_pos", "v")


def lines_of_files(spark, sf):
    """Line files (one an order) of image files (one a customer) by folder."""
    images = table(spark, sf, "customer").select(F.format_string("/data/%d/cell_%d.tif", F.expr("c_custkey % 10"), "c_custkey").alias("path"))
    o = table(spark, sf, "orders")
    name = files.loi_name(F.col("o_orderkey"), F.expr("o_orderkey % 7"), F.expr("o_orderkey % 11"), F.lit(5), F.lit(3))
    suffix = F.when(F.col("o_orderkey") % 5 == 0, "_notes.json").otherwise(".json")
    found = o.select(F.concat(F.format_string("/data/%d/cell_%d/", F.expr("o_custkey % 10"), "o_custkey"), name, suffix).alias("path"))
    return files.lines_of_files(images, found)


SIX_HOURS = 6 * 3600


def _positions(spark, sf):
    e = table(spark, sf, "events")
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / SIX_HOURS)
    return e.select(F.expr("user_id % 10").alias("loi"), at.cast("long").alias("frame"), F.timestamp_seconds(at * SIX_HOURS).alias("at"), F.col("value").alias("x")).dropDuplicates(["loi", "frame", "x"])


def event_time_tracking(spark, sf):
    """Values of all events linked over frames of six hours, by a stream that reads them in files of any order."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    folder = scratch_folder(spark)
    positions = stage(_positions(spark, sf).repartition(4), "positions")
    source = positions.inputFiles()[0].rsplit("/", 1)[0]
    spark.conf.set(key, tracking.ROCKSDB)
    try:
        stream = spark.readStream.schema(positions.schema).parquet(source)
        out = tracking.tracked(stream, ["loi"], "at", SIX_HOURS * 1000, search_range=20.0, memory=2)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return rounded(spark.read.schema(out.schema).parquet(f"{folder}/out"), "x")


QUERIES = {f.__name__: f for f in (maps_by_name, cached_results, predicted_states, value_density, spectrum_mean_std, created_lines, lines_of_files, event_time_tracking)}

_H = "(s * pow(n, CAST(-0.2 AS DOUBLE)))"
ORACLE_SQL = {
    "maps_by_name": f"WITH {_MOVIE}, k(a, b, w) AS (VALUES {_WEIGHTS}), s AS (SELECT file_id, frame, w, {_mirror('y - a', ROWS)} AS my, {_mirror('x - b', COLS)} AS mx FROM px, k) SELECT 'image' AS map, file_id, frame, round(sum(v), 6) AS total FROM px GROUP BY ALL UNION ALL SELECT 'zbands', s.file_id, s.frame, round(sum(w * px.v), 6) FROM s JOIN px ON px.file_id = s.file_id AND px.frame = s.frame AND px.y = my AND px.x = mx GROUP BY ALL",
    "cached_results": "SELECT CAST(o_custkey // 300 AS INTEGER) AS grp, count(*) * (1 + o_custkey // 300 % 2) AS n, round(sum(o_totalprice) * (1 + o_custkey // 300 % 2), 6) AS total FROM orders GROUP BY o_custkey // 300",
    "predicted_states": f"WITH {TRACES}, f AS (SELECT series, frame, floor(y) AS y, lag(floor(y)) OVER w AS a, lead(floor(y)) OVER w AS b, count(*) OVER (PARTITION BY series) AS n FROM t WINDOW w AS (PARTITION BY series ORDER BY frame)), s AS (SELECT series, frame, (coalesce(a, 0) + y + coalesce(b, a, y)) / 3 AS score FROM f) SELECT series, frame, round(score, 6) AS score, CAST(score > {THRESHOLD} AS INTEGER) AS state FROM s",
    "value_density": f"WITH e AS (SELECT event_type, count(*) AS n, min(value) AS a, max(value) AS b, stddev_samp(value) AS s FROM events GROUP BY 1), g AS (SELECT event_type, n, {_H} AS h, a - 3 * {_H} AS a, (b + 3 * {_H} - (a - 3 * {_H})) / 64 AS w FROM e), c AS (SELECT g.event_type, least(floor((value - a) / w), 63) AS i, count(*) AS c FROM events JOIN g USING (event_type) GROUP BY ALL) SELECT event_type, CAST(place AS INTEGER) AS place, round(any_value(a + (place + 0.5) * w), 6) AS x, round(sum(c * exp(-0.5 * pow((place - i) * w / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM g JOIN c USING (event_type), range(0, 64) r(place) GROUP BY event_type, place",
    "spectrum_mean_std": f"WITH {_SPECTRUM} SELECT series % 10 AS loi, round(scale, 6) AS scale, round(frequency, 6) AS frequency, count(magnitude) AS n, round(avg(magnitude), 6) AS magnitude_mean, round(stddev_pop(magnitude), 6) AS magnitude_std FROM z GROUP BY series % 10, scale, frequency",
    "created_lines": f"WITH {_MOVIE}, {_SAMPLES}, nm AS (SELECT file_id, line, pos, {_mirror('CAST(floor(y + 0.5) AS BIGINT)', ROWS)} AS my, {_mirror('CAST(floor(x + 0.5) AS BIGINT)', COLS)} AS mx FROM sm), v AS (SELECT nm.file_id, line, frame, pos, avg(v) AS v FROM nm JOIN px ON px.file_id = nm.file_id AND px.y = my AND px.x = mx GROUP BY ALL), "
    f"l AS (SELECT line, sum(sqrt(dy * dy + dx * dx)) * CAST({PIXEL} AS DOUBLE) AS length, sum(n) AS m FROM sb GROUP BY line), p AS (SELECT line, arg_min(y, pos) AS ay, arg_min(x, pos) AS ax, arg_max(y, pos) AS ey, arg_max(x, pos) AS ex FROM pts GROUP BY line) "
    f"SELECT file_id, line, CAST(ay AS DOUBLE) || '_' || ax || '_' || CAST(ey AS DOUBLE) || '_' || ex || '_{3 * PIXEL + 0.01}_loi' AS name, round(length, 6) AS length, frame, pos AS place, round(pos * length / (m - 1), 6) AS x_pos, round(v, 6) AS v FROM v JOIN l USING (line) JOIN p USING (line)",
    "lines_of_files": "SELECT '/data/' || c_custkey % 10 || '/cell_' || c_custkey || '.tif' AS path, o_orderkey || '_' || o_orderkey % 7 || '_' || o_orderkey % 11 || '_5_3_loi.json' AS loi FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0",
}
