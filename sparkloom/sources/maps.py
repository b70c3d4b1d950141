"""Derived maps by name, result tables that only changed files renew, and metadata with a copy to fall back on: all in folders that every executor sees."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import stage

#: Names of the maps, and the step that makes each.
MAKERS = {
    "image": "import the image files", "zbands": "segment the bands", "zbands_fast_movie": "segment the bands of a fast movie", "mbands": "segment the midlines", "orientation": "map the orientation",
    "cell_mask": "mask the cells", "sarcomere_mask": "mask the sarcomeres",
}
ORIGINAL = "image"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, place = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()) if fs.exists(place) else []


class MapStore:
    """Tiles of maps, a partition of one Parquet table for each map's name.

    A view reads its own partition alone; replacing a map or deleting derived maps touches theirs alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def names(self) -> list[str]:
        """The maps that are there; only folder names are read."""
        return [n.removeprefix("map_name=") for n in _folders(self.spark, self.path) if n.startswith("map_name=")]

    def write(self, name: str, tiles: DataFrame) -> None:
        """Stores (or replaces) a map; it may be computed from views of the store."""
        if name not in MAKERS:
            raise ValueError(f"unknown map {name!r}; there are {', '.join(MAKERS)}")
        made = stage(tiles, name) if name in self.names() else tiles
        made.withColumn("map_name", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("map_name").parquet(self.path)

    def view(self, name: str) -> DataFrame:
        """The tiles of a map; what to do first where it isn't there."""
        if name not in MAKERS:
            raise AttributeError(f"no map {name!r}; there are {', '.join(MAKERS)}")
        if name not in self.names():
            raise FileNotFoundError(f"the map {name!r} is missing in {self.path}: first {MAKERS[name]}")
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/map_name={name}").drop("map_name")

    def delete_derived(self, names: Sequence[str] | None = None) -> list[str]:
        """Deletes derived maps (all, or those named) and gives their names; the original stays."""
        if names is not None and ORIGINAL in names:
            raise ValueError("the original images are no derived map")
        gone = [n for n in self.names() if n != ORIGINAL and (names is None or n in names)]
        for n in gone:
            fs, place = _files(self.spark, f"{self.path}/map_name={n}")
            fs.delete(place, True)
        return gone


class ResultCache:
    """Results of files, of which a refresh computes only those whose bytes have changed.

    `path` holds generations: `files` (path, length, time, fingerprint) and `rows`, in PARTS parts by the file's path.  A refresh lists
    files; those of the same length and time aren't opened; of the others the fingerprint (sha256) is taken; those that have a new one are
    computed.  Parts without a changed or removed file are left as they are.
    """

    #: Parts of the rows, and changed files up to which they are opened by name.
    PARTS, FEW = 64, 10_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _part(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.PARTS)).cast("int").alias("part")

    def _known(self) -> DataFrame | None:
        generations = _folders(self.spark, f"{self.path}/files")
        if not generations:
            return None
        return self.spark.read.parquet(f"{self.path}/files/{generations[-1]}")

    def _open(self, source: str | list[str], glob: str) -> DataFrame:
        reader = self.spark.read.format("binaryFile").option("pathGlobFilter", glob)
        return (reader.option("recursiveFileLookup", "true") if isinstance(source, str) else reader).load(source)

    def _some(self, source: str, glob: str, paths: DataFrame) -> DataFrame:
        """The files of a stored table of paths; only they are opened, unless they are more than FEW."""
        if paths.count() > self.FEW:
            return self._open(source, glob).join(paths, "path")
        plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in paths.collect()]
        return self._open(plain, "*") if plain else self._open(source, glob).limit(0)

    def changed(self, source: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
        """-> index of all files with fingerprints, and the paths to compute; files of the same length and time as before aren't opened."""
        listed = self._open(source, glob).select("path", "length", "modificationTime")
        known, entry = self._known(), ["path", "length", "modificationTime"]
        digest = F.sha2("content", 256).alias("fingerprint")
        if known is None:
            index = stage(self._open(source, glob).select(*entry, digest), "index")
            return index, stage(index.select("path"), "todo")
        same = listed.join(known, entry).select(*entry, "fingerprint")
        touched = stage(listed.join(known, entry, "left_anti").select("path"), "touched")
        fresh = stage(self._some(source, glob, touched).select(*entry, digest), "fresh")
        new = fresh.join(known.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti").select("path")
        return stage(same.unionByName(fresh), "index"), stage(new, "todo")

    def refresh(self, source: str, compute: Callable[[DataFrame], DataFrame], glob: str = "*") -> DataFrame:
        """compute(path, length, modificationTime, content of the files to do) -> rows with a column path; gives all rows, old and new.  Empty files are none."""
        known = self._known()
        index, todo = self.changed(source, glob)
        parts = todo.select(self._part())
        if known is not None:
            parts = parts.union(known.select("path").join(index.select("path"), "path", "left_anti").select(self._part()))
        parts = [r.part for r in parts.distinct().collect()]
        if parts or known is None:
            made = compute(self._open(source, glob) if known is None else self._some(source, glob, todo))
            if known is not None and _folders(self.spark, f"{self.path}/rows"):
                old = self._rows().where(F.col("part").isin(parts)).drop("part").join(index.select("path"), "path", "left_semi").join(todo, "path", "left_anti")
                made = made.unionByName(old, allowMissingColumns=True)
            written = stage(made, "rows").withColumn("part", self._part())
            emptied = set(parts) - {r.part for r in written.select("part").distinct().collect()}
            written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/rows")
            for p in emptied:
                fs, place = _files(self.spark, f"{self.path}/rows/part={p}")
                fs.delete(place, True)
        generations = _folders(self.spark, f"{self.path}/files")
        following = 1 + max((int(g.split("-")[0]) for g in generations), default=0)
        index.write.parquet(f"{self.path}/files/{following:09d}-{uuid.uuid4().hex[:8]}")
        for g in generations:
            fs, place = _files(self.spark, f"{self.path}/files/{g}")
            fs.delete(place, True)
        return self.load()

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def load(self) -> DataFrame:
        """The rows of the last refresh; FileNotFoundError where there was none."""
        if not _folders(self.spark, f"{self.path}/files"):
            raise FileNotFoundError(f"no results in {self.path}: refresh them first")
        return self._rows().drop("part")


def load_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metadata of all measurements below `path`, each in a folder with metadata.json and, while it is written, metadata.temp.json.

    -> folder, the fields of `schema`, source ('kept', 'temporary' or null), error.  A kept file that is missing or broken gives way to the
    temporary copy; where both fail `error` names both; names of old versions are renamed.
    """
    old = {"resxy": "pixelsize", "tint": "frametime"}
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata*.json").text(path).withColumn("file", F.input_file_name())
    name = F.substring_index("file", "/", -1)
    files = files.select(F.expr("substring(file, 1, length(file) - length(substring_index(file, '/', -1)) - 1)").alias("folder"), name.alias("name"), "value").where(F.col("name").isin("metadata.json", "metadata.temp.json"))
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    wide = ", ".join([schema, *[f"{o} {t}" for o, n in old.items() for f, t in fields if f == n], "__bad string"])
    read = files.withColumn("m", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    good = F.col("m").isNotNull() & F.col("m.__bad").isNull()
    both = read.groupBy("folder").agg(*[F.max(F.when(F.col("name") == n, F.struct(good.cast("int").alias("good"), F.col("m").alias("m")))).alias(a) for a, n in (("kept", "metadata.json"), ("temporary", "metadata.temp.json"))])
    source = F.when(F.col("kept.good") == 1, "kept").when(F.col("temporary.good") == 1, "temporary")
    found = both.withColumn("source", source).withColumn("m", F.when(F.col("source") == "kept", F.col("kept.m")).when(F.col("source") == "temporary", F.col("temporary.m")))
    values = [F.coalesce(*[F.col(f"m.{c}") for c in [f, *[o for o, n in old.items() if n == f]]]).alias(f) for f, _ in fields]
    state = lambda a: F.when(F.col(a).isNull(), "missing").otherwise("broken")
    error = F.when(F.col("source").isNull(), F.concat(F.lit("metadata.json is "), state("kept"), F.lit("; metadata.temp.json is "), state("temporary")))
    return found.select("folder", *values, "source", error.alias("error"))
