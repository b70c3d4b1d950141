"""Result tables: projections with missing keys, filters, conditions, unions, remapping, sampling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project(df: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """keys: name -> type.  Columns that df lacks are NULL of that type."""
    return df.select(*[(F.col(f"`{k}`") if k in df.columns else F.lit(None)).cast(t).alias(k) for k, t in keys.items()])


def with_conditions(df: DataFrame, **conditions: Column | Callable[[Column], Column] | object) -> DataFrame:
    """Adds columns: functions of `path` are applied to it, columns taken, other values are literals."""
    for name, c in conditions.items():
        df = df.withColumn(name, c if isinstance(c, Column) else c(F.col("path")) if callable(c) else F.lit(c))
    return df


def half_open(df: DataFrame, limits: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows whose columns are all in [low, high); None is no limit; NULL passes no limit."""
    for c, (low, high) in limits.items():
        if low is not None:
            df = df.where(F.col(c) >= low)
        if high is not None:
            df = df.where(F.col(c) < high)
    return df


def frames(df: DataFrame, selection: str | int | Sequence[int] | None, column: str = "frame") -> DataFrame:
    """'all' or None: all; a number, or numbers; anything else raises.  A plain predicate, so partitions by frame are pruned."""
    if selection is None or isinstance(selection, str) and selection == "all":
        return df
    if isinstance(selection, bool) or isinstance(selection, str):
        raise ValueError(f"frames must be 'all', a number or numbers: {selection!r}")
    if isinstance(selection, int):
        return df.where(F.col(column) == selection)
    return df.where(F.col(column).isin([int(x) for x in selection]))


def parse_frames(text: str) -> str | list[int] | int | None:
    """A text field's frames: empty is None, 'all', a number, numbers by commas (others are skipped); anything else is 0."""
    text = text.strip()
    if not text or text == "all":
        return text or None
    if text.isdigit():
        return int(text)
    return [int(x) for x in (p.strip() for p in text.split(",")) if x.isdigit()] if "," in text else 0


def without_arrays(df: DataFrame) -> DataFrame:
    """Columns that are not arrays, by the schema."""
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.ArrayType)])


def flattened(df: DataFrame) -> DataFrame:
    """Arrays of arrays as one array each."""
    return df.select(*[(F.flatten(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.ArrayType) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema])


def appended(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that a table lacks are NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def remapped(df: DataFrame, column: str, table: DataFrame, source: str, target: str) -> DataFrame:
    """column's values through table(source, target); values that the table lacks stay."""
    t = table.select(F.col(source).alias("__s"), F.col(target).alias("__t"))
    return df.join(t, F.col(column) == F.col("__s"), "left").withColumn(column, F.coalesce("__t", column)).drop("__s", "__t")


def drawn(seed: int, columns: Sequence[str]) -> Column:
    """A text that orders rows at random: the md5 of seed and columns, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def shuffled_labels(df: DataFrame, label: str, seed: int) -> DataFrame:
    """label -> new_label: a permutation of the distinct labels that keeps the smallest; the hash of seed and label decides."""
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    first = labels.agg(F.min(label)).first()[0]
    rest = labels.where(F.col(label) != first)
    by_value, by_hash = Window.orderBy(label), Window.orderBy(drawn(seed, [label]), label)
    a = rest.withColumn("n", F.row_number().over(by_value)).select("n", label)
    b = rest.withColumn("n", F.row_number().over(by_hash)).select("n", F.col(label).alias("new_label"))
    return a.join(b, "n").drop("n").unionByName(labels.where(F.col(label) == first).select(label, F.col(label).alias("new_label")))


def longest(df: DataFrame, column: str, n: int | None, ties: Sequence[str]) -> DataFrame:
    """The n rows of the largest value, ties by the given columns; None is all."""
    out = df.orderBy(F.desc(column), *ties)
    return out if n is None else out.limit(n)


def longest_in_cluster(df: DataFrame, cluster: str, column: str, n: int | None, ties: Sequence[str]) -> DataFrame:
    """The longest row of each cluster; of those the n longest."""
    w = Window.partitionBy(cluster).orderBy(F.desc(column), *ties)
    best = df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return longest(best, column, n, ties)


def random_in_cluster(df: DataFrame, cluster: str, n: int | None, seed: int, ties: Sequence[str]) -> DataFrame:
    """One row of each cluster and of those n, by the hash of seed and the ties columns."""
    draw = drawn(seed, ties)
    w = Window.partitionBy(cluster).orderBy(draw, *ties)
    best = df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").orderBy(draw, *ties)
    return best if n is None else best.limit(n)


def seeds(df: DataFrame, keys: Sequence[str], ties: Sequence[str], share: float, seed: int) -> DataFrame:
    """max(1, int(share * n)) rows of each key, by the hash of seed and the ties columns."""
    w = Window.partitionBy(*keys)
    draw = F.row_number().over(w.orderBy(drawn(seed, ties), *ties))
    size = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * share))
    return df.withColumn("__r", draw).withColumn("__n", size).where("__r <= __n").drop("__r", "__n")


def as_arrays(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as arrays of doubles: arrays of numbers as they are, single numbers as arrays of one, JSON text of a list or number read, anything else NULL."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}

    def one(c: str) -> Column:
        if kinds[c] == "array":
            return F.col(c).cast("array<double>")
        if kinds[c] == "string":
            return F.coalesce(F.from_json(c, "array<double>"), F.when(F.col(c).try_cast("double").isNotNull(), F.array(F.col(c).try_cast("double"))))
        return F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("double")))

    return df.withColumns({c: one(c) for c in columns})


def required(column: Column, name: str) -> Column:
    """The column; a row where it is missing is an error."""
    return F.coalesce(column, F.raise_error(F.lit(f"{name} is missing")))


def if_present(column: Column, then: Callable[[Column], Column]) -> Column:
    """then(column) where it is present, NULL elsewhere."""
    return F.when(column.isNotNull(), then(column))


def missing_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of df that other lacks; empty if df's are a subset."""
    return df.select(*keys).distinct().join(other.select(*keys).distinct(), list(keys), "left_anti")


def feature_catalog(spark: SparkSession) -> DataFrame:
    """Features by name with their level and the stage that makes them."""
    from .catalog import FEATURES

    return spark.createDataFrame(FEATURES, "name string, level string, producer string")
