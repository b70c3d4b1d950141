"""Missing values: NULL inside the engine, NaN only at its borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(c: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """All float columns with NaN as NULL; for use at ingest."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[present(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema])


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def within(c: Column, low: float, high: float) -> Column:
    """c where it is in the closed interval, else NULL."""
    return F.when(c.between(low, high), c)


def missing_ratio(c: Column) -> Column:
    """Missing values over values that are not zero; a missing one counts as not zero."""
    return F.try_divide(F.count_if(c.isNull()), F.count_if(c.isNull() | (c != 0)))
