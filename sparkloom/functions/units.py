"""Units and rounding: lengths in pixels, odd window sizes, unit names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Micrometres per unit; fixed values.
MICROMETRES = {"m": 1e6, "cm": 1e4, "mm": 1e3, "µm": 1.0, "um": 1.0, "micron": 1.0, "nm": 1e-3, "inch": 25400.0}


def pixels_rounded(length: Column, pixelsize: Column) -> Column:
    """Length in whole pixels, halves to even."""
    return F.bround(F.try_divide(length, pixelsize), 0).cast("int")


def pixels_truncated(length: Column, pixelsize: Column) -> Column:
    """Length in whole pixels, towards zero."""
    return F.try_divide(length, pixelsize).cast("int")


def odd_up(x: Column) -> Column:
    """floor(ceil(x) / 2) * 2 + 1."""
    return (F.floor(F.ceil(x) / 2) * 2 + 1).cast("int")


def pixel_size(resolution: Column, unit: Column) -> Column:
    """Micrometres a pixel from pixels a unit; NULL for unknown units and zero resolution."""
    table = F.create_map(*[F.lit(x) for pair in MICROMETRES.items() for x in pair])
    return F.try_divide(F.try_element_at(table, F.lower(unit)), resolution)
