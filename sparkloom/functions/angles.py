"""Angles: signed and axial differences, folding, axial and circular statistics, lateral alignment."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_difference(a: Column, b: Column) -> Column:
    """a - b in (-pi, pi]."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


def axial_difference(a: Column, b: Column) -> Column:
    """Least angle between two axes (directions without sign): 0 to pi/2."""
    d = F.pmod(F.abs(a - b), F.lit(math.pi))
    return F.least(d, F.lit(math.pi) - d)


def folded(a: Column) -> Column:
    """An axis as an angle in [0, pi)."""
    return F.pmod(a, F.lit(math.pi))


def flipped(a: Column, towards: Column) -> Column:
    """a, turned by pi if it is more than pi/2 from `towards`."""
    return F.when(F.abs(signed_difference(a, towards)) > math.pi / 2, a + math.pi).otherwise(a)


def order_parameter(a: Column) -> Column:
    """Aggregate: length of the mean of exp(2ia); 1 for parallel axes, 0 for balanced ones."""
    c, s = F.sum(F.cos(2 * a)), F.sum(F.sin(2 * a))
    return F.try_divide(F.sqrt(c * c + s * s), F.count(a))


def axial_mean(a: Column) -> Column:
    """Aggregate: half the angle of the mean of exp(2ia), in (-pi/2, pi/2]."""
    return F.atan2(F.sum(F.sin(2 * a)), F.sum(F.cos(2 * a))) / 2


def circular_mean(a: Column) -> Column:
    """Aggregate: mean direction in [0, 2 pi)."""
    return F.pmod(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a))), F.lit(2 * math.pi))


def circular_std(a: Column) -> Column:
    """Aggregate: sqrt(-2 ln R)."""
    c, s = F.sum(F.cos(a)), F.sum(F.sin(a))
    r = F.try_divide(F.sqrt(c * c + s * s), F.count(a))
    return F.sqrt(-2 * F.log(F.least(r, F.lit(1.0))))


def alignment_index(ai: Column, aj: Column, to_j: Column, to_i: Column, least: float = 0.4) -> Column:
    """Lateral alignment of two ends with outward directions ai, aj and connecting directions to_j, to_i.

    Product of three cosines: opposite directions, and each direction along the
    connection.  NULL unless the first is positive and the others exceed `least`.
    """
    facing, a, b = F.cos(ai - aj + math.pi), F.cos(ai - to_j), F.cos(aj - to_i)
    return F.when((facing > 0) & (a > least) & (b > least), facing * a * b)
