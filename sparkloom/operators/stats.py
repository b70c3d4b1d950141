"""Grouped statistics: nan-safe, weighted, binned, axial, test statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import distributions


def summary(x: Column, prefix: str) -> list[Column]:
    """Count, mean, population deviation, least, largest and sum of present values."""
    return [f(x).alias(f"{prefix}_{n}") for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("sum", F.sum))]


def weighted_mean_std(df: DataFrame, keys: Sequence[str], x: str, weight: str) -> DataFrame:
    """Weighted mean and population deviation over rows with both values.

    Values are centred by the table's mean first (one number to the driver), so
    that one aggregation of moments keeps its digits.
    """
    df = df.where(F.col(x).isNotNull() & F.col(weight).isNotNull())
    centre = df.agg(F.avg(x)).first()[0] or 0.0
    d, w = F.col(x) - F.lit(float(centre)), F.col(weight)
    sums = df.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * d).alias("wd"), F.sum(w * d * d).alias("wdd"))
    mean = F.try_divide("wd", "w")
    spread = F.greatest(F.try_divide("wdd", "w") - mean * mean, F.lit(0.0))
    return sums.select(*keys, (mean + F.lit(float(centre))).alias("weighted_mean"), F.sqrt(spread).alias("weighted_std"))


def weighted_quantiles(df: DataFrame, keys: Sequence[str], x: str, weight: str, percents: Sequence[float], cells: int = 1024) -> DataFrame:
    """For each percentage the first value, in ascending order, at which the weights so far reach that share of all.

    Equal values are summed first.  Weights of `cells` cells between a key's ends tell in which cell each share is reached; only the values
    of those cells are put in order, so no task orders all values of a key.
    """
    names = {p: f"q{p:g}".replace(".", "_") for p in percents}
    seen = df.where(F.col(x).isNotNull() & F.col(weight).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.sum(weight).alias("w"))
    ends = seen.groupBy(*keys).agg(F.min("x").alias("__a"), F.max("x").alias("__b"))
    cell = F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - F.col("__a"), F.col("__b") - F.col("__a")) * cells), F.lit(cells - 1)), F.lit(0)).cast("int")
    placed = (seen.join(ends, list(keys)) if keys else seen.crossJoin(F.broadcast(ends))).withColumn("__cell", cell).drop("__a", "__b")
    whole = Window.partitionBy(*keys)
    sums = placed.groupBy(*keys, "__cell").agg(F.sum("w").alias("__w"))
    sums = sums.withColumn("__so_far", F.sum("__w").over(whole.orderBy("__cell"))).withColumn("__all", F.sum("__w").over(whole))
    sums = sums.withColumn("__before", F.lag("__so_far").over(whole.orderBy("__cell"))).withColumn("__p", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    target = F.col("__p") / 100 * F.col("__all")
    reached = (F.col("__so_far") >= target) & (F.col("__before").isNull() | (F.col("__before") < target))
    hits = sums.where(reached).select(*keys, "__cell", "__p", target.alias("__target"), F.coalesce("__before", F.lit(0.0)).alias("__before"))
    inside = placed.join(hits, [*keys, "__cell"])
    inside = inside.withColumn("__now", F.col("__before") + F.sum("w").over(Window.partitionBy(*keys, "__p").orderBy("x")))
    # Sums in another order may fall short of the target by a rounding: then it is the cell's last value.
    found = inside.groupBy(*keys, "__p").agg(F.coalesce(F.min(F.when(F.col("__now") >= F.col("__target"), F.col("x"))), F.max("x")).alias("x"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("__p") == float(p), F.col("x"))).alias(n) for p, n in names.items()])


def histogram(df: DataFrame, keys: Sequence[str], x: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and densities of values in [low, high]; the last bin is closed; empty bins have no row."""
    width = (high - low) / bins
    inside = df.where(F.col(x).between(low, high))
    at = F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("long")
    counts = inside.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("density", F.col("n") / (total * width))


def density(df: DataFrame, keys: Sequence[str], x: str, bins: int = 128, bandwidth: float | None = None, reach: float = 3.0) -> DataFrame:
    """Gaussian kernel density: (keys, place, x, density) at the `bins` middles of a grid that goes `reach` bandwidths beyond each key's values.

    Values are counted by the grid's cells first, so the kernel runs over cells, not rows.  Without a bandwidth it is Scott's: the sample
    deviation times n^(-1/5).  A key of one value, or of equal ones, has none and no rows.
    """
    seen = df.where(F.col(x).isNotNull())
    ends = seen.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(x).alias("__a"), F.max(x).alias("__b"), F.stddev_samp(x).alias("__s"))
    h = F.lit(float(bandwidth)) if bandwidth else F.col("__s") * F.pow(F.col("__n"), F.lit(-0.2))
    ends = ends.withColumn("__h", h).where(F.col("__h") > 0).withColumn("__a", F.col("__a") - reach * F.col("__h"))
    ends = ends.withColumn("__w", (F.col("__b") + reach * F.col("__h") - F.col("__a")) / bins).drop("__b", "__s")
    cell = F.least(F.floor((F.col(x) - F.col("__a")) / F.col("__w")), F.lit(bins - 1)).cast("int")
    counts = seen.join(ends.select(*keys, "__a", "__w"), list(keys)).groupBy(*keys, cell.alias("i")).agg(F.count("*").alias("c"))
    held = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("__cells")).join(ends, list(keys))

    def at(j: Column) -> Column:
        def near(total: Column, s: Column) -> Column:
            z = (j - s["i"]) * F.col("__w") / F.col("__h")
            return total + s["c"] * F.exp(z * z * -0.5)

        return F.aggregate("__cells", F.lit(0.0), near) / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))

    grid = held.select(*keys, "__a", "__w", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), at)).alias("place", "density"))
    return grid.select(*keys, "place", (F.col("__a") + (F.col("place") + 0.5) * F.col("__w")).alias("x"), "density")


def most_frequent_bin(df: DataFrame, keys: Sequence[str], x: str, bins: int = 20) -> DataFrame:
    """Left edge of the fullest of `bins` bins between each key's least and largest value, the first of equals."""
    ends = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.min(x).alias("a"), F.max(x).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.floor(F.try_divide(F.col(x) - F.col("a"), width)), F.lit(bins - 1)))
    counts = df.where(F.col(x).isNotNull()).join(ends, list(keys)).groupBy(*keys, "a", "b", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys, "a", "b").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    return best.select(*keys, (F.col("a") + F.col("bin") * width).alias("left_edge"))


def pairwise_t(df: DataFrame, key: str, x: str) -> DataFrame:
    """Welch's t and its degrees of freedom for each pair of groups, from their moments; groups of one value have none."""
    m = df.groupBy(F.col(key).alias("g")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    a, b = m.alias("a"), m.alias("b")
    sa, sb = F.col("a.v") / F.col("a.n"), F.col("b.v") / F.col("b.n")
    t = F.try_divide(F.col("a.m") - F.col("b.m"), F.sqrt(sa + sb))
    freedom = F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("a.n") - 1) + sb * sb / (F.col("b.n") - 1))
    enough = (F.col("a.n") > 1) & (F.col("b.n") > 1)
    # One row a group on either side: a few rows, whatever the table.
    return a.join(b, F.col("a.g") < F.col("b.g")).where(enough).select(F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), t.alias("t"), freedom.alias("freedom"))


def geometric_ks(df: DataFrame, keys: Sequence[str], gap: str) -> DataFrame:
    """Geometric fit p = 1 / mean gap and the largest distance between the gaps' steps and its distribution 1 - (1 - p)^gap."""
    counts = df.where(F.col(gap).isNotNull()).groupBy(*keys, F.col(gap).alias("g")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("g")
    counts = counts.withColumn("all", F.sum("n").over(whole)).withColumn("p", F.sum("n").over(whole) / F.sum(F.col("g") * F.col("n")).over(whole))
    model = 1 - F.pow(1 - F.col("p"), F.col("g"))
    upto = F.sum("n").over(order) / F.col("all")
    before = upto - F.col("n") / F.col("all")
    counts = counts.withColumn("d", F.greatest(F.abs(upto - model), F.abs(before - model)))
    return counts.groupBy(*keys).agg(F.max("p").alias("p"), F.max("d").alias("ks"), F.max("all").alias("n"))


def with_t_p(tests: DataFrame) -> DataFrame:
    """tests(t, freedom, ...) + p_value: two-sided, of Student's distribution."""

    @pandas_udf("double")
    def p(t: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([distributions.t_two_sided(a, b) for a, b in zip(t.astype(float), freedom.astype(float))])

    return tests.withColumn("p_value", F.nanvl(p("t", "freedom"), F.lit(None)))


def with_ks_p(fits: DataFrame) -> DataFrame:
    """fits(ks, n, ...) + p_value: of the limit distribution of the largest distance."""

    @pandas_udf("double")
    def p(ks: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([distributions.kolmogorov(a, b) for a, b in zip(ks.astype(float), n.astype(float))])

    return fits.withColumn("p_value", F.nanvl(p("ks", "n"), F.lit(None)))


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, extend: float = 0.0) -> DataFrame:
    """Least-squares line of y on x, and its two ends over the x range, each moved outward along the line by `extend`."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.min(x).alias("a"), F.max(x).alias("b"))
    step = extend / F.sqrt(1 + F.col("slope") * F.col("slope"))
    fit = fit.withColumn("x0", F.col("a") - step).withColumn("x1", F.col("b") + step)
    ends = [(F.col("intercept") + F.col("slope") * F.col(f"x{i}")).alias(f"y{i}") for i in (0, 1)]
    return fit.select(*keys, "slope", "intercept", "x0", ends[0], "x1", ends[1])


def f1(df: DataFrame, keys: Sequence[str], truth: str, guess: str, eps: float = 1e-7) -> DataFrame:
    """Precision, recall and F1 of 0/1 columns, with eps in the denominators."""
    both = F.count_if((F.col(truth) == 1) & (F.col(guess) == 1))
    p, r = both / (F.count_if(F.col(guess) == 1) + eps), both / (F.count_if(F.col(truth) == 1) + eps)
    return df.groupBy(*keys).agg(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + eps)).alias("f1"))
