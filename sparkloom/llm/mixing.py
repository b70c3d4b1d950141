"""Mixing sources to target weights by entropy balancing.

Among all document rates within [0, max_rate] whose words meet each source's
target, the one of least relative entropy to the corpus is an exponential tilt:
rate = min(max_rate, exp(dual[source] * size / mean size of the source).  The
duals come from Newton steps on the convex dual; rates depend on source and
size alone, so the steps run over counts of (source, size).  Rates are then
rounded into whole copies: each document's uniform number decides, and one
threshold a source, found in histograms, makes the words taken meet its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, small_table, stage, unit

#: Sources up to this number are broadcast (about 100 bytes each); more are joined by shuffle, where adaptive execution splits hot ones.
BROADCAST_SOURCES = 100_000
BINS = 4096
NEWTON_STEPS = 60


def n_words(text: str = "text") -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sources(source, source_size, ...) -> + target: sizes' sum shared by repeating weights over sources by code point (null last),
    none above cap * source_size, the excess reshared by weight until none is above."""
    ranked = sources.withColumn("__sl_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stage(ranked.withColumn("__sl_w", F.get(cycle, (F.col("__sl_r") % len(weights)).cast("int"))), "ranked")
    limit = F.lit(float(cap)) * F.col("source_size")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    price, full = 0.0, 0.0
    while True:
        at_cap = F.col("__sl_w") * price >= limit if price else F.col("source_size") == 0
        capped, open_weight = ranked.agg(F.sum(F.when(at_cap, limit)), F.sum(F.when(~at_cap, F.col("__sl_w")))).first()
        capped, open_weight = capped or 0.0, open_weight or 0.0
        if not open_weight:
            price = math.inf
            break
        if price and capped == full:
            break
        price, full = (total - capped) / open_weight, capped
    wanted = limit if price == math.inf else F.least(limit, F.col("__sl_w") * price)
    return ranked.withColumn("target", wanted).drop("__sl_r", "__sl_w")


def _joined(df: DataFrame, by_source: DataFrame, n_sources: int) -> DataFrame:
    """Adds by_source's columns; a null source meets the null source."""
    right = by_source.withColumnRenamed("source", "__sl_s")
    if n_sources <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return df.join(right, F.col("source").eqNullSafe(F.col("__sl_s")), "left").drop("__sl_s")


def _rate(dual: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.when(dual == math.inf, F.lit(float(cap))).otherwise(F.exp(F.least(F.lit(math.log(cap)), dual * size / mean)))


def solve_duals(counts: DataFrame, targets: DataFrame, n_sources: int, cap: float) -> DataFrame:
    """counts(source, size, n), targets(source, source_size, n_docs, target) -> targets + dual.

    Newton steps inside a bracket for all sources at once: a step is one
    aggregation over counts, and brings one (source, words, slope) row a source
    to the driver, which keeps the dual vector.  Stops when all sources are
    within a quarter of a word or a ten-millionth of their target; if some are
    not after NEWTON_STEPS steps, that is an error.
    """
    spark = counts.sparkSession
    known = targets.select("source", "target", "source_size").collect()
    state = {r.source: [0.0, None, None] for r in known}
    goal = {r.source: r.target for r in known}
    duals = {r.source: math.inf for r in known if r.target >= cap * r.source_size * (1 - 1e-12)}
    means = targets.select("source", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0)).alias("__sl_mean"))
    size = F.col("size").cast("double")
    for _ in range(NEWTON_STEPS):
        rows = [{"source": s, "dual": v[0]} for s, v in state.items() if s not in duals]
        if not rows:
            break
        table = _joined(means, small_table(spark, rows, "source string, dual double"), n_sources)
        table = _joined(counts, table.where(F.col("dual").isNotNull()), n_sources).where(F.col("dual").isNotNull())
        rate = _rate(F.col("dual"), size, F.col("__sl_mean"), cap)
        below = F.col("dual") * size / F.col("__sl_mean") < math.log(cap)
        words = table.groupBy("source").agg(
            F.sum(F.col("n") * size * rate).alias("words"),
            F.sum(F.when(below, F.col("n") * size * size * rate / F.col("__sl_mean")).otherwise(0.0)).alias("slope"),
        )
        for r in words.collect():
            s, (x, low, high) = r.source, state[r.source]
            off = r.words - goal[s]
            if abs(off) <= max(0.25, 1e-7 * goal[s]):
                duals[s] = x
                continue
            low, high = (low, x) if off > 0 else (x, high)
            step = x - off / r.slope if r.slope > 0 else math.nan
            if low is not None and high is not None and not low < step < high:
                step = (low + high) / 2
            elif not math.isfinite(step) or abs(step - x) > 2 * abs(x) + 1:
                step = x + (2 * abs(x) + 1) * (-1 if off > 0 else 1)
            state[s] = [step, low, high]
    open_sources = [s for s in state if s not in duals]
    if open_sources:
        raise RuntimeError(f"{len(open_sources)} sources are off their targets after {NEWTON_STEPS} Newton steps, {open_sources[0]!r} among them")
    rows = [{"source": s, "dual": duals.get(s, state[s][0]), "full": duals.get(s) == math.inf} for s in state]
    rows = [r | {"dual": 0.0} if r["full"] else r for r in rows]
    table = small_table(spark, rows, "source string, dual double, full boolean")
    table = table.select("source", F.when(F.col("full"), F.lit(math.inf)).otherwise(F.col("dual")).alias("dual"))
    return _joined(targets, table, n_sources)


def _threshold(eligible: DataFrame, need: DataFrame, n_sources: int) -> DataFrame:
    """eligible(source, key in [-1, 1), size); need(source, need): the key below which eligible sizes add up to about `need`.

    Two histograms of BINS bins a source, the second inside the bin in which the first meets `need`.
    """
    order = Window.partitionBy("source").orderBy("bin")
    low, width = F.lit(-1.0), 2.0 / BINS
    out, start = need.withColumn("tau", low).withColumn("done", F.lit(0.0)), eligible
    for _ in range(2):
        bins = _joined(start, out.select("source", "tau", "need"), n_sources)
        at = F.floor((F.col("key") - F.col("tau")) / width)
        bins = bins.withColumn("bin", at).where((at >= 0) & (at < BINS)).groupBy("source", "bin").agg(F.sum("size").alias("words"))
        bins = bins.withColumn("sum", F.sum("words").over(order))
        bins = _joined(bins, out.select("source", "need", "done"), n_sources).withColumn("gap", F.col("done") + F.col("sum") - F.col("need"))
        # The last bin end that stays at or below the need; the next histogram looks into the bin behind it.
        below = bins.groupBy("source").agg(
            F.max(F.when(F.col("gap") <= 0, F.struct("bin", "sum"))).alias("b"), F.min(F.when(F.col("gap") > 0, F.struct("bin", "sum"))).alias("a")
        )
        out = stage(
            _joined(out, below, n_sources).select(
                "source",
                "need",
                (F.col("tau") + F.coalesce(F.col("a.bin"), F.col("b.bin") + 1, F.lit(0)) * width).alias("tau"),
                (F.col("done") + F.coalesce("b.sum", F.lit(0))).alias("done"),
                F.col("a.sum").isNotNull().alias("inside"),
                (F.col("done") + F.coalesce("a.sum", F.lit(0))).alias("over"),
            ),
            "threshold",
        )
        width /= BINS
    # One more fine bin is taken if that comes nearer.
    nearer = F.col("inside") & (F.col("over") - F.col("need") < F.col("need") - F.col("done"))
    return out.select("source", (F.col("tau") + F.when(nearer, F.lit(width * BINS)).otherwise(0.0)).alias("tau"))


class Plan:
    """What the sources' rows are rounded by: one row a source (source_size, n_docs, target, dual, tau)."""

    def __init__(self, by_source: DataFrame, n_sources: int, cap: int, seed: int):
        self.by_source, self.n_sources, self.cap, self.seed = by_source, n_sources, cap, seed

    def rates(self, df: DataFrame, id_col: str) -> DataFrame:
        """df(id_col, source, size, ...) -> + the source's columns, rate, __sl_base, __sl_key, without duals and means."""
        mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0))
        out = _joined(df, self.by_source, self.n_sources).withColumn("rate", _rate(F.col("dual"), F.col("size").cast("double"), mean, float(self.cap)))
        out = out.withColumn("__sl_base", F.floor("rate"))
        return out.withColumn("__sl_key", unit(self.seed, F.col(id_col), F.col("size")) - (F.col("rate") - F.col("__sl_base"))).drop("dual", "n_docs")

    def may_rise(self) -> Column:
        return (F.col("__sl_base") < self.cap) & (F.col("size") > 0)

    def copies(self, df: DataFrame, id_col: str) -> DataFrame:
        """df(id_col, source, size, ...) -> + source_size, target, rate, copies."""
        more = F.when(self.may_rise() & (F.col("__sl_key") < F.col("tau")), 1).otherwise(0)
        out = self.rates(df, id_col).withColumn("copies", (F.col("__sl_base") + more).cast("int"))
        return out.drop("tau", "__sl_base", "__sl_key")


def plan(docs: DataFrame, id_col: str = "doc_id", weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, seed: int = 60_461) -> Plan:
    """docs(id_col, source, size), staged -> the mix: duals that meet the targets and thresholds that round them.

    A null source is a source, the last by order.  Documents without words have
    rate 1 and take nothing.  Rows of equal id and size are rounded alike, so
    reruns agree whatever the partitioning.
    """
    counts = stage(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sources = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    targets = source_targets(sources, weights, cap)
    n_sources = targets.count()
    solved = Plan(stage(solve_duals(counts, targets, n_sources, cap), "duals"), n_sources, cap, seed)
    rated = solved.rates(docs, id_col)
    base = rated.groupBy("source").agg(F.sum(F.col("__sl_base") * F.col("size")).alias("base"))
    need = _joined(solved.by_source.select("source", "target"), base, n_sources).select("source", (F.col("target") - F.col("base")).alias("need"))
    open_rows = rated.where(solved.may_rise()).select("source", F.col("__sl_key").alias("key"), "size")
    tau = _threshold(open_rows, stage(need, "need"), n_sources)
    solved.by_source = stage(_joined(solved.by_source, tau, n_sources), "mix")
    return solved


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: weights 5, 2, 1 over sources in order, at most three copies.

    Null and empty texts have size 0 and take nothing; a null source is the last; rows of one doc_id and size take the same; texts of any length
    are counted whole; an empty table has no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words().alias("size"))
    docs = stage(docs, "sizes")
    mixed = plan(docs).copies(docs, "doc_id")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
