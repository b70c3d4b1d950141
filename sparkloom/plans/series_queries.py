"""Queries on series, states, cycles, popping and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import cycles, series, stats
from .inputs import BANDS, TRACES, bands, rounded, traces

DT = 0.5
THRESHOLD = 20.0
CLOSE, OPEN, BUFFER = 3, 2, 3
LEVEL, POP = 56.0, 120.0


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).withColumn("state", (F.col("y") > THRESHOLD).cast("int"))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.opened_and_closed(_states(spark, sf_dir), ["series"], "frame", "state", CLOSE, OPEN, "contr")
    return series.cleared_border(df, ["series"], "frame", "contr", BUFFER, "contr")


def _line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.cleaned_state(cycles.state_of(bands(spark, sf_dir), LEVEL), CLOSE, OPEN, 1)


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.trajectories(bands(spark, sf_dir), cycles.with_cycles(_line_states(spark, sf_dir)), DT, 0.0, 1000.0)


def _inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.in_cycles(_moving(spark, sf_dir))


def traj_diff(spark, sf):
    w = series.over(["series"], ["frame"])
    return rounded(traces(spark, sf).withColumn("d", series.difference("y", w)).select("series", "frame", "d"), "d")


def traj_central_diff(spark, sf):
    w = series.over(["series"], ["frame"])
    return rounded(traces(spark, sf).withColumn("v", series.central_difference("y", w, DT)).select("series", "frame", "v"), "v")


def band_spacing(spark, sf):
    w = Window.partitionBy("loi", "frame").orderBy("band")
    return rounded(bands(spark, sf).withColumn("slen", nulls.within(series.difference("y", w), -50, 50)).select("loi", "band", "frame", "slen"), "slen")


def state_islands(spark, sf):
    return rounded(series.run_table(_states(spark, sf), ["series"], "frame", "state", DT), "start", "duration")


def state_open_close(spark, sf):
    return series.opened_and_closed(_states(spark, sf), ["series"], "frame", "state", CLOSE, OPEN, "contr").select("series", "frame", F.col("contr").cast("long").alias("contr"))


def state_clear_border(spark, sf):
    return _cleaned(spark, sf).select("series", "frame", F.col("contr").cast("long").alias("contr"))


def state_dilated(spark, sf):
    w = series.over(["series"], ["frame"])
    return _states(spark, sf).withColumn("wide", series.dilated(F.col("state"), w, 4).cast("long")).select("series", "frame", "wide")


def rising_edges(spark, sf):
    return series.rising_edges(_states(spark, sf), ["series"], "frame", "state").select("series", "frame")


def run_distance(spark, sf):
    return rounded(series.run_distance(_states(spark, sf), ["series"], "frame", "state", "d").select("series", "frame", "d"), "d")


def filtered_intervals(spark, sf):
    return series.filtered_intervals(traces(spark, sf), ["series"], "frame", "y", 5.0, "kept").select("series", "frame", F.col("kept").cast("long").alias("kept"))


def fixed_chunks(spark, sf):
    return rounded(series.chunks(traces(spark, sf), "frame", 16).groupBy("series", "chunk").agg(F.count("*").alias("n"), F.avg("y").alias("mean")), "mean")


def gap_fill_linear(spark, sf):
    holes = traces(spark, sf).withColumn("y", F.when((F.col("frame") + F.col("series")) % 5 != 0, F.col("y")))
    return rounded(series.filled_gaps(holes, ["series"], "frame", "y", 3, "filled").select("series", "frame", "filled"), "filled")


def closest_value(spark, sf):
    return rounded(series.closest(traces(spark, sf), ["series"], "frame", "y", F.lit(THRESHOLD)), "y")


def missing_ratio(spark, sf):
    v = traces(spark, sf).withColumn("y", nulls.within(F.col("y"), 1.0, 60.0))
    return rounded(v.groupBy("series").agg(nulls.missing_ratio(F.col("y")).alias("missing")), "missing")


def cycle_summary(spark, sf):
    table = series.run_table(_cleaned(spark, sf), ["series"], "frame", "contr", DT)
    return rounded(cycles.rate_and_variability(table, ["series"]), "rate", "variability", "duration_mean", "duration_std")


def cycle_durations(spark, sf):
    return rounded(series.run_table(_line_states(spark, sf), ["loi"], "frame", "contr", DT), "start", "duration")


def quiet_periods(spark, sf):
    return rounded(series.run_table(_line_states(spark, sf), ["loi"], "frame", "quiet", DT), "start", "duration")


def beating_rate(spark, sf):
    return rounded(cycles.rate_and_variability(series.run_table(_line_states(spark, sf), ["loi"], "frame", "contr", DT), ["loi"]), "rate", "variability", "duration_mean", "duration_std")


def cycle_period(spark, sf):
    s = _line_states(spark, sf)
    return rounded(cycles.periods(series.run_table(s, ["loi"], "frame", "contr", DT), series.run_table(s, ["loi"], "frame", "quiet", DT), ["loi"]), "period")


def baseline_median_delta(spark, sf):
    return rounded(_moving(spark, sf).select("loi", "band", "frame", "rest", "delta"), "rest", "delta")


def cycle_extrema(spark, sf):
    return rounded(cycles.cycle_features(_inside(spark, sf), DT).select("loi", "band", "cycle", "contr_max", "elong_max", "vel_contr_max", "vel_elong_max"), "contr_max", "elong_max", "vel_contr_max", "vel_elong_max")


def time_to_peak(spark, sf):
    return rounded(cycles.cycle_features(_inside(spark, sf), DT).select("loi", "band", "cycle", "time_to_peak", "time_to_relax"), "time_to_peak", "time_to_relax")


def percent_time(spark, sf):
    return rounded(cycles.percent_time(_inside(spark, sf), 20.0, 80.0, DT), "percent_time")


def percent_time_relax(spark, sf):
    return rounded(cycles.percent_time(_inside(spark, sf), 80.0, 0.0, DT), "percent_time")


def smi(spark, sf):
    return rounded(cycles.surplus_motion(_inside(spark, sf), DT), "smi")


def _popping(spark, sf):
    return cycles.popping(cycles.cycle_features(_inside(spark, sf), DT), POP)


def popping_rates(spark, sf):
    return rounded(cycles.popping_rates(_popping(spark, sf)), "rate")


def popping_gaps(spark, sf):
    return cycles.popping_gaps(_popping(spark, sf))


def ks_geom_stat(spark, sf):
    return rounded(stats.geometric_ks(cycles.popping_gaps(_popping(spark, sf)), ["loi", "kind"], "gap").drop("n"), "p", "ks")


def ks_geom_p(spark, sf):
    return rounded(stats.with_ks_p(stats.geometric_ks(cycles.popping_gaps(_popping(spark, sf)), ["loi", "kind"], "gap")), "p", "ks", "p_value")


def _pairs(spark, sf, value="delta"):
    table = series.run_table(_line_states(spark, sf), ["loi"], "frame", "contr", DT)
    return cycles.correlations(_moving(spark, sf), table, value)


def cycle_correlation(spark, sf):
    return rounded(_pairs(spark, sf), "r")


def cycle_correlation_velocity(spark, sf):
    return rounded(_pairs(spark, sf, "vel"), "r")


def serial_mutual_ratio(spark, sf):
    return rounded(cycles.serial_and_mutual(_pairs(spark, sf)), "serial", "mutual", "ratio")


def serial_mutual_ratio_velocity(spark, sf):
    return rounded(cycles.serial_and_mutual(_pairs(spark, sf, "vel")), "serial", "mutual", "ratio")


QUERIES = {
    f.__name__: f
    for f in (
        traj_diff, traj_central_diff, band_spacing, state_islands, state_open_close, state_clear_border, state_dilated, rising_edges, run_distance, filtered_intervals, fixed_chunks, gap_fill_linear, closest_value, missing_ratio,
        cycle_summary, cycle_durations, quiet_periods, beating_rate, cycle_period, baseline_median_delta, cycle_extrema, time_to_peak, percent_time, percent_time_relax, smi, popping_rates, popping_gaps, ks_geom_stat, ks_geom_p, cycle_correlation, cycle_correlation_velocity, serial_mutual_ratio, serial_mutual_ratio_velocity,
    )
}


def _dilate(c: str, k: int, key: str) -> str:
    return f"max({c}) OVER (PARTITION BY {key} ORDER BY frame ROWS BETWEEN {k - 1 - k // 2} PRECEDING AND {k // 2} FOLLOWING)"


def _erode(c: str, k: int, key: str) -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY frame ROWS BETWEEN {k // 2} PRECEDING AND {k - 1 - k // 2} FOLLOWING)"
    return f"CASE WHEN count(*) {w} < {k} THEN 0 ELSE min({c}) {w} END"


def _steps(source: str, key: str, steps: list[tuple], prefix: str) -> tuple[str, str]:
    """CTEs that apply (function, size) to column s one after another; their text and the last one's name."""
    parts = []
    for i, (f, k) in enumerate(steps):
        parts.append(f"{prefix}{i} AS (SELECT {key}, frame, {f('s', k, key)} AS s FROM {source})")
        source = f"{prefix}{i}"
    return ", ".join(parts), source


def _numbered(source: str, key: str, name: str, column: str = "s") -> str:
    """CTE `name` with run numbers of column = 1."""
    return (
        f"{name}_a AS (SELECT *, CASE WHEN {column} = 1 AND coalesce(lag({column}) OVER (PARTITION BY {key} ORDER BY frame), 0) = 0 THEN 1 ELSE 0 END AS st FROM {source}), "
        f"{name} AS (SELECT * EXCLUDE (st), CASE WHEN {column} = 1 THEN CAST(sum(st) OVER (PARTITION BY {key} ORDER BY frame) AS BIGINT) END AS run FROM {name}_a)"
    )


def _cleared(source: str, key: str, buffer: int, name: str) -> str:
    return (
        _numbered(source, key, f"{name}_r") + f", {name} AS (SELECT {key}, frame, CASE WHEN run IS NOT NULL AND min(frame) OVER (PARTITION BY {key}, run) - min(frame) OVER (PARTITION BY {key}) >= {buffer} "
        f"AND max(frame) OVER (PARTITION BY {key}) - max(frame) OVER (PARTITION BY {key}, run) >= {buffer} THEN 1 ELSE 0 END AS s FROM {name}_r)"
    )


def _table(source: str, key: str) -> str:
    return f"SELECT {key}, run, min(frame) - 1 AS start_frame, round((min(frame) - 1) * {DT}, 6) AS start, count(*) AS frames, round(count(*) * {DT}, 6) AS duration FROM {source} WHERE run IS NOT NULL GROUP BY {key}, run"


_MORPH = [(_dilate, CLOSE), (_erode, CLOSE), (_erode, OPEN), (_dilate, OPEN)]
_S = f"{TRACES}, s0 AS (SELECT series, frame, CASE WHEN y > {THRESHOLD} THEN 1 ELSE 0 END AS s FROM t)"
_M, _MLAST = _steps("s0", "series", _MORPH, "m")
_CLEAN = f"{_S}, {_M}, {_cleared(_MLAST, 'series', BUFFER, 'c')}"
_L0 = f"{BANDS}, l0 AS (SELECT loi, frame, CASE WHEN avg(y) > {LEVEL} AND count(y) >= 4 THEN 1 ELSE 0 END AS s FROM b GROUP BY loi, frame)"
_LM, _LLAST = _steps("l0", "loi", _MORPH, "n")
_LINE = f"{_L0}, {_LM}, {_cleared(_LLAST, 'loi', 1, 'k')}, q0 AS (SELECT loi, frame, 1 - s AS s FROM k), {_cleared('q0', 'loi', 1, 'q')}"
_CYC = f"{_LINE}, {_numbered('k', 'loi', 'kr')}, {_numbered('q', 'loi', 'qr')}"
_VEL = (
    f"CASE WHEN count(*) OVER (PARTITION BY loi, band) = 1 THEN NULL WHEN lag(frame) OVER w IS NULL THEN (lead(y) OVER w - y) / {DT} WHEN lead(frame) OVER w IS NULL THEN (y - lag(y) OVER w) / {DT} "
    f"ELSE (lead(y) OVER w - lag(y) OVER w) / {2 * DT} END"
)
_MOVE = (
    f"{_CYC}, mv AS (SELECT loi, band, frame, y, {_VEL} AS vel FROM b WINDOW w AS (PARTITION BY loi, band ORDER BY frame)), "
    "rs AS (SELECT loi, band, CASE WHEN median(y) BETWEEN 0 AND 1000 THEN median(y) END AS rest FROM mv JOIN k USING (loi, frame) WHERE s = 0 GROUP BY loi, band), "
    "tr AS (SELECT mv.*, rs.rest, mv.y - rs.rest AS delta FROM mv JOIN k USING (loi, frame) LEFT JOIN rs USING (loi, band))"
)
_IN = f"{_MOVE}, i AS (SELECT tr.*, run AS cycle, frame - min(frame) OVER (PARTITION BY loi, run) AS place FROM tr JOIN kr USING (loi, frame) WHERE run IS NOT NULL)"
_FEAT = (
    f"{_IN}, f AS (SELECT loi, band, cycle, min(delta) AS contr_max, max(delta) AS elong_max, min(vel) AS vel_contr_max, max(vel) AS vel_elong_max, "
    f"CASE WHEN count(*) = count(delta) THEN 0 END AS zero, count(*) AS n, count(delta) AS nd FROM i GROUP BY loi, band, cycle), "
    "lo AS (SELECT loi, band, cycle, min(place) AS ap FROM i JOIN f USING (loi, band, cycle) WHERE delta = contr_max GROUP BY loi, band, cycle)"
)
_POPS = f"{_FEAT}, p AS (SELECT loi, band, cycle, CASE WHEN elong_max > {POP} THEN 1 ELSE 0 END AS pops FROM f)"
_GAPS = (
    f"{_POPS}, g AS (SELECT * FROM (SELECT loi, 'dist' AS kind, band, cycle, band - lag(band) OVER (PARTITION BY loi, cycle ORDER BY band) AS gap FROM p WHERE pops = 1 "
    "UNION ALL SELECT loi, 'tau', band, cycle, cycle - lag(cycle) OVER (PARTITION BY loi, band ORDER BY cycle) FROM p WHERE pops = 1) WHERE gap IS NOT NULL)"
)
_RATE = (
    "count(*) AS n_cycles, round(CASE WHEN avg(gap) <> 0 THEN 1.0 / avg(gap) END, 6) AS rate, round(stddev_pop(gap), 6) AS variability, round(avg(duration), 6) AS duration_mean, round(stddev_pop(duration), 6) AS duration_std"
)


def _correlated(v: str) -> str:
    """Pairs of segments of a line, each as long as the line's median cycle."""
    return (
        f"{_MOVE}, ct AS (SELECT loi, run AS cycle, min(frame) - 1 AS start_frame, count(*) AS frames FROM kr WHERE run IS NOT NULL GROUP BY loi, run), "
        "ce AS (SELECT * FROM ct JOIN (SELECT loi, CAST(floor(median(frames)) AS BIGINT) AS len, max(cycle) AS last FROM ct GROUP BY loi) USING (loi)), "
        f"sg AS (SELECT tr.loi, band, cycle, len, frame - start_frame AS seg, {v} AS v, count({v}) OVER (PARTITION BY tr.loi, band, cycle) AS n FROM tr JOIN ce ON tr.loi = ce.loi AND frame BETWEEN start_frame AND start_frame + len - 1 WHERE cycle < last), "
        "ok AS (SELECT *, avg(v) OVER (PARTITION BY loi, band, cycle) AS m FROM sg WHERE n = len), "
        "r AS (SELECT a.loi, a.band AS i, a.cycle AS k, b.band AS j, b.cycle AS l, CASE WHEN sum((a.v - a.m) * (a.v - a.m)) * sum((b.v - b.m) * (b.v - b.m)) > 0 THEN sum((a.v - a.m) * (b.v - b.m)) / sqrt(sum((a.v - a.m) * (a.v - a.m)) * sum((b.v - b.m) * (b.v - b.m))) END AS r "
        "FROM ok a JOIN ok b ON a.loi = b.loi AND a.seg = b.seg AND a.band >= b.band AND a.cycle >= b.cycle AND (a.band <> b.band OR a.cycle <> b.cycle) GROUP BY ALL)"
    )


_R, _RV = _correlated("delta"), _correlated("vel")
_AVERAGES = "SELECT loi, round(avg(r) FILTER (i = j), 6) AS serial, round(avg(r) FILTER (k = l AND i > j), 6) AS mutual, round(avg(r) FILTER (k = l AND i > j) / avg(r) FILTER (i = j), 6) AS ratio FROM r GROUP BY loi"


def _percent(p0: float, p1: float) -> str:
    rising = p0 > p1
    x, use = ("place - ap", "place >= ap") if rising else ("place", "place <= ap")
    near = lambda p: f"(SELECT x FROM u AS z WHERE z.loi = f.loi AND z.band = f.band AND z.cycle = f.cycle ORDER BY abs(delta - low * {p / 100}), x LIMIT 1)"
    t0 = "0" if p0 == 0 else near(p0)
    t1 = "(SELECT count(*) FROM u AS z WHERE z.loi = f.loi AND z.band = f.band AND z.cycle = f.cycle)" if rising and p1 == 0 else near(p1)
    return (
        f"WITH {_FEAT}, u AS (SELECT i.loi, i.band, i.cycle, {x} AS x, delta, contr_max AS low FROM i JOIN f USING (loi, band, cycle) JOIN lo USING (loi, band, cycle) WHERE {use}) "
        f"SELECT loi, band, cycle, round(CASE WHEN n = nd THEN ({t1} - {t0}) * {DT} ELSE 0.0 END, 6) AS percent_time FROM f"
    )


ORACLE_SQL = {
    "traj_diff": f"WITH {TRACES} SELECT series, frame, round(y - lag(y) OVER (PARTITION BY series ORDER BY frame), 6) AS d FROM t",
    "traj_central_diff": f"WITH {TRACES} SELECT series, frame, round(CASE WHEN count(*) OVER (PARTITION BY series) = 1 THEN NULL WHEN lag(frame) OVER w IS NULL THEN (lead(y) OVER w - y) / {DT} WHEN lead(frame) OVER w IS NULL THEN (y - lag(y) OVER w) / {DT} ELSE (lead(y) OVER w - lag(y) OVER w) / {2 * DT} END, 6) AS v FROM t WINDOW w AS (PARTITION BY series ORDER BY frame)",
    "band_spacing": f"WITH {BANDS}, d AS (SELECT loi, band, frame, y - lag(y) OVER (PARTITION BY loi, frame ORDER BY band) AS d FROM b) SELECT loi, band, frame, round(CASE WHEN d BETWEEN -50 AND 50 THEN d END, 6) AS slen FROM d",
    "state_islands": f"WITH {_S}, {_numbered('s0', 'series', 'r')} {_table('r', 'series')}",
    "state_open_close": f"WITH {_S}, {_M} SELECT series, frame, CAST(s AS BIGINT) AS contr FROM {_MLAST}",
    "state_clear_border": f"WITH {_CLEAN} SELECT series, frame, CAST(s AS BIGINT) AS contr FROM c",
    "state_dilated": f"WITH {_S} SELECT series, frame, CAST({_dilate('s', 4, 'series')} AS BIGINT) AS wide FROM s0",
    "rising_edges": f"WITH {_S}, n AS (SELECT *, lead(s) OVER (PARTITION BY series ORDER BY frame) AS nx FROM s0) SELECT series, frame FROM n WHERE s = 0 AND nx = 1",
    "run_distance": f"WITH {_S}, {_numbered('s0', 'series', 'r')}, d AS (SELECT series, frame, run, CASE WHEN run IS NOT NULL THEN least(frame - min(frame) OVER (PARTITION BY series, run) + 1, max(frame) OVER (PARTITION BY series, run) - frame + 1) END AS d FROM r) SELECT series, frame, round(coalesce(d / max(d) OVER (PARTITION BY series, run), 0.0), 6) AS d FROM d",
    "filtered_intervals": f"WITH {TRACES}, s0 AS (SELECT series, frame, y, CASE WHEN y > 5.0 THEN 1 ELSE 0 END AS s FROM t), {_numbered('s0', 'series', 'r')}, z AS (SELECT series, frame, CASE WHEN run IS NOT NULL AND count(*) OVER w >= 4 AND abs(sum(y) OVER w - min(y) OVER w * count(*) OVER w) >= 3.0 THEN 1 ELSE 0 END AS s FROM r WINDOW w AS (PARTITION BY series, run)), "
    + _steps("z", "series", [(_dilate, 3), (_erode, 3)], "x")[0]
    + " SELECT series, frame, CAST(s AS BIGINT) AS kept FROM x1",
    "fixed_chunks": f"WITH {TRACES} SELECT series, frame // 16 AS chunk, count(*) AS n, round(avg(y), 6) AS mean FROM t GROUP BY ALL",
    "gap_fill_linear": f"WITH {TRACES}, h AS (SELECT series, frame, CASE WHEN (frame + series) % 5 <> 0 THEN y END AS y FROM t), e AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS fa, last_value(y IGNORE NULLS) OVER p AS ya, first_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER n AS fb, first_value(y IGNORE NULLS) OVER n AS yb FROM h WINDOW p AS (PARTITION BY series ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY series ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT series, frame, round(CASE WHEN y IS NOT NULL THEN y WHEN frame - fa <= 3 THEN ya + (yb - ya) * (frame - fa) / (fb - fa) END, 6) AS filled FROM e",
    "closest_value": f"WITH {TRACES}, o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(y - {THRESHOLD}), frame) AS n FROM t) SELECT series, frame, round(y, 6) AS y FROM o WHERE n = 1",
    "missing_ratio": f"WITH {TRACES}, m AS (SELECT series, CASE WHEN y BETWEEN 1.0 AND 60.0 THEN y END AS y FROM t) SELECT series, round(CASE WHEN count(*) FILTER (y IS NULL OR y <> 0) > 0 THEN count(*) FILTER (y IS NULL) / count(*) FILTER (y IS NULL OR y <> 0) END, 6) AS missing FROM m GROUP BY series",
    "cycle_summary": f"WITH {_CLEAN}, {_numbered('c', 'series', 'r')}, y AS ({_table('r', 'series')}), g AS (SELECT *, start - lag(start) OVER (PARTITION BY series ORDER BY start) AS gap FROM y) SELECT series, {_RATE} FROM g GROUP BY series",
    "cycle_durations": f"WITH {_CYC} {_table('kr', 'loi')}",
    "quiet_periods": f"WITH {_CYC} {_table('qr', 'loi')}",
    "beating_rate": f"WITH {_CYC}, y AS ({_table('kr', 'loi')}), g AS (SELECT *, start - lag(start) OVER (PARTITION BY loi ORDER BY start) AS gap FROM y) SELECT loi, {_RATE} FROM g GROUP BY loi",
    "cycle_period": f"WITH {_CYC}, a AS ({_table('kr', 'loi')}), z AS ({_table('qr', 'loi')}) SELECT loi, run AS cycle, round(a.duration + z.duration, 6) AS period FROM a JOIN z USING (loi, run)",
    "baseline_median_delta": f"WITH {_MOVE} SELECT loi, band, frame, round(rest, 6) AS rest, round(delta, 6) AS delta FROM tr",
    "cycle_extrema": f"WITH {_FEAT} SELECT loi, band, cycle, round(contr_max, 6) AS contr_max, round(elong_max, 6) AS elong_max, round(vel_contr_max, 6) AS vel_contr_max, round(vel_elong_max, 6) AS vel_elong_max FROM f",
    "time_to_peak": f"WITH {_FEAT} SELECT f.loi, f.band, f.cycle, round(CASE WHEN n = nd THEN ap * {DT} END, 6) AS time_to_peak, round(CASE WHEN n = nd THEN (n - ap) * {DT} END, 6) AS time_to_relax FROM f LEFT JOIN lo USING (loi, band, cycle)",
    "percent_time": _percent(20.0, 80.0),
    "percent_time_relax": _percent(80.0, 0.0),
    "smi": f"WITH {_IN}, s AS (SELECT loi, band, cycle, CASE WHEN count(*) = count(vel) THEN sum(abs(vel)) * {DT} END AS s FROM i GROUP BY ALL), m AS (SELECT loi, cycle, sum(abs(v)) * {DT} AS s FROM (SELECT loi, cycle, frame, avg(vel) AS v FROM i GROUP BY ALL) GROUP BY ALL) SELECT loi, round((SELECT avg(s.s) FROM s WHERE s.loi = m.loi) / avg(m.s), 6) AS smi FROM m GROUP BY loi",
    "popping_rates": f"WITH {_POPS} SELECT loi, 'all' AS kind, CAST(NULL AS BIGINT) AS item, round(avg(pops), 6) AS rate FROM p GROUP BY loi UNION ALL SELECT loi, 'band', band, round(avg(pops), 6) FROM p GROUP BY loi, band UNION ALL SELECT loi, 'cycle', cycle, round(avg(pops), 6) FROM p GROUP BY loi, cycle",
    "popping_gaps": f"WITH {_GAPS} SELECT loi, kind, band, cycle, gap FROM g",
    "ks_geom_stat": f"WITH {_GAPS}, c AS (SELECT loi, kind, gap, count(*) AS n FROM g GROUP BY ALL), w AS (SELECT *, sum(n) OVER k AS al, sum(n) OVER k / sum(gap * n) OVER k AS p, sum(n) OVER (PARTITION BY loi, kind ORDER BY gap) AS cum FROM c WINDOW k AS (PARTITION BY loi, kind)) SELECT loi, kind, round(max(p), 6) AS p, round(max(greatest(abs(cum / al - (1 - pow(1 - p, gap))), abs((cum - n) / al - (1 - pow(1 - p, gap))))), 6) AS ks FROM w GROUP BY loi, kind",
    "cycle_correlation": f"WITH {_R} SELECT loi, i, k, j, l, round(r, 6) AS r FROM r",
    "cycle_correlation_velocity": f"WITH {_RV} SELECT loi, i, k, j, l, round(r, 6) AS r FROM r",
    "serial_mutual_ratio": f"WITH {_R} {_AVERAGES}",
    "serial_mutual_ratio_velocity": f"WITH {_RV} {_AVERAGES}",
}
