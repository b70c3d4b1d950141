"""Progress and failures of streams and batches, as tables."""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "at timestamp, name string, run string, event string, batch bigint, done bigint, total bigint, seconds double, left_seconds double, error string"


class Reports:
    """Reports gathered on the driver, at most `keep` of the newest; `table` gives them as a DataFrame, `write` appends them to one."""

    def __init__(self, spark: SparkSession, keep: int = 10_000):
        self.spark, self.keep = spark, keep
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def add(self, name: str | None, run: str, event: str, batch: int | None = None, done: int | None = None, total: int | None = None, seconds: float | None = None, left: float | None = None, error: str | None = None) -> None:
        with self._lock:
            self._rows.append((dt.datetime.now(dt.timezone.utc), name, run, event, batch, done, total, seconds, left, error))
            del self._rows[: -self.keep]

    def table(self) -> DataFrame:
        with self._lock:
            return self.spark.createDataFrame(list(self._rows), SCHEMA)

    def write(self, path: str) -> None:
        """Appends the reports to a table and forgets them."""
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


class StreamReports(StreamingQueryListener):
    """Listener that reports each start, micro-batch (rows read, seconds) and end (with the error) of the session's streams.

    spark.streams.addListener(StreamReports(reports))
    """

    def __init__(self, reports: Reports):
        self.reports = reports
        self.names: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self.reports.add(event.name, str(event.runId), "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.reports.add(p.name, str(p.runId), "batch", p.batchId, p.numInputRows, None, p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        self.reports.add(self.names.get(str(event.runId)), str(event.runId), "idle")

    def onQueryTerminated(self, event) -> None:
        error = event.exception
        self.reports.add(self.names.get(str(event.runId)), str(event.runId), "failed" if error else "ended", error=error)


def batch(reports: Reports, name: str, steps: Iterable[tuple[str, Callable[[], object]]], stop: bool = False) -> dict[str, object]:
    """Runs named steps (each a Spark job or more) one after another, each in a job group of its own, and reports every one.

    After each step: steps done of all, seconds so far and an estimate of those left.  A step that fails is reported with its error and
    the others still run (stop: no more do); its jobs are cancelled.  Gives the results of the steps that ended.
    """
    steps = list(steps)
    context, results, start = reports.spark.sparkContext, {}, time.monotonic()
    run = f"{name}-{time.time_ns()}"
    reports.add(name, run, "started", done=0, total=len(steps))
    for i, (step, work) in enumerate(steps, 1):
        group = f"{run}-{i}"
        context.setJobGroup(group, f"{name}: {step}", interruptOnCancel=True)
        error = None
        try:
            results[step] = work()
        except Exception as e:  # noqa: BLE001  reported, never lost
            error = f"{type(e).__name__}: {e}".split("\n")[0][:500]
            context.cancelJobGroup(group)
        seconds = time.monotonic() - start
        reports.add(step, run, "failed" if error else "done", done=i, total=len(steps), seconds=seconds, left=seconds / i * (len(steps) - i), error=error)
        if error and stop:
            break
    context.setLocalProperty("spark.jobGroup.id", None)
    reports.add(name, run, "ended", done=len(results), total=len(steps), seconds=time.monotonic() - start)
    return results


def stages(spark: SparkSession, group: str) -> list[dict]:
    """Jobs and tasks of a job group as Spark's status tracker knows them: a row a stage."""
    tracker, out = spark.sparkContext.statusTracker(), []
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for s in info.stageIds if info else ():
            stage = tracker.getStageInfo(s)
            if stage:
                out.append({"job": job, "status": info.status, "stage": s, "name": stage.name, "tasks": stage.numTasks, "done": stage.numCompletedTasks, "failed": stage.numFailedTasks})
    return out


def as_json(table: DataFrame) -> list[dict]:
    """Reports as plain rows, for a dashboard."""
    return [json.loads(r) for r in table.orderBy("at").toJSON().collect()]
