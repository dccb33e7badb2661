"""Analyses side by side: each under a job tag of its own, failing or cancelled alone, with its outcome in a log."""

from __future__ import annotations

import json
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from ventara.operators import analyses
from ventara.plans.session import kept

#: The log has a row for each analysis of a run; `summary` is JSON.
LOG_SCHEMA = "run_id string, name string, position int, status string, error string, rows long, seconds double, filters string, summary string, timestamp timestamp"
OK, FAILED, CANCELLED = "ok", "failed", "cancelled"
#: Runs that list_runs gives at most.
MOST = 200


@dataclass
class Outcome:
    name: str
    status: str
    frame: DataFrame | None = None
    error: str | None = None
    rows: int | None = None
    seconds: float = 0.0


@dataclass
class Dispatch:
    """A run of analyses over one fact. Jobs share the cluster by the session's scheduler; `pool` names a fair pool where it has one."""

    spark: SparkSession
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    workers: int = 4
    pool: str | None = None
    _stopped: set = field(default_factory=set)
    _running: set = field(default_factory=set)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def tag(self, name: str) -> str:
        return f"analysis-{self.run_id}-{name}"

    def cancel(self, name: str) -> None:
        """Stop one analysis: it does not start any more, or the jobs under its tag end, those included that it starts while it is being stopped."""
        with self._lock:
            self._stopped.add(name)
        threading.Thread(target=self._stop, args=(name,), daemon=True).start()

    def _stop(self, name: str) -> None:
        while name in self._running:
            self.spark.sparkContext.cancelJobsWithTag(self.tag(name))
            time.sleep(0.2)

    def _one(self, name: str, build) -> Outcome:
        context, start = self.spark.sparkContext, time.monotonic()
        context.addJobTag(self.tag(name))
        if self.pool:
            context.setLocalProperty("spark.scheduler.pool", self.pool)
        try:
            with self._lock:
                if name in self._stopped:
                    return Outcome(name, CANCELLED)
                self._running.add(name)
            frame = kept(build())
            rows = frame.count()
            return Outcome(name, OK, frame, rows=rows, seconds=time.monotonic() - start)
        except Exception as error:  # noqa: BLE001 - one analysis must not stop the others
            status = CANCELLED if name in self._stopped else FAILED
            return Outcome(name, status, error=str(error).splitlines()[0][:500], seconds=time.monotonic() - start)
        finally:
            self._running.discard(name)
            context.removeJobTag(self.tag(name))

    def run(self, builds: dict) -> dict[str, Outcome]:
        """Outcomes of named builders of frames, in their order. Each frame is computed and kept here."""
        # each thread gets its own copy of the local properties, which hold the tags
        target = lambda: inheritable_thread_target(self.spark)(self._one)
        with ThreadPoolExecutor(self.workers) as threads:
            waiting = {name: threads.submit(target(), name, build) for name, build in builds.items()}
            return {name: future.result() for name, future in waiting.items()}


def run_analyses(fact: DataFrame, names=tuple(analyses.ANALYSES), slots: dict[str, dict] | None = None, dispatch: Dispatch | None = None) -> dict[str, Outcome]:
    """The analyses of a fact side by side, on their resolved fields where `slots` has them."""
    dispatch = dispatch or Dispatch(fact.sparkSession)
    build = lambda name: lambda: analyses.run_task(fact, name, slots[name]) if slots and name in slots else analyses.run_analysis(fact, name)
    return dispatch.run({name: build(name) for name in names})


def log_run(spark: SparkSession, path: str, run_id: str, outcomes: dict[str, Outcome], filters: dict | None = None, summary: dict | None = None) -> None:
    """Append a run to the log: one small file, written in one step."""
    now = datetime.now(timezone.utc)
    rows = [(run_id, o.name, k, o.status, o.error, o.rows, o.seconds, json.dumps(filters or {}), json.dumps(summary or {}, default=str), now) for k, o in enumerate(outcomes.values())]
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def list_runs(log: DataFrame, n: int = 50) -> DataFrame:
    """The last runs, newest first: how many analyses ended how, their filters and summary."""
    count = lambda s: F.count_if(F.col("status") == s)
    runs = log.groupBy("run_id").agg(
        F.max("timestamp").alias("timestamp"), F.count("*").alias("analyses"), count(OK).alias("ok"), count(FAILED).alias("failed"), count(CANCELLED).alias("cancelled"),
        F.sum("rows").alias("rows"), F.max("filters").alias("filters"), F.max("summary").alias("summary"))
    return runs.orderBy(F.desc("timestamp"), "run_id").limit(min(n, MOST))
