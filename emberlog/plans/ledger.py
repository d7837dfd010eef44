"""Run ledger: which windows were delivered.

The ledger is an append-only table of events; a run is the fold of its events.
Nothing is updated in place, so a writer that dies leaves the earlier state
intact. Several jobs may begin the same window at once: an empty file named by
the run is created by one of them only, which gets the new run.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.windows import Window, timestamp
from emberlog.schema import CYCLE_OUTCOMES, CYCLE_SCHEMA, LEDGER_SCHEMA
from emberlog.session import stage
from emberlog.sources.files import Folder

# Fixed value.
RUN_DAYS = 30


def run_id_of(window_from: Column, window_to: Column) -> Column:
    """Run ids follow from the window: a retried task cannot create a second run."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    return F.md5(F.concat_ws("|", F.date_format(window_from, fmt), F.date_format(window_to, fmt)))


def fold_runs(events: DataFrame) -> DataFrame:
    """Current state of every run. Starting a run that exists changes nothing;
    otherwise the last event gives the status."""
    order = F.struct("at", "seq")
    status = F.col("status")
    changed = F.when(status != "started", order)

    def last_of(column: str, when: Column) -> Column:
        return F.max_by(column, F.when(when, order))

    return events.groupBy("run_id").agg(
        F.min("window_from").alias("window_from"),
        F.min("window_to").alias("window_to"),
        F.coalesce(F.max_by("status", changed), F.lit("started")).alias("status"),
        last_of("cover_msg_id", status == "cover_sent").alias("cover_msg_id"),
        F.coalesce(last_of("files_sent", status == "done"), F.lit(0)).alias("files_sent"),
        F.min("at").alias("created_at"),
        F.max(F.when(status.isin("done", "failed"), F.col("at"))).alias("completed_at"),
        last_of("err", status == "failed").alias("err"),
    )


def pending_windows(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Windows not delivered yet."""
    done = runs.filter(F.col("status") == "done").select("window_from", "window_to")
    return candidates.join(done, ["window_from", "window_to"], "left_anti")


def begin_actions(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """What starting each window would do: ``skip`` a delivered one, ``resume``
    an unfinished one, or begin a ``new`` run."""
    known = runs.select("window_from", "window_to", "run_id", "status")
    return candidates.join(known, ["window_from", "window_to"], "left").select(
        "window_from", "window_to",
        F.coalesce("run_id", run_id_of(F.col("window_from"), F.col("window_to"))).alias("run_id"),
        F.when(F.col("status") == "done", "skip").when(F.col("status").isNotNull(), "resume")
        .otherwise("new").alias("action"),
    )


def completed_run(runs: DataFrame, window: Window) -> DataFrame:
    lo, hi = window.bounds
    return runs.filter(
        (F.col("window_from") == lo) & (F.col("window_to") == hi) & (F.col("status") == "done")
    ).limit(1)


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id")).limit(limit if limit >= 1 else 10)


def cycle_outcomes(cycles: DataFrame) -> DataFrame:
    """Number of cycles by outcome. A run that is still open has none."""
    return cycles.groupBy("outcome").agg(F.count("*").alias("cycles"))


def partial_errors(cycles: DataFrame) -> DataFrame:
    """Sources that failed in cycles that were delivered all the same."""
    delivered = cycles.filter(F.col("outcome").isin("ok", "partial"))
    return delivered.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("partial_errors"))


def retained_runs(runs: DataFrame, now: Column, days: int = RUN_DAYS) -> DataFrame:
    """Delivered runs are kept for ``days``, all others for good."""
    old = (F.col("status") == "done") & (F.col("completed_at") < now - F.make_dt_interval(days=F.lit(days)))
    return runs.filter(~F.coalesce(old, F.lit(False)))


class RunLedger:
    """The ledger table in a folder; the cycles stand in one beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = Folder(spark, path)
        self.claims = Folder(spark, f"{path}_claims")

    def _table(self, schema, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._table(LEDGER_SCHEMA, self.path)

    def cycles(self) -> DataFrame:
        return self._table(CYCLE_SCHEMA, f"{self.path}_cycles")

    def record_cycle(self, window: Window, outcome: str, seconds: float, errors: int = 0) -> None:
        if outcome not in CYCLE_OUTCOMES:
            raise ValueError(f"not an outcome: {outcome}")
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = (window.start, window.end, outcome, now, float(seconds), errors)
        cycles = self.spark.createDataFrame([row], CYCLE_SCHEMA)
        Folder(self.spark, f"{self.path}_cycles").append(cycles)

    def runs(self) -> DataFrame:
        return fold_runs(self.events())

    def _append(self, run_id, status, window=(None, None), cover_msg_id=None, files_sent=None, err=None):
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = (run_id, *window, status, now, time.time_ns(), cover_msg_id, files_sent, err)
        self.table.append(self.spark.createDataFrame([row], LEDGER_SCHEMA))

    def begin(self, window: Window) -> tuple[str, str]:
        """Run id and action (skip, resume or new) for a window."""
        candidate = self.spark.createDataFrame(
            [(window.start, window.end)], "window_from timestamp_ntz, window_to timestamp_ntz"
        )
        row = begin_actions(candidate, self.runs()).first()
        run_id, action = row["run_id"], row["action"]
        if action == "new":
            if not self.claims.claim(run_id):
                action = "resume"
            # also after a lost claim: its owner may have died before this, and starting twice changes nothing
            self._append(run_id, "started", (window.start, window.end))
        return run_id, action

    def sweep(self, now: datetime, days: int = RUN_DAYS) -> None:
        """Remove the events of runs delivered more than ``days`` ago.

        The rest is written beside what is there before that is removed; in
        between events stand twice, which changes no run."""
        before = [n for n in self.table.names() if n.startswith("part-")]
        if not before:
            return
        events, runs = self.events(), self.runs()
        kept = retained_runs(runs, timestamp(now), days).select("run_id")
        old = [r["run_id"] for r in runs.join(kept, "run_id", "left_anti").select("run_id").collect()]
        if not old:
            return
        self.table.append(stage(events.join(kept, "run_id", "left_semi")))
        for name in before:
            self.table.remove(name)
        for run_id in old:
            self.claims.remove(run_id)

    def mark_cover_sent(self, run_id: str, cover_msg_id: int) -> None:
        self._append(run_id, "cover_sent", cover_msg_id=cover_msg_id)

    def finish(self, run_id: str, files_sent: int) -> None:
        self._append(run_id, "done", files_sent=files_sent)

    def fail(self, run_id: str, err: str) -> None:
        self._append(run_id, "failed", err=err)
