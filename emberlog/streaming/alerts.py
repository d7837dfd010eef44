"""Alerts on a stream of records.

The state of a fingerprint is one time, that of its last record or of its last
alert, with a timer that drops it when it cannot matter any more. A new stream
may take its first states from a table, so that it does not alert on what is
known. Each task first combines its records per fingerprint and time bucket,
so a fingerprint that fills a third of a micro-batch reaches its state as a
few rows. The combined rows carry all that the rule looks at.
"""

from __future__ import annotations

import sys
from datetime import timedelta
from typing import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog.functions.fingerprint import fingerprint
from emberlog.functions.normalize import DEFAULT_PROFILE
from emberlog.operators.incidents import with_template
from emberlog.operators.patterns import QUIET, THROTTLE

# workers need not be able to import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KEY = ["host", "app", "fingerprint"]
_KEY_DDL = "host string, app string, fingerprint string"
_COMBINED = f"{_KEY_DDL}, bucket long, first_us long, last_us long, critical_us double"


def _combine(bucket_us: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(bucket=pdf["us"] // bucket_us, critical_us=pdf["us"].where(pdf["is_critical"]))
            yield pdf.groupby([*_KEY, "bucket"], as_index=False).agg(
                first_us=("us", "min"), last_us=("us", "max"), critical_us=("critical_us", "min")
            )

    return run


def _reduced(logs: DataFrame, bucket: timedelta, lateness: str, profile) -> DataFrame:
    rows = with_template(logs, profile).select(
        "host", "app", fingerprint().alias("fingerprint"),
        F.unix_micros(F.col("event_time").cast("timestamp")).alias("us"),
        (F.col("level") == "critical").alias("is_critical"),
    )
    combined = rows.mapInPandas(_combine(bucket // timedelta(microseconds=1)), _COMBINED)
    # a combined row is late only if all its records are
    return combined.withColumn("event_time", F.timestamp_micros("last_us")).withWatermark("event_time", lateness)


def _buckets(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(frames))
    return rows.groupby("bucket").agg({"first_us": "min", "last_us": "max", "critical_us": "min"}).sort_index()


class _LastTime(StatefulProcessor):
    """Keeps one time per fingerprint, for ``hold_us`` of the stream's time.

    ``rule`` takes it (or None) and the combined rows in order of time, and
    returns the alerts and the time to keep."""

    def __init__(self, rule: Callable[[int | None, pd.DataFrame], tuple[list[int], int]], hold_us: int):
        self.rule, self.hold_us = rule, hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "us long, timer long")

    def keep(self, us: int, watermark_ms: int) -> None:
        timer = max((us + self.hold_us) // 1000 + 1, watermark_ms + 1)
        if self.kept.exists():
            self.handle.deleteTimer(self.kept.get()[1])
        self.handle.registerTimer(timer)
        self.kept.update((us, timer))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.keep(int(initialState["us"].max()), timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.kept.get()[0] if self.kept.exists() else None
        alerts, last = self.rule(before, _buckets(rows))
        if last != before:
            self.keep(last, timerValues.getCurrentWatermarkInMs())
        if alerts:
            yield pd.DataFrame([(*key, us) for us in alerts], columns=[*_KEY, "us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def _alerts(reduced: DataFrame, state: _LastTime, known: DataFrame | None, at: str) -> DataFrame:
    if known is not None:
        known = known.select(*_KEY, F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where("us IS NOT NULL")
        known = known.groupBy(*_KEY).agg(F.max("us").alias("us")).groupBy(*_KEY)
    return reduced.groupBy(*_KEY).transformWithStateInPandas(
        state, f"{_KEY_DDL}, us long", "Append", "EventTime", initialState=known
    )


def new_critical_alerts(
    logs: DataFrame, quiet: timedelta = QUIET, lateness: str = "10 minutes", profile=DEFAULT_PROFILE,
    known: DataFrame | None = None,
) -> DataFrame:
    """Critical records whose fingerprint had no record for longer than
    ``quiet``. A state is dropped once the watermark is past its quiet period,
    when any further record counts as new anyway. ``known`` (host, app,
    fingerprint, last_seen), such as the stored history, is what a stream
    without a checkpoint begins with; a restarted one goes on with its own."""
    quiet_us = quiet // timedelta(microseconds=1)

    def rule(last, rows):
        out = []
        for first, end, critical in rows.itertuples(index=False):
            if critical == first and (last is None or first - last > quiet_us):
                out.append(int(first))
            last = int(end) if last is None else max(last, int(end))
        return out, last

    reduced = _reduced(logs, timedelta(days=1), lateness, profile)
    return _alerts(reduced, _LastTime(rule, quiet_us), known, "last_seen").select(
        *_KEY, F.timestamp_micros("us").cast("timestamp_ntz").alias("event_time")
    )


def throttled_alerts(
    logs: DataFrame, gap: timedelta = THROTTLE, level: str = "critical",
    lateness: str = "10 minutes", profile=DEFAULT_PROFILE, known: DataFrame | None = None,
) -> DataFrame:
    """At most one alert per fingerprint and ``gap``; equal times of a
    fingerprint are combined before they reach its state. ``known`` (host, app,
    fingerprint, alert_at) are alerts sent before a stream without a checkpoint."""
    gap_us = gap // timedelta(microseconds=1)

    def rule(last, rows):
        out = []
        for us in rows.index:
            if last is None or us >= last + gap_us:
                last = int(us)
                out.append(last)
        return out, last

    chosen = logs.filter(F.col("level") == level)
    reduced = _reduced(chosen, timedelta(microseconds=1), lateness, profile)
    return _alerts(reduced, _LastTime(rule, gap_us), known, "alert_at").select(
        *_KEY, F.timestamp_micros("us").cast("timestamp_ntz").alias("alert_at")
    )
