"""Incremental incident counts between digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.fingerprint import fingerprint
from emberlog.functions.normalize import DEFAULT_PROFILE
from emberlog.operators.incidents import with_template
from emberlog.schema import INCIDENT_KEY


def incident_counts(
    logs: DataFrame, window: str = "1 hour", lateness: str = "10 minutes", profile=DEFAULT_PROFILE
) -> DataFrame:
    """Counts per window, incident and level of a stream of records.

    Partial aggregation runs before the state store, whose rows are windows
    and not records. In append mode a window is emitted once the watermark has
    passed it; records later than that are dropped. Works on batch input too.
    """
    timed = with_template(logs, profile).withColumn("event_time", F.col("event_time").cast("timestamp"))
    return (
        timed.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", window), *INCIDENT_KEY, "level")
        .agg(
            F.count("*").alias("cnt"),
            F.min("event_time").alias("first_seen"),
            F.max("event_time").alias("last_seen"),
        )
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            "host", "app", fingerprint().alias("fingerprint"), "level", "cnt",
            F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
            F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
        )
    )


def merge_counts(counts: DataFrame) -> DataFrame:
    """Incident counts of a whole period from the windows of the stream."""
    return counts.groupBy("host", "app", "fingerprint", "level").agg(
        F.sum("cnt").alias("cnt"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
