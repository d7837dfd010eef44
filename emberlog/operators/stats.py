"""Counting queries: histograms, stats by fields, field values, freshness."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.windows import timestamp


def hits(logs: DataFrame, step: str = "1 hour", fields=("host",)) -> DataFrame:
    """Count per time bucket and field set, one row per non-empty bucket."""
    return logs.groupBy(F.window("event_time", step).alias("w"), *fields).agg(F.count("*").alias("hits")).select(
        *fields, F.col("w.start").alias("bucket"), "hits"
    )


def hits_series(logs: DataFrame, step: str = "1 hour", fields=("host",)) -> DataFrame:
    """One row per field set: parallel arrays of times and values, and the
    total. An array holds one entry per bucket of the queried window."""
    points = F.sort_array(F.collect_list(F.struct("bucket", "hits")))
    return (
        hits(logs, step, fields).groupBy(*fields)
        .agg(points.alias("p"), F.sum("hits").alias("total"))
        .select(
            F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]).alias("fields"),
            F.col("p.bucket").alias("timestamps"), F.col("p.hits").alias("values"), "total",
        )
    )


def stats_by(logs: DataFrame, *fields: str) -> DataFrame:
    return logs.groupBy(*fields).agg(F.count("*").alias("rows"))


def field_values(logs: DataFrame, field: str) -> DataFrame:
    """Values of a field with their record counts."""
    return logs.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("hits"))


def source_freshness(logs: DataFrame, now: datetime, within: timedelta = timedelta(hours=1)) -> DataFrame:
    """Last record of each host and whether it is recent."""
    recent = timestamp(now - within)
    return logs.filter(F.col("event_time") <= timestamp(now)).groupBy("host").agg(
        F.max("event_time").alias("last_seen"),
        F.count_if(F.col("event_time") >= recent).alias("recent_records"),
    ).withColumn("is_fresh", F.col("recent_records") > 0)


def has_recent(logs: DataFrame, now: datetime, within: timedelta = timedelta(hours=1)) -> DataFrame:
    """Probe: one record of the last hour, or none."""
    t = F.col("event_time")
    return logs.filter((t >= timestamp(now - within)) & (t <= timestamp(now))).limit(1)
