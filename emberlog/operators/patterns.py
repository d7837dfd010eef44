"""Patterns across hosts and days, new and recurring fingerprints, alerts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.fingerprint import fingerprint
from emberlog.functions.normalize import DEFAULT_PROFILE
from emberlog.operators.incidents import incidents, with_template
from emberlog.functions.windows import digest_bucket
from emberlog.operators.throttle import THROTTLE, throttle_alerts  # noqa: F401
from emberlog.schema import INCIDENT_KEY


# Fixed values.
PATTERN_COUNT = 10
PATTERN_HOSTS = 2
QUIET = timedelta(days=7)


def patterns(incidents: DataFrame, min_count: int = PATTERN_COUNT, min_hosts: int = PATTERN_HOSTS) -> DataFrame:
    """Templates across hosts. An incident is unique per host, so the rows of
    a template are its hosts; ``pattern_hosts`` lists them."""
    return (
        incidents.groupBy("app", "normalized_msg")
        .agg(
            F.sum("cnt").alias("cnt"),
            F.max("cnt").alias("max_cnt"),
            F.count("*").alias("host_count"),
        )
        .withColumn("is_pattern", (F.col("max_cnt") >= min_count) | (F.col("host_count") >= min_hosts))
    )


def pattern_hosts(incidents: DataFrame, min_count: int = PATTERN_COUNT, min_hosts: int = PATTERN_HOSTS) -> DataFrame:
    """One row per host of every pattern; a list would grow with the fleet.
    ``incidents`` is read twice: pass a staged table."""
    found = patterns(incidents, min_count, min_hosts).filter("is_pattern").select("app", "normalized_msg")
    return incidents.join(found, ["app", "normalized_msg"], "left_semi").select("app", "normalized_msg", "host", "cnt")


def flag_patterns(incidents: DataFrame, min_count: int = PATTERN_COUNT, min_hosts: int = PATTERN_HOSTS) -> DataFrame:
    """Incidents with the hosts of their template and the pattern flag. The
    counts are joined back, so a template is never gathered in one task."""
    hosts = incidents.groupBy("app", "normalized_msg").agg(F.count("*").alias("host_count"))
    return (
        incidents.join(hosts, ["app", "normalized_msg"])
        .withColumn("is_pattern", (F.col("cnt") >= min_count) | (F.col("host_count") >= min_hosts))
    )


def daily_incidents(logs: DataFrame, profile=DEFAULT_PROFILE, tz: str = "Europe/Moscow") -> DataFrame:
    """Incidents of every digest window in the input, in one pass."""
    return incidents(logs.withColumn("window_start", digest_bucket("event_time", tz)), profile, ("window_start",))


def new_patterns_per_day(daily: DataFrame) -> DataFrame:
    """Fingerprints first seen in each digest window."""
    first = daily.groupBy("host", "fingerprint").agg(F.min("window_start").alias("window_start"))
    return first.groupBy("window_start").agg(F.count("*").alias("new_patterns"))


def browse(
    daily: DataFrame, host: str | None = None, app: str | None = None, level: str | None = None,
    pattern: str | None = None, since=None, fingerprint: str | None = None,
) -> DataFrame:
    """Incident browser over the daily table; ``pattern`` is a text contained
    in the template."""
    wanted = {"host": host, "app": app, "level": level, "fingerprint": fingerprint}
    for name, value in wanted.items():
        if value is not None:
            daily = daily.filter(F.col(name) == value)
    if pattern is not None:
        daily = daily.filter(F.contains("normalized_msg", F.lit(pattern)))
    if since is not None:
        daily = daily.filter(F.col("window_start") >= since)
    return daily


def since_day(daily: DataFrame, since) -> DataFrame:
    """Days of the stored daily table that can hold windows from ``since`` on;
    the filter is on the partition column, so other folders are not read."""
    return daily.filter(F.col("day") >= F.lit(f"{since:%Y-%m-%d}").cast("date"))


def new_fingerprints(current: DataFrame, history: DataFrame, since: Column) -> DataFrame:
    """Incidents whose fingerprint the history has not seen since ``since``."""
    seen = history.filter(F.col("last_seen") >= since).select("host", "fingerprint")
    return current.join(seen, ["host", "fingerprint"], "left_anti")


def sightings(logs: DataFrame, bucket: str, profile=DEFAULT_PROFILE) -> DataFrame:
    """First and last sight of each incident per time bucket, and the first
    critical one. All measures have fixed width, so a template that holds a
    third of all records is combined map-side."""
    critical = F.when(F.col("level") == "critical", F.col("event_time"))
    return (
        with_template(logs, profile)
        .groupBy(*INCIDENT_KEY, F.date_trunc(bucket, "event_time").cast("timestamp_ntz").alias("bucket"))
        .agg(
            F.min("event_time").alias("first_seen"),
            F.max("event_time").alias("last_seen"),
            F.min(critical).alias("first_critical"),
        )
    )


def new_criticals(logs: DataFrame, quiet: timedelta = QUIET, profile=DEFAULT_PROFILE) -> DataFrame:
    """Critical records whose fingerprint had no record for longer than
    ``quiet`` before, or never.

    A gap longer than ``quiet`` can only lie between two day buckets, so the
    comparison runs on one row per fingerprint and day and gives the same
    answer as one over all records.
    """
    if quiet < timedelta(days=1):
        raise ValueError("quiet must be at least one day")
    order = Window.partitionBy(*INCIDENT_KEY).orderBy("bucket")
    gap = F.col("first_seen") - F.col("previous_seen")
    return (
        sightings(logs, "day", profile)
        .withColumn("previous_seen", F.lag("last_seen").over(order))
        .filter(F.col("first_critical") == F.col("first_seen"))
        .filter(F.col("previous_seen").isNull() | (gap > F.lit(quiet)))
        .select("host", "app", fingerprint().alias("fingerprint"),
                F.col("first_seen").alias("event_time"), "previous_seen")
    )


def retained(df: DataFrame, now: Column, days: int, column: str = "last_seen") -> DataFrame:
    """Rows still within the retention period; use it on the partition column
    of dated tables to drop whole days."""
    return df.filter(F.col(column) >= now - F.make_dt_interval(days=F.lit(days)))
