"""Throttled alerts: at most one per fingerprint and gap, by joins alone.

The rule is sequential: each alert is followed by the first record at least a
gap later. But that successor is a function of the moment, so all successors
are found at once, and the alerts are what the first moments reach over them;
pointer doubling follows chains of any length in a logarithm of joins.

Time is cut into slots of one gap. The successor of a moment lies in the next
slot or is the first moment of a later one, so a task sees one slot of a
fingerprint at a time; only one row per slot takes part where a fingerprint is
looked at as a whole.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.fingerprint import fingerprint
from emberlog.functions.normalize import DEFAULT_PROFILE
from emberlog.operators.incidents import with_template
from emberlog.schema import INCIDENT_KEY
from emberlog.session import stage

# Fixed value.
THROTTLE = timedelta(minutes=10)

KEY = ["host", "app", "fingerprint"]


def moments(logs: DataFrame, profile=DEFAULT_PROFILE) -> DataFrame:
    """(host, app, fingerprint, us, records): one row per distinct time."""
    return (
        with_template(logs.filter(F.col("event_time").isNotNull()), profile)
        .groupBy(*INCIDENT_KEY, F.unix_micros(F.col("event_time").cast("timestamp")).alias("us"))
        .agg(F.count("*").alias("records"))
        .select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "app")], fingerprint().alias("fingerprint"), "us", "records")
    )


def _slot(us: str, gap_us: int) -> Column:
    return F.expr(f"({us} - pmod({us}, {gap_us})) div {gap_us}")


def successors(times: DataFrame, gap_us: int) -> DataFrame:
    """(key, us, next, starts): for every moment the first one at least
    ``gap_us`` later, and whether it comes after a silence of that length."""
    order = Window.partitionBy(*KEY).orderBy("slot")
    slots = (
        times.groupBy(*KEY, "slot").agg(F.min("us").alias("first"), F.max("us").alias("last"))
        .withColumns({
            "next_slot": F.lead("slot").over(order), "next_first": F.lead("first").over(order),
            "later_first": F.lead("first", 2).over(order), "before": F.lag("last").over(order),
        })
    )
    # what each moment asks for, among the moments of the following slot; from
    # the latest to the earliest, so that the running minimum is the answer
    asked = times.select(*KEY, (F.col("slot") + 1).alias("slot"), (F.col("us") + gap_us).alias("at"), F.col("us").alias("of"))
    there = times.select(*KEY, "slot", F.col("us").alias("at"), F.lit(None).cast("long").alias("of"))
    down = Window.partitionBy(*KEY, "slot").orderBy(F.desc("at"), F.col("of").asc_nulls_first())
    found = F.min(F.when(F.col("of").isNull(), F.col("at"))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    answers = (
        asked.union(there).withColumn("found", found).filter(F.col("of").isNotNull())
        .select(*KEY, (F.col("slot") - 1).alias("slot"), F.col("of").alias("us"), "found")
    )
    beyond = F.when(F.col("next_slot") == F.col("slot") + 1, F.col("later_first")).otherwise(F.col("next_first"))
    silence = F.col("before").isNull() | (F.col("first") - F.col("before") >= gap_us)
    return answers.join(slots, [*KEY, "slot"]).select(
        *KEY, "us", F.coalesce("found", beyond).alias("next"), ((F.col("us") == F.col("first")) & silence).alias("starts")
    )


def reached(pointers: DataFrame) -> DataFrame:
    """Moments (key, us) reached over the pointers from those that start.

    After each round twice as much of every chain is known: its known part
    jumps ahead by its own length, and the jumps are joined with themselves."""
    pointers = stage(pointers)
    known = pointers.filter("starts").select(*KEY, "us")
    # a pointer to a moment that starts on its own leads nowhere new
    begins = known.withColumnRenamed("us", "next")
    jump = stage(pointers.filter("next IS NOT NULL").select(*KEY, "us", "next").join(begins, [*KEY, "next"], "left_anti"))
    while not jump.isEmpty():
        new = stage(known.join(jump, [*KEY, "us"]).select(*KEY, F.col("next").alias("us")))
        if new.isEmpty():
            break
        known = known.union(new)
        onward = jump.select(*KEY, F.col("us").alias("next"), F.col("next").alias("after"))
        jump = stage(jump.join(onward, [*KEY, "next"]).select(*KEY, "us", F.col("after").alias("next")))
    return known


def throttle_moments(found: DataFrame, gap: timedelta = THROTTLE) -> DataFrame:
    """(key, us, records): the alerts among ``found`` (key, us, records), with
    the records up to the next one."""
    gap_us = max(1, gap // timedelta(microseconds=1))
    times = stage(found.withColumn("slot", _slot("us", gap_us)))
    alerts = stage(reached(successors(times.select(*KEY, "us", "slot"), gap_us)))
    # a slot holds one alert at most; what comes before it belongs to the last one of an earlier slot
    raised = alerts.withColumn("slot", _slot("us", gap_us)).withColumnRenamed("us", "alert")
    slots = times.select(*KEY, "slot").distinct().join(raised, [*KEY, "slot"], "left")
    order = Window.partitionBy(*KEY).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("earlier", F.last("alert", ignorenulls=True).over(order))
    own = F.when(F.col("us") >= F.col("alert"), F.col("alert")).otherwise(F.col("earlier"))
    return (
        times.join(slots, [*KEY, "slot"]).select(*KEY, own.alias("us"), "records")
        .groupBy(*KEY, "us").agg(F.sum("records").alias("records"))
    )


def throttle_alerts(
    logs: DataFrame, gap: timedelta = THROTTLE, level: str = "critical", profile=DEFAULT_PROFILE
) -> DataFrame:
    """At most one alert per fingerprint and ``gap``: the first record of
    ``level`` raises one, and the next is raised by the first record at least
    ``gap`` after it. Records without a time raise none; a gap of zero lets
    every moment raise one."""
    alerts = throttle_moments(moments(logs.filter(F.col("level") == level), profile), gap)
    return alerts.select(*KEY, F.timestamp_micros("us").cast("timestamp_ntz").alias("alert_at"), "records")
