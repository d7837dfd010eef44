"""Incident aggregation.

An incident is the set of records with one (host, app, normalised message).
The aggregation runs in two steps. The first groups by the incident key plus
the low-cardinality columns and keeps only fixed-width measures, so it is a
hash aggregation with map-side combine: a template that holds a third of all
records leaves each map task as a handful of rows. The second step works on
that reduced table and may use wider measures. The fingerprint is a function
of the key, so it is computed once per incident and not once per record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.fingerprint import fingerprint, level_rank
from emberlog.functions.normalize import DEFAULT_PROFILE, normalize
from emberlog.schema import INCIDENT_KEY, MAX_EXAMPLES


def with_template(logs: DataFrame, profile=DEFAULT_PROFILE) -> DataFrame:
    # Never null, so a join on the template needs no null filter, which would
    # run the rules a second time.
    return logs.withColumn("normalized_msg", F.coalesce(normalize("msg", profile), F.lit("")))


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint())


def _order_of_arrival(*ties: str):
    """Sort key: earliest first, records without a time last, then ``ties``."""
    return [F.col("first_seen").isNull(), F.col("first_seen"), *[F.col(c) for c in ties]]


def incidents(
    logs: DataFrame, profile=DEFAULT_PROFILE, extra_key: tuple[str, ...] = (),
    approx_streams: bool = False, level_counts: tuple[str, ...] = (), examples_for: int = 0,
) -> DataFrame:
    """One row per incident (and per value of ``extra_key``, such as a day).

    * level: the highest rank seen; of equal ranks the earliest;
    * module: that of the earliest record, even if empty;
    * streams: distinct non-empty stream ids, exact unless ``approx_streams``,
      which sends a sketch instead of a row per stream;
    * ``level_counts`` adds the records of each named level as ``n_<level>``,
      from which totals by record level follow without another pass;
    * ``examples_for`` adds ``examples_until``, a time by which that many
      distinct messages were seen, or null if that is not certain. Messages
      are split by hash into a few buckets; messages of different buckets
      differ, so the n-th of the buckets' first times is such a time.
    """
    key = [*extra_key, *INCIDENT_KEY]
    buckets = [f"_b{i}" for i in range(2 * examples_for + 2)] if examples_for else []
    stream = F.when(F.col("stream_id") != "", F.col("stream_id"))
    records = with_template(logs, profile)
    if buckets:
        records = records.withColumn("_bucket", F.pmod(F.xxhash64("msg"), F.lit(len(buckets))))
    reduced = (
        records
        .groupBy(*key, "level", "module", *([] if approx_streams else ["stream_id"]))
        .agg(
            F.count("*").alias("cnt"),
            F.min("event_time").alias("first_seen"),
            F.max("event_time").alias("last_seen"),
            *[F.min(F.when(F.col("_bucket") == i, F.col("event_time"))).alias(b) for i, b in enumerate(buckets)],
            *([F.hll_sketch_agg(stream).alias("_streams")] if approx_streams else []),
        )
    )
    until = F.get(F.sort_array(F.array_compact(F.array(*buckets))), F.lit(examples_for - 1)) if buckets else None
    streams = F.hll_sketch_estimate(F.hll_union_agg("_streams")) if approx_streams else F.count_distinct(stream)
    return with_fingerprint(
        reduced.groupBy(*key).agg(
            F.sum("cnt").alias("cnt"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.min_by("level", F.struct(-level_rank(), *_order_of_arrival("level"))).alias("level"),
            F.min_by("module", F.struct(*_order_of_arrival("module"))).alias("module"),
            streams.alias("streams"),
            *[F.sum(F.when(F.col("level") == lv, F.col("cnt")).otherwise(0)).alias(f"n_{lv}") for lv in level_counts],
            *[F.min(b).alias(b) for b in buckets],
        )
    ).select(*extra_key, "host", "app", "fingerprint", "level", "module", "cnt", "first_seen", "last_seen",
             "streams", *[f"n_{lv}" for lv in level_counts],
             *([until.alias("examples_until")] if buckets else []), "normalized_msg")


def examples(
    logs: DataFrame, profile=DEFAULT_PROFILE, n: int = MAX_EXAMPLES, only: DataFrame | None = None
) -> DataFrame:
    """The first ``n`` distinct raw messages of each incident, one row each;
    with ``only``, for the incidents of that table. Where it has
    ``examples_until`` (for at least ``n``), later records cannot matter and
    are dropped before the shuffle.

    Repeats collapse map-side in a hash aggregation, then the planner limits
    each incident to ``n`` rows before the ranking shuffle, so no incident's
    messages are ever collected.
    """
    n = max(1, n)
    records = with_template(logs, profile)
    if only is not None and "examples_until" in only.columns:
        records = records.join(only.select(*INCIDENT_KEY, "examples_until"), list(INCIDENT_KEY)).filter(
            F.col("examples_until").isNull() | (F.col("event_time") <= F.col("examples_until"))
        )
    elif only is not None:
        records = records.join(only.select(*INCIDENT_KEY), list(INCIDENT_KEY), "left_semi")
    firsts = records.groupBy(*INCIDENT_KEY, "msg").agg(
        F.min("event_time").alias("first_seen")
    )
    order = Window.partitionBy(*INCIDENT_KEY).orderBy(*_order_of_arrival("msg"))
    return with_fingerprint(
        firsts.withColumn("example_no", F.row_number().over(order)).filter(F.col("example_no") <= n)
    ).select("host", "fingerprint", F.col("example_no").cast("long").alias("example_no"), "first_seen", "msg")


def incident_levels(logs: DataFrame, profile=DEFAULT_PROFILE) -> DataFrame:
    """Record count per incident and level."""
    return with_fingerprint(
        with_template(logs, profile).groupBy(*INCIDENT_KEY, "level").agg(F.count("*").alias("cnt"))
    ).select("host", "app", "fingerprint", "level", "cnt")


def incident_level_map(logs: DataFrame, profile=DEFAULT_PROFILE) -> DataFrame:
    """As ``incident_levels``, as one map per incident."""
    return incident_levels(logs, profile).groupBy("host", "app", "fingerprint").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "cnt")))).alias("levels")
    )
