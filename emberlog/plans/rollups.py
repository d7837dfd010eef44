"""Daily rollups that hold sketches, so that questions over many days read a
row per day, host and application and no records.

* ``streams``: an HLL sketch of the stream ids. Below some 2 000 streams its
  estimate is exact but for rounding, above that the standard error is
  1.04 / sqrt(2 ** STREAM_BITS), 0.8 %.
* ``templates``: a theta sketch of the templates. Up to 2 ** TEMPLATE_BITS
  templates it holds all of them and sets built from it are exact; above that
  the standard error is 1 / sqrt(2 ** TEMPLATE_BITS), 0.8 % of the union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.normalize import DEFAULT_PROFILE
from emberlog.functions.windows import DEFAULT_ZONE, digest_bucket
from emberlog.operators.incidents import with_template
from emberlog.sources.sinks import write_daily

STREAM_BITS = 14
TEMPLATE_BITS = 14


def daily_rollup(logs: DataFrame, profile=DEFAULT_PROFILE, tz: str = DEFAULT_ZONE) -> DataFrame:
    """(window_start, host, app, records, streams, templates), in one pass.

    Equal templates of a stream are combined first, by a hash aggregation of
    fixed width; the sketches see what is left."""
    stream = F.when(F.col("stream_id") != "", F.col("stream_id"))
    reduced = (
        with_template(logs, profile)
        .groupBy(digest_bucket("event_time", tz).alias("window_start"), "host", "app", "normalized_msg", "stream_id")
        .agg(F.count("*").alias("records"))
    )
    return reduced.groupBy("window_start", "host", "app").agg(
        F.sum("records").alias("records"), F.hll_sketch_agg(stream, STREAM_BITS).alias("streams"),
        F.theta_sketch_agg("normalized_msg", TEMPLATE_BITS).alias("templates"),
    )


def write_rollup(rollup: DataFrame, path: str) -> None:
    """Into folders by day; a day that is written again is replaced."""
    write_daily(rollup, path)


def records_and_streams(rollup: DataFrame, *by: str) -> DataFrame:
    """Records and distinct streams of all days in the input, by host or
    application or in all."""
    return rollup.groupBy(*by).agg(
        F.sum("records").alias("records"), F.hll_sketch_estimate(F.hll_union_agg("streams")).alias("streams")
    )


def templates_per_day(rollup: DataFrame, *by: str) -> DataFrame:
    """Templates of each day, and those of them no earlier day in the input
    had, per value of ``by``: set differences of sketches."""
    daily = rollup.groupBy(*by, "window_start").agg(F.theta_union_agg("templates", TEMPLATE_BITS).alias("templates"))
    earlier = Window.partitionBy(*by).orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.theta_union_agg("templates", F.lit(TEMPLATE_BITS)).over(earlier)
    size = F.theta_sketch_estimate("templates")
    # the first day has none before it
    known = F.count("*").over(earlier) > 0
    return daily.withColumns({"_before": before, "_known": known}).select(
        *by, "window_start", size.alias("templates"),
        F.when(F.col("_known"), F.theta_sketch_estimate(F.theta_difference("templates", "_before"))).otherwise(size).alias("new_templates"),
    )
