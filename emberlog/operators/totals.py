"""Totals per app, host and digest. All work on map-side combined sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.ranking import INCIDENT_ORDER, order_columns, top_n
from emberlog.schema import NOISE_K


def _sum_if(condition, value: str = "cnt"):
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))


def app_totals(incidents: DataFrame) -> DataFrame:
    """Records per app by the level of their incident (the highest one seen)."""
    return incidents.groupBy("host", "app").agg(
        _sum_if(F.col("level") == "error").alias("error"),
        _sum_if(F.col("level") == "critical").alias("critical"),
        F.sum("cnt").alias("total"),
    )


def host_totals(logs: DataFrame) -> DataFrame:
    """Records per host by their own level."""
    return logs.groupBy("host").agg(
        F.count_if(F.col("level") == "error").alias("error"),
        F.count_if(F.col("level") == "critical").alias("critical"),
        F.count("*").alias("total"),
    )


def host_summary(incidents: DataFrame, k: int = NOISE_K) -> DataFrame:
    """All per-host numbers of a report in one aggregation over incidents with
    level counts."""
    below = F.col("cnt") < max(1, k)
    return incidents.groupBy("host").agg(
        F.sum("n_error").alias("error"),
        F.sum("n_critical").alias("critical"),
        F.sum("cnt").alias("total"),
        F.count("*").alias("incidents"),
        F.count_if(~below).alias("above"),
        F.count_if(below).alias("below"),
        _sum_if(below).alias("below_records"),
    )


def noise_summary(incidents: DataFrame, k: int = NOISE_K) -> DataFrame:
    below = F.col("cnt") < max(1, k)
    return incidents.groupBy("host").agg(
        F.sum("cnt").alias("records"),
        F.count("*").alias("incidents"),
        F.count_if(~below).alias("above"),
        F.count_if(below).alias("below"),
        _sum_if(below).alias("below_records"),
    )


def dedup_ratio(incidents: DataFrame) -> DataFrame:
    """Records per incident of each host."""
    return (
        incidents.groupBy("host")
        .agg(F.sum("cnt").alias("records"), F.count("*").alias("incidents"))
        .withColumn("ratio", F.col("records") / F.greatest(F.lit(1), F.col("incidents")))
    )


def hosts(logs: DataFrame) -> DataFrame:
    return logs.select("host").distinct().orderBy("host")


def cover_totals(host_rows: DataFrame) -> DataFrame:
    """Per-host rows and a grand total (host ``*``) in one pass; the input
    holds the hosts whose report succeeded."""
    return (
        host_rows.rollup("host")
        .agg(*[F.sum(c).alias(c) for c in ("error", "critical", "incidents")])
        .withColumn("host", F.coalesce("host", F.lit("*")))
    )


def top_app_per_host(apps: DataFrame) -> DataFrame:
    return top_n(apps, ["host"], ["-total", "app"], 1).drop("rank")


def app_share(apps: DataFrame) -> DataFrame:
    """Percentage of each app in its host's records. The host sums are a
    small table joined back, so no host is gathered in one task."""
    of_host = apps.groupBy("host").agg(F.sum("total").alias("host_total"))
    return apps.join(of_host, "host").withColumn("share", F.col("total") * 100.0 / F.col("host_total"))


def top_pattern_others(incidents: DataFrame) -> DataFrame:
    """Largest incident of each host and the records of all others, in one
    aggregation: the parts always add up to the total."""
    first = F.min_by(
        F.struct("fingerprint", "app", "normalized_msg", "cnt"),
        F.struct(*[-F.col(c[1:]) if c.startswith("-") else F.col(c) for c in INCIDENT_ORDER]),
    )
    return (
        incidents.groupBy("host")
        .agg(first.alias("top"), F.sum("cnt").alias("total"), F.count("*").alias("incidents"))
        .select(
            "host", F.col("top.fingerprint").alias("fingerprint"), F.col("top.app").alias("app"),
            F.col("top.normalized_msg").alias("pattern"), F.col("top.cnt").alias("pattern_records"),
            (F.col("total") - F.col("top.cnt")).alias("other_records"),
            (F.col("incidents") - 1).alias("other_incidents"), "total",
        )
    )


def top_apps(logs: DataFrame, n: int = 20) -> DataFrame:
    """Apps with most records."""
    return logs.groupBy("app").agg(F.count("*").alias("rows")).orderBy(*order_columns(["-rows", "app"])).limit(n)


def host_list(spark: SparkSession, names) -> DataFrame:
    """The configured hosts, in order."""
    return spark.createDataFrame(list(enumerate(names, 1)), "host_no int, host string")


def zero_filled(configured: DataFrame, stats: DataFrame, counts=("error", "critical", "total")) -> DataFrame:
    """A row for every configured host, with zeros where nothing was seen."""
    return configured.join(stats, "host", "left").select(
        *[c for c in configured.columns],
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in counts else F.col(c)
          for c in stats.columns if c != "host"],
    )


def with_labels(hosts_df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Display label of each host; '' where none is configured. The planner
    knows the size of the literal table and broadcasts it only while small."""
    spark = hosts_df.sparkSession
    table = spark.createDataFrame(sorted(labels.items()), "host string, label string")
    return hosts_df.join(table, "host", "left").withColumn("label", F.coalesce("label", F.lit("")))
