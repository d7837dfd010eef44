"""Ranking, top-N and caps that do not depend on how large a group is."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.schema import NOISE_K, TOP_N
from emberlog.session import stage

# Order of incidents within a host; total, since a fingerprint is unique.
INCIDENT_ORDER = ("-cnt", "first_seen", "fingerprint")
# Parts into which the rows of a group are dealt before its first rows are chosen.
_PARTS = 32


def order_columns(order) -> list[Column]:
    """Names to sort keys; a leading minus means descending."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def ranked(df: DataFrame, group, order, name: str = "rank") -> DataFrame:
    """Exact ``row_number`` per group, also where one group holds most rows.

    Rows are range-partitioned by (group, order), so a large group spans many
    tasks. Each slice is numbered on its own and shifted by the rows its group
    has in earlier slices. The slices are written before they are counted:
    both uses then see the same split. ``order`` should be total.
    """
    group, keys = list(group), order_columns(order)
    sliced = stage(
        df.repartitionByRange(*[F.col(g) for g in group], *keys).withColumn("_slice", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_slice").alias("_of"), "_before")
    )
    # null is a group like any other
    same = reduce(and_, [sliced[g].eqNullSafe(offsets[f"_of_{g}"]) for g in group], sliced["_slice"] == offsets["_of"])
    within = Window.partitionBy(*group, "_slice").orderBy(*keys)
    return (
        sliced.withColumn("_row", F.row_number().over(within))
        .join(offsets, same)
        .withColumn(name, F.col("_row") + F.col("_before"))
        .drop("_row", "_before", "_slice", "_of", *[f"_of_{g}" for g in group])
    )


def top_n(df: DataFrame, group, order, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; null is a group.

    The rows of a group are dealt into parts by hash and every part keeps its
    first ``n``, so that the last step sees at most ``n`` rows per part,
    however large the group is and whatever ``n`` is.
    """
    keys = order_columns(order)
    part = F.pmod(F.xxhash64(*[c.lstrip("-") for c in order]), F.lit(_PARTS))
    dealt = df.withColumn("_part", part)
    inside = Window.partitionBy(*group, "_part").orderBy(*keys)
    first = dealt.withColumn("_no", F.row_number().over(inside)).filter(F.col("_no") <= n).drop("_no", "_part")
    w = Window.partitionBy(*group).orderBy(*keys)
    return first.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def incident_rank(incidents: DataFrame) -> DataFrame:
    """All incidents of each host, numbered by count, first sight, fingerprint."""
    return ranked(incidents, ["host"], INCIDENT_ORDER)


def top_incidents(incidents: DataFrame, k: int = NOISE_K, n: int = TOP_N) -> DataFrame:
    """The numbered report list: the first ``n`` incidents with count >= ``k``."""
    return top_n(incidents.filter(F.col("cnt") >= max(1, k)), ["host"], INCIDENT_ORDER, max(1, n))


def incident_sections(incidents: DataFrame, k: int = NOISE_K, n: int = TOP_N) -> DataFrame:
    """Every incident with its section: ``top``, ``overflow`` (count >= k but
    beyond the list) or ``below`` the noise threshold.

    The list is at most ``n`` rows per host and is joined back, so a host's
    incidents are never gathered in one task. ``incidents`` is read twice:
    pass a staged table.
    """
    top = top_incidents(incidents, k, n).select("host", "fingerprint", "rank")
    section = (
        F.when(F.col("cnt") < max(1, k), "below").when(F.col("rank").isNotNull(), "top").otherwise("overflow")
    )
    return incidents.join(top, ["host", "fingerprint"], "left").withColumn("section", section)


def host_cap(logs: DataFrame, cap: int, ties=("msg", "stream_id", "app", "level", "module")) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` records of each host by time, and a per-host summary
    (total, kept, is_cut) so that a cut is always visible. Records without a
    time come last; records without a host are a host of their own.

    A count per host and second finds the second in which the cap is reached;
    earlier records pass through a plain filter without a shuffle and only
    the records of that second are ranked.
    """
    last = (1 << 62)  # the second of records without a time
    second = F.coalesce(F.unix_seconds(F.col("event_time").cast("timestamp")), F.lit(last))
    per_second = logs.groupBy("host", second.alias("second")).agg(F.count("*").alias("rows"))
    running = Window.partitionBy("host").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    upto = per_second.withColumn("upto", F.sum("rows").over(running))
    # one row per host
    edge = stage(
        upto.groupBy("host").agg(
            F.sum("rows").alias("total"),
            F.min(F.when(F.col("upto") > cap, F.col("second"))).alias("edge"),
            F.coalesce(F.max(F.when(F.col("upto") <= cap, F.col("upto"))), F.lit(0)).alias("before_edge"),
        )
    )
    numbered = logs.withColumn("_second", second)
    of = edge.select(F.col("host").alias("_host"), "edge", "before_edge")
    tagged = numbered.join(of, numbered["host"].eqNullSafe(of["_host"]))
    whole = tagged.filter(F.col("edge").isNull() | (F.col("_second") < F.col("edge")))
    at_edge = ranked(tagged.filter(F.col("_second") == F.col("edge")), ["host"], ["event_time", *ties], "_rank")
    part = at_edge.filter(F.col("_rank") <= cap - F.col("before_edge"))
    kept = whole.select(*logs.columns).unionByName(part.select(*logs.columns))
    summary = edge.select(
        "host", "total", F.least(F.col("total"), F.lit(cap)).alias("kept"), (F.col("total") > cap).alias("is_cut")
    )
    return kept, summary
