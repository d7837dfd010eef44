"""A store of log records that selections can skip through.

Records lie in folders by UTC day and host. Within them they are sorted by
level and time, so that the statistics of row groups tell levels and times
apart, and the files carry Bloom filters for stream ids and applications, which
the sort scatters. A selection reads the folders of its days and hosts, of
these the row groups whose statistics allow its levels and window, and of these
the ones whose filters may hold its stream or application.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.windows import Window, timestamp, utc_naive
from emberlog.operators.filters import by_hosts, by_levels, in_window
from emberlog.schema import LOG_SCHEMA
from emberlog.sources.files import Folder

#: columns looked up by value
LOOKED_UP = ("stream_id", "app")
#: bytes of a row group: small enough that skipping pays, large enough to scan
ROW_GROUP = 32 << 20

_NONE = "__HIVE_DEFAULT_PARTITION__"
_STORED = T.StructType([*[f for f in LOG_SCHEMA if f.name != "host"], T.StructField("day", T.DateType()), T.StructField("host", T.StringType())])


def write_records(logs: DataFrame, path: str, row_group: int = ROW_GROUP, distinct: int | None = None) -> None:
    """Put records in place of those of the same days. Records without a time
    have a folder of their own.

    The rows are dealt by range over (day, host, level, time): a host with a
    third of all records spans many tasks and files, a small one shares a task
    with its neighbours. ``distinct`` is about how many different streams a row
    group holds, where that is known.
    """
    rows = logs.select(*LOG_SCHEMA.fieldNames(), F.to_date("event_time").alias("day"))
    order = ("day", "host", "level", "event_time")
    writer = (
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", row_group)
    )
    for column in LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        if distinct:
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", distinct)
    writer.partitionBy("day", "host").parquet(path)


class RecordStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def _rows(self) -> DataFrame:
        # with the types given, a host "007" stays a text
        return self.spark.read.schema(_STORED).parquet(self.folder.path)

    @staticmethod
    def _records(rows: DataFrame) -> DataFrame:
        """In the shape of all records; the folder of no name is that of ''."""
        return rows.withColumn("host", F.coalesce("host", F.lit(""))).select(*LOG_SCHEMA.fieldNames())

    def records(self) -> DataFrame:
        return self._records(self._rows())

    def select(
        self, window: Window, hosts: tuple[str, ...] = (), levels: tuple[str, ...] = (),
        stream_id: str | None = None, app: str | None = None,
    ) -> DataFrame:
        """Records of a window, of some hosts, levels, a stream, an application."""
        days = [F.lit(f"{t:%Y-%m-%d}").cast("date") for t in (window.start, window.end)]
        rows = self._rows().filter(F.col("day").between(*days))
        if hosts:
            named = by_hosts(rows, [h for h in hosts if h])
            rows = named if "" not in hosts else rows.filter(F.col("host").isNull() | F.col("host").isin(list(hosts)))
        rows = in_window(by_levels(rows, levels), window)
        for column, value in (("stream_id", stream_id), ("app", app)):
            if value is not None:
                rows = rows.filter(F.col(column) == value)
        return self._records(rows)

    def newest_folders(self, now: datetime) -> dict[str, str]:
        """The newest day folder of every host up to ``now``, from the names of
        the folders alone."""
        found: dict[str, str] = {}
        last = f"day={utc_naive(now):%Y-%m-%d}"
        for day in sorted((n for n in self.folder.names() if n.startswith("day=2") and n <= last), reverse=True):
            for host in self.folder.names(day):
                if host.startswith("host="):
                    found.setdefault(host.partition("=")[2], day)
        return found

    def freshness(self, now: datetime, within: timedelta = timedelta(hours=1)) -> DataFrame:
        """(host, last_seen, recent_records, is_fresh): the last record of each
        host up to ``now``, and the records of the time just before.

        Only times are read, of one day of a host, and of today's and
        yesterday's folders where the period begins before midnight. A host
        whose newest folder has no record up to ``now`` is looked up in all."""
        now = utc_naive(now)
        newest = self.newest_folders(now)
        # (folder, host): few names, which the planner turns into partition filters
        by_day: dict[str, list[str]] = {}
        for host, day in newest.items():
            by_day.setdefault(day.partition("=")[2], []).append(unquote(host))
        rows = self._rows().select("day", F.coalesce("host", F.lit("")).alias("host"), "event_time").filter(F.col("event_time") <= timestamp(now))
        wanted = F.lit(False)
        for day, hosts in by_day.items():
            names = [h for h in hosts if h != _NONE]
            one = F.col("host").isin(names) | (F.lit(_NONE in hosts) & (F.col("host") == ""))
            wanted = wanted | ((F.col("day") == F.lit(day).cast("date")) & one)
        recent = F.col("day").between(*[F.lit(f"{t:%Y-%m-%d}").cast("date") for t in (now - within, now)])
        since = timestamp(now - within)

        def seen(of: DataFrame) -> DataFrame:
            return of.groupBy("host").agg(
                F.max("event_time").alias("last_seen"), F.count_if(F.col("event_time") >= since).alias("recent_records")
            )

        first = seen(rows.filter(wanted | recent))
        # today's folder may hold nothing but records of the hours to come
        known = {r["host"] for r in first.select("host").collect()}
        late = [h for hosts in by_day.values() for h in ("" if x == _NONE else x for x in hosts) if h not in known]
        if late:
            first = first.union(seen(rows.filter(F.col("host").isin(late))))
        return first.withColumn("is_fresh", F.col("recent_records") > 0)
