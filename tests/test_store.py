from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions.windows import Window
from emberlog.operators import stats
from emberlog.sources.store import RecordStore, write_records

T0 = datetime(2025, 5, 1)
LEVELS = ("critical", "debug", "error", "info", "warn")


@pytest.fixture(scope="module")
def logs(spark):
    """Four days, five hosts, five levels; half of all records of one host."""
    n = F.col("id")
    host = F.when(n % 2 == 0, "hot").otherwise(F.element_at(F.array(*[F.lit(h) for h in ("007", "a/b=c", "", "h4")]), (n % 4 + 1).cast("int")))
    return spark.range(0, 40_000, numPartitions=6).select(
        (F.lit(T0.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(secs=n * 8)).alias("event_time"),
        F.md5((n % 997).cast("string")).alias("stream_id"), F.lit("").alias("stream"), F.concat(F.lit("m"), n).alias("msg"),
        host.alias("host"), F.concat(F.lit("app"), (n % 7).cast("string")).alias("app"),
        F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.pmod(F.xxhash64(n), F.lit(5)) + 1).cast("int")).alias("level"),
        F.lit("").alias("module"), F.lit("").alias("job"),
    )


@pytest.fixture(scope="module")
def store(spark, logs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "records")
    write_records(logs, path, row_group=32 << 10)
    return RecordStore(spark, path)


def scanned(df):
    """Files and rows that the scan of a query has read."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.select(*df.columns)
        jdf = rows._jdf
        n = jdf.count() if False else len(rows.collect())
        leaf = jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return n, leaf.metrics().apply("numFiles").value(), leaf.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_nothing_is_lost(store, logs):
    assert store.records().exceptAll(logs).count() == 0 and store.records().count() == 40_000


@pytest.mark.parametrize("hosts", [("hot",), ("007", "a/b=c"), ("", "h4"), ()])
def test_selection(store, logs, hosts):
    w = Window(T0 + timedelta(hours=20), T0 + timedelta(hours=51))
    want = logs.filter((F.col("event_time") >= F.lit(str(w.start)).cast("timestamp_ntz")) & (F.col("event_time") < F.lit(str(w.end)).cast("timestamp_ntz")))
    want = want.filter(F.col("host").isin(list(hosts))) if hosts else want
    got = store.select(w, hosts, ("error", "critical"))
    want = want.filter("level in ('error', 'critical')")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_folders_and_row_groups_are_skipped(store):
    whole, files, rows = scanned(store.records())
    assert whole == rows == 40_000
    day = Window(T0 + timedelta(days=1), T0 + timedelta(days=1, hours=23))
    n, some, read = scanned(store.select(day, ("h4",)))
    assert 0 < n <= read <= 10_800 // 4 and some < files / 8  # one of four days, one of five hosts
    n, _, level = scanned(store.select(day, ("hot",), ("error",)))
    assert 0 < n <= level < 5400 / 2  # sorted by level: the groups of others are not read
    n, _, stream = scanned(store.select(Window(T0, T0 + timedelta(days=5)), stream_id="no such stream"))
    assert n == 0 and stream < 4000  # the filters of the files rule the rest out
    assert scanned(store.select(Window(T0, T0 + timedelta(days=5)), app="app99"))[2] < 4000


def test_a_day_is_replaced(spark, logs, tmp_path):
    path = str(tmp_path / "r")
    write_records(logs, path)
    first = logs.filter("event_time < timestamp_ntz'2025-05-02 00:00:00' and host = 'hot'")
    write_records(first.union(first), path)
    days = {r["d"]: r["n"] for r in RecordStore(spark, path).records().groupBy(F.to_date("event_time").cast("string").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert days["2025-05-02"] == 10_800 and RecordStore(spark, path).select(Window(T0, T0 + timedelta(days=1)), ("hot",)).count() == 2 * first.count()


@pytest.mark.parametrize("now", [T0 + timedelta(days=2, minutes=30), T0 + timedelta(days=3, hours=5), T0 + timedelta(days=9), T0 - timedelta(days=1)])
def test_freshness_equals_that_of_all_records(store, logs, now):
    got = {tuple(r) for r in store.freshness(now).collect()}
    assert got == {tuple(r) for r in stats.source_freshness(logs, now).collect()}


def test_freshness_reads_newest_folders(store, spark, make_logs, tmp_path):
    assert scanned(store.freshness(T0 + timedelta(days=9)))[2] < 10_000
    # a host whose newest folder lies wholly after the moment
    path = str(tmp_path / "r")
    rows = make_logs([{"event_time": T0 + timedelta(hours=h), "host": "x", "msg": "m"} for h in (1, 30)] + [{"host": "x", "msg": "no time"}])
    write_records(rows, path)
    got = RecordStore(spark, path).freshness(T0 + timedelta(hours=25)).collect()
    assert [tuple(r) for r in got] == [("x", T0 + timedelta(hours=1), 0, False)]
