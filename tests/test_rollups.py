import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators.patterns import browse, daily_incidents
from emberlog.operators.search import TemplateIndex, grams_of
from emberlog.plans import metrics, rollups

T0 = datetime(2025, 5, 1, 6)


def test_quantiles_of_many_durations(spark):
    """Beyond what a sketch holds, ranks stay within the stated bound; tails
    that no fixed edge covers are as exact as the rest."""
    rng = random.Random(1)
    rows = [(T0 + timedelta(days=rng.randrange(12), seconds=k % 60_000), rng.lognormvariate(3, 3)) for k in range(120_000)]
    rows += [(T0 + timedelta(days=30), 9999.0), (T0 + timedelta(days=30), None)]
    sketches = metrics.latency_sketches(spark.createDataFrame(rows, "at timestamp, seconds double").withColumn("at", F.col("at").cast("timestamp_ntz")))
    bound = 2.3 / metrics.SKETCH_K**0.9
    for q in (0.5, 0.95, 0.999):
        got = {r["day"].date(): (r["cycles"], r["quantile"]) for r in metrics.sketched_quantile(sketches, q).collect()}
        assert len(got) == 13 and got[(T0 + timedelta(days=30)).date()] == (1, 9999.0)
        for day, (n, value) in got.items():
            last = sorted(v for t, v in rows if v is not None and day - timedelta(days=7) < t.date() <= day)
            assert n == len(last) and abs(sum(v <= value for v in last) / n - q) <= bound + 1 / n


def test_streams_over_many_days(spark, tmp_path):
    """The estimate of the merged sketches, against the exact count."""
    n = F.col("id")
    logs = spark.range(0, 200_000, numPartitions=8).select(
        (F.lit(T0.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(days=(n % 9).cast("int"))).alias("event_time"),
        F.when(n % 11 > 0, F.md5((n % 60_000).cast("string"))).otherwise("").alias("stream_id"), F.lit("").alias("stream"),
        F.concat(F.lit("kind "), F.chr(97 + n % 20), F.lit(" "), n).alias("msg"), F.when(n % 3 > 0, "big").otherwise("small").alias("host"),
        F.lit("a").alias("app"), F.lit("error").alias("level"), F.lit("").alias("module"), F.lit("").alias("job"),
    )
    path = str(tmp_path / "r")
    for _ in range(2):  # a day written twice counts once
        rollups.write_rollup(rollups.daily_rollup(logs), path)
    stored = spark.read.parquet(path)
    got = {r["host"]: (r["records"], r["streams"]) for r in rollups.records_and_streams(stored, "host").collect()}
    for r in logs.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct(F.nullif("stream_id", F.lit(""))).alias("s")).collect():
        assert got[r["host"]][0] == r["n"] and abs(got[r["host"]][1] - r["s"]) <= 0.03 * r["s"]
    plan = rollups.records_and_streams(stored.filter("day >= '2025-05-05'"), "host")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "templates" not in plan.split("ReadSchema")[1]


def test_new_templates(spark, make_logs):
    kinds = {0: "abc", 1: "bcd", 2: "", 3: "az"}
    logs = make_logs([
        {"event_time": T0 + timedelta(days=d), "host": h, "app": "x", "msg": f"kind {k} 17"}
        for d, ks in kinds.items() for k in ks for h in ("h", "g") if h == "h" or k != "a"
    ])
    rows = rollups.templates_per_day(rollups.daily_rollup(logs), "host").collect()
    first = min(r["window_start"] for r in rows)
    got = {(r["host"], (r["window_start"] - first).days): (r["templates"], r["new_templates"]) for r in rows}
    assert got == {("h", 0): (3, 3), ("h", 1): (3, 1), ("h", 3): (2, 1), ("g", 0): (2, 2), ("g", 1): (3, 1), ("g", 3): (1, 1)}


@pytest.fixture(scope="module")
def daily(spark, make_logs):
    rng = random.Random(5)
    words = ["order", "refused", "модуле", "a", "%", "_", "\\", "x*", "日本語", "ab", "aba", "İ", " "]
    rows = [{"event_time": T0 + timedelta(days=rng.randrange(6)), "host": f"h{rng.randrange(2)}", "app": "a",
             "msg": rng.choice([" ", ""]).join(rng.choices(words, k=rng.randrange(0, 6)))} for _ in range(500)]
    return daily_incidents(make_logs(rows)).persist()


def test_search_equals_contains(spark, daily, tmp_path):
    index = TemplateIndex(spark, str(tmp_path / "i"))
    assert index.templates("abc").count() == 0
    middle = daily.agg(F.min("window_start") + F.expr("INTERVAL 2 DAYS")).first()[0]
    cut = F.lit(str(middle)).cast("timestamp_ntz")
    index.update(daily.filter(F.col("window_start") <= cut))
    index.update(daily.filter(F.col("window_start") >= cut))  # one day comes again
    assert grams_of("abab") == ["aba", "bab"] and grams_of("ab") == []
    since = middle + timedelta(days=1)
    for text in ("", "a", "ab", "aba", "order ref", "модуле", "%_", "\\x*", "語", "İ a", "refusedorder", "nothing like it", "  "):
        for s in (None, since):
            got, want = index.search(text, s), browse(daily, pattern=text, since=s)
            columns = ["window_start", "host", "fingerprint", "cnt", "normalized_msg"]
            assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect())), text


def test_search_prunes(spark, daily, tmp_path):
    index = TemplateIndex(spark, str(tmp_path / "i"))
    index.update(daily)
    text = index.templates("refused")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in text and "In(gram" in text.replace(" ", "")
    assert "PartitionFilters: [" in index.search("refused")._jdf.queryExecution().toString()


def test_interrupted_update_of_the_index(spark, daily, tmp_path, monkeypatch):
    """Lists that were written twice find what they find once."""
    index = TemplateIndex(spark, str(tmp_path / "i"))
    index.update(daily)
    index.folder.remove("templates")
    index.update(daily)
    want = daily.filter("contains(normalized_msg, 'refused')").count()
    assert index.search("refused").count() == want > 0
