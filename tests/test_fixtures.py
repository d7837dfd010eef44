"""The log shapes a digest meets, generated by Spark with fixed rules."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions.links import LinkTarget
from emberlog.functions.normalize import EXTENDED_PROFILE
from emberlog.functions.windows import Window
from emberlog.operators import filters, incidents as inc, patterns as pat, ranking, totals
from emberlog.plans.digest import DigestConfig, build_digest
from emberlog.schema import LOG_SCHEMA
from emberlog.sources import jsonl
from emberlog.streaming.ingest import incident_counts

T0 = datetime(2025, 5, 1)


def generated(spark, n, host="f1", app="app", level="error", msg="x", step_s=1):
    """``n`` records; text columns are SQL expressions over ``id``."""
    def text(e):
        return F.expr(e) if any(c in e for c in "(%'") else F.lit(e)

    start = F.lit(T0.isoformat(sep=" ")).cast("timestamp_ntz")
    values = {"host": text(host), "app": text(app), "level": text(level), "msg": text(msg),
              "stream_id": F.md5((F.col("id") % 7).cast("string"))}
    return spark.range(n).select(
        (start + F.make_dt_interval(secs=F.col("id") * step_s)).alias("event_time"),
        *[values.get(c, F.lit("")).alias(c) for c in LOG_SCHEMA.fieldNames()[1:]],
    )


def test_normal(spark):
    logs = generated(
        spark, 1000, app="concat('app', id % 5)", level="if(id % 10 = 0, 'critical', 'error')",
        msg="concat('step ', char(97 + cast((id div 5) % 4 as int)), ' took ', id, ' ticks')")
    incs = inc.incidents(logs)
    assert incs.count() == 20
    assert incs.agg(F.sum("cnt")).first()[0] == 1000
    row = totals.host_totals(logs).first()
    assert (row["error"], row["critical"]) == (900, 100)


def test_noisy(spark):
    logs = generated(
        spark, 100_000,
        msg="concat('at 2025-05-01T', lpad(id % 24, 2, '0'), ':00:00.', id, 'Z kind ', char(97 + cast(id % 10 as int)),"
            " ' from 10.0.', id % 256, '.1:', id, ' token ', md5(string(id)))")
    got = inc.incidents(logs).collect()
    assert len(got) == 10 and {r["cnt"] for r in got} == {10_000} and {r["streams"] for r in got} == {7}
    shown = inc.examples(logs).groupBy("fingerprint").count().collect()
    assert {r["count"] for r in shown} == {3}


def test_mixed_levels(spark):
    logs = generated(spark, 500, level="case when id % 50 = 0 then 'critical' when id % 50 < 10 then 'error' else 'warn' end")
    assert filters.by_levels(logs, ["error", "critical"]).count() == 100


def test_empty(spark):
    logs = generated(spark, 0)
    cfg = DigestConfig(("f1",), LinkTarget("https://x.example", 1, "u", "t"))
    digest = build_digest(logs, Window(T0, T0 + timedelta(days=1)), cfg, T0)
    assert "не обнаружено" in digest.reports.first()["body"]
    assert digest.incidents.count() == digest.top.count() == 0
    assert ranking.incident_rank(digest.incidents).count() == 0


def test_with_critical(spark):
    logs = generated(
        spark, 200, level="if(id < 100, 'critical', 'error')", step_s=60,
        msg="concat('fault ', char(97 + cast(id % 5 as int)))")
    assert pat.new_criticals(logs).count() == 5
    alerts = pat.throttle_alerts(logs, timedelta(minutes=10))
    # each of five templates has a critical record every five minutes for 100 minutes
    assert alerts.count() == 5 * 10
    assert alerts.agg(F.sum("records")).first()[0] == 100


def test_ids_collapse_with_the_extended_profile(spark):
    logs = generated(
        spark, 50,
        msg="concat('user', id, '@example.org order #', id, ' from [fe80::', hex(id), ']:', 1000 + id,"
            " ' id ', lower(hex(id + 2684354560)), ' file /var/log/', id, '.log')")
    assert inc.incidents(logs, EXTENDED_PROFILE).count() == 1
    assert inc.incidents(logs).count() > 1


def test_large_messages(spark):
    logs = generated(spark, 100, msg="concat(repeat('длинный текст ', 2000), id)")
    row = inc.incidents(logs).first()
    assert row["cnt"] == 100 and len(row["normalized_msg"]) > 10_000


def test_history_over_three_digests(spark, tmp_path):
    def day(n, kinds):
        logs = generated(spark, kinds, msg="concat('kind ', char(97 + cast(id as int)))")
        return inc.incidents(logs.withColumn("event_time", F.col("event_time") + F.make_dt_interval(days=F.lit(n))))

    stored = FingerprintHistory(spark, str(tmp_path / "history"))
    for n, kinds in ((0, 3), (1, 2), (2, 4)):
        stored.update(day(n, kinds), Window(T0 + timedelta(days=n - 1), T0 + timedelta(days=n)))
    history = stored.current()
    got = sorted((r["count_total"], r["count_last_24h"]) for r in history.collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 1)]
    since = F.lit((T0 + timedelta(days=1)).isoformat(sep=" ")).cast("timestamp_ntz")
    assert pat.new_fingerprints(day(3, 6), history, since).count() == 2


@pytest.mark.parametrize("damaged", [0, 5])
def test_stream_of_lines(spark, tmp_path, damaged):
    """JSON lines through the streaming reader give the batch counts."""
    lines = jsonl.as_jsonl(generated(spark, 3 * 3600, msg="concat('job ', id, ' lost')", step_s=2))
    lines.coalesce(2).write.text(str(tmp_path / "in"))
    (tmp_path / "in" / "bad.txt").write_text('{"_msg":5}\n' * damaged)
    parsed = jsonl.stream_jsonl(spark, str(tmp_path / "in"))

    def drained(df, name):
        q = (df.writeStream.format("parquet").option("path", str(tmp_path / name))
             .option("checkpointLocation", str(tmp_path / f"{name}_cp")).trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    counts = drained(incident_counts(parsed.records), "counts")
    assert [(r["window_start"].hour, r["cnt"]) for r in counts.orderBy("window_start").collect()] == [(h, 1800) for h in range(5)]
    assert drained(parsed.quarantine, "bad").count() == damaged
