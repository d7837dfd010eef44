import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators import patterns as pat
from emberlog.operators.incidents import incidents
from emberlog.streaming.alerts import new_critical_alerts, throttled_alerts
from emberlog.streaming.ingest import incident_counts, merge_counts
from emberlog.streaming.run import drain

T0 = datetime(2025, 5, 1)


def records(n, span_s, seed=1):
    rnd = random.Random(seed)
    return sorted(({
        "event_time": T0 + timedelta(seconds=rnd.randrange(span_s), microseconds=rnd.randrange(10**6)),
        "host": "h", "app": "a", "level": rnd.choice(["critical", "error"]), "msg": f"m{'abcd'[rnd.randrange(4)]}",
    } for _ in range(n)), key=lambda r: r["event_time"])


def stream(spark, make_logs, tmp_path, batches, transform):
    """Feed the batches one after the other, with a restart before each."""
    base = tmp_path / uuid.uuid4().hex
    for b in batches:
        make_logs(b).coalesce(2).write.mode("append").parquet(str(base / "in"))
        out = drain(spark, str(base / "in"), transform, str(base / "out"), str(base / "checkpoint"))
    return out


def split(rows, n):
    return [rows[i * len(rows) // n:(i + 1) * len(rows) // n] for i in range(n)]


def test_new_critical_alerts_equal_the_batch_twin(spark, make_logs, tmp_path):
    rows = records(60, 60 * 86400)
    got = stream(spark, make_logs, tmp_path, split(rows, 3), new_critical_alerts)
    want = pat.new_criticals(make_logs(rows)).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 4


def test_throttled_alerts_equal_the_batch_twin(spark, make_logs, tmp_path):
    rows = records(400, 6 * 3600)
    got = stream(spark, make_logs, tmp_path, split(rows, 3), throttled_alerts)
    want = pat.throttle_alerts(make_logs(rows)).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 20


def test_counts_equal_batch_for_closed_windows(spark, make_logs, tmp_path):
    rows = records(300, 12 * 3600)
    # the last record closes all earlier windows
    tail = [{"event_time": T0 + timedelta(days=1), "host": "h", "app": "a", "level": "error", "msg": "end"}]
    got = stream(spark, make_logs, tmp_path, [*split(rows, 2), tail], incident_counts)
    want = incident_counts(make_logs(rows))
    assert sorted(got.collect()) == sorted(want.collect())
    assert merge_counts(got).groupBy().sum("cnt").first()[0] == 300


def test_late_records_are_dropped(spark, make_logs, tmp_path):
    def at(h):
        return {"event_time": T0 + timedelta(hours=h), "host": "h", "app": "a", "level": "error", "msg": "x"}

    got = stream(spark, make_logs, tmp_path, [[at(0), at(5)], [at(0.5), at(10)], [at(20)]], incident_counts)
    assert {r["window_start"].hour: r["cnt"] for r in got.collect()} == {0: 1, 5: 1, 10: 1}


def test_a_new_stream_begins_with_what_is_known(spark, make_logs, tmp_path):
    rows = records(60, 60 * 86400)
    cut = T0 + timedelta(days=26)
    old, new = [r for r in rows if r["event_time"] < cut], [r for r in rows if r["event_time"] >= cut]
    # known records are no part of the stream, and a restart does not take them up again
    known = incidents(make_logs(old)).select("host", "app", "fingerprint", "last_seen")
    got = stream(spark, make_logs, tmp_path, split(new, 3), lambda df: new_critical_alerts(df, known=known))
    want = pat.new_criticals(make_logs(rows)).select(*got.columns).where(F.col("event_time") >= F.lit(cut).cast("timestamp_ntz"))
    assert sorted(got.collect()) == sorted(want.collect())
    cold = stream(spark, make_logs, tmp_path, split(new, 1), new_critical_alerts)
    assert cold.count() > got.count()


@pytest.mark.parametrize("gap_days,alerts", [(6, 1), (8, 2)])
def test_quiet_period_counts_from_the_last_record(spark, make_logs, tmp_path, gap_days, alerts):
    def at(day, level="critical"):
        return [{"event_time": T0 + timedelta(days=day), "host": "h", "app": "a", "level": level, "msg": "x"}]

    batches = [at(0), at(5, "error"), at(5 + gap_days)]
    assert stream(spark, make_logs, tmp_path, batches, new_critical_alerts).count() == alerts


def test_a_late_record_does_not_hide_one_in_time(spark, make_logs, tmp_path):
    def at(hour, minute, msg):
        return {"event_time": T0 + timedelta(hours=hour, minutes=minute), "host": "h", "app": "a", "level": "critical", "msg": msg}

    batches = [[at(22, 0, "yy")], [at(0, 5, "xx"), at(23, 0, "xx")], [at(23, 30, "zz")]]
    got = stream(spark, make_logs, tmp_path, batches, new_critical_alerts).collect()
    assert len({r["fingerprint"] for r in got}) == 3


def test_a_micro_batch_is_bounded(spark, make_logs, tmp_path):
    rows = records(200, 6 * 3600)
    make_logs(rows).repartition(6).write.parquet(str(tmp_path / "in"))
    seen = []

    def transform(df):
        seen.append(df)
        return df.select("host", "msg")

    out = drain(spark, str(tmp_path / "in"), transform, str(tmp_path / "out"), str(tmp_path / "checkpoint"), max_files=2)
    assert out.count() == 200
    commits = [p for p in (tmp_path / "checkpoint" / "commits").iterdir() if not p.name.startswith(".")]
    assert len(commits) == 3
