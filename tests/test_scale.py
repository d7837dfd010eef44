"""Operators that must not depend on the size of one group, against brute
force on data where one group holds most rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions.normalize import normalize
from emberlog.operators import incidents as inc
from emberlog.operators import patterns as pat
from emberlog.operators import ranking
from emberlog.session import stage

T0 = datetime(2025, 5, 1)


@pytest.fixture(scope="module")
def skewed(make_logs):
    """2 000 records over 40 days; one template of one host holds most."""
    rnd = random.Random(5)
    out = []
    for i in range(2000):
        hot = rnd.random() < 0.7
        at = T0 + timedelta(seconds=rnd.choice([rnd.randrange(40 * 86400), rnd.randrange(3600)]), microseconds=rnd.randrange(10**6))
        out.append({
            "event_time": at, "host": "hot" if hot else f"h{rnd.randrange(3)}", "app": "a",
            "level": rnd.choice(["critical", "error"]), "msg": "down" if hot else f"k{rnd.randrange(60)} failed",
            "stream_id": str(i),
        })
    return stage(make_logs(out)), out


def test_ranked_is_row_number_over_many_slices(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        (F.hash("id") % 50).alias("v"), "id")
    got = ranking.ranked(df.repartition(8), ["g"], ["-v", "id"])
    assert got.groupBy("g").count().count() == 8
    expected = defaultdict(list)
    for r in df.collect():
        expected[r["g"]].append((-r["v"], r["id"]))
    want = {(g, i): n for g, rows in expected.items() for n, (_, i) in enumerate(sorted(rows), 1)}
    assert {(r["g"], r["id"]): r["rank"] for r in got.collect()} == want


def test_ranked_splits_the_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20000).select(F.lit("hot").alias("g"), "id")
        slices = df.repartitionByRange("g", "id").select(F.spark_partition_id().alias("p")).distinct().count()
        assert slices > 1
        assert ranking.ranked(df, ["g"], ["id"]).filter("rank <> id + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_n_uses_the_sliced_ranking(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), "id")
    assert ranking.top_n(df, ["g"], ["id"], 1500).agg(F.max("id"), F.count("*")).first()[:] == (1499, 1500)


@pytest.mark.parametrize("cap", [1, 50, 1399, 100000])
def test_host_cap(skewed, cap):
    logs, rows = skewed
    kept, summary = ranking.host_cap(logs, cap)
    by_host = defaultdict(list)
    for r in rows:
        by_host[r["host"]].append((r["event_time"], r["msg"], r["stream_id"]))
    want = {(h, *x) for h, xs in by_host.items() for x in sorted(xs)[:cap]}
    assert {(r["host"], r["event_time"], r["msg"], r["stream_id"]) for r in kept.collect()} == want
    got = {r["host"]: (r["total"], r["kept"], r["is_cut"]) for r in summary.collect()}
    assert got == {h: (len(x), min(cap, len(x)), len(x) > cap) for h, x in by_host.items()}


def test_cap_inside_one_second(make_logs):
    logs = make_logs([{"event_time": T0, "host": "h", "msg": f"m{i:04d}"} for i in range(500)])
    kept, summary = ranking.host_cap(logs, 123)
    assert sorted(r["msg"] for r in kept.collect()) == [f"m{i:04d}" for i in range(123)]
    assert summary.first()["is_cut"]


def sequences(logs):
    """(host, app, fingerprint) -> its (time, level) in order."""
    out = defaultdict(list)
    rows = inc.with_fingerprint(logs.withColumn("normalized_msg", normalize("msg"))).collect()
    for r in rows:
        out[r["host"], r["app"], r["fingerprint"]].append((r["event_time"], r["level"]))
    return {k: sorted(v, key=lambda x: (x[0], x[1] != "critical")) for k, v in out.items()}


@pytest.mark.parametrize("days", [1, 3, 7])
def test_new_criticals(skewed, days):
    logs, _ = skewed
    want = set()
    for key, seen in sequences(logs).items():
        last = None
        for at, level in seen:
            if level == "critical" and (last is None or at - last > timedelta(days=days)):
                want.add((*key, at, last))
            last = at
    got = pat.new_criticals(logs, timedelta(days=days)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("minutes", [0, 1, 10, 600])
def test_throttle(skewed, minutes):
    logs, _ = skewed
    want = {}
    for key, seen in sequences(logs).items():
        last = None
        for at, level in seen:
            if level != "critical":
                continue
            if last is None or at >= last + timedelta(minutes=max(minutes, 0)) and at != last:
                last = at
                want[(*key, at)] = 0
            want[(*key, last)] += 1
    got = {(r["host"], r["app"], r["fingerprint"], r["alert_at"]): r["records"]
           for r in pat.throttle_alerts(logs, timedelta(minutes=minutes)).collect()}
    assert got == want


def test_examples_of_the_hot_template(make_logs):
    logs = make_logs([{"event_time": T0 + timedelta(seconds=i), "host": "h", "msg": f"id {i % 40} gone"} for i in range(4000)])
    got = inc.examples(logs.repartition(8), n=3).orderBy("example_no").collect()
    assert [r["msg"] for r in got] == ["id 0 gone", "id 1 gone", "id 2 gone"]


@pytest.mark.parametrize("n", [1, 3, 5])
def test_example_bound_is_exact_and_prunes(make_logs, n):
    rnd = random.Random(n)
    rows = []
    for i in range(3000):
        kind = rnd.choice(["all differ", "few", "same"])
        msg = {"all differ": f"all differ {i}", "few": f"few {rnd.randrange(4)}", "same": "same"}[kind]
        rows.append({"event_time": T0 + timedelta(seconds=rnd.randrange(900)), "host": "h", "msg": msg})
    rows.append({"event_time": None, "host": "h", "msg": "few 77"})
    logs = stage(make_logs(rows).repartition(6))
    incs = stage(inc.incidents(logs, examples_for=n))
    order = ["fingerprint", "example_no"]
    assert inc.examples(logs, n=n, only=incs).orderBy(*order).collect() == inc.examples(logs, n=n).orderBy(*order).collect()
    until = {r["normalized_msg"]: r["examples_until"] for r in incs.collect()}
    assert until["all differ <N>"] < T0 + timedelta(seconds=60)
    assert n == 1 or until["same"] is None
    assert sorted(inc.incidents(logs).collect()) == sorted(incs.drop("examples_until").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_and_no_python_in_batch_queries(spark):
    from conftest import FOLDER
    from emberlog.catalog import QUERIES

    for name, query in QUERIES.items():
        if name.startswith("stream_"):
            continue
        text = plan(query(spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "Python" not in text and "Pandas" not in text, name


def test_incident_plan(spark):
    from conftest import FOLDER
    from emberlog.catalog import incidents, incident_top, logs_window

    text = plan(incidents(spark, FOLDER))
    assert text.count("Exchange") == 3
    # the record-level aggregation is a hash aggregation with map-side combine
    scan_side = text.rsplit("Exchange", 1)[1]
    assert "HashAggregate" in scan_side and "SortAggregate" not in scan_side
    assert "value" not in text.split("ReadSchema")[1]
    assert "WindowGroupLimit" in plan(incident_top(spark, FOLDER))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan(logs_window(spark, FOLDER))


def test_throttle_of_long_chains(spark):
    """Thousands of alerts in a row, of one fingerprint that never pauses,
    against the rule taken literally; equal slots, borders and silences too."""
    import random

    from emberlog.operators import throttle

    rng = random.Random(6)
    gap = 1000
    times = {"hot": sorted(rng.sample(range(0, 3_000_000), 40_000)), "even": list(range(0, 200_000, 500)),
             "border": [0, 999, 1000, 1001, 2000, 2999, 3001], "far": [5, 10_000, 10_999, 11_000, 90_000], "past": [-2500, -1500, -1, 0, 499]}
    rows = [("h", "a", k, t, 1 + t % 3) for k, ts in times.items() for t in ts]
    found = spark.createDataFrame(rows, "host string, app string, fingerprint string, us long, records long").repartition(7)
    want = {}
    for k, ts in times.items():
        last = None
        for t in ts:
            if last is None or t >= last + gap:
                last = t
            want[k, last] = want.get((k, last), 0) + 1 + t % 3
    got = {(r["fingerprint"], r["us"]): r["records"] for r in throttle.throttle_moments(found, timedelta(microseconds=gap)).collect()}
    assert got == want and sum(k == "hot" for k, _ in want) > 2500


def test_throttle_deals_a_hot_fingerprint(make_logs, spark):
    """Moments are dealt by fingerprint and slot, so one fingerprint spans tasks."""
    from emberlog.operators import throttle

    logs = make_logs([{"event_time": T0 + timedelta(seconds=7 * i), "host": "h", "app": "a", "level": "critical", "msg": "x"} for i in range(5000)])
    times = throttle.moments(logs).withColumn("slot", throttle._slot("us", 600_000_000))
    text = plan(throttle.successors(times.select(*throttle.KEY, "us", "slot"), 600_000_000))
    # the windows over moments have the slot in their key; those without it see one row per slot
    by_moment = [x for x in text.split("Window ") if "at#" in x.split("\n")[0]]
    assert by_moment and all("slot" in x.split("], [")[1 if x.startswith("[min") else 0] for x in by_moment)


@pytest.mark.parametrize("gap,alerts", [(599.2, 1), (600.0, 2), (599.999999, 1)])
def test_throttle_is_exact(make_logs, gap, alerts):
    start = T0 + timedelta(microseconds=900_000)
    logs = make_logs([
        {"event_time": start + timedelta(seconds=s), "host": "h", "app": "a", "level": "critical", "msg": "x"} for s in (0, gap)
    ])
    got = pat.throttle_alerts(logs).collect()
    assert len(got) == alerts and min(r["alert_at"] for r in got) == start
    assert sum(r["records"] for r in got) == 2


def test_host_cap_with_null_times_and_hosts(make_logs):
    rows = [{"event_time": T0 + timedelta(seconds=i), "host": "h", "msg": f"m{i}"} for i in range(10)]
    rows += [{"event_time": None, "host": "h", "msg": f"n{i}"} for i in range(5)]
    rows += [{"event_time": T0 + timedelta(seconds=i), "host": None, "msg": f"o{i}"} for i in range(10)]
    for cap in (4, 8, 12):
        kept, summary = ranking.host_cap(make_logs(rows), cap)
        got = kept.collect()
        assert {r["host"]: r["kept"] for r in summary.collect()} == {"h": cap, None: min(cap, 10)}
        assert sum(r["host"] == "h" for r in got) == cap and sum(r["host"] is None for r in got) == min(cap, 10)
        assert sum(r["event_time"] is None for r in got) == max(0, cap - 10)


def test_ranking_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 1)], "g string, n int")
    assert sorted(map(tuple, ranking.ranked(df, ["g"], ["n"]).collect()), key=str) == [("a", 1, 1), (None, 1, 1), (None, 2, 2)]
    for n in (2, 2000):
        got = ranking.top_n(df, ["g"], ["n"], n)
        assert got.count() == 3 and dict(got.dtypes)["rank"] == "int"
