from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators import incidents as inc
from emberlog.operators import ranking, stats, totals
from emberlog.operators.patterns import flag_patterns, pattern_hosts, patterns

T0 = datetime(2025, 5, 1, 10)


def rec(i=0, **kw):
    return {"event_time": T0 + timedelta(seconds=i), "host": "a1", "app": "api", "level": "error", **kw}


def test_one_template_many_ids(make_logs):
    logs = make_logs([rec(i, msg=f"order {i:016X} lost at 2025-05-01T10:00:{i % 60:02d}Z", stream_id=f"s{i % 4}")
                      for i in range(1000)])
    row = inc.incidents(logs).collect()
    assert len(row) == 1
    assert row[0]["cnt"] == 1000 and row[0]["streams"] == 4
    assert row[0]["normalized_msg"] == "order <hex> lost at <ts>"
    assert (row[0]["first_seen"], row[0]["last_seen"]) == (T0, T0 + timedelta(seconds=999))
    shown = inc.examples(logs).orderBy("example_no").collect()
    assert [r["msg"][6:22] for r in shown] == [f"{i:016X}" for i in range(3)]
    assert inc.examples(logs, n=0).count() == 1


def test_host_and_app_split_incidents(make_logs):
    logs = make_logs([rec(msg="down"), rec(msg="down", host="a2"), rec(msg="down", app="db")])
    assert inc.incidents(logs).select("fingerprint").distinct().count() == 3


def test_level_is_the_highest_and_ties_take_the_first(make_logs):
    logs = make_logs([
        rec(0, msg="x"), rec(1, msg="x", level="critical"), rec(2, msg="x"),
        rec(1, msg="y", level="warning"), rec(2, msg="y", level="warn"),
        rec(5, msg="z", level="odd"), rec(4, msg="z", level="strange"), rec(6, msg="z", level=""),
    ])
    got = {r["normalized_msg"]: r["level"] for r in inc.incidents(logs).collect()}
    assert got == {"x": "critical", "y": "warning", "z": "strange"}


def test_module_of_first_record_even_if_empty(make_logs):
    logs = make_logs([rec(5, msg="x", module="late"), rec(1, msg="x", module=""), rec(3, msg="x", module="mid")])
    assert inc.incidents(logs).first()["module"] == ""


def test_records_without_time(make_logs):
    logs = make_logs([rec(msg="x", event_time=None, module="none"), rec(3, msg="x", module="m")])
    row = inc.incidents(logs).first()
    assert row["cnt"] == 2 and row["first_seen"] == row["last_seen"] == T0 + timedelta(seconds=3)
    assert row["module"] == "m"


def test_empty_streams_do_not_count(make_logs):
    logs = make_logs([rec(msg="x", stream_id=""), rec(msg="x", stream_id="s"), rec(msg="x", stream_id="s")])
    assert inc.incidents(logs).first()["streams"] == 1
    assert inc.incidents(logs, approx_streams=True).first()["streams"] == 1


def test_equal_messages_give_one_example(make_logs):
    logs = make_logs([rec(i, msg="same") for i in range(100)])
    assert inc.examples(logs).count() == 1
    assert inc.incidents(logs).first()["cnt"] == 100


@pytest.fixture(scope="module")
def grouped(make_logs):
    sizes = {"ten": 10, "two": 2, "one": 1}
    return inc.incidents(make_logs([rec(i, msg=m) for m, n in sizes.items() for i in range(n)]))


def test_noise_split(grouped):
    row = totals.noise_summary(grouped, 5).first()
    assert (row["records"], row["incidents"], row["above"], row["below"], row["below_records"]) == (13, 3, 1, 2, 3)
    assert totals.noise_summary(grouped, 0).first()["below"] == 0


def test_sections_cover_everything(grouped):
    got = {r["normalized_msg"]: r["section"] for r in ranking.incident_sections(grouped, 2, 1).collect()}
    assert got == {"ten": "top", "two": "overflow", "one": "below"}


def test_order_ties(make_logs):
    logs = make_logs([rec(2, msg="late"), rec(1, msg="early"), rec(1, msg="early too")])
    ranked = ranking.incident_rank(inc.incidents(logs)).orderBy("rank").collect()
    assert ranked[2]["normalized_msg"] == "late"
    assert ranked[0]["fingerprint"] < ranked[1]["fingerprint"]


def test_app_totals_use_the_incident_level_and_host_totals_the_record_level(make_logs):
    logs = make_logs(
        [rec(i, msg=f"E{i}", app="a") for i in range(5)] + [rec(i, msg=f"C{i}", app="a", level="critical") for i in range(2)]
        + [rec(i, msg=f"E{i}", app="b") for i in range(3)] + [rec(1, msg="mix", app="c"), rec(2, msg="mix", app="c", level="critical")]
    )
    incs = inc.incidents(logs, level_counts=("error", "critical"))
    apps = {r["app"]: (r["error"], r["critical"], r["total"]) for r in totals.app_totals(incs).collect()}
    assert apps == {"a": (5, 2, 7), "b": (3, 0, 3), "c": (0, 2, 2)}
    row = totals.host_totals(logs).first()
    assert (row["error"], row["critical"], row["total"]) == (9, 3, 12)
    same = totals.host_summary(incs).first()
    assert (same["error"], same["critical"], same["total"]) == (9, 3, 12)
    assert totals.top_app_per_host(totals.app_totals(incs)).first()["app"] == "a"


def test_zero_fill_and_labels(spark, make_logs):
    configured = totals.with_labels(totals.host_list(spark, ["a1", "quiet"]), {"quiet": "Spare"})
    got = totals.zero_filled(configured, totals.host_totals(make_logs([rec(msg="x")]))).orderBy("host_no").collect()
    assert [(r["host"], r["label"], r["total"]) for r in got] == [("a1", "", 1), ("quiet", "Spare", 0)]


def test_hits_series_totals(make_logs):
    logs = make_logs([rec(i * 1800, msg="x") for i in range(5)])
    row = stats.hits_series(logs, "1 hour", ("host",)).first()
    assert row["fields"] == {"host": "a1"} and row["values"] == [2, 2, 1] and row["total"] == sum(row["values"])
    assert row["timestamps"] == [T0 + timedelta(hours=h) for h in range(3)]


def test_freshness(make_logs):
    logs = make_logs([rec(0, msg="x"), rec(7200, msg="x", host="a2")])
    now = T0 + timedelta(hours=2, minutes=30)
    got = {r["host"]: r["is_fresh"] for r in stats.source_freshness(logs, now).collect()}
    assert got == {"a1": False, "a2": True}
    assert stats.has_recent(logs, now).count() == 1
    assert stats.has_recent(logs, now + timedelta(days=1)).count() == 0


def test_level_map(make_logs):
    logs = make_logs([rec(msg="x"), rec(msg="x"), rec(msg="x", level="critical")])
    assert inc.incident_level_map(logs).first()["levels"] == {"error": 2, "critical": 1}


def test_patterns(make_logs):
    logs = make_logs([rec(i, msg="often") for i in range(10)] + [rec(msg="wide"), rec(msg="wide", host="a2"), rec(msg="rare")])
    incs = inc.incidents(logs)
    got = {r["normalized_msg"]: (r["is_pattern"], r["host_count"]) for r in patterns(incs).collect()}
    assert got == {"often": (True, 1), "wide": (True, 2), "rare": (False, 1)}
    on = {(r["normalized_msg"], r["host"]) for r in pattern_hosts(incs).collect()}
    assert on == {("often", "a1"), ("wide", "a1"), ("wide", "a2")}
    assert flag_patterns(incs).filter("is_pattern").count() == 3


def test_sections_sum_to_total(spark):
    from conftest import FOLDER
    from emberlog.sources.tables import document_logs

    logs = document_logs(spark, FOLDER)
    parts = ranking.incident_sections(inc.incidents(logs), 3, 2)
    assert parts.agg(F.sum("cnt")).first()[0] == logs.count()
