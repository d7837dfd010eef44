from datetime import datetime, timedelta, timezone
from urllib.parse import parse_qs, urlsplit
import json

import pytest
from pyspark.sql import functions as F

from emberlog.functions import links, text
from emberlog.functions.windows import Window, digest_bucket, digest_day, digest_window_at, digest_window_for, timestamp
from emberlog.operators import filters

A, B = datetime(2025, 5, 1, 5), datetime(2025, 5, 2, 5)


def value(spark, col):
    return spark.range(1).select(col).first()[0]


def test_window_bounds():
    for a, b in ((B, A), (A, A), (None, B), (A, None)):
        with pytest.raises(ValueError):
            Window(a, b)
    zoned = Window(datetime(2025, 5, 1, 8, tzinfo=timezone(timedelta(hours=3))), B)
    assert zoned == Window(A, B)


def test_scheduled_window_starts_at_the_hour():
    w = digest_window_at(datetime(2025, 5, 2, 5, 17, 33, tzinfo=timezone.utc))
    assert w == Window(A, B)
    # a zone half an hour off cuts at its own hour
    half = digest_window_at(datetime(2025, 5, 2, 5, 17, tzinfo=timezone.utc), "Asia/Kolkata")
    assert half.end == datetime(2025, 5, 2, 4, 30)


def test_window_for_a_day_has_24_elapsed_hours():
    assert digest_window_for("2025-05-02") == Window(A, B)
    spring = digest_window_for("2025-03-30", "Europe/Berlin")
    assert spring.end == datetime(2025, 3, 30, 6) and spring.end - spring.start == timedelta(hours=24)


def test_digest_bucket_and_day(spark):
    rows = spark.createDataFrame([(A - timedelta(microseconds=1),), (A,), (B - timedelta(microseconds=1),)], "t timestamp_ntz")
    got = rows.select(digest_bucket("t"), digest_day("t", "Europe/Moscow").cast("string")).collect()
    assert [tuple(r) for r in got] == [
        (A - timedelta(days=1), "2025-05-01"), (A, "2025-05-02"), (A, "2025-05-02")]
    with pytest.raises(ValueError):
        digest_bucket("t", "Europe/Berlin")


def test_query_checks():
    w = Window(A, B)
    with pytest.raises(ValueError):
        filters.LogQuery(w)
    with pytest.raises(ValueError):
        filters.LogQuery(None, host="h")
    filters.LogQuery(w, levels=("error",))


def test_half_open_window_and_blank_levels(make_logs):
    logs = make_logs([{"event_time": t, "host": "h", "level": "error"} for t in (A, B)])
    assert filters.LogQuery(Window(A, B), host="h", levels=(" error ", "")).apply(logs).count() == 1
    assert filters.by_levels(logs, ["", " "]).count() == filters.by_hosts(logs, []).count() == 2


GOOD = dict(base_url="https://logs.example.com/sub/", org_id=3, source_uid="u1", source_type="t")


@pytest.mark.parametrize("change", [
    {"base_url": ""}, {"base_url": "logs.example.com"}, {"org_id": 0}, {"source_uid": " "}, {"source_type": ""}])
def test_link_target_checks(change):
    with pytest.raises(ValueError):
        links.LinkTarget(**{**GOOD, **change})


@pytest.mark.parametrize("base,path", [
    ("https://x.example", "/explore"), ("https://x.example/", "/explore"), ("https://x.example/a//b/", "/a/b/explore")])
def test_link(spark, base, path):
    target = links.LinkTarget(**{**GOOD, "base_url": base})
    expr = '{host="h"} level:=error app:="a~b*c <&> \\"д"'
    url = value(spark, links.explore_link(target, F.lit(expr), timestamp(A), timestamp(B)))
    parts = urlsplit(url)
    assert parts.path == path and "~" in parts.query and "*" not in parts.query
    q = parse_qs(parts.query)
    assert list(q) == ["orgId", "panes", "schemaVersion"] and q["orgId"] == ["3"] and q["schemaVersion"] == ["1"]
    pane = json.loads(q["panes"][0])["a"]
    assert pane["queries"] == [{"refId": "A", "datasource": {"uid": "u1", "type": "t"}, "expr": expr}]
    assert pane["range"] == {"from": "1746075600000", "to": "1746162000000"}
    assert "\\u003c\\u0026\\u003e" in q["panes"][0]


def test_no_link_without_expression_or_range(spark):
    target = links.LinkTarget(**GOOD)
    assert value(spark, links.explore_link(target, F.lit("  "), timestamp(A), timestamp(B))) is None
    assert value(spark, links.explore_link(target, F.lit("x"), timestamp(B), timestamp(B))) is None


def test_expressions(spark):
    assert value(spark, links.host_expr(F.lit("h"), ["error", " critical", ""])) == '{host="h"} (level:=error OR level:=critical)'
    assert value(spark, links.host_expr(F.lit("h"), [" "])) == '{host="h"}'
    assert links.all_hosts_expr(["a", "b"], ["error"]) == '{host=~"a|b"} level:=error'
    assert links.all_hosts_expr([], []) == "{}"
    got = value(spark, links.incident_expr(F.lit("h"), F.lit("error"), F.lit("")))
    assert got == '{host="h"} level:=error'


def test_link_range_is_clipped(spark):
    w, m = Window(A, B), timedelta(minutes=1)
    rows = spark.createDataFrame(
        [(A, B), (A + 5 * m, A + 5 * m), (B + 5 * m, B + 9 * m)], "first_seen timestamp_ntz, last_seen timestamp_ntz")
    got = [tuple(r) for r in rows.select(*links.link_range(w)).collect()]
    assert got == [(A, B), (A + 4 * m, A + 6 * m), (A, B)]


def test_texts(spark):
    cases = {"  one \ntwo": "one", "а" * 100: "а" * 100 + "…", "b" * 161: "b" * 160 + "…", " x ": "x", "": ""}
    for raw, want in cases.items():
        assert value(spark, text.first_line(F.lit(raw))) == want
    for raw in ("x" * 2048, "я" * 3000, "a☺" * 1500, "😀" * 900, "a" * 2044 + "😀zz"):
        got = value(spark, text.truncate_example(F.lit(raw)))
        if len(raw.encode()) <= 2048:
            assert got == raw
        else:
            assert got.endswith("…") and raw.startswith(got[:-1]) and 2044 <= len(got.encode()) <= 2048
    assert value(spark, text.html_escape(F.lit("<a href='x'>\"&amp;"))) == "&lt;a href=&#39;x&#39;&gt;&#34;&amp;amp;"
    assert value(spark, text.mask_secrets(F.lit("key=s3cret;s3"), ["s3cret", "", "s3"])) == "key=***;***"
    assert value(spark, text.fmt_time(timestamp(A), "Europe/Moscow")) == "2025-05-01 08:00:00"
    assert value(spark, text.fmt_time_short(F.lit(None).cast("timestamp_ntz"))) == "—"
    assert value(spark, text.report_file(F.lit("h"), timestamp(B), "Europe/Moscow")) == "h_2025-05-02.md"


def test_quoted_texts_escape_what_cannot_be_printed(spark):
    from emberlog.functions.links import host_expr

    cases = {'a"b\\c': '"a\\"b\\\\c"', "tab\there": '"tab\\there"', "nl\n\x01é": '"nl\\n\\x01é"', "nb ": '"nb\\u00a0"', "": '""'}
    rows = spark.createDataFrame([(k,) for k in cases], "host string").select("host", host_expr("host").alias("e")).collect()
    assert {r["host"]: r["e"] for r in rows} == {k: "{host=" + v + "}" for k, v in cases.items()}
