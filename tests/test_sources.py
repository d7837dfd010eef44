import json
import gzip
from datetime import datetime

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from emberlog import catalog
from emberlog.schema import LOG_SCHEMA
from emberlog.sources import jsonl
from emberlog.sources.collect import union_sources
from emberlog.sources.sinks import write_daily, write_reports

GOOD = {
    '{"_time":"2025-05-01T10:00:00.123456Z","_stream_id":"ab","_stream":"{app=\\"x\\"}","_msg":"m1","host":"h","app":"a","level":"error","module":"mo","job":"j"}': "m1",
    '  {"_time":"2025-05-01T12:00:00+02:00","_msg":"offset time"}  ': "offset time",
    '{"_time":"2025-05-01T10:00:00Z","_msg":"unknown fields","extra":{"host":5},"n":1}': "unknown fields",
    '{"_time":"2025-05-01T10:00:00Z","_msg":"quote \\" brace } and \\"host\\":5"}': 'quote " brace } and "host":5',
    '{"_time":"2025-05-01T10:00:00Z","_msg":"null field","host":null}': "null field",
    '{"_msg":"no time"}': "no time",
    '{"_time":"2025-05-01T10:00:00Z","_msg":"два\\nряда \\u263a"}': "два\nряда ☺",
    "{}": "",
}
BAD = [
    '{"_time":"2025-05-01T10:00:00Z","_msg":"cut',
    '{"_time":"2025-05-01T10:00:00Z","_msg":123}',
    '{"_time":"yesterday","_msg":"bad time"}',
    '{"_time":"2025-13-41T10:00:00Z","_msg":"no such day"}',
    '{"_time":"2025-05-01T10:00:00","_msg":"no zone"}',
    '{"_time":"","_msg":"empty time"}',
    '{"_time":1745298000,"_msg":"number time"}',
    '{"_msg":"x"} trailing',
    '{"_msg":"x"}{"_msg":"y"}',
    '{"_msg":"x"},{"_msg":"y"}',
    '[{"_msg":"x"}]',
    '"text"',
    "7",
    "not json",
    '{"host":["a"],"_msg":"list"}',
    '{"level":true,"_msg":"bool"}',
]


@pytest.fixture()
def lines_file(tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join([*GOOD, "", "   ", *BAD, "", ""]), encoding="utf-8")
    return str(path)


def test_good_and_bad_lines(spark, lines_file):
    parsed = jsonl.read_jsonl(spark, lines_file)
    assert parsed.records.schema.fieldNames() == LOG_SCHEMA.fieldNames()
    assert sorted(r["msg"] for r in parsed.records.collect()) == sorted(GOOD.values())
    assert sorted(r["value"] for r in parsed.quarantine.collect()) == sorted(BAD)


def test_times_are_utc_wall_clocks_and_absent_texts_are_empty(spark, lines_file):
    rows = {r["msg"]: r for r in jsonl.read_jsonl(spark, lines_file).records.collect()}
    assert rows["m1"]["event_time"] == datetime(2025, 5, 1, 10, 0, 0, 123456)
    assert rows["offset time"]["event_time"] == datetime(2025, 5, 1, 10)
    assert rows["no time"]["event_time"] is None
    assert rows["null field"]["host"] == rows["no time"]["level"] == ""


def test_long_line(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text(json.dumps({"_time": "2025-05-01T10:00:00Z", "_msg": "x" * (11 << 20)}))
    assert jsonl.read_jsonl(spark, str(path)).records.select(F.length("msg")).first()[0] == 11 << 20


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("")
    parsed = jsonl.read_jsonl(spark, str(tmp_path / "e.jsonl"))
    assert parsed.records.count() == parsed.quarantine.count() == 0


def test_round_trip(spark, make_logs, tmp_path):
    logs = make_logs([{"event_time": datetime(2025, 5, 1, 1, 2, 3, 4), "msg": 'a "b"\n<c>', "host": "h", "level": "info"}])
    jsonl.as_jsonl(logs).write.text(str(tmp_path / "out"))
    assert jsonl.read_jsonl(spark, str(tmp_path / "out")).records.collect() == logs.collect()


def test_failed_source_is_reported_and_the_rest_is_read(spark, make_logs, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"_msg":"x","host":"a"}\n')
    got = union_sources(spark, {
        "a": lambda: jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl")).records,
        "b": lambda: jsonl.read_jsonl(spark, str(tmp_path / "missing.jsonl")).records,
    })
    assert got.records.count() == 1
    status = {r["source"]: r["failed"] for r in got.status.collect()}
    assert status == {"a": False, "b": True}
    assert got.is_partial().first()["partial"] is True
    assert union_sources(spark, {"a": lambda: make_logs([])}).is_partial().first()["partial"] is False


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("h1", "2025-05-01", "h1_2025-05-01.md", "# one\n\ntext\n"), ("h2", "2025-05-01", "h2_2025-05-01.md", "two\n")],
        "host string, report_date string, file_name string, body string")
    out = tmp_path / "reports"
    write_reports(df, str(out))
    write_reports(df.filter("host = 'h1'").withColumn("body", F.lit("again\n")), str(out))
    folder = out / "report_date=2025-05-01"
    body = {p.name: p.read_text() for p in folder.iterdir() if not p.name.startswith(".")}
    assert body == {"h1_2025-05-01.md": "again\n", "h2_2025-05-01.md": "two\n"}
    assert [p.name for p in out.iterdir()] == ["report_date=2025-05-01"]


def test_a_source_that_fails_while_it_is_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"_msg":"x","host":"a"}\n')
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(b'{"_msg":"y","host":"b"}\n' * 9999)[:-300])
    got = union_sources(spark, {
        n: (lambda n=n: jsonl.read_jsonl(spark, str(tmp_path / n)).records) for n in ("a.jsonl", "b.jsonl.gz")
    })
    assert got.failures() == 0  # nothing was read yet
    assert [r["host"] for r in got.attempt(lambda records: records.collect())] == ["a"]
    assert {r["source"]: r["failed"] for r in got.status.collect()} == {"a.jsonl": False, "b.jsonl.gz": True}
    assert got.failures() == 1 and "b.jsonl.gz" in got.errors["b.jsonl.gz"]
    with pytest.raises(ZeroDivisionError):  # an error of the action is not that of a source
        got.attempt(lambda records: 1 / 0)


def test_filters_reach_the_scan_of_each_source(spark, make_logs, tmp_path):
    for name in "ab":
        make_logs([{"event_time": datetime(2025, 5, 1), "host": name, "level": "error", "msg": "x"}]).write.parquet(str(tmp_path / name))
    got = union_sources(spark, {n: lambda n=n: spark.read.parquet(str(tmp_path / n)) for n in "ab"})
    text = got.records.filter("level = 'error'").select("host")._jdf.queryExecution().toString()
    assert text.count("EqualTo(level,error)") >= 2 and "msg" not in text.split("ReadSchema")[1]
    assert got.records.count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_digest_without_a_damaged_source(spark, tmp_path):
    """The digest is made again without it, is partial, and one cycle is kept."""
    from emberlog.functions.links import LinkTarget
    from emberlog.functions.windows import Window
    from emberlog.plans.digest import DigestConfig, run_digest
    from emberlog.plans.ledger import RunLedger

    line = '{"_time":"2025-05-01T10:00:00Z","_msg":"x","host":"%s","app":"a","level":"error"}\n'
    (tmp_path / "a.jsonl").write_text((line % "a") * 3)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress((line % "b").encode() * 9999)[:-90])
    sources = union_sources(spark, {n: lambda n=n: jsonl.read_jsonl(spark, str(tmp_path / n)).records for n in ("a.jsonl", "b.jsonl.gz")})
    book, w = RunLedger(spark, str(tmp_path / "runs")), Window(datetime(2025, 5, 1, 5), datetime(2025, 5, 2, 5))
    digest = run_digest(sources, w, DigestConfig(("a", "b"), LinkTarget("https://x.example", 1, "u", "t")), str(tmp_path / "out"), book)
    assert {r["host"]: r["total"] for r in digest.hosts.collect()} == {"a": 3, "b": 0}
    assert "[partial-report]" in digest.cover.first()["body"] and book.runs().first()["status"] == "done"
    assert [(r["outcome"], r["errors"]) for r in book.cycles().collect()] == [("partial", 1)]


def test_only_a_newline_ends_a_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"_msg":"x",\r"host":"a"}\n{"_msg":"y"}\r\n')
    parsed = jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r["msg"] for r in parsed.records.collect()) == ["x", "y"] and parsed.quarantine.count() == 0


def test_daily_table_is_pruned_by_day(spark, make_logs, tmp_path):
    from emberlog.operators.patterns import daily_incidents

    logs = make_logs([{"event_time": datetime(2025, 5, d, 12), "msg": "x", "host": "h"} for d in (1, 2, 3)])
    write_daily(daily_incidents(logs), str(tmp_path / "d"))
    one = spark.read.parquet(str(tmp_path / "d")).filter("day = '2025-05-02'")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()


def test_parts_of_a_staged_table(spark):
    from emberlog.session import Staged

    df = spark.range(100).withColumn("name", F.concat(F.lit("n"), "id"))
    both = Staged(df, "id % 3 = 0")
    one, two = both.part(True), both.part(False)
    assert one.columns == ["id", "name"] and one.count() == 34 and two.count() == 66
    both.drop(True)
    assert both.part(True).count() == 0 and two.count() == 66
    assert Staged(df.limit(0), "id > 3").part(False).count() == 0


def test_long_lines_take_little_disk(spark, tmp_path, monkeypatch):
    """Lines of 40 times a text are not 40 times the texts on disk."""
    monkeypatch.setattr(catalog, "scratch_dir", lambda _: str(tmp_path))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    got = catalog.long_lines(spark, FOLDER).agg(F.count("*"), F.sum("bytes")).first()
    assert tuple(got) == (docs.count(), 40 * texts)
    assert 0 < sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()) < 4 * texts
