from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberlog.functions.links import LinkTarget
from emberlog.functions.windows import Window
from emberlog.functions.normalize import EXTENDED_PROFILE
from emberlog.plans.digest import DigestConfig, build_digest, run_digest, sweep
from emberlog.plans.history import FingerprintHistory
from emberlog.plans.ledger import RunLedger
from emberlog.sources.sinks import write_reports

A = datetime(2025, 5, 1, 5)
W = Window(A, A + timedelta(days=1))
CFG = DigestConfig(("h1", "h2", "idle"), LinkTarget("https://x.example", 1, "u", "t"), noise_k=2, top_n=2,
                   labels={"h1": "Main"}, tz="Europe/Moscow")


@pytest.fixture(scope="module")
def logs(make_logs):
    out = []
    for msg, n in (("five", 5), ("four", 4), ("three", 3), ("lone", 1)):
        out += [{"event_time": A + timedelta(minutes=i), "host": "h1", "app": "<api>", "level": "error", "msg": msg,
                 "module": "core" if msg == "five" else "", "stream_id": f"s{i}"} for i in range(n)]
    out += [{"event_time": A + timedelta(hours=1), "host": "h2", "app": "db", "level": "critical", "msg": "multi\nline\n```"}]
    # outside: level, window, host
    out += [{"event_time": A, "host": "h1", "app": "api", "level": "info", "msg": "x"},
            {"event_time": W.end, "host": "h1", "app": "api", "level": "error", "msg": "x"},
            {"event_time": A, "host": "other", "app": "api", "level": "error", "msg": "x"}]
    return make_logs(out)


@pytest.fixture(scope="module")
def digest(logs):
    return build_digest(logs, W, CFG, A + timedelta(days=1))


@pytest.fixture(scope="module")
def bodies(digest):
    return {r["host"]: r for r in digest.reports.collect()}


def test_report_for_every_configured_host(bodies):
    assert set(bodies) == {"h1", "h2", "idle"}
    assert bodies["h1"]["file_name"] == "h1_2025-05-02.md" and bodies["h1"]["report_date"] == "2025-05-02"


def test_report_text(bodies):
    body = bodies["h1"]["body"]
    for part in (
        "# Отчёт по ошибкам: `h1` (Main)\n\n**Период:** 2025-05-01 08:00:00 — 2025-05-02 08:00:00 (Europe/Moscow)\n",
        "error = **13**, critical = **0**, записей всего: **13**, инцидентов (fingerprint'ов): **4**",
        "| `<api>` | 13 | 0 | 13 |\n\n\n## Топ-2 инцидентов\n\n### 1. [`<api>`] five\n",
        "- **level:** `error`\n- **module:** `core`\n- **first / last:** 2025-05-01 08:00:00 → 2025-05-01 08:04:00\n",
        "(уникальных стримов: 5)", "Выдержки:\n\n```\nfive\n```\n\n\n\n### 2. [`<api>`] four\n\n",
        "- **level:** `error`\n- **first / last:**",
        "## Прочее (ниже шум-порога K=2)\n\n**1** инцидентов, **1** записей. [Открыть в Grafana →](https://x.example/explore?",
    ):
        assert part in body, part
    assert "three" not in body and "lone" not in body
    assert "```\nmulti\nline\n```\n```" not in bodies["h2"]["body"]  # below the threshold
    assert bodies["h2"]["body"].count("## Топ-0") == 1


def test_idle_host(bodies):
    body = bodies["idle"]["body"]
    assert "За окно ошибок уровня `error` / `critical` не обнаружено.\n\n[Открыть в Grafana →](" in body
    assert "## " not in body and body.endswith(")\n")


def test_totals_agree(digest, logs):
    inside = logs.filter("level in ('error', 'critical') and host in ('h1', 'h2')").filter(
        F.col("event_time") < F.lit(W.end).cast("timestamp_ntz")).count()
    assert digest.incidents.agg(F.sum("cnt")).first()[0] == inside
    assert digest.hosts.agg(F.sum("total")).first()[0] == inside
    assert digest.apps.agg(F.sum("total")).first()[0] == inside


def test_cover(digest):
    row = digest.cover.first()
    assert "h1             13      0  &lt;api&gt;\nh2              0      1  db\nidle            0      0  \n</pre>" in row["body"]
    assert "<b>Всего:</b> 13 error, 1 critical\n<b>Уникальных инцидентов:</b> 5\n" in row["body"]
    assert "[partial-report]" not in row["body"] and row["fits"]


def test_partial_cover(logs):
    cover = build_digest(logs, W, CFG, A, partial=True).cover.first()["body"]
    assert cover.rstrip().endswith("</i>") and "[partial-report]" in cover


def test_window_is_delivered_once(spark, logs, tmp_path):
    book = RunLedger(spark, str(tmp_path / "runs"))
    assert run_digest(logs, W, CFG, str(tmp_path / "out"), book) is not None
    files = sorted(p.name for p in Path(tmp_path / "out/reports/report_date=2025-05-02").iterdir() if not p.name.startswith("."))
    assert files == [f"{h}_2025-05-02.md" for h in ("h1", "h2", "idle")]
    assert run_digest(logs, W, CFG, str(tmp_path / "out"), book) is None
    row = book.runs().first()
    assert (row["status"], row["files_sent"]) == ("done", 3) and row["cover_msg_id"] is not None
    assert [r["outcome"] for r in book.cycles().orderBy("at").collect()] == ["ok", "skipped"]


def test_failure_is_recorded(spark, logs, tmp_path):
    book = RunLedger(spark, str(tmp_path / "runs"))
    with pytest.raises(Exception):
        run_digest(logs.drop("msg"), W, CFG, str(tmp_path / "out"), book)
    assert book.runs().first()["status"] == "failed"
    assert run_digest(logs, W, CFG, str(tmp_path / "out"), book, errors=2) is not None
    assert book.runs().first()["status"] == "done"
    assert [(r["outcome"], r["errors"]) for r in book.cycles().orderBy("at").collect()] == [("failed", 0), ("partial", 2)]


def test_history_is_kept(spark, logs, tmp_path):
    kept = FingerprintHistory(spark, str(tmp_path / "history"))
    assert kept.read().count() == 0
    digest = run_digest(logs, W, CFG, str(tmp_path / "out"), history=kept)
    first = {r["fingerprint"]: r for r in kept.current().collect()}
    assert len(first) == digest.incidents.count() and all(r["count_last_24h"] == r["count_total"] for r in first.values())
    total = sum(r["count_total"] for r in first.values())
    for _ in range(2):  # the window again, and once more
        assert kept.update(digest.incidents, W)
        assert sum(r["count_total"] for r in kept.current().collect()) == total
    later = Window(W.end, W.end + timedelta(days=1))
    untouched = sorted((tmp_path / "history/windows").glob(f"{W.end:%Y%m%d}*/*"))
    assert kept.update(digest.incidents.limit(1), later) and kept.windows() == sorted(kept.windows()) and len(kept.windows()) == 2
    assert untouched == sorted((tmp_path / "history/windows").glob(f"{W.end:%Y%m%d}*/*"))
    twice = sum(r["count_total"] == 2 * first[r["fingerprint"]]["count_total"] for r in kept.current().collect())
    assert twice == 1 and kept.current().filter("count_last_24h > 0").count() == 1
    assert kept.update(digest.incidents.limit(0), later)  # a smaller second attempt leaves nothing of the first
    assert sum(r["count_total"] for r in kept.current().collect()) == total and kept.current().filter("count_last_24h > 0").count() == 0
    assert kept.current(EXTENDED_PROFILE).count() == 0
    before = sorted(map(tuple, kept.read().collect()))
    kept.sweep(W.end, 400)
    assert sorted(map(tuple, kept.read().collect())) == before and kept.windows() == []
    assert not kept.update(digest.incidents, W) and sorted(map(tuple, kept.read().collect())) == before  # closed
    kept.sweep(W.end + timedelta(days=100))
    assert kept.read().count() == 0 and len(list((tmp_path / "history/base").iterdir())) == 1


def test_half_written_history_is_not_seen(spark, logs, tmp_path):
    kept = FingerprintHistory(spark, str(tmp_path / "history"))
    digest = run_digest(logs, W, CFG, str(tmp_path / "out"), history=kept)
    first = sorted(map(tuple, kept.read().collect()))
    # an attempt that died has no mark of its end, nor has a base
    name = kept._name(W)
    digest.incidents.limit(1).write.parquet(str(tmp_path / f"history/windows/{name}/99999999999999999999"))
    (tmp_path / f"history/windows/{name}/99999999999999999999/_SUCCESS").unlink()
    digest.incidents.limit(1).write.parquet(str(tmp_path / "history/base/99999999999999999999/rows"))
    assert sorted(map(tuple, kept.read().collect())) == first
    assert kept.update(digest.incidents, W) and sorted(map(tuple, kept.read().collect())) == first


def test_failed_run_counts_once(spark, logs, tmp_path, monkeypatch):
    """A run that dies after the history has taken it up, and is resumed."""
    kept, book = FingerprintHistory(spark, str(tmp_path / "history")), RunLedger(spark, str(tmp_path / "runs"))
    update = kept.update
    monkeypatch.setattr(kept, "update", lambda *a: (update(*a), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        run_digest(logs, W, CFG, str(tmp_path / "out"), book, history=kept)
    once = sorted(map(tuple, kept.read().collect()))
    monkeypatch.undo()
    assert run_digest(logs, W, CFG, str(tmp_path / "out"), book, history=kept) is not None
    assert sorted(map(tuple, kept.read().collect())) == once


def test_config_checks():
    link = CFG.link
    for bad in ({"hosts": ()}, {"levels": ()}, {"profile": (("x", "[", ""),)}):
        with pytest.raises(ValueError):
            DigestConfig(**{"hosts": ("h",), "link": link, **bad})
    cfg = DigestConfig(("h",), link, noise_k=0, top_n=0, max_examples=0)
    assert (cfg.noise_k, cfg.top_n, cfg.max_examples) == (1, 20, 3)


def test_sweep(spark, logs, tmp_path):
    """Old reports, delivered runs and fingerprints go; what is open or newer stays."""
    book, kept = RunLedger(spark, str(tmp_path / "runs")), FingerprintHistory(spark, str(tmp_path / "history"))
    assert run_digest(logs, W, CFG, str(tmp_path / "out"), book, history=kept) is not None
    open_run, _ = book.begin(Window(A - timedelta(days=9), A - timedelta(days=8)))
    (tmp_path / "out/reports/notes").mkdir()
    soon, late = datetime.now() + timedelta(days=3), datetime.now() + timedelta(days=40)
    sweep(spark, str(tmp_path / "out"), W.end + timedelta(days=20), book, kept)
    assert book.runs().count() == 2 and kept.read().count() == 5 and (tmp_path / "out/reports/report_date=2025-05-02").exists()
    sweep(spark, str(tmp_path / "out"), soon, book, kept)
    assert book.runs().count() == 2 and kept.read().count() == 0
    assert [p.name for p in (tmp_path / "out/reports").iterdir() if not p.name.startswith(".")] == ["notes"]
    sweep(spark, str(tmp_path / "out"), late, book, kept)
    assert [r["run_id"] for r in book.runs().collect()] == [open_run]
    assert book.begin(W)[1] == "new"  # forgotten, so it can run again


def test_reports_are_replaced_in_place(spark, tmp_path):
    def reports(body):
        return spark.createDataFrame([("h", "2025-05-02", "h.md", body)], "host string, report_date string, file_name string, body string")

    for body in ("first\n", "second, and longer\n", ""):
        write_reports(reports(body), str(tmp_path / "r"))
        files = [p for p in (tmp_path / "r").rglob("*") if p.is_file() and not p.name.startswith(".")]
        assert [p.name for p in files] == ["h.md"] and files[0].read_text().strip() == body.strip()
        # the checksum beside it is that of the new text
        assert [r["value"] for r in spark.read.text(str(files[0])).collect()] == [body.strip()]
