from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions.windows import Window, timestamp
from emberlog.plans import ledger, metrics
from emberlog.schema import CYCLE_SCHEMA, LEDGER_SCHEMA

D = datetime(2025, 5, 1, 5)
DAY = Window(D, D + timedelta(days=1))


def test_life_of_a_run(spark, tmp_path):
    book = ledger.RunLedger(spark, str(tmp_path / "runs"))
    run_id, action = book.begin(DAY)
    assert action == "new"
    assert book.begin(DAY) == (run_id, "resume")
    assert ledger.completed_run(book.runs(), DAY).count() == 0
    book.mark_cover_sent(run_id, 77)
    assert book.runs().first()["status"] == "cover_sent"
    assert book.begin(DAY) == (run_id, "resume")
    book.fail(run_id, "no answer")
    row = book.runs().first()
    assert (row["status"], row["err"], row["cover_msg_id"]) == ("failed", "no answer", 77)
    assert row["completed_at"] is not None
    book.finish(run_id, 5)
    assert book.begin(DAY) == (run_id, "skip")
    row = ledger.completed_run(book.runs(), DAY).first()
    assert (row["status"], row["files_sent"], row["window_from"]) == ("done", 5, DAY.start)
    other, action = book.begin(Window(D, D + timedelta(hours=1)))
    assert action == "new" and other != run_id
    assert book.runs().count() == 2


@pytest.fixture(scope="module")
def runs(spark):
    """40 daily runs; every tenth failed, the last is open."""
    events = []
    for i in range(40):
        a, b = D + timedelta(days=i), D + timedelta(days=i + 1)
        events.append((f"r{i}", a, b, "started", b, 2 * i, None, None, None))
        if i < 39:
            ok = i % 10 != 9
            took = timedelta(seconds=4 if i % 2 else 700)
            events.append((f"r{i}", None, None, "done" if ok else "failed", b + took, 2 * i + 1, None, 5 if ok else None,
                           None if ok else "x"))
    return ledger.fold_runs(spark.createDataFrame(events, LEDGER_SCHEMA))


def test_recent(runs):
    assert [r["run_id"] for r in ledger.recent_runs(runs, 3).collect()] == ["r39", "r38", "r37"]
    assert ledger.recent_runs(runs, 0).count() == 10


@pytest.fixture(scope="module")
def cycles(spark):
    """40 days: every tenth cycle failed, every fifth other was partial."""
    rows = []
    for i in range(40):
        at = D + timedelta(days=i)
        outcome = "failed" if i % 10 == 9 else "partial" if i % 5 == 2 else "ok"
        rows.append((at, at + timedelta(days=1), outcome, at, 1.0, 2 if outcome == "partial" else 0))
    return spark.createDataFrame([*rows, (D, D, "skipped", D + timedelta(hours=1), 0.1, 0)], CYCLE_SCHEMA)


def test_outcomes(cycles):
    got = {r["outcome"]: r["cycles"] for r in ledger.cycle_outcomes(cycles).collect()}
    assert got == {"ok": 28, "failed": 4, "partial": 8, "skipped": 1}
    assert ledger.partial_errors(cycles).first()[0] == 16
    assert ledger.partial_errors(cycles.limit(0)).first()[0] == 0


def test_pending(spark, runs):
    candidates = runs.select("window_from", "window_to")
    assert ledger.pending_windows(candidates, runs).count() == 4
    actions = {r["action"]: r["count"] for r in ledger.begin_actions(candidates, runs).groupBy("action").count().collect()}
    assert actions == {"skip": 36, "resume": 4}


def test_retained(runs):
    kept = ledger.retained_runs(runs, timestamp(D + timedelta(days=40)), 30)
    assert kept.filter("status = 'failed'").count() == 3
    assert kept.filter("status = 'done'").count() == 27


def test_success_rate(cycles):
    last = metrics.success_rate(cycles).orderBy(F.col("day").desc()).first()
    assert (last["cycles"], last["succeeded"]) == (28, 25)


def test_failed_share(cycles):
    got = {r["day"].day: r for r in metrics.failed_share(cycles).filter("day < '2025-06-01'").collect()}
    # of days 4 to 10, one failed and one was partial
    assert (got[10]["failed"], got[10]["cycles"], got[10]["is_alert"]) == (2, 7, False)
    assert got[10]["share"] == 2 / 7


def test_latency(runs):
    # of seven durations about half lie in (1, 5] and half in (600, 1200]
    row = metrics.latency_quantile(runs, 0.5, 2).orderBy(F.col("day").desc()).first()
    assert 1 < row["quantile"] <= 1200
    alone = metrics.latency_quantile(runs, 0.5, 1).orderBy("day").collect()
    assert [r["quantile"] for r in alone[:2]] == [900.0, 3.0]


def test_delivery_state(runs):
    last = D + timedelta(days=39, seconds=700)
    fresh = metrics.delivery_state(runs, last + timedelta(hours=30)).first()
    assert fresh["last_success"] is not None and fresh["is_overdue"]
    assert not metrics.delivery_state(runs, last).first()["is_overdue"]
    assert metrics.delivery_state(runs.limit(0), last).first()["is_overdue"]


def test_histogram_quantile_beyond_the_last_edge(spark):
    df = spark.createDataFrame([(9999.0,)], "value double")
    hist = metrics.duration_histogram(df)
    assert [r["cumulative"] for r in hist.orderBy("edge_no").collect()] == [0] * 12 + [1]
    assert metrics.histogram_quantile(hist, 0.95).first()["quantile"] == 3600.0


def test_burn_rate(make_logs):
    rows = []
    for minute in range(120):
        for k in range(10):
            bad = minute >= 60 and k < 5
            rows.append({"event_time": D + timedelta(minutes=minute, seconds=k), "host": "h",
                         "level": "error" if bad else "info", "msg": "x"})
    got = {r["minute"]: r for r in metrics.burn_rate(make_logs(rows)).collect()}
    first = min(m for m, r in got.items() if r["fast_alert"])
    # long share reaches 14.4 % when 18 of 60 minutes are half bad
    assert first == D + timedelta(minutes=60 + 17)
    assert not got[D + timedelta(minutes=59)]["slow_alert"]


def test_two_jobs_begin_one_window(spark, tmp_path):
    """Both see no run; one gets the new one, whichever is first."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    w = Window(datetime(2025, 5, 1), datetime(2025, 5, 2))
    books = [ledger.RunLedger(spark, str(tmp_path / "runs")) for _ in range(4)]
    gate = Barrier(len(books))

    def begin(book):
        claim = book.claims.claim

        def late(*names):
            gate.wait(60)  # all have read the ledger before any claims
            return claim(*names)

        book.claims.claim = late
        return book.begin(w)

    with ThreadPoolExecutor(len(books)) as pool:
        got = list(pool.map(begin, books))
    assert sorted(action for _, action in got) == ["new", "resume", "resume", "resume"] and len({i for i, _ in got}) == 1
    assert [(r["run_id"], r["status"]) for r in ledger.RunLedger(spark, str(tmp_path / "runs")).runs().collect()] == [(got[0][0], "started")]


def test_owner_of_a_claim_died(spark, tmp_path):
    w = Window(datetime(2025, 5, 1), datetime(2025, 5, 2))
    book = ledger.RunLedger(spark, str(tmp_path / "runs"))
    append, book._append = book._append, lambda *a, **k: 1 / 0
    with pytest.raises(ZeroDivisionError):
        book.begin(w)
    book._append = append
    run_id, action = book.begin(w)
    assert action == "resume" and book.runs().first()["run_id"] == run_id
    book.finish(run_id, 1)
    assert book.begin(w)[1] == "skip"
