import pytest
import random

import numpy as np
from brute import edits, leaks, leaks_of_any_length
from conftest import FOLDER

from emberlog.llm import decontam, queries


def test_query_finds_what_brute_force_finds(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op10_decontamination(spark, FOLDER).collect()}
    assert set(got) == set(texts)
    planted = {i: sorted(k for k, t in items if t in (x or "")) for i, x in texts.items()}
    assert any(planted.values())
    for i, r in got.items():
        assert set(planted[i]) <= set(r["items"]) and r["contaminated"] == (len(r["items"]) > 0)
    # a sample of documents against all windows and items
    some = [i for i in texts if planted[i]][:4] + [i for i in texts if texts[i] and len(texts[i]) < 800][:12]
    for i in some:
        want = leaks(texts[i], items, decontam.words_of, decontam.allowed)
        assert got[i]["items"] == [w[0] for w in want]


def test_edited_passages(spark):
    """Recall on items with up to a fifth of their words edited."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 50)))) for k in range(60)]
    docs, want = [], set()
    for i in range(600):
        k, body = items[i % 60]
        w = body.split()
        for _ in range(rng.randrange(decontam.allowed(len(w)) + 1)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind < 2)] = [] if kind == 0 else [word()]
        docs.append((i, " ".join([word() for _ in range(rng.randrange(60))] + w + [word() for _ in range(60)]).title()))
        found = leaks(docs[-1][1], [(k, body)], decontam.words_of, decontam.allowed)
        want |= {(i, f[0]) for f in found}
    docs += [(1000 + i, " ".join(word() for _ in range(300))) for i in range(50)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], x["item_id"]) for r in decontam.find_leaks(rows, bench).collect() for x in r["leaks"]}
    assert got <= want | {(i, i % 60) for i in range(600)}
    assert len(got & want) >= 0.97 * len(want) > 300
    assert all(i < 1000 for i, _ in got)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    bench = spark.createDataFrame(
        [(1, "one two three four five"), (1, "one two three four five"), (2, None), (None, "a b"), (3, "..."), (4, "Alpha beta")],
        "item_id long, text string",
    )
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "ONE two, three FOUR five", "x"), (3, "ONE two, three FOUR five", "x"), (None, "alpha-beta", "x"), (5, "pad " * 20_000 + "one two zzz four five", "x")],
        "doc_id long, text string, leaks string",
    )
    got = decontam.drop_leaks(docs, bench)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 2]
    report = decontam.leak_report(docs, bench).collect()
    assert {(r["doc_id"], tuple(r["items"]), r["least_distance"]) for r in report} == {
        (1, (), None), (2, (), None), (3, (1,), 0), (None, (4,), 0), (5, (1,), 1)
    }
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == docs.count()
    assert decontam.leak_report(docs.limit(0), bench).count() == 0


def test_edit_distances():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (200, 9)), rng.integers(0, 4, (200, 9))
    assert decontam.edit_distances(a, b).tolist() == [edits(list(x), list(y)) for x, y in zip(a, b)]


def test_embedding_keeps_edits_close():
    """Windows one edit apart share a sample of places far more often than others."""
    rng = np.random.default_rng(3)
    walks = decontam.Walks(30, 5)
    a = rng.integers(0, 1000, (300, 30))
    b = a.copy()
    for row, at in zip(b, rng.integers(0, 29, 300)):
        row[at:-1] = row[at + 1 :]
        row[-1] = 2000
    meet = (walks.keys(a) == walks.keys(b)).any(axis=1).mean()
    other = (walks.keys(a) == walks.keys(np.roll(b, 1, axis=0))).any(axis=1).mean()
    assert meet > 0.98 and other < 0.02


def test_windows_of_any_length():
    """Items with up to a fifth of their words edited, alone, at the ends and
    inside of documents: every leak, with the window that brute force names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(1, 4)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 6, 9, 10, 15, 15, 20, 30])]
    texts = []
    for i in range(330):
        w = items[i % 11][1].split()
        for _ in range(rng.choice([decontam.allowed(len(w)), decontam.allowed(len(w)) + 1])):
            at, kind = rng.randrange(len(w)), rng.choice([0, 0, 1, 2])
            w[at : at + (kind < 2)] = [] if kind == 0 and len(w) > 1 else [word()]
        before, after = rng.choice([(0, 0), (0, 9), (9, 0), (9, 9)])
        texts.append(" ".join([word() for _ in range(before)] + w + [word() for _ in range(after)]))
    index = decontam.Index([(k, decontam.words_of(t)) for k, t in items])
    got = index.leaks([decontam.words_of(t) for t in texts])
    want = [leaks_of_any_length(t, items, decontam.words_of, decontam.allowed) for t in texts]
    assert got == want
    # what windows of the item's own length do not show
    assert sum(len(x) > len(leaks(t, items, decontam.words_of, decontam.allowed)) for x, t in zip(want, texts)) > 30


def test_item_without_one_word(spark):
    body = [f"w{i}" for i in range(15)]
    docs = spark.createDataFrame([(1, " ".join(body[:7] + body[8:])), (2, "other words only")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(body))], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.drop_leaks(docs, bench).collect()] == [2]
    report = {r["doc_id"]: r for r in decontam.leak_report(docs, bench).collect()}
    assert (report[1]["items"], report[1]["least_distance"], report[1]["first_start"]) == ([7], 1, 0)


@pytest.mark.parametrize("n", [5, 15, 30, 45, 59])
def test_recall_of_the_walks(monkeypatch, n):
    """Against the search that compares every place: passages with as many
    edits as allowed, inside documents and at their ends."""
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, [rng.choice(vocabulary) for _ in range(n)]) for k in range(60)]
    texts = []
    for _, body in items * 3:
        w = list(body)
        for _ in range(decontam.allowed(n)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = [rng.choice([*vocabulary, "other"])] * rng.randrange(2)
        ends = [["x"] * rng.randrange(30) for _ in range(2)]
        texts.append([*ends[0], *w, *ends[1]])
    found = decontam.Index(items).leaks(texts)
    monkeypatch.setattr(decontam.Walks, "alike", lambda self, places, low, high, of: np.ones(len(places), bool))
    want = decontam.Index(items).leaks(texts)
    total = sum(map(len, want))
    lost = sum(x not in f for f, w in zip(found, want) for x in w)
    assert total >= 170 and lost <= 0.01 * total and all(x in w for f, w in zip(found, want) for x in f)


def test_places_without_a_window():
    """A chunk at a text's start may put the item so far before it that no
    window begins there; nor does any other place of the batch have one."""
    items = [(1, "a a b b b a a b b a")]
    index = decontam.Index([(k, decontam.words_of(t)) for k, t in items])
    for text in ("b b a a a a a a", "b b a a a a a a a", "b b a b a b a b a b"):
        want = leaks_of_any_length(text, items, decontam.words_of, decontam.allowed)
        assert index.leaks([decontam.words_of(text)]) == [want]
