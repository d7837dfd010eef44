import hashlib
import random

import pandas as pd
from brute import repeats
from conftest import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import queries, substrings


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=60).map(str.encode), st.text("abc", max_size=9).map(lambda s: s.encode() * 5)))
def test_suffix_array(text):
    assert substrings.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_smallest_owners():
    rng = random.Random(5)
    segments = [("".join(rng.choice("ab") for _ in range(rng.randrange(8, 30))).encode(), rng.randrange(20)) for _ in range(60)]
    got = substrings.smallest_owners(segments, 8)
    for (text, _), own in zip(segments, got):
        for p, x in enumerate(own):
            assert x == min(i for t, i in segments if text[p : p + 8] in t)


def rows_of(found):
    return sorted(
        (r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found
    )


def expected(docs, size=50):
    return sorted((i, n, cut, runs, hashlib.sha256(rest).hexdigest()) for i, n, cut, runs, rest in repeats(docs, size))


def test_query(spark):
    docs = [(r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = rows_of(queries.op6_suffix_dedup(spark, FOLDER).collect())
    assert got == expected(docs)
    assert sum(r[2] for r in got) > 0


def test_near_copies_and_passages(spark, monkeypatch):
    """Copies with edits, shared passages, periodic texts, many small blocks."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(substrings, "SORT_BYTES", 3000)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    base, passage = [word() for _ in range(300)], " ".join(word() for _ in range(30))
    texts = [None, "", "x" * 49, "x" * 50, "x" * 400, "ab" * 300, "ab" * 200]
    for _ in range(40):
        copy = list(base[rng.randrange(100) : 200 + rng.randrange(100)])
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
        texts.append(" ".join(word() for _ in range(20)) + passage + word())
    rows = list(enumerate(texts)) + [(7, texts[7]), (8, texts[9]), (None, texts[11])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    got = rows_of(substrings.remove_repeats(docs).collect())
    # a null id is smaller than all others
    assert got == expected([(-1 if i is None else i, (t or "").encode()) for i, t in rows])


def test_kept_text_and_empty_table(spark):
    docs = spark.createDataFrame([(2, "A" * 60 + "tail"), (1, "A" * 60)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in substrings.remove_repeats(docs, with_text=True).collect()}
    assert got == {1: b"A" * 60, 2: b"tail"}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_hot_anchor_is_split(spark, monkeypatch):
    """A passage that all documents share, each with borders of its own."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", 20, raising=False)
    monkeypatch.setattr(substrings, "SOME_SEGMENTS", 2, raising=False)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    passage, borders = "".join(word() for _ in range(30)), [word() for _ in range(40)]
    texts = ["".join([word(), word(), rng.choice(borders), passage, rng.choice(borders), word()]) for _ in range(200)]
    texts += ["ab" * 200, "ab" * 150, "x" * 60, ""]
    rows = list(enumerate(texts)) + [(7, texts[9]), (8, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(substrings.remove_repeats(docs).collect()) == expected([(i, t.encode()) for i, t in rows])

    buckets = 2
    raw = docs.selectExpr("doc_id", "cast(text as binary) AS text")
    blocks = substrings._blocks(raw, buckets, 50).toPandas()
    shared = pd.concat([substrings._answer_shared(f) for _, f in blocks[blocks["bucket"] >= 0].groupby("bucket")])
    met: dict[int, set] = {}
    for _, frame in pd.concat([blocks[blocks["bucket"] == -1], shared]).groupby("block"):
        sent = substrings._send_segments(buckets, 50)(frame)
        for b, data in zip(sent["bucket"], sent["data"]):
            if 0 <= b < buckets:
                _, anchor, _, segments = substrings._unpacked(data)
                for k, t in zip(anchor.tolist(), segments):
                    met.setdefault(k, set()).add(t)
    assert max(map(len, met.values())) < 40
