import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from brute import words
from conftest import FOLDER
from oracle_check import connect
from pyspark.sql import functions as F

from emberlog.llm import prefixes as op, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """rows: [(conv_id, turn, role, text)] without ties of turn; a set of nodes."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    first = {c: c - int(c % 20 if c >= 0 else -(-c % 20)) for c in own}
    seq = {c: tuple(own.get(first[c], [])[: h[c]] + t[h[c] :]) for c, t in own.items()}
    members = defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(members[p]) - 1) * (len(words(p[-1][1])) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seq[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(tuple(-1 if x is None else x for x in r) for r in op.prefix_trie(df).collect())
    assert got == brute(rows)
    return got


def invented(rng, n, most, texts):
    rows = []
    for c in rng.sample(range(-30, 3 * n), n):
        turns = rng.sample(range(100), rng.randrange(1, most))
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in turns]
    return rows


@pytest.mark.parametrize("container,segment", [(3, 4), (512, 1024)])
def test_against_brute_force(spark, monkeypatch, container, segment):
    """Small containers and segments burst and continue everywhere."""
    monkeypatch.setattr(op, "CONTAINER", container)
    monkeypatch.setattr(op, "SEGMENT", segment)
    rng = random.Random(4)
    rows = invented(rng, 120, 11, ["a b", "a", "", None, "some more words", "é \x0b x"])
    for c in range(1000, 1030):  # one conversation many times, and a common first turn
        rows += [(c, k, "user", f"same {k}") for k in range(6)]
    for c in range(1040, 1070):
        rows += [(c, 0, "user", "same 0"), (c, 1, "user", "same 1"), (c, 2, "x", "same 2"), (c, 3, "user", f"own {c % 7}"), (c, 4, "u", f"{c % 3}")]
    rows += [(2001, None, "user", "null first"), (2001, 0, "user", "then this"), (None, 1, "user", "nobody's"), (2021, 5, "user", "x"), (2041, 5, "user", "x")]
    got = check(spark, rows)
    assert got[-1] and max(r[1] for r in got) >= 9


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 300)
    rows = [(c, k, "user", f"turn {k}" if k < 700 + c else f"turn {k} of {c}") for c in (20, 40, 41) for k in range(1000)]
    check(spark, rows)


def test_turnless_and_empty(spark):
    quiet = next(c for c in range(1, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 1)
    got = check(spark, [(quiet, 0, "user", "its only turn goes")])
    assert [r[:7] for r in got] == [(quiet, 0, -1, 1, 0, 1, 0)]
    assert op.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_ties_repeats_and_columns(spark):
    """Equal turns have one order, whatever the order of rows."""
    rows = [(40, 1, "user", t) for t in "abcabc"] + [(40, None, None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("p", "n", "k1", "depth", "items")})
    one, two = (sorted(map(tuple, op.prefix_trie(x).collect()), key=str) for x in (df, df.repartition(7)))
    assert one == two and len(one) >= 6


def test_query_and_its_sql(spark):
    folder = FOLDER.replace("0.001", "0.01")
    df = queries.op12_conversation_trie(spark, folder)
    found = connect(folder).execute(queries.SQL["op12_conversation_trie"])
    assert df.columns == [c[0] for c in found.description]
    got, want = (sorted(map(tuple, rows), key=str) for rows in (df.collect(), found.fetchall()))
    assert len(got) > 300 and got == want
