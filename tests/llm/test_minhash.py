import random

import numpy as np
import pytest
from brute import UPPER, groups, words
from conftest import FOLDER
from oracle_check import canonical, connect

from emberlog.llm import minhash as op, queries


def shingles(text):
    w = words((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(texts):
    """{id: (n, component)}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    linked = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    roots = groups(ids, linked)
    return {i: (len(sets[i]), roots[i]) for i in ids}


def check(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = op.near_duplicates(df).collect()
    want = brute(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want and len(rows) == len(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return want


def family(rng, base, n, most):
    """Variants of a text with words replaced."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_families_and_short_texts(spark):
    rng = random.Random(7)
    texts = []
    for n, length, most in ((60, 150, 10), (40, 40, 3), (30, 400, 30), (30, 12, 1), (20, 5, 1)):
        texts += family(rng, [f"w{rng.randrange(400)}" for _ in range(length)], n, most)
    passage = " ".join(f"p{i}" for i in range(15))
    for _ in range(150):  # a passage in otherwise different texts
        own = [f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(0, 120))]
        texts.append(" ".join([*own[:20], passage, *own[20:]]))
    texts += [None, "", " \n", "one", "ONE", "one two", "é x  y\x0bz", "a b c " * 20_000, "a b c d", "A b  c D"]
    rng.shuffle(texts)
    want = check(spark, dict(enumerate(texts)))
    assert len({c for _, c in want.values()}) < len(texts) - 60


@pytest.mark.parametrize("rows", [3, 1024])
def test_one_large_family(spark, monkeypatch, rows):
    """Most of the rows in a family, with chains outside its main component;
    many blocks give what one gives."""
    monkeypatch.setattr(op, "BLOCK_ROWS", rows)
    monkeypatch.setattr(op, "DENSE", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = family(rng, base, 150, 12)
    far = [f"x{i}" if i % 12 == 0 else w for i, w in enumerate(base)]
    texts += family(rng, far, 30, 5)
    check(spark, dict(enumerate(texts)))


def test_chain_of_links(spark):
    """Neighbours are linked, the ends have nothing in common."""
    check(spark, {i: " ".join(f"w{k}" for k in range(8 * i, 8 * i + 200)) for i in range(40)})


def test_estimate():
    full = np.iinfo(np.uint64).max
    a = np.array([[*range(32)], [*range(32)], [1, 2, 3, *[full] * 29]], np.uint64)
    b = np.array([[*range(32)], [*range(100, 132)], [2, 3, 4, *[full] * 29]], np.uint64)
    assert op._estimated(a, b).tolist() == [True, False, True]


def test_null_ids_repeats_and_columns(spark):
    t = "some words that make a text of more than three shingles"
    df = spark.createDataFrame(
        [(None, t, 1, "x"), (4, t, 2, "y"), (4, t, 3, "z"), (None, "other one", 0, ""), (None, "other one", 0, ""), (None, None, 0, ""), (9, "", 0, "")],
        "doc_id long, text string, n int, c string",
    )
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in op.near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (0, 1, 0, True), (0, 1, 0, True), (0, 9, 4, False), (4, 9, 4, True), (4, 9, 4, True), (9, 0, 9, True)]
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_query_and_its_sql(spark):
    folder = FOLDER.replace("0.001", "0.01")
    got = canonical(queries.op11_minhash_dedup(spark, folder).toPandas())
    want = canonical(connect(folder).execute(queries.SQL["op11_minhash_dedup"]).df())
    assert len(got) == 1000 and got.equals(want) and (got["kept"] == "False").sum() > 20
