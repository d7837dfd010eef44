import random

from brute import groups, near, simhash
from conftest import FOLDER
from pyspark.sql import functions as F

from emberlog.llm import graph, queries, simhash as op


def check(rows, texts):
    prints = {i: simhash(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    linked = {(a, b) for a, b in near(prints.values())}
    roots = groups(prints.values(), linked)
    first = {}
    for i, p in prints.items():
        first[roots[p]] = min(i, first.get(roots[p], i))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: first[roots[p]] for i, p in prints.items()}


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    check(queries.op7_simhash_dedup(spark, FOLDER).collect(), texts)


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: " \n", 4: "one", 5: "ONE", 6: "one two", 7: "é x  y\x0bz", 8: "a b c " * 20_000, 9: "a b c"}
    docs = spark.createDataFrame([(i, t, 0, "f") for i, t in texts.items()], "doc_id long, text string, fp int, component_id string")
    check(op.near_duplicates(docs).collect(), texts)
    assert op.near_duplicates(docs.limit(0)).count() == 0
    twice = op.near_duplicates(docs.union(docs)).collect()
    assert len(twice) == 18 and {r["component_id"] for r in twice if r["doc_id"] < 4} == {1}


def test_links_are_complete(spark):
    """Against all pairs, with clusters of flipped bits in all places."""
    rng = random.Random(11)
    values = [rng.getrandbits(64) for _ in range(300)] + [0, 2**64 - 1]
    for v in values[:150]:
        for _ in range(3):
            bits = [rng.randrange(64) for _ in range(rng.randrange(1, 6))]
            if rng.random() < 0.3:  # both bits of a segment
                s = 2 * rng.randrange(32)
                bits = [s, s + 1, rng.randrange(64)]
            values.append(v ^ sum({1 << b for b in bits}))
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {tuple(sorted(r)) for r in op.links(nodes).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3}
    assert got == want and len(want) > 200


def test_keep_one(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (3, "other words here", "fr"), (3, "other words here", "fr")],
        "doc_id long, text string, __gone string",
    ).withColumnRenamed("__gone", "lang")
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_keep_one_by_id_and_text(spark):
    """Rows without an id, and ids with several texts, are judged by row."""
    def kept(rows):
        return sorted(
            ((r["doc_id"], r["text"]) for r in op.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()),
            key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""),
        )

    a, b, c = "a first text of some words", "and a third that is on its own", "quite another one stands here"
    # a copy without an id takes no other row without an id with it
    assert kept([(1, a), (None, a), (None, b), (None, c), (None, c)]) == [(1, a), (None, b), (None, c)]
    # without such a copy, different texts without an id all stay
    assert kept([(1, a), (None, b), (None, c)]) == [(1, a), (None, b), (None, c)]
    # an id whose one text is a copy keeps its other
    assert kept([(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept([(4, a), (4, b), (4, b)]) == [(4, a), (4, b)]
    assert len(kept([(None, None), (None, ""), (2, a)])) == 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)]
    edges += [(500, x) for x in range(501, 540)] + [(9, 9)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == groups(nodes, [e for e in edges if e[0] != e[1]])
    assert graph.components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).count() == 0
