import pytest
from brute import stats
from conftest import FOLDER

from emberlog.llm import queries, quality

DOCS = "doc_id long, text string, kept string, __w int"
LABELS = "doc_id long, quality int, toxic int"
TEXTS = [
    None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "a a a a a a a a a a a", "x\ny\nx\n\n\nx ", "#$ 5% <b> | é ü\x0b",
    "one two three four five " * 3 + "\n" + "one two three four five", "w " * 30_000, "𝕏 é\u00a0b " * 9,
    " ".join(f"w{i}" for i in range(12)),
]


def test_stats(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], DOCS)
    rows = quality.with_stats(docs).select("doc_id", "kept", "__q.*").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert tuple(r[c] for c in quality.STATS) == stats(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert r["kept"] == "x"


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op9_quality_rules(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        s = stats(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.STATS) == s
        assert r["base_failed"] == (s[0] < 10 or 100 * s[4] > 20 * s[0])
        assert not (r["base_failed"] and r["kept"])


def test_learned_rules(spark):
    """Held-out rows: what is marked bad goes, what is clean stays."""
    good = [(i, " ".join(f"word{i}x{j}" for j in range(40)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{i}x{j}###" for j in range(40)), 0) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t, _ in good + bad], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad if i % 2] + [(5, None, 0), (None, 1, 0)], LABELS)
    kept = {r["doc_id"] for r in quality.drop_low_quality(docs, labels).collect()}
    assert kept == {i for i, _, _ in good}


@pytest.mark.parametrize("quality_of", [None, 1])
def test_nothing_to_learn(spark, quality_of):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(20))), "k", 0), (None, None, "k", 0)] * 2, DOCS)
    labels = spark.createDataFrame([(1, quality_of, 0)], LABELS)
    rows = quality.quality_report(docs, labels).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in rows) == [(0, False)] * 2 + [(1, True)] * 2
    assert quality.drop_low_quality(docs, labels).columns == docs.columns
    assert quality.quality_report(docs.limit(0), labels.limit(0)).count() == 0


def test_list_is_ordered():
    c = quality.Condition(2, True, 0.5)
    assert str(c) == "symbols_per_word > 0.5"
