import math
import random

import pytest
from brute import held_out

from emberlog.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.1"


def test_fold():
    assert toxicity.fold("1D10T ІDІОТ sсum t​rash ＳＣＵＭ l0$er") == "idiot idiot scum trash scum loser"
    assert toxicity.fold("Ñandú École") == "ñandú école"


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op1_toxicity(spark, FOLDER).collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r["held_out"] == held_out(i) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in rows.items())
    seen = [(labels[i], rows[i]["predicted"]) for i in labels if i in rows and held_out(i)]
    toxic = [p for t, p in seen if t]
    clean = [p for t, p in seen if not t]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.005 * len(clean)


def sample(spark):
    """Documents with insults of two kinds, and one phrase that is harmless."""
    texts = []
    for i in range(600):
        body = " ".join(f"word{(i * 7 + j) % 50}" for j in range(40))
        kind = i % 6
        text, toxic = (f"{body} you scum", 1) if kind == 0 else (f"{body} trash can", 0) if kind == 1 else (f"{body} trash talk", 1) if kind == 2 else (body, 0)
        texts.append((i, text, toxic))
    docs = spark.createDataFrame([(i, f"{i} {t}", "x") for i, t, _ in texts], "doc_id long, text string, raw string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in texts], "doc_id long, quality int, toxic int")
    return docs, labels, texts


def test_exceptions_and_disguise(spark):
    docs, labels, texts = sample(spark)
    more = [(9001, "hello S C U M", "x"), (9002, "hello ѕсυm 5cum", "x"), (9003, None, "x"), (9004, "", "x"), (9005, "scummy words", "x"), (9006, "scum " * 30_000, "x"), (None, "you scum", "x")]
    rows = toxicity.score_toxicity(docs.union(spark.createDataFrame(more, docs.schema)), labels).collect()
    got = {r["doc_id"]: r for r in rows}
    assert [got[i]["predicted"] for i, _, x in texts] == [x for _, _, x in texts]
    assert got[9002]["hits"] == 2 and got[9002]["predicted"] == 1 and got[None]["predicted"] == 1
    assert got[9001]["score"] == got[9003]["score"] == got[9004]["score"] < 0.5 and got[9006]["predicted"] == 1


@pytest.mark.parametrize("toxic", [0, None])
def test_nothing_to_learn(spark, toxic):
    docs, labels, _ = sample(spark)
    none = spark.createDataFrame([(i, 1, toxic) for i in range(9)], labels.schema)
    rows = toxicity.score_toxicity(docs, none).collect()
    assert len(rows) == 600 and {r["score"] for r in rows} == {0.0} if toxic is None else {r["predicted"] for r in rows} == {0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_order_of_rows_does_not_count(spark):
    """Equal texts with different labels, in any order and partitioning."""
    rng = random.Random(3)
    rows = [(i, f"{'scum' if i % 3 == 0 else 'nice'} words {i % 300}") for i in range(900)]
    marks = [(i, int(i % 3 == 0 and i // 300 == i % 2)) for i in range(900)]
    found = []
    for parts in (1, 7):
        rng.shuffle(rows)
        rng.shuffle(marks)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        labels = spark.createDataFrame(marks, "doc_id long, toxic int").repartition(parts)
        found.append({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) > 1


def test_matcher_against_plain_search(spark):
    """Every start of a word, every entry, every exception, one by one."""
    weights = {"scum": 2.0, "tras*": 1.0, "trash": 3.0, "id*": 0.5, "l": 0.25, "scu*": 4.0}
    excused = ["trash can", "nice scum", "scum of earth"]

    def plain(text):
        low = toxicity.fold(text or "")
        end_of = lambda e: e == len(low) or not low[e].isalpha()
        starts = [i for i in range(len(low)) if not i or not low[i - 1].isalpha()]
        free = [(i, i + len(p)) for i in starts for p in excused if low.startswith(p, i) and end_of(i + len(p))]
        best = {}
        for i in starts:
            for term, weight in weights.items():
                body = term.rstrip("*")
                if low.startswith(body, i) and end_of(i + len(body)) != term.endswith("*"):
                    best[i] = max(best.get(i, (0, 0)), (weight, i + len(body)))
        hits = [w for i, (w, e) in best.items() if not any(a <= i and e <= b for a, b in free)]
        return sum(hits) / math.log2(2 + low.count(" ") + low.count("\n")), len(hits)

    rng = random.Random(8)
    parts = ["scum", "trash", "trashy", "can", "nice", "1d10t", "tra5h", "ѕcum", "scums", "of", "earth", "l", "rascum", "é", "-", "\n", ""]
    texts = [rng.choice([" ", "", "  ", "\n"]).join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["raw"], r["hits"]) for r in toxicity.raw_scores(docs, weights, excused, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        raw, hits = plain(t)
        assert got[i][1] == hits and abs(got[i][0] - raw) < 1e-9, (t, got[i], raw, hits)


def test_counted_documents_without_a_term(spark, monkeypatch):
    """Documents counted together may hold no phrase of the lexicon, or no word."""
    docs, labels, _ = sample(spark)
    docs = docs.union(spark.createDataFrame([(7000 + i, "..." + "!" * i, "x") for i in range(3)], docs.schema))
    labels = labels.union(spark.createDataFrame([(7000 + i, 1, 0) for i in range(3)], labels.schema))
    want = sorted(toxicity.score_toxicity(docs, labels).collect())
    monkeypatch.setattr(toxicity, "COUNTED_DOCS", 1)
    assert sorted(toxicity.score_toxicity(docs, labels).collect()) == want
