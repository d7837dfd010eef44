from collections import Counter

import corpus_pipeline
from brute import groups, held_out, kept_lines, leaks, near, simhash, stats, words
from conftest import FOLDER
from pyspark.sql import functions as F
from test_packing import check, ids_of

from emberlog.llm import decontam


def test_stages_against_brute_force(spark):
    """Every stage on its own input; the learned verdicts are held against
    the labels, all else against plain code."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps, frames = dict(corpus_pipeline.STAGES), {"": docs}
    for name, step in list(steps.items())[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, FOLDER))
        assert docs.columns == frames[""].columns
        frames[name] = docs
    texts = {k: {r["doc_id"]: r["text"] for r in f.collect()} for k, f in frames.items()}

    before, after = texts[""], texts["quality_rules"]
    for i, t in before.items():
        s = stats(t)
        assert i not in after or not (s[0] < 10 or 100 * s[4] > 20 * s[0])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [i in after for i in before if labels.get(i) == 1 and held_out(i)]
    assert sum(good) >= 0.9 * len(good)

    before, after = after, texts["line_dedup"]
    kept = kept_lines(before.items())
    want = {}
    for i, t in before.items():
        lines = t.split("\n")
        out = [x for n, x in enumerate(lines) if n in kept[i] or not words(x)]
        if kept[i]:
            want[i] = "\n".join(out)
    assert after == want

    before, after = after, texts["simhash_dedup"]
    prints = {i: simhash(t) for i, t in before.items()}
    roots = groups(prints.values(), near(prints.values()))
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(roots[p], i)
    assert set(after) == set(first.values())

    before, after = after, texts["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    planted = {i for i, t in before.items() if any(x in t for _, x in items)}
    assert planted.isdisjoint(after)
    for i in set(before) - set(after):
        assert leaks(before[i], items, decontam.words_of, decontam.allowed)

    rows = steps["packing"](spark, docs, FOLDER).collect()
    check(rows, Counter((i, tuple(ids_of(t))) for i, t in after.items()))


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id"} <= set(rows[0].asDict())


def test_columns_of_any_name(spark):
    """Names that the stages use themselves are columns like others."""
    odd = ["id", "key", "kept", "rest", "__id", "__key", "__h", "__g", "__gone_id", "__q", "__q_w", "__q_lines", "__q_row", "__leaks",
           "leaks", "fp", "bad", "a.b", "a`b", "__row"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.select("lang", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in odd], "doc_id", "n_chars", "text", "source")
    for name, step in corpus_pipeline.STAGES[:-1]:
        plain = step(spark, docs.select("doc_id", "text"), FOLDER)
        out = step(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(map(tuple, plain.collect())), name
        assert all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in odd), name
