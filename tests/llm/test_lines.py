import random

from brute import kept_lines, words
from conftest import FOLDER

from emberlog.llm import lines, queries


def check(rows, texts):
    want = kept_lines(texts.items())
    assert {r["doc_id"]: r["kept_lines"] for r in rows} == want
    for r in rows:
        n = sum(bool(words(x)) for x in (texts[r["doc_id"]] or "").split("\n"))
        assert (r["n_lines"], r["n_removed"]) == (n, n - len(want[r["doc_id"]]))


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = [r.asDict() for r in queries.op8_line_dedup(spark, FOLDER).collect()]
    check([r | {"kept_lines": [int(n) for n in r["kept_lines"].split(",") if n]} for r in rows], texts)


def test_edits(spark):
    """Copies of lines with words replaced, added, deleted and moved."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 14))] for _ in range(40)]
    texts = {0: None, 1: "", 2: " \n\t\n", 3: "a b c d e\n  a  b c\td e \n\nx", 4: "x\nx", 5: "one two three four"}
    for i in range(6, 60):
        body = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(line))
                kind = rng.randrange(3)
                line[at : at + (kind < 2)] = [] if kind == 0 and len(line) > 1 else [f"w{rng.randrange(12)}"]
            body.append(" ".join(line))
        texts[i] = "\n".join(body)
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in texts.items()], "doc_id long, text string, n int, line string")
    check(lines.line_report(docs).collect(), texts)


def test_slots_do_not_reach_across(spark):
    """Equal variants from different places are two edits apart."""
    texts = {1: "x a b c d e f", 2: "a b c d e f y", 3: "a b c d e f"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(lines.line_report(docs).collect(), texts)


def test_documents(spark):
    long = "\n".join(f"line number {i} of a long text with {i}{i} words" for i in range(3000))
    rows = [
        (1, "keep this line here please\n\nshort", "en", 34), (2, "keep this line here please", "en", 26),
        (3, "keep this line here again\nnew", "en", 29), (4, None, "en", None), (5, "", "en", 0), (6, long, "de", len(long)),
        (7, "twice", "fr", 5), (7, "twice", "fr", 5), (None, "no id", "fr", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = lines.drop_repeated_lines(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    kept = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()), key=str)
    assert [k for k in kept if k[0] != 6] == sorted([
        (0, "no id", 5), (1, "keep this line here please\n\nshort", 33), (3, "new", 3), (4, None, None), (5, "", 0),
        (7, "twice", 5), (7, "twice", 5),
    ], key=str)
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0
    assert lines.line_report(docs.limit(0)).count() == 0
