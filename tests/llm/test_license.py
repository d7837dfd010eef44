import random

from brute import license_matches, licenses
from conftest import FOLDER

from emberlog.llm import license, queries

COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels")
TEXTS = [
    None, "", "MIT License", "mit-license MIT\nLICENSE mit license", "the mit  licenses", "licenſe mit", "Mit LicenSe",
    "GNU General Public License, version 3", "lesser general public license", "Kit license mit",
    "licensed under the Apache License, Version 2.0. " * 3, "éMIT license mit license\u00e9 mit\u00a0license",
    "general public general public license", "mit " * 20_000 + "license", "license " * 20_000,
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met", "redistribution source forms modification permitted provided conditions",
]


def test_phrases(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, score string")
    rows = license.scan_licenses(docs).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == licenses(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]][:80]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[15] == "bsd" and labels[16] == "" and labels[8] == "gpl,lgpl"


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op2_license_scan(spark, FOLDER).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows} == {i: licenses(t) for i, t in texts.items()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert license.scan_licenses(docs).count() == 0


def test_rarest_words_elsewhere(spark):
    """A passage without the template's rarest words, which stand far from it."""
    some = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    far = "associated with files of documentation " + "plain prose " * 40
    rows = [(0, far + some)] + [(i, " ".join(reversed(some.split()))) for i in range(1, 5)]
    rows += [(i, "nothing of note") for i in range(5, 40)]
    got = {r["doc_id"]: r for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["labels"] == "mit" and 0.6 < got[0]["score"] < 0.7
    assert all(r["labels"] == "" and r["score"] == 0 for i, r in got.items() if i)


def _damaged(rng, text, share):
    """The text with a share of its words lost, replaced or doubled."""
    out = []
    for w in text.split():
        kind = rng.random()
        out += [w] if kind > share else [[], ["other"], [w, w]][rng.randrange(3)]
    return " ".join(out)


def test_labels_and_score_against_all_alignments(spark):
    """Every alignment of every template: whole, damaged, cut, mixed and
    repeated passages, with license words strewn between them."""
    rng = random.Random(7)
    plain = "the file of plain prose holds public software and a copy of files modification license version".split()
    texts = list(TEXTS[:14]) + [t.text for t in license.TEMPLATES]
    for _ in range(160):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            t = rng.choice(license.TEMPLATES).text
            words = _damaged(rng, t, rng.choice([0, 0.02, 0.05, 0.2])).split()
            a = rng.choice([0, 0, rng.randrange(len(words) // 2 + 1)])
            parts += [" ".join(words[a : a + rng.choice([len(words), len(words) * 2 // 3 + 1])])]
            parts += [" ".join(rng.choices(plain, k=rng.randrange(12)))]
        texts.append(" ".join(parts))
    want = license_matches(texts, license.TEMPLATES, license.MIN_COVER)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, row int, t int")
    got = {r["doc_id"]: r for r in license.scan_licenses(docs).collect()}
    assert len(got) == len(texts)
    hit = 0
    for i, (labels, best) in enumerate(want):
        base = set(filter(None, licenses(texts[i])[4].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == labels | base, texts[i]
        assert abs(got[i]["score"] - (1.0 if base else best)) < 1e-9
        hit += bool(labels)
    assert 60 < hit < len(texts)


def test_looks_up_the_rarest_words(spark):
    """Of a file that holds a whole template, words that cannot make up the
    needed share on their own are not looked up, and these are the lightest."""
    t = license.TEMPLATES[0]
    weight = {w: 10 * (i + 1) for i, w in enumerate(license.VOCABULARY)}
    df = spark.createDataFrame([(sorted(t.places),)], "__present array<string>")
    ask = df.select(license._lookup(0, t, weight).alias("x")).first()["x"]
    rank = license._ranks(weight)
    left = [w for w in t.places if rank[w] < ask["cut"]]
    assert left and sum(weight[w] * len(t.places[w]) for w in left) == ask["rest"] < ask["need"]


def test_one_long_file(spark):
    """A file of many repeated license words and thousands of passages."""
    text = "permission software copy " * 30_000 + license.TEMPLATES[5].text + " . " + "mit license " * 3000
    rows = [(0, text)] + [(i, "nothing of note") for i in range(1, 9)]
    got = {r["doc_id"]: r for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["labels"] == "bsd,mit" and got[0]["n_base"] == 3000
