"""License scans: a positional index of rare license words.

Templates are indexed as postings (word, template, place). Each text becomes,
in its own row, the list of its license words with their positions; document
frequencies over the whole corpus (at most one row per word of the vocabulary)
rank them. A file looks up its highest-IDF license words: as many as are needed
until the others cannot reach the share of a template that has to agree. The
postings found are intersected by relative position, place of the word in the
text less its place in the template; what their common weight cannot rule out is
verified word by word, with all of the mandatory key phrase in place. The look-up
loses no alignment, whatever the length of a text.

Only files that hold all words of a key phrase, and enough of its template, are
looked up; of the others nothing is shuffled.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import stage, text_or_empty

#: what separates words, for either case of A-Z
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: phrases that count wherever their words stand one after the other
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    #: words too common to be worth a posting; they leave gaps
    skip: str = "a an and any as be by for in is it of on or that the this to under with you your"

    @property
    def words(self) -> list[str | None]:
        return [None if w in self.skip.split() else w for w in self.text.split()]

    @property
    def places(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            if w:
                out.setdefault(w, []).append(i)
        return out

    @property
    def key_places(self) -> list[int]:
        words, key = self.text.split(), self.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return [i for i in range(at, at + len(key)) if self.words[i]]


TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files", "permission is hereby granted"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "licensed under the gnu general public license version", "general public license"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", "source and binary forms"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc", "licensed under a creative commons attribution license", "creative commons"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "unencumbered software released"),
    # whole texts
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction including without "
             "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
             "software and to permit persons to whom the software is furnished to do so subject to the following "
             "conditions the above copyright notice and this permission notice shall be included in all copies or "
             "substantial portions of the software the software is provided as is without warranty of any kind express "
             "or implied including but not limited to the warranties of merchantability fitness for a particular purpose "
             "and noninfringement", "without restriction including without limitation"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and "
             "the following disclaimer redistributions in binary form must reproduce the above copyright notice this list "
             "of conditions and the following disclaimer in the documentation and or other materials provided with the "
             "distribution", "binary form must reproduce"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
             "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
             "without fee"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the "
             "license at unless required by applicable law or agreed to in writing software distributed under the license "
             "is distributed on an as is basis without warranties or conditions of any kind either express or implied",
             "writing software distributed"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
             "general public license as published by the free software foundation either version 3 of the license or at "
             "your option any later version", "free software foundation"),
)

VOCABULARY = sorted({w for t in TEMPLATES for w in t.words if w} | {w for _, p in BASE for w in p.split()})

#: percentage of a template's weight that has to agree
MIN_COVER = 60


def license_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, number of words, license words with positions (from 0)."""
    words = F.array_remove(F.split(text_or_empty(text), BETWEEN), "")

    def is_hit(x: Column) -> Column:
        # signs that only lower-case to ASCII, such as the Kelvin sign, are longer in UTF-8
        return F.lower(x["w"]).isin(*VOCABULARY) & (F.octet_length(x["w"]) == F.octet_length(F.lower(x["w"])))

    rows = docs.select(id_col, words.alias("__w"))
    found = F.filter(F.transform("__w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), is_hit)
    return rows.select(
        id_col, F.size("__w").cast("long").alias("n_words"),
        F.transform(found, lambda x: F.struct(F.lower(x["w"]).alias("w"), x["i"].alias("i"))).alias("hits"),
    )


def idf(rows: DataFrame) -> dict[str, int]:
    """Weight of every word of the vocabulary, in millionths, at least 1;
    bounded by the vocabulary. Whole numbers, so that sums have one value."""
    n = rows.count()
    seen = rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w"))
    df = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: max(1, round(1e6 * math.log((n + 1) / (df.get(w, 0) + 1)))) for w in VOCABULARY}


def _phrase_starts(phrase: str, weight: dict[str, int]) -> Column:
    """Starts of the phrase, from the places of its rarest word.

    All words of the phrase belong to the vocabulary, so words that follow one
    another in the text also do so in the list of hits."""
    words = phrase.split()
    p = max(range(len(words)), key=lambda j: (weight[words[j]], -j))
    hits = F.col("hits")
    look = F.filter(
        F.transform(hits, lambda h, k: F.struct(h["w"].alias("w"), h["i"].alias("i"), k.alias("k"))),
        lambda x: x["w"] == words[p],
    )

    def stands(x: Column) -> Column:
        tests = []
        for j, w in enumerate(words):
            at = x["k"] + (j - p)
            y = F.when(at >= 0, F.get(hits, at))
            tests.append(F.coalesce((y["w"] == w) & (y["i"] == x["i"] + (j - p)), F.lit(False)))
        return reduce(lambda a, b: a & b, tests)

    return F.transform(F.filter(look, stands), lambda x: x["i"] - p)


def _total(t: Template, weight: dict[str, int]) -> int:
    return sum(weight[w] * len(at) for w, at in t.places.items())


def postings(spark: SparkSession, weight: dict[str, int], templates=TEMPLATES) -> DataFrame:
    """The index: (t, w, p, weight, rank, key), a row per word of a template.
    ``rank`` orders the words by weight. Bounded by the templates."""
    rank = _ranks(weight)
    rows = [
        (number, w, p, weight[w], rank[w], int(p in t.key_places))
        for number, t in enumerate(templates) for w, at in t.places.items() for p in at
    ]
    names = ("t", "w", "p", "weight", "rank", "key")
    text = json.dumps([dict(zip(names, r)) for r in rows])
    parsed = F.from_json(F.lit(text), "array<struct<t:int,w:string,p:int,weight:long,rank:int,key:int>>")
    return spark.range(1).select(F.inline(parsed))


def _ranks(weight: dict[str, int]) -> dict[str, int]:
    return {w: i for i, w in enumerate(sorted(weight, key=lambda w: (weight[w], w)))}


def _lookup(number: int, t: Template, weight: dict[str, int]) -> Column:
    """What a file has to look up for a template: (t, need, rest, cut), null if
    it lacks a word of the key phrase or too much weight.

    From its lightest words on, a file's words of the template are left out while
    their weight stays below what is needed; ``rest`` is the weight left out and
    ``cut`` the rank of the first word to look up. Any alignment that agrees
    enough has a word from there on in place."""
    rank = _ranks(weight)
    total = _total(t, weight)
    words = sorted(t.places, key=rank.get)
    listed = F.from_json(
        F.lit(json.dumps([{"w": w, "r": rank[w], "s": weight[w] * len(t.places[w])} for w in words])),
        "array<struct<w:string,r:int,s:long>>",
    )
    need = F.lit(-(-MIN_COVER * total // 100)).cast("long")
    held = F.filter(listed, lambda x: F.array_contains("__present", x["w"]))
    start = F.struct(F.lit(0).cast("long").alias("rest"), F.lit(None).cast("int").alias("cut"))

    def add(done: Column, x: Column) -> Column:
        short = done["cut"].isNull() & (done["rest"] + x["s"] < need)
        return F.struct(
            F.when(short, done["rest"] + x["s"]).otherwise(done["rest"]).alias("rest"),
            F.when(short, F.lit(None).cast("int")).otherwise(F.coalesce(done["cut"], x["r"])).alias("cut"),
        )

    asked = F.aggregate(held, start, add)
    whole = [F.array_contains("__present", w) for w in sorted({t.words[i] for i in t.key_places})]
    return F.when(
        reduce(lambda a, b: a & b, whole),
        F.transform(F.array(asked), lambda x: F.when(x["cut"].isNotNull(), F.struct(
            F.lit(number).alias("t"), need.alias("need"), x["rest"].alias("rest"), x["cut"].alias("cut"),
        )))[0],
    )


def matches(rows: DataFrame, weight: dict[str, int], templates=TEMPLATES) -> DataFrame:
    """Alignments (row, t, cover): at least MIN_COVER of the template's weight
    in place, among it the whole key phrase. ``rows`` has (row, hits)."""
    index = F.broadcast(postings(rows.sparkSession, weight, templates))
    present = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    asks = F.array_compact(F.array(*[_lookup(i, t, weight) for i, t in enumerate(templates)]))
    asking = (
        rows.where(F.size("hits") > 0).withColumn("__present", present)
        .select("row", "hits", asks.alias("asks")).where(F.size("asks") > 0)
    )
    asking = stage(asking)
    looked = (
        asking.select("row", "hits", F.inline("asks")).select("row", "t", "need", "rest", "cut", F.inline("hits"))
        .join(index, ["t", "w"]).where(F.col("rank") >= F.col("cut"))
    )
    # the rest could still agree with all of its weight
    found = stage(
        looked.groupBy("row", "t", "need", "rest", (F.col("i") - F.col("p")).alias("at")).agg(F.sum("weight").alias("s"))
        .where(F.col("s") + F.col("rest") >= F.col("need")).select("row", "t", "need", "at")
    )
    expected = found.join(index, "t").select("row", "t", "need", "at", (F.col("at") + F.col("p")).alias("i"), "w", "weight", "key")
    there = asking.join(found.select("row").distinct(), "row", "left_semi").select("row", F.inline("hits"))
    totals = F.array(*[F.lit(_total(t, weight)).cast("long") for t in templates])
    keys = F.array(*[F.lit(len(t.key_places)) for t in templates])
    return (
        expected.join(there, ["row", "i", "w"])
        .groupBy("row", "t", "need", "at").agg(F.sum("weight").alias("s"), F.sum("key").alias("k"))
        .where((F.col("s") >= F.col("need")) & (F.col("k") == F.get(keys, F.col("t"))))
        .select("row", "t", (F.col("s") / F.get(totals, F.col("t"))).alias("cover"))
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """License labels of every row.

    ``score`` is 1 with a base phrase, else the largest share of a template's
    weight that an accepted alignment has in place, else 0. Null text counts as
    empty: no words, no labels, score 0. Rows are judged one by one, so repeated
    ids and rows give repeated results; other columns are not used; no rows give
    none. Texts of any length take time in proportion to their words.
    """
    rows = stage(license_words(docs, id_col, text).withColumn("row", F.monotonically_increasing_id()))
    weight = idf(rows)
    labels = F.array(*[F.lit(t.label) for t in templates])
    # bounded by the templates
    best = matches(rows.select("row", "hits"), weight, templates).groupBy("row").agg(
        F.collect_set(F.get(labels, F.col("t"))).alias("more"), F.max("cover").alias("cover")
    )
    named = [(label, _phrase_starts(phrase, weight)) for label, phrase in BASE]
    some = F.size("hits") > 0
    found = rows.select(
        "row", F.col(id_col).alias("__id"), "n_words",
        *[F.when(some, c).otherwise(F.array().cast("array<int>")).alias(f"__b_{x}") for x, c in named],
    ).join(best, "row", "left")
    starts = F.concat(*[F.col(f"__b_{x}") for x, _ in BASE])
    base = F.array_compact(F.array(*[F.when(F.size(f"__b_{x}") > 0, F.lit(x)) for x, _ in BASE]))
    more = F.coalesce(F.col("more"), F.array().cast("array<string>"))
    n = F.size(starts).cast("long")
    return found.select(
        F.col("__id").alias(id_col), "n_words", n.alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
