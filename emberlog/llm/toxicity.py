"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first (case, homoglyphs, digits that stand for letters). The
lexicon, its weights, the exception phrases and the calibration are learned
from a bounded sample of labelled rows; all texts are then scored in one pass
without a shuffle. What is sent to the tasks is bounded by LEXICON and
EXCEPTIONS entries.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import stage

# workers need not be able to import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: labelled rows the model is fitted on, at most
SAMPLE_ROWS = 20_000
#: entries of the lexicon and of the exception phrases, at most
LEXICON, EXCEPTIONS = 2_000, 2_000
#: evidence an entry needs: log-likelihood ratio, lift over the base rate, toxic documents
MIN_LLR, MIN_LIFT, MIN_DOCS = 30.0, 2.5, 5
#: lengths of word starts that may be entries, next to whole words
STARTS = range(4, 8)
#: documents whose terms are counted together
COUNTED_DOCS = 512
TOXIC_FROM = 0.7

# fixed values: signs that stand for Latin letters
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
DROPPED = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

_TABLE = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {ord(x): None for x in DROPPED} | {
    0xFF21 + i: chr(97 + i) for i in range(26)  # full-width letters
} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_SIGNS = re.compile(r"[013457@$" + DROPPED + "".join(HOMOGLYPHS) + "\uff21-\uff5a]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    low = text.lower()
    return low.translate(_TABLE) if _SIGNS.search(low) else low


def _llr(a: int, b: int, pos: int, neg: int) -> float:
    """Log-likelihood ratio of a word in a of pos toxic and b of neg other documents."""
    n, total = a + b, 0.0
    for seen, expected in (
        (a, n * pos / (pos + neg)), (b, n * neg / (pos + neg)),
        (pos - a, (pos + neg - n) * pos / (pos + neg)), (neg - b, (pos + neg - n) * neg / (pos + neg)),
    ):
        if seen > 0:
            total += seen * math.log(seen / expected)
    return 2 * total


def _weight(a: int, b: int, pos: int, neg: int) -> float:
    return math.log((a + 0.5) / (pos - a + 0.5)) - math.log((b + 0.5) / (neg - b + 0.5))


def _terms(words: set[str]) -> list[str]:
    """Words, and starts of longer words marked by a star."""
    return [*words, *{w[:n] + "*" for w in words for n in STARTS if n < len(w)}]


def _phrases(words: list[str], lexicon: set[str]) -> set[str]:
    """Word pairs that hold a word of the lexicon."""
    found = [w in lexicon or any(w[:n] + "*" in lexicon for n in STARTS if n < len(w)) for w in words]
    return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], found, found[1:]) if x or y}


def _counted(rows: DataFrame, lexicon: set[str] | None) -> DataFrame:
    """(term, a, b): toxic and other documents with the term; summed over
    COUNTED_DOCS documents before the shuffle."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), COUNTED_DOCS):
                part = frame.iloc[at : at + COUNTED_DOCS]
                counts = (Counter(), Counter())
                for text, toxic in zip(part["text"], part["toxic"]):
                    words = _WORD.findall(fold(text))
                    counts[0 if toxic else 1].update(_terms(set(words)) if lexicon is None else _phrases(words, lexicon))
                terms = list(counts[0].keys() | counts[1].keys())
                if terms:  # the columns of an empty frame would not have the types named below
                    yield pd.DataFrame({
                        "term": terms, "a": [counts[0][t] for t in terms], "b": [counts[1][t] for t in terms]
                    })

    parts = rows.select("text", "toxic").mapInPandas(task, "term string, a bigint, b bigint")
    return parts.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def raw_scores(docs: DataFrame, weights: dict[str, float], exceptions: list[str], keep: list[str]) -> DataFrame:
    """Columns ``keep`` plus ``raw`` (weight of the hits over the logarithm of
    the length) and ``hits`` (number of lexicon words found)."""
    entries, excused = dict(weights), list(exceptions)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        # per text: weight of the word, weight of the start, whether it is an exception
        table: dict[str, list] = {}
        for term, weight in entries.items():
            table.setdefault(term.rstrip("*"), [None, None, False])[term.endswith("*")] = weight
        for phrase in excused:
            table.setdefault(phrase, [None, None, False])[2] = True
        automaton = ahocorasick.Automaton()
        for term, kinds in table.items():
            automaton.add_word(term, (len(term), *kinds))
        if len(automaton):
            automaton.make_automaton()

        def judge(text: str) -> tuple[float, int]:
            if not text or not len(automaton):
                return 0.0, 0
            low = fold(text)
            hits: dict[int, tuple[int, float]] = {}
            free = []
            for end, (size, word, start_of, excuse) in automaton.iter(low):
                start = end - size + 1
                if start and low[start - 1].isalpha():
                    continue  # inside a longer word
                ends = end + 1 == len(low) or not low[end + 1].isalpha()
                weight = word if ends else start_of
                # of the entries that fit a word the strongest counts
                if weight is not None and (start not in hits or weight > hits[start][1]):
                    hits[start] = (end, weight)
                if excuse and ends:
                    free.append((start, end))
            if free and hits:
                free.sort()
                at, reach = 0, -1
                for start in sorted(hits):
                    while at < len(free) and free[at][0] <= start:
                        reach = max(reach, free[at][1])
                        at += 1
                    if hits[start][0] <= reach:
                        del hits[start]
            total = sum(w for _, w in hits.values())
            return total / math.log2(2 + low.count(" ") + low.count("\n")), len(hits)

        for frame in frames:
            found = [judge(t) for t in frame.pop("text")]
            yield frame.assign(raw=[f[0] for f in found], hits=[f[1] for f in found])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInPandas(
        task, f"{schema}, raw double, hits bigint"
    )


class Calibration:
    """Monotone map of raw scores to probabilities."""

    def __init__(self, points: list[tuple[float, float]], base: float) -> None:
        self.points, self.base = points, base

    @classmethod
    def fit(cls, bins: list[tuple[float, int, int]], base: float) -> Calibration:
        """bins: (raw, toxic, other), pooled until the rates ascend."""
        pools: list[list] = []
        for raw, a, b in sorted(bins):
            pools.append([raw, a, b])
            while len(pools) > 1 and _rate(pools[-2]) >= _rate(pools[-1]):
                last = pools.pop()
                pools[-1][1] += last[1]
                pools[-1][2] += last[2]
        return cls([(p[0], _rate(p)) for p in pools], base)

    def column(self, raw: Column) -> Column:
        out = F.lit(float(self.points[0][1] if self.points else self.base))
        for at, rate in self.points[1:]:
            out = F.when(raw >= at, F.lit(rate)).otherwise(out)
        return out


def _rate(pool: list) -> float:
    return (pool[1] + 0.05) / (pool[1] + pool[2] + 0.5)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every row; higher means toxic is likelier.

    The model is fitted on at most SAMPLE_ROWS labelled documents, those with
    the smallest hash of their id, none of them with crc32(id) mod 3 = 1.
    Several labels of a document, or of equal texts, count as the highest; null
    labels as none.
    Without a toxic label the lexicon is empty and all rows score the base
    rate. Null texts count as empty and score like texts without a hit.
    Repeated rows and ids are scored one by one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    held_out = F.coalesce(third == 1, F.lit(False))
    known = (
        labels.where(F.col("toxic").isNotNull() & (third != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    )
    # at most SAMPLE_ROWS rows of two numbers: small enough to send everywhere
    sample = stage(
        rows.where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    )
    pos, n = sample.agg(F.sum("toxic"), F.count("*")).first()
    pos, neg = pos or 0, n - (pos or 0)
    weights, excused = {}, []
    if pos and neg:
        counts = _counted(sample, None)
        strong = counts.where((F.col("a") >= MIN_DOCS) & (F.col("a") * n >= MIN_LIFT * pos * (F.col("a") + F.col("b"))))
        # by the largest counts first, so that what reaches the driver is bounded
        top = strong.orderBy(F.desc(F.col("a") * F.col("a") / (F.col("a") + F.col("b"))), "term").limit(LEXICON).collect()
        weights = {r["term"]: _weight(r["a"], r["b"], pos, neg) for r in top if _llr(r["a"], r["b"], pos, neg) >= MIN_LLR}
    if weights:
        pairs = _counted(sample, set(weights)).where((F.col("b") >= MIN_DOCS) & (F.col("b") * pos >= 2 * F.col("a") * neg))
        excused = [r["term"] for r in pairs.orderBy(F.desc("b"), "term").limit(EXCEPTIONS).collect()]
    step = F.least(F.floor(F.col("raw") * 10), F.lit(400)) / 10
    bins = raw_scores(sample, weights, excused, ["toxic"]).groupBy(step.alias("r")).agg(
        F.sum("toxic").alias("a"), F.count("*").alias("n")
    ).collect()
    base = pos / n if n else 0.0
    curve = Calibration.fit([(float(b["r"]), int(b["a"]), int(b["n"] - b["a"])) for b in bins], base)
    score = curve.column(F.col("raw"))
    return raw_scores(rows, weights, excused, ["doc_id"]).select(
        F.col("doc_id").alias(id_col), held_out.alias("held_out"), score.alias("score"),
        (score >= TOXIC_FROM).cast("int").alias("predicted"), "hits",
    )
