"""Quality rules: a decision list learned by sequential covering.

Text statistics are plain column expressions, computed once per row without a
shuffle. The list is learned from labelled statistics: every step of growing
or pruning a rule is one aggregation into counts by feature and bin, so the
driver only ever sees a table of features x bins, whatever the input size.
The result is an ordered conditional expression that needs no further data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import SPACE, each_word, others_aside, stage, text_or_empty

#: symbols whose density marks junk
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
#: percent of words in repeated windows that the base rule lets pass
MAX_REPEAT = 20

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_marks", "n_distinct")
FEATURES = (
    "n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "marks_per_word",
    "distinct_share",
)


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at the sorted ``starts``."""
    steps = F.zip_with(
        starts, F.slice(starts, 2, F.size(starts)),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def with_stats(docs: DataFrame, text: str = "text", out: str = "__q") -> DataFrame:
    """All columns plus struct ``out`` of the text statistics.

    Null text counts as empty: all statistics are zero. Every row is judged on
    its own, so repeated rows and ids give repeated results.
    """
    w, lines, grams, pairs, starts = (f"{out}_{x}" for x in ("w", "lines", "grams", "pairs", "starts"))
    t = text_or_empty(text)
    keep = docs.columns
    words = F.col(w)
    n = F.size(words)
    step = docs.select(*keep, each_word(t).alias(w), F.split(t, "\n").alias(lines))
    gram = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )
    step = step.select(
        *keep, w,
        F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
        F.when(n >= WINDOW, gram).alias(grams),
    )
    g = F.col(grams)
    # only texts that do repeat a window are sorted
    step = step.select(
        *keep, w, lines,
        F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias(pairs),
    )
    p = F.col(pairs)

    def same(x: Column, i: Column, by: int) -> Column:
        return F.coalesce(F.when(i + by >= 0, F.get(p, i + by)["h"]) == x["h"], F.lit(False))

    twice = F.filter(p, lambda x, i: same(x, i, -1) | same(x, i, 1))
    step = step.select(*keep, w, lines, F.sort_array(F.transform(twice, lambda x: x["i"])).alias(starts))
    full = F.col(lines)
    stats = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col(starts)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(full).cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("[!?]")).cast("long").alias("n_marks"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
    )
    return step.select(*keep, stats.alias(out))


def base_failed(q: str = "__q") -> Column:
    s = F.col(q)
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"])


def features(q: str = "__q") -> list[Column]:
    """The statistics as the learned rules see them, in the order of FEATURES."""
    s = F.col(q)

    def per(a: str, b: str) -> Column:
        return F.when(s[b] > 0, s[a] / s[b]).otherwise(0.0)

    return [
        s["n_words"].cast("double"), per("word_chars", "n_words"), per("n_symbols", "n_words"),
        per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_upper", "word_chars"),
        per("n_marks", "n_words"), per("n_distinct", "n_words"),
    ]


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def column(self, q: str) -> Column:
        value = features(q)[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class DecisionList:
    """Ordered reject rules; what no rule rejects is kept."""

    rules: tuple[Rule, ...]

    def reason(self, q: str = "__q") -> Column:
        """First rule that fires as text, null if none does."""
        out = F.when(base_failed(q), F.lit("base"))
        for rule in self.rules:
            fires = reduce(lambda a, b: a & b, [c.column(q) for c in rule])
            out = out.when(fires, F.lit(" and ".join(map(str, rule))))
        return out

    def kept(self, q: str = "__q") -> Column:
        return self.reason(q).isNull()


def _binned(stats: DataFrame, q: str, bins: int) -> tuple[DataFrame, list[list[float]]]:
    """Rows (bad, grow, bins) and each feature's thresholds."""
    cols = [f"f{i}" for i in range(len(FEATURES))]
    rows = stats.select("bad", "grow", *[c.alias(n) for c, n in zip(features(q), cols)])
    at = [i / bins for i in range(1, bins)]
    # a reject rule lives in the tails of the bad rows as well as of the good ones
    cuts: list[list[float]] = [[] for _ in cols]
    for r in rows.groupBy("bad").agg(*[F.percentile_approx(c, at, 10000).alias(c) for c in cols]).collect():
        cuts = [sorted({*cut, *(r[c] or ())}) for cut, c in zip(cuts, cols)]
    index = [_bin(c, cut) for c, cut in zip(cols, cuts)]
    return stage(rows.select("bad", "grow", F.array(*index).alias("bins"))), cuts


def _bin(value: str, cuts: list[float]) -> Column:
    """Number of thresholds below the value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(value)))


def _inside(feature: int, above: bool, cut: int) -> Column:
    """The binned form of a condition: value > cuts[cut] means bin > cut."""
    b = F.col("bins")[feature]
    return b > cut if above else b <= cut


def learn(
    stats: DataFrame, q: str = "__q", bins: int = 24, max_rules: int = 8, max_conditions: int = 3,
    min_precision: float = 0.9, min_share: float = 0.002,
) -> DecisionList:
    """Decision list from rows (``bad`` int 0/1, ``grow`` boolean, struct ``q``).

    Sequential covering: each rule is grown on the grow rows by information
    gain, one condition at a time, then shortened to the prefix that does best
    on the other rows, and kept if at least ``min_precision`` of what it
    rejects there is bad. Rows it covers leave the training set; the next rule
    is learned from the rest. No bad rows, or no labels at all, give an empty
    list. Rows that fail the base rules are not learned from.
    """
    rows, cuts = _binned(stats.where(~base_failed(q)).where(F.col("bad").isNotNull()), q, bins)
    found: list[Rule] = []
    left = F.lit(True)
    total_bad = rows.where("bad = 1").count()
    least = max(5, math.ceil(min_share * total_bad))
    for _ in range(max_rules if total_bad else 0):
        rest = rows.where(left)
        grown: list[tuple[int, bool, int]] = []
        covered = rest
        while len(grown) < max_conditions:
            best = _best_condition(covered.where("grow"), cuts, least, grown)
            if best is None:
                break
            grown.append(best[0])
            covered = covered.where(_inside(*best[0]))
            if best[1] >= 0.999:
                break
        if not grown:
            break
        size = _shortened(rest.where(~F.col("grow")), grown, min_precision, least)
        if not size:
            break
        rule = grown[:size]
        found.append(tuple(Condition(f, above, cuts[f][cut]) for f, above, cut in rule))
        left = left & ~reduce(lambda a, b: a & b, [_inside(*c) for c in rule])
    return DecisionList(tuple(found))


def _best_condition(rows: DataFrame, cuts: list[list[float]], least: int, used: list):
    """Condition with the highest gain on ``rows`` and its precision."""
    counts = (
        rows.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b")
        .agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
    )
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    if not by:
        return None
    p0, n0 = (sum(x[i] for x in by[0].values()) for i in (0, 1))
    if not p0 or p0 == n0:
        return None
    best = None
    for f in sorted(by):
        p = n = 0
        for cut in range(len(cuts[f])):
            p, n = p + by[f].get(cut, (0, 0))[0], n + by[f].get(cut, (0, 0))[1]
            for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if pp < least or (f, above, cut) in used:
                    continue
                gain = pp * (math.log2(pp / nn) - math.log2(p0 / n0))
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, (f, above, cut), pp / nn)
    return best and (best[1], best[2])


def _shortened(rows: DataFrame, grown: list, min_precision: float, least: int) -> int:
    """Number of conditions to keep, 0 to refuse the rule."""
    sums, fires = [], F.lit(True)
    for i, c in enumerate(grown):
        fires = fires & _inside(*c)
        sums += [F.sum(F.when(fires, F.col("bad"))).alias(f"p{i}"), F.sum(fires.cast("long")).alias(f"n{i}")]
    r = rows.agg(*sums).first()
    best = (-1.0, 0)
    for i in range(len(grown)):
        p, n = r[f"p{i}"] or 0, r[f"n{i}"] or 0
        if p >= max(1, least // 2) and p / n >= min_precision and (2 * p - n) / n > best[0]:
            best = ((2 * p - n) / n, i + 1)
    return best[1]


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``stats`` (doc_id, ...) that have a quality label, with ``bad``
    and ``grow``. Several labels of a document count as the worst of them; a
    null label is none."""
    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (1 - F.min("quality")).cast("int").alias("bad")
    )
    rows = stats.join(one, "doc_id")
    return rows.withColumn("grow", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: statistics, base verdict, verdict of the learned
    list and the rule that rejected it. The texts are read once."""
    stats = stage(with_stats(docs.select("doc_id", "text")).select("doc_id", "__q"))
    rules = learn(labelled(stats, labels))
    return stats.select(
        "doc_id", *[F.col("__q")[s].alias(s) for s in STATS], base_failed().alias("base_failed"),
        rules.kept().alias("kept"), rules.reason().alias("rejected_by"),
    )


@others_aside("doc_id", "text")
def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    # narrow rows, so that no text is shuffled for the labels
    stats = stage(with_stats(docs.select("doc_id", "text")).select("doc_id", "__q"))
    rules = learn(labelled(stats, labels))
    # the row number keeps the planner from moving the filter below the
    # statistics, where every use of them would be computed on its own
    rows = with_stats(docs).withColumn("__q_row", F.monotonically_increasing_id())
    return rows.where(rules.kept() & (F.col("__q_row") >= 0)).select(*docs.columns)
