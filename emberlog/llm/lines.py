"""Line dedup by deletion neighbourhoods over words.

Lines are compared with single spaces between their words. A line goes if an
earlier one is equal, or, from five words on, within one word edit of it. The
bound is one edit at every length, so it is 0.8 similarity at five words and
stricter above: longer lines with two edits stay. Order is (document id, line number, hash of
the text); all lines are judged on the input.

Two lines within one edit become equal once a word is deleted from one or
both. Emitting all such variants of all lines would multiply the corpus by
the words of a line, so a lossless sieve comes first: such a pair shares the
first or the last half of its words. Only lines that share a half with
another line emit variants, as hashes; equal hashes are joined to the earliest
line of their group, never to each other, and the edit is verified on the
words themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import others_aside, stage, text_or_empty

#: one edit keeps a similarity of 0.8 from five words on
MIN_WORDS = 5


def _plain(t: Column) -> Column:
    """Text with single spaces for all white space inside its lines. Texts
    that are so already, nearly all, do not reach the regex."""
    odd = reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.when(odd, F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(t)


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, key, n, line, words): every line that has a word."""
    t = text_or_empty(text)
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(t).alias("key"), F.posexplode(F.split(_plain(t), "\n")).alias("n", "raw")
    )
    rows = rows.select("id", "key", "n", F.trim("raw").alias("line")).where("line != ''")
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return rows.withColumn("words", spaces + 1)


def _hash(line: Column) -> tuple[Column, Column]:
    """Two hashes of a line; together wide enough for any corpus."""
    return F.xxhash64(line).alias("h"), F.hash(line).alias("g")


def _halves(length: Column) -> list[Column]:
    """Hashes of the first and the last half, as of a pair whose longer line
    has ``length`` words."""
    q = F.floor((length - 1) / 2).cast("int")
    return [
        F.xxhash64(length, F.lit(0), F.call_function("substring_index", "line", F.lit(" "), q)),
        F.xxhash64(length, F.lit(1), F.call_function("substring_index", "line", F.lit(" "), -q)),
    ]


def _classes(lines: DataFrame) -> DataFrame:
    """One row per distinct line: hashes, its earliest place, its half keys."""
    w = F.col("words")
    keys = [F.when(w >= MIN_WORDS, k) for k in (*_halves(w), *_halves(w + 1))]
    rows = lines.select(
        *_hash(F.col("line")), "words", *[k.alias(f"k{i}") for i, k in enumerate(keys)],
        F.struct("id", "n", "key").alias("place"),
    )
    return rows.groupBy("h", "g", "words", "k0", "k1", "k2", "k3").agg(F.min("place").alias("place"))


def _candidates(classes: DataFrame) -> DataFrame:
    """(h, g, words, place) of distinct lines that share a half with another."""
    halves = classes.where(F.col("words") >= MIN_WORDS).select(
        "h", "g", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k")
    )
    shared = halves.groupBy("k").agg(
        F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("g").alias("glo"), F.max("g").alias("ghi")
    ).where("lo != hi or glo != ghi").select("k")
    some = halves.join(shared, "k", "left_semi").select("h", "g").distinct()
    return classes.select("h", "g", "words", "place").join(some, ["h", "g"], "left_semi")


def _variants(lines: DataFrame) -> DataFrame:
    """(h, g, words, place, v, at): every line with the word ``at`` deleted."""
    w, line = F.col("words"), F.col("line")
    at = lines.withColumn("at", F.explode(F.sequence(F.lit(0), w - 1)))
    head = F.call_function("substring_index", line, F.lit(" "), F.col("at"))
    tail = F.call_function("substring_index", line, F.lit(" "), F.col("at") + 1 - w)
    rest = F.when(F.col("at") == 0, tail).when(F.col("at") == w - 1, head).otherwise(F.concat_ws(" ", head, tail))
    return at.select("h", "g", "words", "place", F.xxhash64(rest).alias("v"), F.hash(rest).alias("vg"), "at")


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one insertion, deletion or
    substitution apart: common start and common end cover all but one word."""

    def common(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(first > 0, first - 1).otherwise(F.greatest(F.size(x), F.size(y)).cast("long"))

    longer = F.greatest(F.size(a), F.size(b))
    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= longer - 1


def _near(docs: DataFrame, classes: DataFrame, id_col: str, text: str) -> DataFrame:
    """(h, g) of distinct lines within one edit of an earlier line."""
    found = stage(_candidates(classes))
    # the text of a distinct line comes from the document it first stands in;
    # other documents are not split again
    wanted = found.groupBy(F.col("place.id").alias("__id"), F.col("place.key").alias("__key")).agg(
        F.collect_list(F.struct("h", "g", "words", "place")).alias("__lines")
    )
    t = text_or_empty(text)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("key"), t.alias("text"))
    held = rows.join(wanted, rows["id"].eqNullSafe(wanted["__id"]) & (rows["key"] == wanted["__key"]))
    lines = held.select(F.split(_plain(F.col("text")), "\n").alias("lines"), F.explode("__lines").alias("l"))
    lines = lines.select("l.h", "l.g", "l.words", "l.place", F.trim(F.get("lines", F.col("l.place.n"))).alias("line"))
    spoken = stage(lines.dropDuplicates(["h", "g"]))
    variants = stage(_variants(spoken))
    # a word replaced: the same variant by deleting the same place
    slot = ["v", "vg", "at", "words"]
    first = variants.groupBy(*slot).agg(F.min("place").alias("p"), F.count("*").alias("m")).where("m > 1").drop("m")
    replaced = variants.join(first, slot).where(F.col("p") < F.col("place")).select("h", "g", F.col("p").alias("partner"))
    # a word more or less: the variant of one line is the other line
    whole = spoken.select(F.col("h").alias("v"), F.col("g").alias("vg"), F.col("place").alias("q"))
    both = variants.join(whole, ["v", "vg"])
    longer = both.where(F.col("q") < F.col("place")).select("h", "g", F.col("q").alias("partner"))
    shorter = (
        variants.groupBy("v", "vg").agg(F.min("place").alias("partner")).join(whole, ["v", "vg"])
        .where(F.col("partner") < F.col("q")).select(F.col("v").alias("h"), F.col("vg").alias("g"), "partner")
    )
    pairs = replaced.union(longer).union(shorter).distinct()
    words = spoken.select("h", "g", F.split("line", " ").alias("a"))
    other = spoken.select(F.col("place").alias("partner"), F.split("line", " ").alias("b"))
    checked = pairs.join(words, ["h", "g"]).join(other, "partner")
    return checked.where(_within_one_edit(F.col("a"), F.col("b"))).select("h", "g").distinct()


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, kept): numbers of the lines that stay, for every document
    that keeps one; key is the hash of the text."""
    classes = stage(_classes(_lines(docs, id_col, text)))
    gone = _near(docs, classes, id_col, text)
    stay = classes.select("h", "g", "place").join(gone, ["h", "g"], "left_anti")
    return stay.groupBy(F.col("place.id").alias("id"), F.col("place.key").alias("key")).agg(
        F.sort_array(F.collect_list("place.n")).alias("kept")
    )


def _same(df: DataFrame, kept: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [df["__id"].eqNullSafe(kept["id"]), df["__key"] == kept["key"]])


def line_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: lines with a word, how many of them go, and the
    numbers (from 0) of those that stay.

    Null text counts as empty. Rows that repeat an id and its text count as
    one, and are reported as often as they stand in the input; rows of one id
    with different texts are ordered by line number, then by hash of the text.
    A null id comes before all others.
    """
    kept = kept_lines(docs, id_col, text)
    t = text_or_empty(text)
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(t).alias("__key"), lines.alias("n_lines"))
    joined = rows.join(kept, _same(rows, kept), "left")
    stay = F.coalesce("kept", F.array().cast("array<int>"))
    return joined.select(
        F.col("__id").alias(id_col), "n_lines", (F.col("n_lines") - F.size(stay)).alias("n_removed"), stay.alias("kept_lines")
    )


@others_aside("doc_id", "text", "n_chars")
def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines that repeat earlier ones. Lines without a
    word stay; a document that had words and keeps none goes. ``n_chars``
    follows the text where the column exists."""
    columns = docs.columns
    rows = docs.withColumns({"__id": F.col("doc_id"), "__key": F.xxhash64(text_or_empty())})
    kept = stage(kept_lines(docs))
    joined = rows.join(kept, _same(rows, kept), "left")
    lines = F.split(text_or_empty(), "\n")
    blank = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))) == 0
    stay = F.filter(lines, lambda x, i: ~x.rlike(r"[^\x20\x09-\x0D]") | F.array_contains("kept", i))
    joined = joined.where(blank | F.col("kept").isNotNull())
    joined = joined.withColumn("text", F.when(blank, F.col("text")).otherwise(F.array_join(stay, "\n")))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*columns)
