"""How far the sources of a language are apart in the words they use.

Counting is an Arrow pipeline inside ``mapInArrow``: texts are lower-cased
(``ascii_lower``), split (``split_pattern_regex``), dictionary-encoded and
counted by hash ``group_by``. A task sends one row per language, source and
term it has seen, however often. The merged counts are dealt into columnar
shards of terms; a shard holds all counts of its terms for one or two blocks of
sources and gives partial divergences, which are summed.

All arithmetic is in whole numbers: the probability of a term in a group is
``1 + floor(SCALE * (count + SMOOTHING) / (N + SMOOTHING * V))``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import stage

# workers need not be able to import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DOCS, SMOOTHING, SCALE = 30, 5, 1_000_000_000
#: rank to which the terms of a group are listed
TERMS = 50
#: what ends a term: all of ASCII but the letters
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

#: bytes of text counted at a time, and rows a task gathers before it sends them
CHUNK_BYTES, FLUSH_ROWS = 4 << 20, 500_000
#: (source, term) rows of a shard, terms of which are laid out densely at a time, and sources of a block
SHARD_ROWS, DENSE_TERMS, BLOCK_SOURCES = 50_000, 512, 256

_PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _chunk_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some documents; a null term names a
    group that occurs."""
    langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
    both = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
    groups, group_of = np.unique(both, return_inverse=True)
    lang = langs.dictionary.take(pa.array(groups // max(1, len(sources.dictionary))))
    source = sources.dictionary.take(pa.array(groups % max(1, len(sources.dictionary))))
    none = pa.nulls(len(groups), pa.string())
    zero = pa.array(np.zeros(len(groups), np.int64))
    present = pa.Table.from_arrays([lang, source, none, zero, zero], schema=_PART)

    words = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), BETWEEN)
    terms = pc.list_flatten(words).dictionary_encode()
    doc = pc.list_parent_indices(words).to_numpy().astype(np.int64)
    size = max(1, len(terms.dictionary))
    seen = pa.table({"key": doc * size + terms.indices.to_numpy()}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    key, n = seen["key"].to_numpy(), seen["count_all"].to_numpy()
    by_group = (
        pa.table({"key": group_of[key // size] * size + key % size, "n": n}).group_by("key", use_threads=False)
        .aggregate([("n", "sum"), ([], "count_all")])
    )
    key = by_group["key"].to_numpy()
    found = pa.Table.from_arrays(
        [lang.take(pa.array(key // size)), source.take(pa.array(key // size)), terms.dictionary.take(pa.array(key % size)),
         by_group["n_sum"].combine_chunks(), by_group["count_all"].combine_chunks()], schema=_PART,
    )
    return pa.concat_tables([present, found.filter(pc.not_equal(found["term"], ""))])


def _merged(tables: list[pa.Table]) -> pa.Table:
    names = ["lang", "source", "term"]
    out = pa.concat_tables(tables).group_by(names, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*names, "n_sum", "docs_sum"]).rename_columns(_PART.names).cast(_PART)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged, waiting, rows = [], [], 0
    for batch in batches:
        text, start = batch.column(2), 0
        ends = np.cumsum(pc.binary_length(text).to_numpy())
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
            part = _chunk_counts(batch.slice(start, stop - start))
            waiting.append(part)
            rows, start = rows + part.num_rows, stop
            if rows > FLUSH_ROWS:
                table = _merged(merged + waiting)
                waiting, rows = [], 0
                if table.num_rows > FLUSH_ROWS:
                    yield from table.to_batches(max_chunksize=65536)
                    table = table.slice(0, 0)
                merged = [table]
    if merged or waiting:
        yield from _merged(merged + waiting).to_batches(max_chunksize=65536)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term;
    a row with a null term for every group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _probability(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), by
    long division, so that nothing exceeds 64 bits."""
    left, by = count + SMOOTHING, total + SMOOTHING * terms
    out = left // by
    left = left - out * by
    for _ in range(3):
        left = left * 1000
        digit = left // by
        out, left = out * 1000 + digit, left - digit * by
    return out + 1


def _shard(counts: pa.Table, sources: pa.Table) -> pa.Table:
    """Partial values of one shard of terms: ``sources`` are those of its one
    or two blocks, ``counts`` (term, source, n, total) what is not zero."""
    names = sources["source"].combine_chunks()
    lang = sources["lang"][0].as_py()
    block = sources["block"].to_numpy()
    total, size = sources["n"].to_numpy(), sources["terms"].to_numpy()
    first = block == block.min()
    alone = sources["low"][0].as_py() == sources["high"][0].as_py()
    left = np.flatnonzero(first)
    right = left if alone else np.flatnonzero(~first)
    gaps = np.zeros((len(left), len(right)), np.int64)
    out = []
    if counts.num_rows:
        at = pc.index_in(counts["source"], names).to_numpy()
        term = counts["term"].combine_chunks().dictionary_encode()
        row, n = term.indices.to_numpy(), counts["n"].to_numpy()
        p = _probability(n, total[at], size[at])
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(0, len(term.dictionary) + DENSE_TERMS, DENSE_TERMS))
        none = _probability(np.zeros(len(names), np.int64), total, size)
        for k, low in enumerate(range(0, len(term.dictionary), DENSE_TERMS)):
            part = order[ends[k] : ends[k + 1]]
            dense = np.tile(none, (min(DENSE_TERMS, len(term.dictionary) - low), 1))
            dense[row[part] - low, at[part]] = p[part]
            for i, a in enumerate(left):
                gaps[i] += np.abs(dense[:, [a]] - dense[:, right]).sum(axis=0)
        if alone:
            q = _probability(counts["total"].to_numpy(), counts["lang_n"].to_numpy(), size[at])
            more = np.flatnonzero(p > q)
            place = pc.rank(term.dictionary).to_numpy().astype(np.int64)[row]
            # the last key decides first: source, value, term
            best = more[np.lexsort((place[more], (q - p)[more], at[more]))]
            rank = np.arange(len(best)) - np.searchsorted(at[best], at[best])
            best = best[rank < TERMS]
            out.append((names.take(pa.array(at[best])), ["term"] * len(best), term.dictionary.take(pa.array(row[best])), (p - q)[best]))
    for i, a in enumerate(left):
        others = right[right != a]
        value = gaps[i][right != a]
        out.append((pa.array([names[a].as_py()] * len(others), pa.string()), ["pair"] * len(others), names.take(pa.array(others)), value))
        if not alone:
            out.append((names.take(pa.array(others)), ["pair"] * len(others), pa.array([names[a].as_py()] * len(others), pa.string()), value))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    tables = [
        pa.Table.from_arrays([pa.array([lang] * len(s), pa.string()), s, pa.array(k, pa.string()), t, pa.array(v, pa.int64())], schema=schema)
        for s, k, t, v in out
    ]
    return pa.concat_tables(tables) if tables else schema.empty_table()


def divergences(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language with the sum of the
    absolute differences of all kept terms' probabilities. Part ``term``: the
    terms that the source uses more than its language does, the first ``TERMS``
    of them. A language keeps the terms of at least ``MIN_DOCS`` of its
    documents; rows that repeat count each time. Null text, lang and source
    are empty ones, which are values like others; other columns are not read.
    No documents give no rows, a source alone in its language without kept
    terms gives none either, and sources of a language without kept terms have
    pairs of value zero.
    """
    counts = stage(term_counts(docs))
    rows = counts.where("term IS NOT NULL")
    groups = counts.where("term IS NULL").select("lang", "source")
    kept = stage(
        rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
        .where(F.col("docs") >= MIN_DOCS).select("lang", "term", "total")
    )
    rows = stage(rows.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"))
    langs = (
        groups.groupBy("lang").agg(F.count("*").alias("sources"))
        .join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n")), "lang", "left")
        .join(rows.groupBy("lang").agg(F.count("*").alias("rows")), "lang", "left")
        .select(
            "lang", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("terms", "lang_n")],
            F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int").alias("blocks"),
            F.greatest(F.lit(1), F.ceil(F.col("rows") / SHARD_ROWS)).cast("int").alias("shards"),
        )
    )
    langs = stage(langs)
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    # every pair of blocks that a row is part of
    pairs = F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda b: F.struct(F.least(b, "block").alias("low"), F.greatest(b, "block").alias("high")),
    )).alias("at")
    left = (
        rows.join(langs, "lang")
        .select("lang", "source", "term", "n", "total", "lang_n", block, "blocks", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
        .select("*", pairs).select("lang", "shard", "at.low", "at.high", "source", "term", "n", "total", "lang_n")
    )
    right = (
        groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang")
        .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "terms", block, "blocks", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        .select("*", pairs).select("lang", "shard", "at.low", "at.high", "source", "n", "terms", "block")
    )
    key = ["lang", "shard", "low", "high"]
    schema = "lang string, source string, part string, item string, value bigint"
    partial = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_shard, schema)
    # a term lies in one shard, a pair of sources in all of its language
    summed = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where(
        (F.col("part") == "pair") | (F.col("rank") <= TERMS)
    )
