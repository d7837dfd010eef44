"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into segments of two bits; the counts of set bits per
segment are a vector whose Manhattan distance never exceeds the Hamming
distance of the fingerprints. Vectors within distance three agree up to one in
at least one half of their segments, so a grid over half vectors, joined with
itself and with its neighbours one step away, finds every candidate; the
Manhattan distance and then the exact distance decide.

The counts are held in unary (each segment with its bits sorted), so the
Manhattan distance is the number of bits in which two embeddings differ.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import others_aside, stage, text_or_empty
from emberlog.llm.graph import components

# workers need not be able to import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, MAX_BITS = 3, 3
SEED = 42
_LOW, _HIGH, _HALF = 0x5555555555555555, -0x5555555555555556, 0xFFFFFFFF


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): 64 majority bits over the hashes of all word shingles.

    A-Z are lower-cased, words are runs without ASCII white space. Fewer words
    than a shingle has make one shingle; none (null, empty) give zero."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import accumulate

        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest
        weights = (np.uint64(1) << np.arange(64, dtype=np.uint64))

        def of(body: bytes) -> int:
            words = body.lower().split()
            n = len(words) - shingle + 1
            if not words:
                return 0
            joined = b" ".join(words)
            if n <= 1:
                return digest(joined, SEED)
            ends = list(accumulate([len(w) + 1 for w in words]))
            starts = [0, *ends]
            hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
            bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
            return int(weights[2 * bits.sum(axis=0, dtype=np.int64) > n].sum(dtype=np.uint64))

        for batch in batches:
            found = np.array([of(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def embedding(fp: Column) -> Column:
    """Popcounts of the two-bit segments in unary: 00, 01 or 11."""
    either = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(F.lit(_HIGH))
    return either.bitwiseOR(both)


def _one_step_up(half: Column) -> Column:
    """The neighbours of a half vector with one count raised by one."""

    def raised(s: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), 2 * s)
        high = F.call_function("shiftleft", F.lit(2).cast("long"), 2 * s)
        has_low, has_high = half.bitwiseAND(low) != 0, half.bitwiseAND(high) != 0
        return F.when(~has_low, half.bitwiseOR(low)).when(~has_high, half.bitwiseOR(high))

    return F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(15)), raised))


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` that differ in at most
    three bits. Every pair is found, perhaps once for each half."""
    vectors = nodes.select("fp", embedding(F.col("fp")).alias("v"))
    halves = vectors.select("fp", "v", F.posexplode(F.array(
        F.col("v").bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned("v", 32)
    )).alias("side", "half"))
    cells = halves.select("side", F.col("half").alias("cell"), F.col("fp").alias("b"), F.col("v").alias("vb"))
    own = halves.select("side", F.col("half").alias("cell"), F.col("fp").alias("a"), F.col("v").alias("va"), F.lit(True).alias("same"))
    near = halves.select(
        "side", F.explode(_one_step_up(F.col("half"))).alias("cell"), F.col("fp").alias("a"), F.col("v").alias("va"),
        F.lit(False).alias("same"),
    )
    found = own.union(near).join(cells, ["side", "cell"]).where(~F.col("same") | (F.col("a") < F.col("b")))
    manhattan = F.bit_count(F.col("va").bitwiseXOR(F.col("vb")))
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return found.where(manhattan <= MAX_BITS).where(exact <= MAX_BITS).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id, fingerprint, component.

    The component is the smallest id reachable over links, the row's own
    included. Copies share a fingerprint and are linked as one; null ids are
    passed over when the smallest is taken. An empty table gives no rows.
    """
    rows = stage(fingerprints(docs, id_col, text, shingle))
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(joined.join(smallest, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select(
        F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@others_aside("doc_id", "text")
def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, with its own columns: the one with the
    smallest id, rows without an id last; of different texts under that id the
    one with the smallest hash. Rows that repeat an id and its text, also those
    without an id, are copies, of which one stays."""
    text = text_or_empty()
    # in the order in which rows are preferred
    key = F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), F.hash(text).alias("g")
    )
    rows = near_duplicates(docs.select(key.alias("key"), "text"), "key", shingle=shingle)
    rows = stage(rows.select("key", "component_id"))
    gone = rows.where(~F.col("key").eqNullSafe(F.col("component_id"))).select(
        *[F.col(f"key.{x}").alias(f"__gone_{x}") for x in ("id", "h", "g")]
    ).distinct()
    keyed = docs.withColumns({"__h": F.xxhash64(text), "__g": F.hash(text)})
    same = F.col("doc_id").eqNullSafe(F.col("__gone_id")) & (F.col("__h") == F.col("__gone_h")) & (F.col("__g") == F.col("__gone_g"))
    kept = keyed.join(gone, same, "left_anti")
    # texts are shuffled by their key only where a row that stays does repeat
    stays = rows.where(F.col("key").eqNullSafe(F.col("component_id")))
    if not stays.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__h", "__g"])
    return kept.select(*docs.columns)
