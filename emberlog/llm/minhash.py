"""Near-duplicates by bottom-k sketches of one hash function.

A document is the set of its word shingles, hashed once each; its sketch are
the ``K`` smallest hashes. Sets that are alike share most retained values, so
of each sketch only the rarest values need to be listed: two sketches with
``LEAST`` values in common agree in at least one of their first
``size - LEAST + 1``, whatever the order, and the order from rare to frequent
keeps common passages out of the lists.

Members of a list are compared in two steps, each linear in the list where it
holds one group of near copies: first all with one member of it, then, once
these links have been folded into components, those outside the main component
of a list with all members. In both steps the estimate from the sketch of the
union (its ``K`` smallest values, and how many of them both hold) passes pairs
on to the exact comparison of the whole sets. Pairs are compared in blocks of
bounded size, never emitted.

With similarity 0.85 a sketch shares 27.2 of its 32 values on average, with a
deviation of 2.02; fewer than ``LEAST`` in one of about two million pairs. Sets
of up to 27 shingles are compared without loss.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import stage
from emberlog.llm.graph import components

# workers need not be able to import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, K, LEAST = 3, 32, 16
#: least similarity in hundredths
SIMILARITY = 85
#: members and values of a block, and members from which the lists of one component are compared together
BLOCK_ROWS, BLOCK_VALUES, DENSE = 1024, 1 << 20, 64


def _hashes(body: bytes) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    from itertools import accumulate

    import xxhash

    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    found = [xxhash.xxh64_intdigest(joined[a : b - 1]) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    return np.unique(np.array(found or [xxhash.xxh64_intdigest(joined)], dtype=np.uint64))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _shingled(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sets = [_hashes(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     _lists(sets if whole else [s[:K] for s in sets])],
                    names=["doc_id", "n", "c", "items"],
                )

    return task


def _sets(docs: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, n, c, items): size of the set, its class, and its hashes or
    the smallest of them."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_shingled(whole), f"doc_id {kind}, n bigint, c binary, items array<bigint>")


def _shared(sets: list[np.ndarray], outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the outer with the inner sets."""
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = seen > 1
    column = (np.cumsum(often) - 1)[at]
    row, column = row[often[at]], column[often[at]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(outer), len(inner)), np.float32), 4096
    for low in range(0, int(often.sum()), width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        dense = np.zeros((len(sets), min(width, int(often.sum()) - low)), np.float32)
        dense[row[part], column[part] - low] = 1
        out += dense[outer] @ dense[inner].T
    return out


def _estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sketches of unions (rows of ``a`` with rows of ``b``,
    filled up with the largest number) hold enough that is in both."""
    most = np.iinfo(np.uint64).max
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = both[:, 1:] == both[:, :-1]
    real = both != most
    rank = np.cumsum(~twice & real, axis=1)
    of = np.minimum(K, rank[:, -1])
    return (twice & real & (rank <= K)).sum(axis=1) * K >= LEAST * of


def _passing(sets: list[np.ndarray], outer: np.ndarray, inner: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Members with a partner that the estimate passes."""
    size = np.array([len(s) for s in sets])
    padded = np.full((len(sets), K), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(sets):
        padded[i, : len(s)] = s
    shared = _shared(sets, outer, inner)
    x, y = np.nonzero(apart & (shared * K >= LEAST * np.maximum(size[outer][:, None], size[inner][None, :])))
    x, y = outer[x], inner[y]
    marked = np.zeros(len(sets), bool)
    for low in range(0, len(x), 65536):
        a, b = x[low : low + 65536], y[low : low + 65536]
        new = ~(marked[a] & marked[b])
        a, b = a[new], b[new]
        ok = _estimated(padded[a], padded[b])
        marked[a[ok]] = marked[b[ok]] = True
    return marked


def _linked(sets: list[np.ndarray], outer: np.ndarray, inner: np.ndarray, apart: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links between different components, as many as join them."""
    size = np.array([len(s) for s in sets])
    shared = _shared(sets, outer, inner).astype(np.int64)
    union = size[outer][:, None] + size[inner][None, :] - shared
    x, y = np.nonzero(apart & (100 * shared >= SIMILARITY * union))
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while (above := up.get(c, c)) != c:
            up[c] = c = up.get(above, above)
        return c

    out = []
    for a, b in zip(outer[x].tolist(), inner[y].tolist()):
        p, q = root(int(comp[a])), root(int(comp[b]))
        if p != q:
            up[p] = q
            out.append((a, b))
    return out


def _compared(exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task over rows sorted by block (g, i, j): the outer rows of a block are
    compared with its inner ones, where their components differ. Gives rows
    that pass the estimate, or links."""

    def block(rows: list[tuple], sets: list[np.ndarray]) -> pa.RecordBatch | None:
        role = np.array([r[3] for r in rows])
        outer, inner = np.flatnonzero(role), np.flatnonzero(~role)
        codes: dict[bytes, int] = {}
        comp = np.array([codes.setdefault(r[5], len(codes)) for r in rows])
        if not len(outer) or not len(inner) or len(codes) < 2:
            return None
        apart = comp[outer][:, None] != comp[inner][None, :]
        if exact:
            found = _linked(sets, outer, inner, apart, comp)
            ends = [pa.array([rows[p[side]][4] for p in found], pa.binary()) for side in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"]) if found else None
        kept = [rows[i] for i in np.flatnonzero(_passing(sets, outer, inner, apart))]
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        names = ["g", "i", "j", "outer", "c", "comp"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*kept), kinds)], names=names) if kept else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        sets: list[np.ndarray] = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            ends = batch.column(6).offsets.to_numpy()
            values = batch.column(6).values.to_numpy().view(np.uint64)
            for n, row in enumerate(zip(*columns)):
                if rows and rows[-1][:3] != row[:3]:
                    if (out := block(rows, sets)) is not None:
                        yield out
                    rows, sets = [], []
                rows.append(row)
                sets.append(values[ends[n] : ends[n + 1]])
        if rows and (out := block(rows, sets)) is not None:
            yield out

    return task


def _compare(rows: DataFrame, items: DataFrame, exact: bool) -> DataFrame:
    """``rows`` (g, i, j, outer, c, comp) with the ``items`` of their class."""
    wide = rows.join(items, "c").select("g", "i", "j", "outer", "c", "comp", "items")
    dealt = wide.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.mapInArrow(_compared(exact), "a binary, b binary" if exact else "g binary, i int, j int, outer boolean, c binary, comp binary")


def _blocks(members: DataFrame) -> DataFrame:
    """Members (g, c, n, comp, outer) as rows of blocks: inner row j and outer
    row i of a group meet in block (i, j). An outer member is an inner one too."""
    many = lambda rows, values: F.greatest(
        F.lit(1), F.ceil(rows / BLOCK_ROWS), F.ceil(values / BLOCK_VALUES)
    ).cast("int")
    mine = F.when(F.col("outer"), F.col("n"))
    sizes = stage(members.groupBy("g").agg(
        many(F.count("*"), F.sum("n")).alias("inner_blocks"), many(F.count(mine), F.coalesce(F.sum(mine), F.lit(0))).alias("outer_blocks")
    ))
    at = members.join(sizes, "g")
    place = lambda blocks: F.pmod(F.xxhash64("c"), F.col(blocks)).cast("int")
    steps = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    inner = at.select("g", steps("outer_blocks").alias("i"), place("inner_blocks").alias("j"), F.lit(False).alias("outer"), "c", "comp")
    outer = at.where("outer").select("g", place("outer_blocks").alias("i"), steps("inner_blocks").alias("j"), F.lit(True).alias("outer"), "c", "comp")
    return inner.union(outer)


def _links(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between members of a group, of which one is an outer one."""
    passed = stage(_compare(_blocks(members), classes.select("c", "items"), exact=False))
    wanted = stage(classes.join(passed.select("c").distinct(), "c", "left_semi").select("c", F.col("first").alias("id")))
    ids = wanted.select(F.col("id").alias("__wanted")).distinct()
    few = docs.select("doc_id", "text")
    few = few.join(ids, few["doc_id"].eqNullSafe(ids["__wanted"]), "left_semi")
    whole = _sets(few, whole=True).select("c", "items").join(wanted.select("c"), "c", "left_semi")
    # an id may be that of several rows
    whole = whole.dropDuplicates(["c"])
    return stage(_compare(passed, stage(whole), exact=True))


def _listed(classes: DataFrame) -> DataFrame:
    """(v, c, n, known): the rarest values of each sketch that have to be
    listed, without those no other sketch has."""
    values = classes.where("n > 0").select("c", "n", F.explode("items").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("often")).where("often > 1")
    mine = Window.partitionBy("c")
    rank = F.row_number().over(mine.orderBy("often", "v"))
    size = F.least(F.col("n"), F.lit(K))
    # smaller sets and their partners are in their sketches as a whole
    least = F.when(F.col("n") <= SIMILARITY * K // 100, F.ceil(F.col("n") * SIMILARITY / 100)).otherwise(LEAST)
    ranked = values.join(often, "v").withColumns({"rank": rank, "known": F.count("*").over(mine)})
    return ranked.where(size - F.col("known") + F.col("rank") <= size - least + 1).select("v", "c", "n", "known")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id, kept.

    Shingles are of three words, which are runs without ASCII white space; A-Z
    are lower-cased. Fewer words make one shingle, none (null, empty) an empty
    set, which is linked with nothing. Sets are held as 64-bit hashes of whole
    shingles. Rows that repeat a set, under whatever ids, are linked; null ids
    are passed over when the smallest is taken, and a component of such rows
    only has none, and keeps all. Other columns are not read. An empty table
    gives no rows.
    """
    rows = stage(_sets(docs.select("doc_id", "text"), whole=False))
    classes = stage(rows.groupBy("c", "n").agg(F.min("doc_id").alias("first"), F.first("items").alias("items")))
    lists = stage(_listed(classes))

    # every list against its most common member: that with the most values others have, too
    pivots = lists.groupBy("v").agg(F.min(F.struct(-F.col("known"), "c")).alias("p"), F.count("*").alias("m")).where("m > 1")
    pairs = lists.join(pivots.select("v", F.col("p.c").alias("g")), "v").select("g", "c", "n").distinct()
    star = stage(pairs.select("g", "c", "n", F.col("c").alias("comp"), (F.col("g") == F.col("c")).alias("outer")))
    near = _links(star, classes, docs)

    # what is not in the main component of a list against all of the list
    comps = components(near).withColumnRenamed("node", "c").withColumnRenamed("root", "comp")
    members = stage(lists.join(comps, "c", "left").select("v", "c", "n", F.coalesce("comp", "c").alias("comp")))
    counts = members.groupBy("v", "comp").agg(F.count("*").alias("m"))
    mixed = stage(
        counts.groupBy("v").agg(F.count("*").alias("comps"), F.max(F.struct("m", F.xxhash64("v", "comp"), "comp")).alias("top"))
        .where("comps > 1").select("v", F.col("top.comp").alias("main"), F.col("top.m").alias("m"))
    )
    # lists of one large component mostly hold the same members: these are compared once
    group = F.when(F.col("m") >= DENSE, F.col("main")).otherwise(F.unhex(F.lpad(F.hex("v"), 16, "0"))).alias("g")
    rest = (
        members.join(mixed, "v").select(group, "c", "n", "comp", (F.col("comp") != F.col("main")).alias("outer"))
        .groupBy("g", "c", "n", "comp").agg(F.max("outer").alias("outer"))
    )
    far = _links(stage(rest), classes, docs)

    roots = components(near.union(far)).withColumnRenamed("node", "c")
    joined = classes.select("c", "first").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("least"))
    of = stage(joined.join(smallest, "root").select("c", "least"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.join(of, "c").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
