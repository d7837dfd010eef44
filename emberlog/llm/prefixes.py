"""The prefix trie of conversations, built as a burst trie.

Conversations are cut into segments of ``SEGMENT`` turns. What a segment holds
is a suffix under the trie node that the turns before it lead to, the head of
its container. A node is named by the exclusive or of the hashes of its turns
and their places, so every segment knows its head at once, however long the
conversation is.

Containers with more than ``CONTAINER`` different suffixes burst: their
suffixes move on by one turn, to containers under the nodes named by the next
turn. Bursting is a grouping and goes on until no container is too large; the
others are sorted by Spark and swept into nodes, in one pass that holds the
open path only. Sums over subtrees then rise from the swept containers through
the burst nodes, round by round, and from segment to segment.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import SPACE, stage
from emberlog.operators.ranking import ranked

# workers need not be able to import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: a conversation begins with up to this many turns less one of the first of its family
SHARED, FAMILY = 4, 20
#: turns of a segment, suffixes a container holds
SEGMENT, CONTAINER = 1024, 512

_SUMS = ("children", "leaves", "saved")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, u1, u2, words): turns by place from 0, with two hashes of
    role and text. Equal turn numbers are ordered by role, then by hash."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("u1"), F.xxhash64(F.lit(2), role, text).alias("u2"), words.alias("words"),
    )
    return ranked(rows, ["conv_id"], ("turn", "role", "u1", "u2"), "p").select(
        "conv_id", (F.col("p") - 1).alias("p"), "u1", "u2", "words"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id), and their turns (conv_id, p, u1, u2, words)
    after each one's first h have been replaced by those of its family."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")
    heads = stage(turns.where((F.col("p") < SHARED - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "family"))
    known = heads.groupBy("family").agg(F.count("*").alias("known"))
    convs = stage(
        convs.select("conv_id", first, h).join(known, "family", "left")
        .select("conv_id", "family", "h", F.least("h", F.coalesce("known", F.lit(0))).alias("taken"))
    )
    own = turns.join(convs, "conv_id").where("p >= h").select(
        "conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), "u1", "u2", "words"
    )
    taken = convs.join(heads, "family").where("p < taken").select("conv_id", "p", "u1", "u2", "words")
    return convs.select("conv_id"), own.union(taken)


def _segments(turns: DataFrame) -> DataFrame:
    """(conv_id, level, items, x1, x2, k1, k2): segments with the name of the
    node before each of them."""
    a, b = F.xxhash64("p", "u1", "u2").alias("a"), F.xxhash64("u2", "p", "u1").alias("b")
    rows = turns.select("conv_id", F.floor(F.col("p") / SEGMENT).cast("int").alias("level"), F.struct("p", a, b, "words").alias("item"))
    cut = rows.groupBy("conv_id", "level").agg(
        F.transform(F.sort_array(F.collect_list("item")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["words"].alias("words"))).alias("items"),
        F.bit_xor("item.a").alias("x1"), F.bit_xor("item.b").alias("x2"),
    )
    before = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumns({k: F.coalesce(F.bit_xor(x).over(before), F.lit(0)) for k, x in (("k1", "x1"), ("k2", "x2"))})


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers, whose suffixes come sorted."""
    schema = pa.schema([
        *[(x, pa.int64()) for x in ("id1", "id2", "p1", "p2")], ("depth", pa.int32()), *[(x, pa.int64()) for x in ("conv_id", "n", *_SUMS)],
    ])
    out: list[tuple] = []
    # open nodes: turn, name, smallest member, members, sums of what lies below
    path: list[list] = []
    key = None

    def close(keep: int, done: int) -> None:
        while len(path) > keep:
            _, words, one, two, conv, n, children, leaves, saved = path.pop()
            up = path[-1] if path else None
            saved += (n - 1) * words
            leaves = leaves if children else 1
            p1, p2 = (up[2], up[3]) if up else key[:2]
            out.append((one, two, p1, p2, done + len(path) + 1, conv, n, children, leaves, saved))
            if up:
                up[4] = conv if up[4] is None else min(up[4], conv)
                up[5], up[6], up[7], up[8] = up[5] + n, up[6] + 1, up[7] + leaves, up[8] + saved

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        ends = batch.column(3).offsets.to_pylist()
        turns = batch.column(3).values
        a, b, words = (turns.field(i).to_pylist() for i in range(3))
        rest = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7, 8)]
        for i, (k1, k2, done, conv, n, *more) in enumerate(zip(*rest)):
            if key != (k1, k2, done):
                if key:
                    close(0, key[2])
                key = (k1, k2, done)
            low, high = ends[i] + done, ends[i + 1]
            same = 0
            while same < len(path) and low + same < high and path[same][0] == (a[low + same], b[low + same]):
                same += 1
            close(same, done)
            one, two = (path[-1][2], path[-1][3]) if path else (k1, k2)
            for t in range(low + same, high):
                one, two = one ^ a[t], two ^ b[t]
                path.append([(a[t], b[t]), words[t], one, two, None, 0, 0, 0, 0])
            last = path[-1]
            last[4] = conv if last[4] is None else min(last[4], conv)
            last[5] += n
            for x, add in enumerate(more):
                last[6 + x] += add
            if len(out) >= 8192:
                yield batch_of(out)
                out.clear()
    if key:
        close(0, key[2])
    if out:
        yield batch_of(out)


def _summed(children: DataFrame) -> DataFrame:
    """Sums of the nodes below each node (q1, q2), one level down."""
    return children.groupBy(F.col("p1").alias("q1"), F.col("p2").alias("q2")).agg(
        F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )


def _with_sums(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes that know their own sums (``words``, n and what begins at them in
    the next segment) with those of what lies below."""
    joined = nodes.join(
        below.select("q1", "q2", *[F.col(x).alias(f"below_{x}") for x in _SUMS]),
        (nodes["id1"] == F.col("q1")) & (nodes["id2"] == F.col("q2")), "left",
    )
    total = {x: F.col(x) + F.coalesce(f"below_{x}", F.lit(0)) for x in _SUMS}
    return joined.select(
        "id1", "id2", "p1", "p2", "depth", "conv_id", "n", total["children"].alias("children"),
        F.when(total["children"] == 0, 1).otherwise(total["leaves"]).alias("leaves"),
        (total["saved"] + (F.col("n") - 1) * F.col("words")).alias("saved"),
    )


def _level(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one level of segments, and the sums of its heads (q1, q2).
    ``rows``: (k1, k2, done, items, conv_id, n, children, leaves, saved)."""
    key = ["k1", "k2"]
    held, bursts, waiting = [], [], rows
    while True:
        large = stage(waiting.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > CONTAINER).select(*key))
        if large.isEmpty():
            held.append(waiting)
            break
        held.append(waiting.join(large, key, "left_anti").select(*rows.columns))
        turn = F.element_at("items", F.col("done") + 1)
        moved = stage(waiting.join(large, key, "left_semi").select(
            F.col("k1").alias("p1"), F.col("k2").alias("p2"), turn["words"].alias("words"),
            F.col("k1").bitwiseXOR(turn["a"]).alias("k1"), F.col("k2").bitwiseXOR(turn["b"]).alias("k2"),
            (F.col("done") + 1).alias("done"), *[c for c in rows.columns if c not in ("k1", "k2", "done")],
        ))
        ends = F.size("items") == F.col("done")
        bursts.append(stage(
            moved.groupBy(F.col("k1").alias("id1"), F.col("k2").alias("id2")).agg(
                *[F.min(x).alias(x) for x in ("p1", "p2")], F.min("done").alias("depth"), F.min("words").alias("words"),
                F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"),
                *[F.sum(F.when(ends, F.col(x)).otherwise(0)).alias(x) for x in _SUMS],
            )
        ))
        waiting = moved.where(~ends).select(*rows.columns)
    sorted_rows = held[0]
    for more in held[1:]:
        sorted_rows = sorted_rows.union(more)
    sorted_rows = sorted_rows.repartition(*key).sortWithinPartitions(*key, "items")
    swept = stage(sorted_rows.mapInArrow(
        _sweep, "id1 bigint, id2 bigint, p1 bigint, p2 bigint, depth int, conv_id bigint, n bigint, children bigint, leaves bigint, saved bigint"
    ))
    parts = [swept]
    for depth in range(len(bursts), 0, -1):  # burst nodes of that depth, the deepest first
        parts.append(stage(_with_sums(bursts[depth - 1], _summed(_at(parts, depth + 1)))))
    heads = _summed(_at(parts, 1))
    nodes = parts[0]
    for more in parts[1:]:
        nodes = nodes.union(more)
    return nodes, stage(heads)


def _at(parts: list[DataFrame], depth: int) -> DataFrame:
    """Nodes of a depth: swept ones, and those of the last burst handled."""
    found = parts[0].where(F.col("depth") == depth)
    return found.union(parts[-1].where(F.col("depth") == depth)) if len(parts) > 1 else found


def _hash_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node; rows come sorted."""
    import hashlib

    key, digest = None, None
    for batch in batches:
        out = []
        for k1, k2, conv in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if key != (k1, k2):
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256(str(conv).encode())
            else:
                digest.update(b",%d" % conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["k1", "k2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=["k1", "k2", "ends_sha256"])


def _ends(last: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) from the last node (k1, k2) of every conversation.

    A hash over ids in order cannot be summed from parts, so the ids of a node
    pass one task, as a stream that holds nothing."""
    counts = last.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.min("conv_id").alias("conv_id"))
    one = counts.where("m = 1").select("k1", "k2", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = last.join(counts.where("m > 1").select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "conv_id")
    several = several.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    return one.union(several.mapInArrow(_hash_of_ids, "k1 bigint, k2 bigint, ends_sha256 string"))


def _xored(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, nulls first, equal ones by role and then in
    an arbitrary but fixed order; rows that repeat are turns of their own. Null
    role or text is an empty one, of which conversations may have many. Rows
    without a conv_id belong to no conversation. Turns are told apart by
    128-bit hashes of place, role and text. Other columns are not read. A
    table without conversations gives no nodes, not even a root.
    """
    turns = stage(numbered_turns(conversations.select("conv_id", "turn", "role", "text")))
    convs, turns = rebuilt(turns)
    segments = stage(_segments(turns))
    last = stage(
        convs.join(segments.groupBy("conv_id").agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2")), "conv_id", "left")
        .select("conv_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("k1", "k2")])
    )
    # equal suffixes of a head are one, with the number of their conversations
    same = segments.groupBy("level", "k1", "k2", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    suffixes = stage(same.join(segments.select("conv_id", "level", "items"), ["conv_id", "level"]))
    levels = suffixes.agg(F.max("level")).first()[0]

    nodes, heads = [], None
    for level in range(-1 if levels is None else levels, -1, -1):
        rows = suffixes.where(F.col("level") == level)
        if heads is None:
            rows = rows.withColumns({x: F.lit(0).cast("long") for x in _SUMS})
        else:  # what goes on after the segment
            rows = rows.withColumns({"z1": _xored("k1", "x1"), "z2": _xored("k2", "x2")})
            rows = rows.join(heads, (rows["z1"] == heads["q1"]) & (rows["z2"] == heads["q2"]), "left")
            rows = rows.withColumns({x: F.coalesce(x, F.lit(0)) for x in _SUMS})
        found, heads = _level(rows.select("k1", "k2", F.lit(0).alias("done"), "items", "conv_id", "n", *_SUMS))
        nodes.append(found.withColumn("depth", F.col("depth") + level * SEGMENT))

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", F.lit(1).cast("long").alias("n"), *[zero.alias(x) for x in _SUMS])
    if heads is not None:  # of the first level, which has one head
        root = root.union(heads.select(none, zero, *_SUMS))
    root = root.agg(F.min("conv_id").alias("conv_id"), *[F.sum(x).alias(x) for x in ("n", *_SUMS)]).where("n > 0")
    root = root.withColumn("leaves", F.greatest("leaves", F.lit(1).cast("long")))
    tree = root.select(zero.alias("id1"), zero.alias("id2"), none.alias("p1"), none.alias("p2"), F.lit(0).alias("depth"), "conv_id", "n", *_SUMS)
    for found in nodes:
        tree = tree.union(found)
    tree = stage(tree)
    parents = tree.select(F.col("id1").alias("p1"), F.col("id2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends(last).withColumnsRenamed({"k1": "id1", "k2": "id2"})
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return tree.join(parents, ["p1", "p2"], "left").join(ends, ["id1", "id2"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
