"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each group of them is a star around its
text, so a document's neighbours are counted by (text, shard) and never listed
in pairs. Every round, the documents of a group want to move to a shard that
holds more of the group. Moves from one shard to another are admitted against
moves the other way, along cycles of shards, and into free room, so that full
shards exchange members; what stays apart in the end is cut. Documents without
a link then fill the shards up, so that row counts differ by one at most (law
``rows``).

The state of the propagation is one row per text whose group is still apart,
with an entry per shard that holds a part of it: it follows the linked texts,
not the copies. Only tables of shards x shards x powers of two, which do not
grow with the input, reach the driver.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import numbered, prefix_sums, stage, text_or_empty

SHARDS = 24
#: rounds on end without progress after which the propagation ends; each of
#: them draws ties anew
PATIENCE = 4
#: groups that fill less than this part of a shard may also move to smaller parts
SMALL = 8
#: growth of the sum of the squared parts that counts as none
HARDLY = 1e-4


def quotas(total: int, shards: int) -> list[int]:
    """Rows of each shard; they differ by one at most."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def _cycle(left: Counter, shards: int) -> list[int] | None:
    """Shards along which demand runs in a circle, the first one also last."""
    after = {s: [t for t in range(shards) if left[s, t] > 0] for s in range(shards)}
    for start in range(shards):
        came, queue = {start: -1}, [start]
        for at in queue:
            for t in after[at]:
                if t == start:
                    path = [at]
                    while came[path[-1]] >= 0:
                        path.append(came[path[-1]])
                    return [*reversed(path), start]
                if t not in came:
                    came[t] = at
                    queue.append(t)
    return None


def flows(demand: dict[tuple[int, int], int], room: list[int]) -> Counter:
    """How much of the demand (source, target) is met, with no shard above its
    room: circles first, which leave all counts as they are, then moves into
    room, each of which makes room where it came from."""
    left, met, room = Counter(demand), Counter(), list(room)
    while path := _cycle(left, len(room)):
        pairs = list(zip(path, path[1:]))
        x = min(left[e] for e in pairs)
        for e in pairs:
            left[e] -= x
            met[e] += x
    # no circle is left, so room travels against the demand and comes to rest
    while moves := [(s, t) for (s, t), m in left.items() if m > 0 and room[t] > 0]:
        for s, t in moves:
            x = min(left[s, t], room[t])
            left[s, t] -= x
            met[s, t] += x
            room[t] -= x
            room[s] += x
    return met


def _wanted(state: DataFrame, quota: list[int], room: list[int], turn: int) -> DataFrame:
    """Moves (key, source, target, m, size) that groups want.

    In even rounds members go for the largest part of their group (by members,
    ties by a hash). The largest part may stand in a full shard that has
    nothing to give, so in odd rounds a group goes for its largest part in a
    shard that has room for all the others, or, where none has, members go for
    any part by hash; of a group that is not small beside a shard only upwards,
    since cutting such a move would undo what has come together."""

    def of(values: list[int], shard: Column) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in values]), shard)

    ranked = F.transform("parts", lambda c: F.struct(
        c["n"].alias("n"), F.xxhash64(F.col("key"), c["shard"], F.lit(turn)).alias("tie"), c["shard"].alias("shard")
    ))
    rows = state.select("key", ranked.alias("parts")).withColumn(
        "total", F.aggregate("parts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    )
    fits = F.array_max(F.filter("parts", lambda o: F.col("total") - o["n"] <= of(room, o["shard"])))
    rows = rows.withColumn("fits", fits if turn % 2 else F.lit(None).cast("struct<n:bigint,tie:bigint,shard:int>"))

    def target(c: Column) -> Column:
        above = F.filter("parts", lambda o: (o > c) & (o["n"] < of(quota, o["shard"])))
        if turn % 2:
            below = F.filter("parts", lambda o: o["tie"] > c["tie"])
            above = F.when(F.col("total") * SMALL <= min(quota), below).otherwise(above)
            above = F.transform(above, lambda o: F.struct(o["tie"].alias("tie"), o["shard"].alias("shard")))
        return F.when(F.col("fits").isNull(), F.array_max(above)["shard"]).when(c != F.col("fits"), F.col("fits.shard"))

    moves = F.transform("parts", lambda c: F.struct(
        c["shard"].alias("source"), target(c).alias("target"), c["n"].alias("m"),
        F.floor(F.log2(c["n"].cast("double"))).cast("int").alias("size"),
    ))
    return rows.select("key", F.explode(moves).alias("v")).select("key", "v.*").where("target is not null")


def _admitted(moves: DataFrame, room: list[int]) -> tuple[DataFrame, Counter]:
    """Moves cut to what the shards can take (key, source, target, ok), and the
    members moved by (source, target). Larger parts go first, parts of one size
    (a power of two) by hash."""
    moves = stage(moves)
    sizes = moves.groupBy("source", "target", "size").agg(F.sum("m").alias("m"), F.count("*").alias("rows")).collect()
    demand = Counter()
    for r in sizes:
        demand[r["source"], r["target"]] += r["m"]
    met = flows(demand, room)
    left, whole, part, cut_rows = Counter(met), [], [], 0
    for r in sorted(sizes, key=lambda r: -r["size"]):
        e = (r["source"], r["target"])
        take = min(r["m"], left[e])
        left[e] -= take
        if take == r["m"]:
            whole.append((*e, r["size"]))
        elif take:
            part.append((*e, r["size"], take))
            cut_rows += r["rows"]
    spark, on = moves.sparkSession, ["source", "target", "size"]
    dealt = moves.join(spark.createDataFrame(whole, "source int, target int, size int"), on)
    dealt = dealt.select("key", "source", "target", F.col("m").alias("ok"))
    if part:
        some = moves.join(spark.createDataFrame(part, "source int, target int, size int, take long"), on)
        some = prefix_sums(some, on, F.struct("key"), "m", "before", cut_rows)
        ok = F.least(F.col("m"), F.col("take") - F.col("before"))
        dealt = dealt.union(some.select("key", "source", "target", ok.alias("ok")).where("ok > 0"))
    return dealt, met


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    # at most one entry per shard
    of = moves.groupBy("key").agg(F.collect_list(F.struct("source", "target", "ok")).alias("moves"))

    def change(c: Column, end: str) -> Column:
        return F.aggregate(F.filter("moves", lambda v: v[end] == c["shard"]), F.lit(0).cast("long"), lambda s, v: s + v["ok"])

    parts = F.transform("parts", lambda c: F.struct(
        c["shard"].alias("shard"), (c["n"] + change(c, "target") - change(c, "source")).alias("n")
    ))
    after = F.when(F.col("moves").isNull(), F.col("parts")).otherwise(F.filter(parts, lambda c: c["n"] > 0))
    return stage(state.join(of, "key", "left").select("key", after.alias("parts")))


def propagate(held: DataFrame, quota: list[int]) -> DataFrame:
    """(key, shard, n) after moving members of the groups towards each other,
    until the sum of the squared parts of the groups hardly grows any more.
    Rounds read and write only the groups that are still apart."""
    used = _used(held)
    state = stage(held.groupBy("key").agg(F.collect_list(F.struct("shard", "n")).alias("parts")))
    square = F.aggregate("parts", F.lit(0.0), lambda s, c: s + c["n"].cast("double") * c["n"])
    whole, turn, idle = [], 0, 0
    while idle < PATIENCE:
        whole.append(state.where(F.size("parts") == 1))
        state = state.where(F.size("parts") > 1)
        before = state.agg(F.sum(square)).first()[0]
        if before is None:
            break
        room = [q - used[s] for s, q in enumerate(quota)]
        moves, met = _admitted(_wanted(state, quota, room, turn), room)
        state = _moved(state, moves)
        for (s, t), m in met.items():
            used[s] -= m
            used[t] += m
        idle = 0 if state.agg(F.sum(square)).first()[0] > before * (1 + HARDLY) else idle + 1
        turn += 1
    parts = reduce(DataFrame.union, whole, state)
    return stage(parts.select("key", F.explode("parts").alias("p")).select("key", "p.shard", "p.n"))


def _used(held: DataFrame) -> Counter:
    return Counter({r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()})


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per input row: its shard and its slot there.

    Size: bytes of the text plus 8; a null text counts as empty, so null and
    empty texts are one group. Rows are told apart by (id, text); rows equal in
    both are interchangeable, and take as many slots as they are. Slots count
    from 0 without gaps.
    """
    t = text_or_empty(text)
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(t).cast("long") + 8).alias("size"),
        F.crc32(t).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("key"),
    ))
    total = rows.count()
    quota = quotas(total, shards)
    groups = stage(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    linked = stage(rows.join(groups.select("key"), "key", "left_semi"))
    single = rows.join(groups.select("key"), "key", "left_anti")

    # start: by hash of the id; the little by which that overfills a shard moves on
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    held = stage(linked.groupBy("key", start.alias("shard")).agg(F.count("*").alias("n")))
    held = propagate(_levelled(held, quota), quota)

    # members take the places of their group by rank, singles what is left
    n_linked, pieces = linked.count(), held.count()
    ranked = numbered(linked, ["key"], F.struct("doc_id", "size"), "rank", n_linked)
    upto = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = prefix_sums(held, ["shard"], F.struct("key"), "n", "base", pieces)
    placed = placed.withColumn("low", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # at most one entry per shard
    spans = placed.groupBy("key").agg(F.collect_list(F.struct("low", "n", "shard", "base")).alias("spans"))
    of = F.filter("spans", lambda x: (F.col("rank") >= x["low"]) & (F.col("rank") < x["low"] + x["n"]))[0]
    joined = ranked.join(spans, "key").withColumn("of", of).select(
        "doc_id", "size", "text_crc32", F.col("of.shard").cast("int").alias("shard"),
        (F.col("of.base") + F.col("rank") - F.col("of.low")).alias("slot"),
    )
    used = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    order = numbered(single, [], F.struct("doc_id", "size", "text_crc32"), "rank", total)
    at, shard, slot = 0, F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        free = quota[s] - used.get(s, 0)
        inside = (F.col("rank") >= at) & (F.col("rank") < at + free)
        shard = F.when(inside, F.lit(s)).otherwise(shard)
        slot = F.when(inside, F.col("rank") - at + used.get(s, 0)).otherwise(slot)
        at += free
    alone = order.select("doc_id", "size", "text_crc32", shard.alias("shard"), slot.alias("slot"))
    return joined.union(alone).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _levelled(held: DataFrame, quota: list[int]) -> DataFrame:
    """The start with no shard above its quota: the excess of a shard, the
    first of its members by hash, is dealt to shards with room."""
    used = _used(held)
    over = {s: used[s] - q for s, q in enumerate(quota) if used[s] > q}
    if not over:
        return held
    room = {s: q - used[s] for s, q in enumerate(quota) if used[s] < q}
    spans = []
    for s, excess in over.items():
        low = 0
        while low < excess:
            t = next(iter(room))
            x = min(excess - low, room[t])
            spans.append((s, t, low, low + x))
            low, room[t] = low + x, room[t] - x
            if not room[t]:
                del room[t]
    places = stage(prefix_sums(held, ["shard"], F.struct("key"), "n", "before", held.count()))
    dealt = places.join(held.sparkSession.createDataFrame(spans, "shard int, target int, low long, high long"), "shard")
    ok = F.least(F.col("before") + F.col("n"), F.col("high")) - F.greatest("before", "low")
    moves = dealt.withColumn("ok", ok).where("ok > 0")
    change = moves.select("key", F.explode(F.array(
        F.struct(F.col("target").alias("shard"), F.col("ok").alias("n")),
        F.struct(F.col("shard"), (-F.col("ok")).alias("n")),
    )).alias("c")).select("key", "c.shard", "c.n")
    return stage(held.union(change).groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
