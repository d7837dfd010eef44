"""URL filters: character models of accepted and rejected addresses.

Rules decide where they fit. Every other address is judged by the difference
of two smoothed variable-order Markov models, trained on the addresses that
the rules accept and reject. All characters count; a context of up to five of
them is used once it was seen MIN_CONTEXT times, so the models grow with the
input.

The models are kept as differences between orders: an address scores the sum
of all entries it touches, so that scoring is one join and one sum. The planner
broadcasts the staged model while its measured size allows, and joins by a
shuffle of (row, key) beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import stage

#: (rule, verdict); a rule is a host and the start of a path
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: characters of the longest context
ORDER = 5
#: contexts from this length on are joined apart from the shorter ones
LONG = 3
#: a context is used from this many sightings on
MIN_CONTEXT = 4
BETA = 4.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _codes(url: Column) -> Column:
    """Code points of the characters after the scheme, in lower case."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""))
    return F.transform(F.filter(F.split(rest, ""), lambda c: c != ""), F.ascii)


def _key(codes: Column, i: Column, first: int, last: int) -> Column:
    """Key of the characters from ``first`` to ``last`` places before place
    ``i``; zeros stand before the start. Contexts (``last`` 1) have keys of
    their own."""

    def at(back: int) -> Column:
        return F.coalesce(F.when(i >= back, F.get(codes, i - back)), F.lit(0))

    return F.xxhash64(F.lit(first if last == 0 else -first), *[at(k) for k in range(first, last - 1, -1)])


def _touched(codes: Column, levels: range) -> Column:
    """Keys of the grams and contexts of an address."""

    def of(_, i: Column) -> Column:
        grams = [_key(codes, i, k, 0) for k in levels]
        return F.array(*grams, *[_key(codes, i, k, 1) for k in levels if k])

    return F.flatten(F.transform(codes, of))


def _grams(codes: Column) -> Column:
    """(level, key, context, lower) of all grams of an address; ``lower`` is
    the gram without its first character."""

    def of(_, i: Column) -> Column:
        keys = [_key(codes, i, k, 0) for k in range(ORDER + 1)]
        return F.array(*[F.struct(
            F.lit(k).alias("level"), keys[k].alias("key"),
            (_key(codes, i, k, 1) if k else F.lit(0).cast("long")).alias("context"),
            (keys[k - 1] if k else F.lit(0).cast("long")).alias("lower"),
        ) for k in range(ORDER + 1)])

    return F.flatten(F.transform(codes, of))


def train(labelled: DataFrame, url: str = "url", accepted: str = "accepted") -> DataFrame:
    """Model (level int, key long, value double) from rows with a boolean verdict."""
    good = F.col(accepted)
    # a column of its own: within the keys the codes would be made anew for each of them
    codes = labelled.select(good.alias("good"), _codes(F.col(url)).alias("codes"))
    grams = codes.select("good", F.explode(_grams(F.col("codes"))).alias("g")).select("good", "g.*")
    counts = stage(grams.groupBy("level", "key", "context", "lower").agg(
        F.count(F.when(F.col("good"), 1)).alias("a"), F.count(F.when(~F.col("good"), 1)).alias("r")
    ))
    level = [counts.where(F.col("level") == k).drop("level") for k in range(ORDER + 1)]
    a, r, kinds = level[0].agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0)), F.count("*")).first()
    # one more character than seen, for all others
    below = level[0].select(
        "key", ((F.col("a") + 1) / (a + kinds + 1)).alias("pa"), ((F.col("r") + 1) / (r + kinds + 1)).alias("pr")
    )
    model = below.select(F.lit(0).alias("level"), "key", F.log(F.col("pa") / F.col("pr")).alias("value"))
    for k in range(1, ORDER + 1):
        contexts = (
            level[k].groupBy("context").agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
            .where(F.col("ca") + F.col("cr") >= MIN_CONTEXT)
        )
        backed = F.log((F.col("cr") + BETA) / (F.col("ca") + BETA))
        pa = (F.col("a") + BETA * F.col("pa")) / (F.col("ca") + BETA)
        pr = (F.col("r") + BETA * F.col("pr")) / (F.col("cr") + BETA)
        rows = stage(
            level[k].join(contexts, "context").join(below.withColumnRenamed("key", "lower"), "lower")
            .select("key", "context", backed.alias("backed"), pa.alias("own_a"), pr.alias("own_r"), "pa", "pr")
        )
        gain = F.log(F.col("own_a") / F.col("own_r")) - F.log(F.col("pa") / F.col("pr")) - F.col("backed")
        # every kept context has a gram
        model = model.union(rows.groupBy("context").agg(F.max("backed").alias("v")).select(F.lit(k), "context", "v"))
        model = model.union(rows.select(F.lit(k), "key", gain))
        below = rows.select("key", F.col("own_a").alias("pa"), F.col("own_r").alias("pr"))
    return stage(model)


def scored(rows: DataFrame, model: DataFrame, url: str = "url") -> DataFrame:
    """All columns plus ``score``: log-likelihood difference per character."""
    keep = rows.columns
    rows = stage(rows.withColumn("__row", F.monotonically_increasing_id()))
    codes = rows.select("__row", _codes(F.col(url)).alias("__c"))

    def values(levels: range, part: DataFrame) -> DataFrame:
        keys = F.explode(_touched(F.col("__c"), levels)).alias("key")
        # a left join, as only the model may be broadcast: the planner takes the keys of an address for one row
        return codes.select("__row", F.size("__c").alias("__n"), keys).join(part, "key", "left").select("__row", "__n", "value")

    # short contexts are few and touched by every address: a table of its own, small enough to be broadcast
    short = stage(model.where(F.col("level") < LONG).select("key", "value"))
    long = model.where(F.col("level") >= LONG).select("key", "value")
    sums = values(range(LONG), short).union(values(range(LONG, ORDER + 1), long))
    sums = sums.groupBy("__row", "__n").agg(F.sum("value").alias("__s"))
    score = F.coalesce(F.col("__s") / F.col("__n"), F.lit(0.0))
    return rows.join(sums.hint("merge"), "__row", "left").select(*keep, score.alias("score"))


def threshold(rows: DataFrame) -> float:
    """Cut (score >= cut is accepted) with the best balanced accuracy on rows
    (accepted boolean, score), in steps of 0.01, halfway between the steps it
    parts; 0 if a class is missing."""
    step = F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") * 100)))
    bins = rows.groupBy(step.alias("b")).agg(
        F.count(F.when(F.col("accepted"), 1)).alias("a"), F.count(F.when(~F.col("accepted"), 1)).alias("r")
    ).collect()
    a, r = sum(x["a"] for x in bins), sum(x["r"] for x in bins)
    if not a or not r:
        return 0.0
    best, cut, kept_a, kept_r, below = 0.0, 0.0, a, r, None
    for x in sorted(bins, key=lambda x: x["b"]):
        balanced = kept_a / a + 1 - kept_r / r
        if balanced > best + 1e-12:
            best, cut = balanced, (x["b"] + (x["b"] if below is None else below + 1)) / 200
        kept_a, kept_r, below = kept_a - x["a"], kept_r - x["r"], x["b"]
    return cut


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict on every row.

    Trained on the rows a rule decides, but for a fifth of their addresses (by
    hash), on which the cut is set. A null url, or one without ``://``, has
    empty host and path, so no rule fits; an address without characters scores
    0. Repeated rows and ids are judged one by one.
    """
    u = F.col(url)
    rows = stage(
        pages.select(F.col(id_col), u.cast("string").alias("url"))
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    )
    allow = [r for r, v in rules if v == "allow"]
    decided = rows.where(F.col("rule").isNotNull()).select("url", F.col("rule").isin(*allow).alias("accepted"))
    tuning = F.pmod(F.crc32(F.col("url")), F.lit(5)) == 0
    model = train(decided.where(~tuning))
    cut = threshold(scored(decided.where(tuning), model))
    judged = scored(rows, model)
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    by_rule = F.when(F.col("rule").isin(*allow), "allow").otherwise("block")
    return judged.select(
        id_col, "host", "path", "rule",
        F.when(F.col("rule").isNull(), by_model).otherwise(by_rule).alias("verdict"), "score",
    )
