"""Tables, text helpers and distributed numbering shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.session import stage

__all__ = ["SPACE", "ceil_div", "each_word", "numbered", "others_aside", "prefix_sums", "stage", "table", "text_or_empty"]

#: ASCII white space as the word rules of the operators name it
SPACE = r"[\x20\x09-\x0D]+"

#: rows one task numbers or sorts at a time
BLOCK_ROWS = 8192


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def each_word(text: Column) -> Column:
    """Words: runs without ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def others_aside(*needed: str) -> Callable:
    """For a step from documents to documents: it sees the ``needed`` columns,
    and all others as one, so that these may have any name. The result has the
    columns of the input again."""

    def of(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(step)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            names = docs.columns
            others = [c for c in names if c not in needed]
            if others:
                row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in others]).alias("__row")
                docs = docs.select(*[c for c in names if c in needed], row)
            out = step(docs, *args, **options)
            return out.select(*[F.col("__row").getField(c).alias(c) if c in others else F.col(c) for c in names])

        return run

    return of


def ceil_div(n: int, by: int) -> int:
    return max(1, -(-n // by))


def prefix_sums(df: DataFrame, group: list[str], key: Column, value: str, out: str, total: int) -> DataFrame:
    """``out``: sum of ``value`` over the rows of the same group before this one,
    in the order of hashed ``key`` (unique within its group).

    Two levels, so that no group meets in one task: rows fall into blocks by
    the hash of their key, whose number follows ``total``, the number of rows;
    each block is summed on its own and shifted by the blocks before it.
    """
    blocks = ceil_div(total, BLOCK_ROWS)
    df = df.withColumn("__h", F.xxhash64(key)).withColumn("__b", F.pmod(F.col("__h"), F.lit(blocks)))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        df.groupBy(*group, "__b").agg(F.sum(value).alias("__s"))
        .withColumn("__s", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    )
    if not group:  # a constant key, only to give the small table of blocks one
        shift = shift.withColumnRenamed("__b", "__c")
        joined = df.join(shift, df["__b"] == shift["__c"]).drop("__c")
    else:
        named = shift.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__b").alias("__c"), "__s")
        cond = df["__b"] == named["__c"]
        for g in group:
            cond = cond & df[g].eqNullSafe(named[f"__g_{g}"])
        joined = df.join(named, cond).drop("__c", *[f"__g_{g}" for g in group])
    inside = (
        Window.partitionBy(*group, "__b").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1)
    )
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(out, (F.col("__s") + own).cast("long")).drop("__h", "__b", "__s")


def numbered(df: DataFrame, group: list[str], key: Column, out: str, total: int) -> DataFrame:
    """Numbers from 0 within each group, without one task holding a group."""
    return prefix_sums(df.withColumn("__one", F.lit(1)), group, key, "__one", out, total).drop("__one")
