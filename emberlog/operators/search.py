"""Search for a text in the templates of many days, by a trigram index.

The index has an inverted list per trigram, laid out by buckets of trigrams. A
search intersects the lists of the trigrams of its text, verifies what is left
on the templates themselves, and reads the incident table only on the days and
for the templates found. A text of fewer than three characters has no trigram;
it is looked up in the table of templates, which is small beside the incidents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.files import Folder

GRAM, BUCKETS = 3, 64


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substr(text, i, F.lit(GRAM))
    ))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _template_id() -> Column:
    return F.md5(F.col("normalized_msg").cast("binary"))


class TemplateIndex:
    """Tables in a folder: ``incidents`` by day, ``templates``, the inverted
    lists ``grams`` by bucket, and ``days`` of each template by day."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.folder.has(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder.at(name))

    def _templates(self) -> DataFrame:
        return self._table("templates", "template string, normalized_msg string")

    def update(self, daily: DataFrame) -> None:
        """Take up incidents (window_start, …, normalized_msg); days in the
        input replace those stored. Only templates not known yet are indexed.
        Lists are written before the templates they belong to, so an update
        that died and is repeated indexes them again, which changes no search."""
        rows = daily.withColumns({"day": F.to_date("window_start"), "template": _template_id()})
        new = rows.select("template", "normalized_msg").distinct().join(self._templates().select("template"), "template", "left_anti")
        # a template shorter than a trigram has no lists
        lists = new.filter(F.length("normalized_msg") >= GRAM).select("template", F.explode(_grams(F.col("normalized_msg"))).alias("gram"))
        (
            lists.withColumn("bucket", _bucket(F.col("gram"))).repartitionByRange("bucket", "gram", "template")
            .sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(self.folder.at("grams"))
        )
        new.write.mode("append").parquet(self.folder.at("templates"))
        for name, table in (("days", rows.select("template", "day").distinct()), ("incidents", rows)):
            table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.folder.at(name))

    def templates(self, text: str) -> DataFrame:
        """(template, normalized_msg) that contain ``text``."""
        known, wanted = self._templates(), grams_of(text)
        if wanted:
            # the buckets are computed by the engine that wrote them
            names = self.spark.createDataFrame([(g,) for g in wanted], "gram string")
            buckets = [r["b"] for r in names.select(_bucket(F.col("gram")).alias("b")).distinct().collect()]
            lists = self._table("grams", "template string, gram string, bucket int")
            lists = lists.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
            found = lists.groupBy("template").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted))
            known = known.join(found.select("template"), "template", "left_semi")
        return known.filter(F.contains("normalized_msg", F.lit(text))).dropDuplicates(["template"])

    def search(self, text: str, since=None) -> DataFrame:
        """Incidents whose template contains ``text``, on the days from ``since`` on."""
        found = self.templates(text).select("template")
        days = self._table("days", "template string, day date")
        if since is not None:
            days = days.filter(F.col("day") >= F.lit(f"{since:%Y-%m-%d}").cast("date"))
        # at most one name per stored day
        on = [r["day"] for r in days.join(found, "template", "left_semi").select("day").distinct().collect()]
        rows = self.spark.read.parquet(self.folder.at("incidents"))
        return rows.filter(F.col("day").isin(on) if on else F.lit(False)).join(found, "template", "left_semi").drop("template", "day")
