"""JSON-lines source: one record per line, bad lines set aside."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names on the wire.
WIRE_FIELDS = {
    "stream_id": "_stream_id", "stream": "_stream", "msg": "_msg", "host": "host",
    "app": "app", "level": "level", "module": "module", "job": "job",
}
TIME_FIELD = "_time"
# RFC 3339 with any fraction and a zone
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
END_MARK = "end of line 6f1c2b"
# Variants keep the JSON type: a number where a text is expected makes the line
# a bad one instead of turning into text.
_WIRE = f"line STRUCT<{', '.join(f'`{n}`: VARIANT' for n in (TIME_FIELD, *WIRE_FIELDS.values()))}>, end STRING"


def _is_text(v: Column) -> Column:
    return v.isNull() | F.schema_of_variant(v).isin("STRING", "VOID")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse column ``value``; adds the record columns and ``is_good``.

    A line is good if it is one JSON object whose known fields are texts (or
    null or absent) and whose time, if given, is an RFC 3339 time. Unknown
    fields are ignored. Blank lines are dropped.
    """
    line = F.btrim("value", F.lit("\t\r\n "))
    # The parser ignores what follows a document, so the line becomes the first
    # field of an object: the mark after it is found only if the line is one
    # whole document.
    wrapped = F.concat(F.lit('{"line":'), line, F.lit(f',"end":"{END_MARK}"}}'))
    # inline() parses once per line; filters on the result stay above it.
    wire = lines.filter(line != "").select(
        *lines.columns, F.inline(F.array(F.from_json(wrapped, _WIRE)))
    )
    fields = {n: F.col("line")[n] for n in (TIME_FIELD, *WIRE_FIELDS.values())}
    raw_time = _text(fields[TIME_FIELD])
    time = F.try_to_timestamp(F.when(raw_time.rlike(RFC3339), raw_time)).cast("timestamp_ntz")
    good = F.col("line").isNotNull() & (F.col("end") == END_MARK) & (raw_time.isNull() | time.isNotNull())
    for value in fields.values():
        good = good & _is_text(value)
    return wire.select(
        *lines.columns,
        time.alias("event_time"),
        *[F.coalesce(_text(fields[w]), F.lit("")).alias(c) for c, w in WIRE_FIELDS.items()],
        F.coalesce(good, F.lit(False)).alias("is_good"),
    )


@dataclass
class Parsed:
    """``records`` follow LOG_SCHEMA; ``quarantine`` holds the bad lines."""

    records: DataFrame
    quarantine: DataFrame


def split_lines(lines: DataFrame) -> Parsed:
    """Good records and bad lines. Each side is a filter over the same parse;
    neither needs the other to be materialised."""
    parsed = parse_lines(lines)
    carried = [c for c in lines.columns if c != "value"]
    records = parsed.filter("is_good").select(
        "event_time", *WIRE_FIELDS, *carried
    )
    quarantine = parsed.filter(~F.col("is_good")).select("value", *carried)
    return Parsed(records, quarantine)


def read_jsonl(spark: SparkSession, path: str | list[str]) -> Parsed:
    return split_lines(spark.read.option("lineSep", "\n").text(path))


def stream_jsonl(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> Parsed:
    """As ``read_jsonl`` over files that keep arriving in a folder."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return split_lines(reader.text(path))


def as_jsonl(logs: DataFrame) -> DataFrame:
    """Records back to lines; empty optional fields are left out."""
    def present(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c))

    time = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return logs.select(
        F.to_json(F.struct(time.alias(TIME_FIELD), *[present(c).alias(w) for c, w in WIRE_FIELDS.items()])).alias("value")
    )
