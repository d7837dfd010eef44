"""Log and ledger views over the driver's Parquet tables.

Every view is a pure projection of its table (one join for document labels),
so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _numbered(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def event_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Log records derived from ``events``; six message shapes."""
    e = table(spark, folder, "events")
    user, event = F.col("user_id"), F.col("event_id")
    digest = F.md5(event.cast("string"))
    uuid = F.concat_ws(
        "-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    kind = F.col("event_type")
    level = (
        F.when(kind == "purchase", "critical")
        .when(kind == "error", "error")
        .when(kind == "signup", "warn")
        .when(kind == "view", "info")
        .otherwise("debug")
    )
    shape = event % 6
    msg = (
        F.when(shape == 0, F.concat(
            F.date_format("ts", "dd.MM.yyyy HH:mm:ss.SSSSSS"), F.lit(" +00:00 | E | order uid: "),
            F.upper(F.substring(digest, 1, 16)), F.lit(" rejected")))
        .when(shape == 1, F.concat(
            _numbered("connection refused to 10.", event % 250), _numbered(".1.", user % 250), F.lit(":8443")))
        .when(shape == 2, F.concat(F.lit("user="), uuid, F.lit(" failed")))
        .when(shape == 3, F.concat(
            _numbered("timeout after ", event % 40), _numbered("ms on shard ", event)))
        .when(shape == 4, F.concat(_numbered("Ошибка", event % 9), _numbered(" в модуле ", event)))
        .otherwise(F.concat(
            F.lit("at "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(" payload "), F.col("props")))
    )
    host, app = _numbered("h", user % 5 + 1), _numbered("app", user % 3)
    return e.select(
        F.col("ts").alias("event_time"),
        F.md5(_numbered("s", user)).alias("stream_id"),
        F.concat(F.lit('{app="'), app, F.lit('",host="'), host, F.lit('"}')).alias("stream"),
        msg.alias("msg"),
        host.alias("host"),
        app.alias("app"),
        level.alias("level"),
        _numbered("mod", user % 2).alias("module"),
        F.lit("ingest").alias("job"),
    )


def document_logs(spark: SparkSession, folder: str) -> DataFrame:
    """One record per line of every document; the level comes from ``labels``."""
    # labels are joined to documents, before these become many lines
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    lines = labelled.select(
        "doc_id", "lang", "source", "quality", "toxic", F.posexplode(F.split("text", "\n")).alias("pos", "msg")
    )
    level = (
        F.when(F.col("toxic") == 1, "critical")
        .when(F.col("quality") == 0, "error")
        .when(F.col("quality") == 1, "info")
        .otherwise("warn")
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return lines.select(
        (start + F.make_dt_interval(mins=F.col("doc_id").cast("int"), secs=F.col("pos"))).alias("event_time"),
        F.md5(_numbered("d", F.col("doc_id"))).alias("stream_id"),
        F.lit("").alias("stream"),
        "msg",
        F.col("source").alias("host"),
        F.col("lang").alias("app"),
        level.alias("level"),
        F.lit("").alias("module"),
        F.lit("").alias("job"),
    )


def conversation_logs(spark: SparkSession, folder: str) -> DataFrame:
    """One record per turn; the whole text is the message."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    role = F.col("role")
    return table(spark, folder, "conversations").select(
        (start + F.make_dt_interval(mins=F.col("conv_id").cast("int"), secs=F.col("turn"))).alias("event_time"),
        F.md5(_numbered("c", F.col("conv_id"))).alias("stream_id"),
        F.lit("").alias("stream"),
        F.col("text").alias("msg"),
        F.lit("chat").alias("host"),
        role.alias("app"),
        F.when(role == "system", "critical").when(role == "user", "error").otherwise("info").alias("level"),
        F.lit("").alias("module"),
        F.lit("").alias("job"),
    )


def ledger_events(spark: SparkSession, folder: str) -> DataFrame:
    """Run-ledger events derived from ``events``: one run per hour window."""
    kind, ts = F.col("event_type"), F.col("ts")
    start = F.date_trunc("hour", ts).cast("timestamp_ntz")
    return table(spark, folder, "events").select(
        F.md5(F.date_format(start, "yyyy-MM-dd HH:mm:ss")).alias("run_id"),
        start.alias("window_from"),
        (start + F.expr("INTERVAL 1 HOUR")).alias("window_to"),
        F.when(kind == "click", "cover_sent").when(kind == "purchase", "done")
        .when(kind == "error", "failed").otherwise("started").alias("status"),
        ts.alias("at"),
        F.col("event_id").alias("seq"),
        F.when(kind == "click", F.col("event_id")).alias("cover_msg_id"),
        F.when(kind == "purchase", F.col("user_id") % 5 + 1).alias("files_sent"),
        F.when(kind == "error", F.col("props")).alias("err"),
    )


def cycle_events(spark: SparkSession, folder: str) -> DataFrame:
    """Cycles of digests derived from ``events``: one per event."""
    kind, ts = F.col("event_type"), F.col("ts")
    start = F.date_trunc("hour", ts).cast("timestamp_ntz")
    return table(spark, folder, "events").select(
        start.alias("window_from"), (start + F.expr("INTERVAL 1 HOUR")).alias("window_to"),
        F.when(kind == "error", "failed").when(kind == "click", "partial").when(kind == "view", "skipped")
        .otherwise("ok").alias("outcome"),
        ts.alias("at"), F.col("value").alias("seconds"),
        F.when(kind == "click", F.col("user_id") % 3 + 1).otherwise(0).cast("long").alias("errors"),
    )
