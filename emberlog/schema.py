"""Column layout of log records and of the run ledger."""

from pyspark.sql import types as T

# Text columns of a log record; an absent value is always '' and never null.
TEXT_COLUMNS = ("stream_id", "stream", "msg", "host", "app", "level", "module", "job")

# event_time is a wall clock in UTC; a zone is applied only on output.
LOG_SCHEMA = T.StructType(
    [T.StructField("event_time", T.TimestampNTZType())]
    + [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
)

# One row per ledger event. A run is the fold of its events (see plans.ledger).
LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("window_from", T.TimestampNTZType()),
        T.StructField("window_to", T.TimestampNTZType()),
        T.StructField("status", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
        T.StructField("cover_msg_id", T.LongType()),
        T.StructField("files_sent", T.LongType()),
        T.StructField("err", T.StringType()),
    ]
)

# One row per call of a digest: how it ended, and what it took.
CYCLE_SCHEMA = T.StructType(
    [
        T.StructField("window_from", T.TimestampNTZType()),
        T.StructField("window_to", T.TimestampNTZType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("errors", T.LongType()),
    ]
)

# Grouping key of an incident, and what names it without its template.
INCIDENT_KEY = ("host", "app", "normalized_msg")
HISTORY_KEY = ("host", "app", "fingerprint")

# Fixed values.
ALERT_LEVELS = ("error", "critical")
LEVEL_RANKS = {"critical": 40, "error": 30, "warn": 20, "warning": 20, "info": 10, "debug": 5}
RUN_STATUSES = ("started", "cover_sent", "done", "failed")
CYCLE_OUTCOMES = ("ok", "partial", "failed", "skipped")
NOISE_K = 5
TOP_N = 20
MAX_EXAMPLES = 3
