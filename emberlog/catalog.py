"""Every operator as a query over the driver's tables.

Each query takes (spark, folder) and reads whole tables. Queries that need an
incident table twice stage it first.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import links, text
from emberlog.functions.fingerprint import fingerprint, level_rank, short_fingerprint
from emberlog.functions.normalize import DEFAULT_PROFILE, EXTENDED_PROFILE, Rule, normalize
from emberlog.functions.windows import Window, digest_window_at, digest_window_for, timestamp
from emberlog.operators import filters, incidents as inc, patterns as pat, ranking, stats, totals
from emberlog.operators.search import TemplateIndex
from emberlog.plans import history, ledger, metrics, rollups
from emberlog.plans.digest import DigestConfig, build_digest
from emberlog.plans.report import cover_rows
from emberlog.schema import ALERT_LEVELS, LOG_SCHEMA, MAX_EXAMPLES
from emberlog.session import scratch_dir, stage
from emberlog.sources import jsonl
from emberlog.sources.collect import union_sources
from emberlog.sources.files import Folder
from emberlog.sources.sinks import write_daily
from emberlog.sources.store import RecordStore, write_records
from emberlog.sources.tables import (
    conversation_logs, cycle_events, document_logs, event_logs, ledger_events, table,
)
from emberlog.streaming.alerts import new_critical_alerts, throttled_alerts
from emberlog.streaming.ingest import incident_counts
from emberlog.streaming.run import drain

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries; the oracle uses the same ones.
ZONE = "Europe/Moscow"  # UTC+3 all year
NOW = datetime(2024, 1, 30, 23, 0)
MIDDLE = datetime(2024, 1, 16)
WINDOW = Window(datetime(2024, 1, 1, 5), datetime(2024, 1, 31, 5))
DAY = digest_window_for("2024-01-11", ZONE)
LAST_DAY = digest_window_at(datetime(2024, 1, 20, 9, 41, tzinfo=timezone.utc), ZONE)
HOSTS = ("h1", "h2", "h3", "h4", "h5", "h6")
LABELS = {"h1": "Primary", "h3": "Backup"}
TARGET = links.LinkTarget("https://logs.example.com/view/", 2, "ds1", "logs")
CUSTOM_PROFILE = (
    Rule("shard", r"(?i)\bshard (\d+)", "shard <${1}>"),
    Rule("tail", r"\s+failed$", " <end>"),
    Rule("money", r"payload", "$$"),
    Rule("word_end", r"\w+\b:", "<key>:"),
)
SECRETS = ("refused", "", "uid: ", "модуле")
K, N = 5, 20


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    return filters.by_levels(event_logs(spark, folder), ALERT_LEVELS)


def _incidents(spark: SparkSession, folder: str) -> DataFrame:
    return inc.incidents(_alerts(spark, folder))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.fold_runs(ledger_events(spark, folder))


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return ledger_events(spark, folder).select("window_from", "window_to").distinct()


def _runs_before_middle(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.fold_runs(ledger_events(spark, folder).filter(F.col("at") < timestamp(MIDDLE)))


def _before(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("event_time") < timestamp(MIDDLE))


def _after(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("event_time") >= timestamp(MIDDLE))


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return pat.daily_incidents(_alerts(spark, folder), tz=ZONE)


# --- sources -----------------------------------------------------------------

def read_jsonl(spark, folder):
    path = f"{scratch_dir(spark)}/jsonl/{uuid.uuid4().hex}"
    jsonl.as_jsonl(event_logs(spark, folder)).write.text(path)
    return jsonl.read_jsonl(spark, path).records


def quarantine(spark, folder):
    """Four kinds of damage by event type; errors stay whole."""
    e = table(spark, folder, "events")
    good = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("_time"), F.col("props").alias("_msg"),
        F.col("event_type").alias("app")))
    value = (
        F.when(F.col("event_type") == "view", F.left(good, F.length(good) - 3))
        .when(F.col("event_type") == "click", F.replace(good, F.lit('"app":"click"'), F.lit('"app":7')))
        .when(F.col("event_type") == "signup", F.replace(good, F.lit('Z"'), F.lit('"')))
        .when(F.col("event_type") == "purchase", F.concat(good, F.lit(" trailing")))
        .otherwise(good)
    )
    return jsonl.split_lines(e.select(value.alias("value"), "event_id")).quarantine.select("event_id")


def long_lines(spark, folder):
    """Lines of many times the length of a document, through JSON and back."""
    path = f"{scratch_dir(spark)}/jsonl/{uuid.uuid4().hex}"
    texts = {"stream_id": F.md5(F.concat(F.lit("d"), F.col("doc_id").cast("string"))), "msg": F.repeat("text", F.lit(40))}
    long = spark.read.parquet(f"{folder}/documents.parquet").select(
        *[texts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA])
    # a line is 40 times its text, which repeats: as plain text the files would be many times the input
    jsonl.as_jsonl(long).write.option("compression", "lz4").text(path)
    return jsonl.read_jsonl(spark, path).records.select(
        "stream_id", F.octet_length("msg").cast("long").alias("bytes"), F.md5("msg").alias("digest"))


def _collected(spark, folder):
    return union_sources(spark, {
        "events": lambda: event_logs(spark, folder),
        "documents": lambda: document_logs(spark, folder),
        "conversations": lambda: conversation_logs(spark, folder),
        "missing": lambda: spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/no_such_source"),
    })


def _volumes(records):
    return records.groupBy("host", "app", "level").agg(
        F.count("*").alias("records"), F.sum(F.octet_length("msg").cast("long")).alias("bytes"))


def union_of_sources(spark, folder):
    return _volumes(_collected(spark, folder).records)


def _damaged(spark, folder):
    """Records of three hosts as lines; the files of one are not what their
    names say, which shows only when they are read."""
    base = Folder(spark, f"{scratch_dir(spark)}/damaged/{uuid.uuid4().hex}")
    logs = event_logs(spark, folder)
    for host in ("h1", "h2", "h3"):
        jsonl.as_jsonl(filters.by_host(logs, host)).write.text(base.at(host))
    for part in base.names("h2"):
        if part.startswith("part-"):
            base.move(base.at("h2", part), "h2", f"{part}.gz")
    return union_sources(spark, {h: lambda h=h: jsonl.read_jsonl(spark, base.at(h)).records for h in ("h1", "h2", "h3")})


def damaged_source(spark, folder):
    """What is left without the source that fails while it is read."""
    return _damaged(spark, folder).attempt(lambda records: stage(_volumes(records)))


def damaged_source_status(spark, folder):
    sources = _damaged(spark, folder)
    sources.attempt(lambda records: stage(_volumes(records)))
    return sources.status.select("source", "failed")


def _store(spark, folder):
    path = f"{scratch_dir(spark)}/records/{uuid.uuid4().hex}"
    write_records(event_logs(spark, folder), path)
    return RecordStore(spark, path)


def stored_records(spark, folder):
    """Two hosts and two levels of some days, from their folders."""
    return _store(spark, folder).select(digest_window_for("2024-01-11", ZONE), ("h2", "h4"), ALERT_LEVELS)


def stored_stream(spark, folder):
    """One stream of the whole time, by the filters of the files."""
    logs = event_logs(spark, folder)
    return _store(spark, folder).select(WINDOW, stream_id=logs.agg(F.min("stream_id")).first()[0])


def stored_freshness(spark, folder):
    return _store(spark, folder).freshness(NOW)


def source_freshness(spark, folder):
    return stats.source_freshness(event_logs(spark, folder), NOW)


def source_status(spark, folder):
    """One of the sources is not there; the others are whole."""
    return _collected(spark, folder).status.select("source", "failed")


def source_partial(spark, folder):
    return _collected(spark, folder).is_partial()


def has_recent(spark, folder):
    return stats.has_recent(event_logs(spark, folder), NOW).select((F.col("event_time") <= timestamp(NOW)).alias("found"))


# --- filters -----------------------------------------------------------------

def logs_by_host(spark, folder):
    return filters.by_host(event_logs(spark, folder), "h2")


def logs_by_level(spark, folder):
    return filters.by_levels(event_logs(spark, folder), ["error", " critical ", ""])


def logs_window(spark, folder):
    return filters.in_window(event_logs(spark, folder), DAY)


def logs_scheduled_window(spark, folder):
    return filters.in_window(event_logs(spark, folder), LAST_DAY)


def logs_extra_filter(spark, folder):
    query = filters.LogQuery(WINDOW, host="h3", levels=("error", "critical"), extra=(
        F.col("app") == "app1", F.col("msg").rlike("refused|модуле")))
    return query.apply(event_logs(spark, folder))


def logs_all_hosts(spark, folder):
    return filters.digest_records(event_logs(spark, folder), ["h1", "h4"], ALERT_LEVELS, WINDOW)


def logs_last_hours(spark, folder):
    return filters.last(event_logs(spark, folder), timedelta(hours=24), NOW, offset=timedelta(hours=6))


def first_records(spark, folder):
    return filters.first_n(event_logs(spark, folder), 100)


# --- joins -------------------------------------------------------------------

def host_totals_zero_filled(spark, folder):
    return totals.zero_filled(totals.host_list(spark, HOSTS), totals.host_totals(_alerts(spark, folder)))


def host_labels(spark, folder):
    return totals.with_labels(totals.host_totals(_alerts(spark, folder)), LABELS)


def pending_windows(spark, folder):
    return ledger.pending_windows(_windows(spark, folder), _runs_before_middle(spark, folder))


def new_fingerprints_antijoin(spark, folder):
    logs = _alerts(spark, folder)
    history = inc.incidents(_before(logs))
    since = timestamp(MIDDLE - timedelta(days=7))
    return pat.new_fingerprints(inc.incidents(_after(logs)), history, since).select(
        "host", "app", "fingerprint", "cnt", "first_seen")


# --- aggregations ------------------------------------------------------------

def incidents(spark, folder):
    return _incidents(spark, folder)


def doc_incidents(spark, folder):
    return inc.incidents(document_logs(spark, folder))


def _examples(logs):
    """Only records up to the time by which enough messages are known."""
    return inc.examples(logs, only=stage(inc.incidents(logs, examples_for=MAX_EXAMPLES)))


def incident_examples(spark, folder):
    return _examples(_alerts(spark, folder))


def doc_examples(spark, folder):
    return _examples(document_logs(spark, folder))


def incident_streams(spark, folder):
    return inc.incidents(event_logs(spark, folder)).select("host", "fingerprint", "streams")


def level_escalation(spark, folder):
    return inc.incidents(event_logs(spark, folder)).select("host", "fingerprint", "level", "module", "cnt")


def app_totals(spark, folder):
    return totals.app_totals(_incidents(spark, folder))


def host_totals(spark, folder):
    return totals.host_totals(event_logs(spark, folder))


def noise_summary(spark, folder):
    return totals.noise_summary(_incidents(spark, folder), K)


def cover_totals(spark, folder):
    rows = inc.incidents(_alerts(spark, folder), level_counts=("error", "critical"))
    return totals.cover_totals(totals.host_summary(rows, K))


def hosts(spark, folder):
    return totals.hosts(event_logs(spark, folder))


def hits_histogram(spark, folder):
    return stats.hits(event_logs(spark, folder), "1 hour", ("host", "level"))


def hits_series(spark, folder):
    series = stats.hits_series(_alerts(spark, folder), "1 hour", ("host", "app"))
    return series.select(
        F.col("fields")["host"].alias("host"), F.col("fields")["app"].alias("app"), "total",
        F.posexplode(F.arrays_zip("timestamps", "values")).alias("no", "p"),
    ).select("host", "app", "total", "no", F.col("p.timestamps").alias("bucket"), F.col("p.values").alias("hits"))


def stats_by_host_level(spark, folder):
    return stats.stats_by(event_logs(spark, folder), "host", "level")


def stats_by_app(spark, folder):
    return stats.stats_by(_alerts(spark, folder), "app")


def dedup_ratio(spark, folder):
    return totals.dedup_ratio(_incidents(spark, folder))


def incident_levels(spark, folder):
    return inc.incident_levels(event_logs(spark, folder))


def incident_level_map(spark, folder):
    m = inc.incident_level_map(event_logs(spark, folder))
    return m.select("host", "app", "fingerprint", *[
        F.coalesce(F.col("levels")[lv], F.lit(0)).alias(lv) for lv in ("critical", "error", "warn", "info", "debug")])


def app_share(spark, folder):
    return totals.app_share(stage(totals.app_totals(_incidents(spark, folder))))


def top_pattern_others(spark, folder):
    return totals.top_pattern_others(_incidents(spark, folder))


def field_values(spark, folder):
    return stats.field_values(event_logs(spark, folder), "stream")


# --- ranking -----------------------------------------------------------------

_RANK_COLUMNS = ("host", "fingerprint", "cnt", "first_seen", "rank")


def incident_rank(spark, folder):
    return ranking.incident_rank(_incidents(spark, folder)).select(*_RANK_COLUMNS)


def incident_top(spark, folder):
    return ranking.top_incidents(_incidents(spark, folder), K, N).select(*_RANK_COLUMNS)


def incident_sections(spark, folder):
    return ranking.incident_sections(stage(_incidents(spark, folder)), K, N).select(
        "host", "app", "fingerprint", "cnt", F.coalesce("rank", F.lit(0)).alias("rank"), "section")


def top_app_per_host(spark, folder):
    return totals.top_app_per_host(totals.app_totals(_incidents(spark, folder)))


def top_apps(spark, folder):
    return totals.top_apps(event_logs(spark, folder), 2)


def _with_gaps(logs):
    """Signups lose their time, clicks their host."""
    return logs.withColumns({
        "event_time": F.when(F.col("level") != "warn", F.col("event_time")),
        "host": F.when(F.col("level") != "debug", F.col("host")),
    })


def host_cap(spark, folder):
    kept, _ = ranking.host_cap(_with_gaps(event_logs(spark, folder)), 1000)
    return kept.select("host", "event_time", "msg")


def host_cap_summary(spark, folder):
    return ranking.host_cap(_with_gaps(event_logs(spark, folder)), 1000)[1]


# --- scalar functions --------------------------------------------------------

def normalize_query(spark, folder):
    return event_logs(spark, folder).select("event_time", "msg", normalize("msg").alias("normalized_msg"))


def normalize_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", normalize("text").alias("normalized_msg"))


def normalize_custom(spark, folder):
    return inc.with_template(event_logs(spark, folder), CUSTOM_PROFILE).select("event_time", "msg", "normalized_msg")


def normalize_extended(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("msg"))
    logs = event_logs(spark, folder).select(F.date_format("event_time", "yyyyMMddHHmmssSSSSSS").alias("id"), "msg")
    return logs.unionByName(docs).select("id", normalize("msg", EXTENDED_PROFILE).alias("normalized_msg"))


def fingerprint_query(spark, folder):
    logs = inc.with_template(event_logs(spark, folder))
    return logs.select("event_time", fingerprint().alias("fingerprint"),
                       short_fingerprint(fingerprint()).alias("short"))


def level_rank_query(spark, folder):
    docs = document_logs(spark, folder).select("level")
    types = table(spark, folder, "events").select(F.col("event_type").alias("level"))
    both = event_logs(spark, folder).select("level").unionByName(docs).unionByName(types)
    return both.groupBy("level", level_rank().cast("int").alias("level_rank")).agg(F.count("*").alias("records"))


def first_line(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    turns = table(spark, folder, "conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    return docs.unionByName(turns).select("kind", "id", "turn", text.first_line("text").alias("first_line"))


def fmt_time(spark, folder):
    t = F.when(F.col("level") != "debug", F.col("event_time"))
    return event_logs(spark, folder).select(
        "event_time", text.fmt_time(t, ZONE).alias("long_form"), text.fmt_time_short(t, ZONE).alias("short_form"))


def html_escape(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.html_escape("html").alias("escaped"))


def mask_secrets(spark, folder):
    return event_logs(spark, folder).select("event_time", text.mask_secrets("msg", SECRETS).alias("masked"))


def truncate_example(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.truncate_example("text").alias("example"))


def _linked(spark, folder):
    start, end = links.link_range(WINDOW)
    return _incidents(spark, folder).withColumns(
        {"expr": links.incident_expr(), "link_from": start, "link_to": end})


def link_expr(spark, folder):
    return _linked(spark, folder).select(
        "fingerprint", "expr", links.host_expr("host", ALERT_LEVELS).alias("host_expr"),
        F.lit(links.all_hosts_expr(HOSTS, ALERT_LEVELS)).alias("all_expr"))


def link_range(spark, folder):
    return _linked(spark, folder).select("fingerprint", "link_from", "link_to")


def explore_link(spark, folder):
    link = links.explore_link(TARGET, F.col("expr"), F.col("link_from"), F.col("link_to"))
    return _linked(spark, folder).select("fingerprint", link.alias("link"))


def report_files(spark, folder):
    found = event_logs(spark, folder).groupBy("host").agg(F.max("event_time").alias("window_to"))
    return found.select(
        "host", text.report_date("window_to", ZONE).alias("report_date"),
        text.report_file("host", "window_to", ZONE).alias("file_name"))


# --- windows and alerts ------------------------------------------------------

def daily_incidents(spark, folder):
    return _daily(spark, folder).select(
        "window_start", "host", "app", "fingerprint", "level", "module", "cnt", "first_seen", "last_seen", "streams")


def new_critical(spark, folder):
    return pat.new_criticals(_alerts(spark, folder))


def doc_new_critical(spark, folder):
    return pat.new_criticals(document_logs(spark, folder), timedelta(days=1))


def alert_throttle(spark, folder):
    return pat.throttle_alerts(event_logs(spark, folder))


def alert_throttle_long(spark, folder):
    """A gap of twelve hours, within which most fingerprints come again."""
    return pat.throttle_alerts(event_logs(spark, folder), timedelta(hours=12))


def _streamed(spark, logs, transform, cuts=(datetime(2024, 1, 11), datetime(2024, 1, 21))):
    """Three runs over records that arrive in order of time, each going on
    where the one before stopped. With the last, early records arrive once
    more, days behind the watermark: they must not count."""
    base = f"{scratch_dir(spark)}/stream/{uuid.uuid4().hex}"
    at, (first, last) = F.col("event_time"), map(timestamp, cuts)
    late = logs.where(at < timestamp(cuts[0] - timedelta(days=1)))
    for rows in (
        logs.where(at < first), logs.where((at >= first) & (at < last)), logs.where((at >= last) | at.isNull()).union(late),
    ):
        rows.write.mode("append").parquet(f"{base}/in")
        out = drain(spark, f"{base}/in", transform, f"{base}/out", f"{base}/checkpoint")
    return out


def stream_incident_counts(spark, folder):
    return _streamed(spark, _alerts(spark, folder), incident_counts)


def stream_new_critical(spark, folder):
    return _streamed(spark, _alerts(spark, folder), new_critical_alerts)


def stream_throttled_alerts(spark, folder):
    return _streamed(spark, event_logs(spark, folder), throttled_alerts)


def stream_throttled_long(spark, folder):
    return _streamed(spark, event_logs(spark, folder), lambda logs: throttled_alerts(logs, timedelta(hours=12)))


def stream_handed_over(spark, folder):
    """A stream that begins in the middle of the month with the stored history."""
    logs = _alerts(spark, folder)
    stored = _history(spark)
    stored.update(inc.incidents(_before(logs)), Window(WINDOW.start, MIDDLE))
    return _streamed(
        spark, _after(logs), lambda rows: new_critical_alerts(rows, known=stored.current()),
        (datetime(2024, 1, 19), datetime(2024, 1, 24)),
    )


# --- ledger ------------------------------------------------------------------

def _without_nulls(runs: DataFrame) -> DataFrame:
    return runs.withColumns({"cover_msg_id": F.coalesce("cover_msg_id", F.lit(-1)), "err": F.coalesce("err", F.lit(""))})


def run_status(spark, folder):
    return _without_nulls(_runs(spark, folder))


def stored_runs(spark, folder):
    """The ledger's own table after two appends."""
    stored = ledger.RunLedger(spark, f"{scratch_dir(spark)}/ledger/{uuid.uuid4().hex}")
    events, early = ledger_events(spark, folder), F.col("at") < timestamp(MIDDLE)
    for part in (early, ~early):
        stored.table.append(events.filter(part))
    return _without_nulls(stored.runs())


def begin_run_actions(spark, folder):
    return ledger.begin_actions(_windows(spark, folder), _runs_before_middle(spark, folder))


def completed_run(spark, folder):
    runs = _runs(spark, folder)
    first = Window(datetime(2024, 1, 10, 7), datetime(2024, 1, 10, 8))
    return _without_nulls(ledger.completed_run(runs, first))


def recent_runs(spark, folder):
    return _without_nulls(ledger.recent_runs(_runs(spark, folder), 0))


def _history(spark):
    return history.FingerprintHistory(spark, f"{scratch_dir(spark)}/history/{uuid.uuid4().hex}")


def fingerprint_history(spark, folder):
    """Two digests, of which the second is delivered twice."""
    logs = _alerts(spark, folder)
    stored = _history(spark)
    stored.update(inc.incidents(_before(logs)), Window(WINDOW.start, MIDDLE))
    for _ in range(2):
        stored.update(inc.incidents(_after(logs)), WINDOW)
    return stored.current().drop("profile_version", "updated_at").withColumnRenamed("count_last_24h", "count_last")


def retention(spark, folder):
    return pat.retained(_incidents(spark, folder), timestamp(NOW), 10).select("host", "fingerprint", "last_seen")


def retained_runs(spark, folder):
    return ledger.retained_runs(_runs(spark, folder), timestamp(NOW), 14).select("run_id", "status", "completed_at")


def history_by_version(spark, folder):
    """A table that holds two profiles, folded and read again."""
    logs = _alerts(spark, folder)
    stored = _history(spark)
    stored.update(inc.incidents(_before(logs), EXTENDED_PROFILE), Window(WINDOW.start, MIDDLE), EXTENDED_PROFILE)
    stored.update(inc.incidents(_after(logs)), WINDOW)
    stored.compact()
    return stored.current().select("host", "app", "fingerprint", "first_seen", "last_seen", "count_total")


def history_kept(spark, folder):
    """Two digests; what the first alone has seen is swept, and the second is
    delivered once more after that."""
    logs = _alerts(spark, folder)
    stored = _history(spark)
    stored.update(inc.incidents(_before(logs)), Window(WINDOW.start, MIDDLE))
    stored.update(inc.incidents(_after(logs)), WINDOW)
    stored.sweep(NOW, 10)
    stored.update(inc.incidents(_after(logs)), WINDOW)
    return stored.current().drop("profile_version", "sample_msg", "updated_at")


# --- reports and metrics -----------------------------------------------------

def _digest(spark, folder):
    cfg = DigestConfig(HOSTS, TARGET, noise_k=K, top_n=N, tz=ZONE, labels=LABELS)
    return build_digest(event_logs(spark, folder), WINDOW, cfg, NOW)


def report_lines(spark, folder):
    return _digest(spark, folder).lines


def report_bodies(spark, folder):
    return _digest(spark, folder).reports


def cover_rows_query(spark, folder):
    return cover_rows(_digest(spark, folder).hosts)


def cover(spark, folder):
    return _digest(spark, folder).cover


def cycle_outcomes(spark, folder):
    return ledger.cycle_outcomes(cycle_events(spark, folder))


def metric_partial_errors(spark, folder):
    return ledger.partial_errors(cycle_events(spark, folder))


def duration_histogram(spark, folder):
    return metrics.duration_histogram(table(spark, folder, "events"), "value", by=("event_type",))


def metric_host_records(spark, folder):
    return metrics.host_records(totals.host_totals(event_logs(spark, folder)))


def metric_host_incidents(spark, folder):
    return metrics.host_incidents(_incidents(spark, folder))


def patterns(spark, folder):
    return pat.patterns(_incidents(spark, folder))


def pattern_hosts(spark, folder):
    return pat.pattern_hosts(stage(_incidents(spark, folder)))


def pattern_flags(spark, folder):
    return pat.flag_patterns(stage(_incidents(spark, folder))).select(
        "host", "app", "fingerprint", "cnt", "host_count", "is_pattern")


def new_patterns_per_day(spark, folder):
    return pat.new_patterns_per_day(_daily(spark, folder))


def slo_success_rate(spark, folder):
    return metrics.success_rate(cycle_events(spark, folder))


def slo_failed_share(spark, folder):
    return metrics.failed_share(cycle_events(spark, folder))


def slo_latency(spark, folder):
    return metrics.latency_quantile(_runs(spark, folder))


def delivery_state(spark, folder):
    return metrics.delivery_state(_runs(spark, folder), NOW)


def burn_rate(spark, folder):
    return metrics.burn_rate(event_logs(spark, folder))


def incident_browse(spark, folder):
    """Over the table by digest day, whose folders ``since`` prunes."""
    path = f"{scratch_dir(spark)}/daily/{uuid.uuid4().hex}"
    write_daily(_daily(spark, folder), path)
    kept = pat.since_day(spark.read.parquet(path), NOW - timedelta(days=10))
    return pat.browse(
        kept, host="h2", level="critical", pattern="<ip>", since=timestamp(NOW - timedelta(days=10))
    ).select("window_start", "host", "app", "fingerprint", "cnt")


def slo_latency_sketch(spark, folder):
    """From daily sketches that are stored and read again."""
    path = f"{scratch_dir(spark)}/latency/{uuid.uuid4().hex}"
    cycles = cycle_events(spark, folder).filter(F.col("outcome").isin("ok", "partial"))
    metrics.latency_sketches(cycles).write.parquet(path)
    return metrics.sketched_quantile(spark.read.parquet(path))


def _rollup(spark, folder):
    path = f"{scratch_dir(spark)}/rollup/{uuid.uuid4().hex}"
    rollups.write_rollup(rollups.daily_rollup(_alerts(spark, folder), tz=ZONE), path)
    return pat.since_day(spark.read.parquet(path), NOW - timedelta(days=20))


def rollup_streams(spark, folder):
    return rollups.records_and_streams(_rollup(spark, folder), "host", "app")


def rollup_templates(spark, folder):
    return rollups.templates_per_day(_rollup(spark, folder), "host")


def _index(spark, folder):
    index = TemplateIndex(spark, f"{scratch_dir(spark)}/index/{uuid.uuid4().hex}")
    daily = _daily(spark, folder)
    # in two updates, of which the second brings the middle day again
    index.update(daily.filter(F.col("window_start") <= timestamp(MIDDLE)))
    index.update(daily.filter(F.col("window_start") > timestamp(MIDDLE - timedelta(days=1))))
    return index


def template_search(spark, folder):
    return _index(spark, folder).search("модуле <", NOW - timedelta(days=20)).select("window_start", "host", "app", "fingerprint", "cnt")


def template_search_short(spark, folder):
    return _index(spark, folder).search(" <").select("window_start", "host", "app", "fingerprint", "cnt")


QUERIES: dict[str, Query] = {
    "slo_latency_sketch": slo_latency_sketch,
    "rollup_streams": rollup_streams,
    "rollup_templates": rollup_templates,
    "template_search": template_search,
    "template_search_short": template_search_short,
    "read_jsonl": read_jsonl,
    "long_lines": long_lines,
    "quarantine": quarantine,
    "union_sources": union_of_sources,
    "damaged_source": damaged_source,
    "damaged_source_status": damaged_source_status,
    "stored_records": stored_records,
    "stored_stream": stored_stream,
    "stored_freshness": stored_freshness,
    "source_freshness": source_freshness,
    "source_status": source_status,
    "source_partial": source_partial,
    "has_recent": has_recent,
    "logs_scheduled_window": logs_scheduled_window,
    "metric_partial_errors": metric_partial_errors,
    "history_kept": history_kept,
    "pattern_hosts": pattern_hosts,
    "logs_by_host": logs_by_host,
    "logs_by_level": logs_by_level,
    "logs_window": logs_window,
    "logs_extra_filter": logs_extra_filter,
    "logs_all_hosts": logs_all_hosts,
    "logs_last_hours": logs_last_hours,
    "first_records": first_records,
    "host_totals_zero_filled": host_totals_zero_filled,
    "host_labels": host_labels,
    "pending_windows": pending_windows,
    "new_fingerprints_antijoin": new_fingerprints_antijoin,
    "incidents": incidents,
    "doc_incidents": doc_incidents,
    "incident_examples": incident_examples,
    "doc_examples": doc_examples,
    "incident_streams": incident_streams,
    "level_escalation": level_escalation,
    "app_totals": app_totals,
    "host_totals": host_totals,
    "noise_summary": noise_summary,
    "cover_totals": cover_totals,
    "hosts": hosts,
    "hits_histogram": hits_histogram,
    "hits_series": hits_series,
    "stats_by_host_level": stats_by_host_level,
    "stats_by_app": stats_by_app,
    "dedup_ratio": dedup_ratio,
    "incident_levels": incident_levels,
    "incident_level_map": incident_level_map,
    "app_share": app_share,
    "top_pattern_others": top_pattern_others,
    "field_values": field_values,
    "incident_rank": incident_rank,
    "incident_top": incident_top,
    "incident_sections": incident_sections,
    "top_app_per_host": top_app_per_host,
    "top_apps": top_apps,
    "host_cap": host_cap,
    "host_cap_summary": host_cap_summary,
    "normalize": normalize_query,
    "normalize_documents": normalize_documents,
    "normalize_custom": normalize_custom,
    "normalize_extended": normalize_extended,
    "fingerprint": fingerprint_query,
    "level_rank": level_rank_query,
    "first_line": first_line,
    "fmt_time": fmt_time,
    "html_escape": html_escape,
    "mask_secrets": mask_secrets,
    "truncate_example": truncate_example,
    "link_expr": link_expr,
    "link_range": link_range,
    "explore_link": explore_link,
    "report_files": report_files,
    "daily_incidents": daily_incidents,
    "new_critical": new_critical,
    "doc_new_critical": doc_new_critical,
    "alert_throttle": alert_throttle,
    "alert_throttle_long": alert_throttle_long,
    "stream_incident_counts": stream_incident_counts,
    "stream_new_critical": stream_new_critical,
    "stream_throttled_alerts": stream_throttled_alerts,
    "stream_throttled_long": stream_throttled_long,
    "stream_handed_over": stream_handed_over,
    "run_status": run_status,
    "stored_runs": stored_runs,
    "begin_run_actions": begin_run_actions,
    "completed_run": completed_run,
    "recent_runs": recent_runs,
    "fingerprint_history": fingerprint_history,
    "retention": retention,
    "retained_runs": retained_runs,
    "history_by_version": history_by_version,
    "report_lines": report_lines,
    "report_bodies": report_bodies,
    "cover_rows": cover_rows_query,
    "cover": cover,
    "cycle_outcomes": cycle_outcomes,
    "duration_histogram": duration_histogram,
    "metric_host_records": metric_host_records,
    "metric_host_incidents": metric_host_incidents,
    "patterns": patterns,
    "pattern_flags": pattern_flags,
    "new_patterns_per_day": new_patterns_per_day,
    "slo_success_rate": slo_success_rate,
    "slo_failed_share": slo_failed_share,
    "slo_latency": slo_latency,
    "delivery_state": delivery_state,
    "burn_rate": burn_rate,
    "incident_browse": incident_browse,
}
