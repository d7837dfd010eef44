"""The digest: from records to reports, cover and ledger rows."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.links import LinkTarget, all_hosts_expr, explore_link, host_expr, incident_expr, link_range
from emberlog.functions.normalize import DEFAULT_PROFILE, compile_profile
from emberlog.functions.text import report_date, report_file, truncate_example
from emberlog.functions.windows import DEFAULT_ZONE, Window
from emberlog.operators.filters import digest_records
from emberlog.operators.incidents import examples, incidents
from emberlog.operators.ranking import top_incidents
from emberlog.operators.totals import (
    app_totals, host_list, host_summary, top_app_per_host, with_labels, zero_filled,
)
from emberlog.plans.history import HISTORY_DAYS, FingerprintHistory
from emberlog.plans.ledger import RUN_DAYS, RunLedger
from emberlog.plans.report import cover, report_bodies, report_lines
from emberlog.schema import ALERT_LEVELS, MAX_EXAMPLES, NOISE_K, TOP_N
from emberlog.session import stage
from emberlog.sources.collect import Collected
from emberlog.sources.sinks import REPORT_DAYS, sweep_reports, write_reports


@dataclass(frozen=True)
class DigestConfig:
    hosts: tuple[str, ...]
    link: LinkTarget
    levels: tuple[str, ...] = ALERT_LEVELS
    noise_k: int = NOISE_K
    top_n: int = TOP_N
    max_examples: int = MAX_EXAMPLES
    #: bytes an example may have in a report; whole messages if not set
    example_bytes: int | None = None
    tz: str = DEFAULT_ZONE
    ext: str = "md"
    labels: dict[str, str] = field(default_factory=dict)
    profile: tuple = DEFAULT_PROFILE

    def __post_init__(self):
        if not self.hosts or not self.levels:
            raise ValueError("hosts and levels are needed")
        if self.top_n < 1:
            object.__setattr__(self, "top_n", TOP_N)
        if self.max_examples < 1:
            object.__setattr__(self, "max_examples", MAX_EXAMPLES)
        object.__setattr__(self, "noise_k", max(1, self.noise_k))
        compile_profile(self.profile)


@dataclass
class Digest:
    """Tables of one digest; ``incidents`` and ``top`` are staged."""

    incidents: DataFrame
    apps: DataFrame
    hosts: DataFrame
    top: DataFrame
    examples: DataFrame
    lines: DataFrame
    reports: DataFrame
    cover: DataFrame


def build_digest(
    logs: DataFrame, window: Window, cfg: DigestConfig, generated_at: datetime, partial: bool = False
) -> Digest:
    """Two passes over the records: the incident table of the first feeds all
    numbers, the second fetches the examples of the listed incidents only."""
    spark = logs.sparkSession
    records = digest_records(logs, cfg.hosts, cfg.levels, window)
    incs = stage(incidents(
        records, cfg.profile, level_counts=("error", "critical"), examples_for=cfg.max_examples
    ))
    apps = app_totals(incs)
    lo, hi = window.bounds

    start, end = link_range(window)
    listed = top_incidents(incs, cfg.noise_k, cfg.top_n)
    top = stage(listed.withColumn("link", explore_link(cfg.link, incident_expr(), start, end)))

    counts = ("error", "critical", "total", "incidents", "above", "below", "below_records")
    configured = with_labels(host_list(spark, cfg.hosts), cfg.labels)
    hosts = zero_filled(configured, host_summary(incs, cfg.noise_k), counts)
    hosts = hosts.withColumn("listed", F.least("above", F.lit(cfg.top_n).cast("long")))
    hosts = hosts.join(top_app_per_host(apps).select("host", F.col("app").alias("top_app")), "host", "left")
    hosts = stage(
        hosts.withColumn("top_app", F.coalesce("top_app", F.lit("")))
        .withColumn("link", explore_link(cfg.link, host_expr("host", cfg.levels), lo, hi))
    )

    shown = examples(records, cfg.profile, cfg.max_examples, only=top)
    if cfg.example_bytes:
        shown = shown.withColumn("msg", truncate_example("msg", cfg.example_bytes))
    lines = report_lines(hosts, apps, top, shown, window, cfg.tz, cfg.noise_k, generated_at)
    reports = report_bodies(lines).select(
        "host", report_date(hi, cfg.tz).alias("report_date"),
        report_file("host", hi, cfg.tz, cfg.ext).alias("file_name"), "body",
    )
    all_link = explore_link(cfg.link, F.lit(all_hosts_expr(cfg.hosts, cfg.levels)), lo, hi)
    return Digest(incs, apps, hosts, top, shown, lines, reports,
                  cover(hosts, window, cfg.tz, all_link, partial))


def sweep(
    spark: SparkSession, out: str, now: datetime, ledger: RunLedger | None = None, history: FingerprintHistory | None = None,
    report_days: int = REPORT_DAYS, run_days: int = RUN_DAYS, history_days: int = HISTORY_DAYS,
) -> None:
    """Retention of all that digests leave: report files, delivered runs and
    fingerprints not seen any more."""
    sweep_reports(spark, f"{out}/reports", now, report_days)
    if ledger is not None:
        ledger.sweep(now, run_days)
    if history is not None:
        history.sweep(now, history_days)


def run_digest(
    logs: DataFrame | Collected, window: Window, cfg: DigestConfig, out: str, ledger: RunLedger | None = None,
    errors: int = 0, history: FingerprintHistory | None = None,
) -> Digest | None:
    """Build and write the digest of a window once. Returns None for a window
    that is already delivered; a failure is recorded and raised again.

    ``logs`` may be collected sources: one that fails on the way is left out
    and the digest is made without it. ``errors`` is the number of sources that
    could not be read; a digest without them is partial. Every call leaves its outcome among the cycles of
    the ledger. ``history`` takes up the incidents of a delivered digest.
    """
    began = time.monotonic()

    known = errors

    def deliver(records: DataFrame) -> Digest:
        missing = known + (logs.failures() if isinstance(logs, Collected) else 0)
        made = build_digest(records, window, cfg, datetime.now(timezone.utc), missing > 0)
        write_reports(made.reports, f"{out}/reports")
        made.cover.coalesce(1).write.mode("overwrite").parquet(f"{out}/cover/{window.end:%Y%m%dT%H%M}")
        return made

    def outcome(kind: str) -> None:
        if ledger is not None:
            ledger.record_cycle(window, kind, time.monotonic() - began, errors)

    run_id = None
    if ledger is not None:
        run_id, action = ledger.begin(window)
        if action == "skip":
            outcome("skipped")
            return None
    try:
        if isinstance(logs, Collected):
            digest = logs.attempt(deliver)
            errors += logs.failures()
        else:
            digest = deliver(logs)
        if ledger is not None:
            # the cover is known by the end of its window
            ledger.mark_cover_sent(run_id, int(window.end.replace(tzinfo=timezone.utc).timestamp()))
        if history is not None:
            history.update(digest.incidents, window, cfg.profile)
    except Exception as e:
        if ledger is not None:
            ledger.fail(run_id, str(e).split("\n", 1)[0])
        outcome("failed")
        raise
    if ledger is not None:
        ledger.finish(run_id, len(cfg.hosts))
    outcome("partial" if errors else "ok")
    return digest
