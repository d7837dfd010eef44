"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the tables (default sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_REPEAT   copies of every event, for load tests (default 1)
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from emberlog import catalog  # noqa: E402
from emberlog.session import local_session, scratch_dir  # noqa: E402

HEADLINE = (
    "incidents", "incident_examples", "incident_sections", "incident_rank", "normalize", "doc_incidents",
    "daily_incidents", "host_totals", "app_totals", "noise_summary", "patterns", "hits_histogram",
    "new_critical", "alert_throttle", "fingerprint_history", "burn_rate", "run_status", "report_bodies",
    "read_jsonl", "doc_examples", "host_cap", "normalize_extended", "stream_incident_counts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    sf = os.path.basename(folder.rstrip("/"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "16g")
    if repeat > 1:
        folder = repeated(spark, folder, repeat)
    times = {}
    for name in names:
        for _ in range(2):  # the first run warms up the JVM
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "repeat": repeat, "cpus": cpus,
        "events": events, "events_per_sec": {n: round(events / t) for n, t in times.items()},
    }))


def repeated(spark, folder: str, n: int) -> str:
    """Folder with ``n`` shifted copies of every event; other tables as they are."""
    out = f"{scratch_dir(spark)}/bench/{uuid.uuid4().hex}"
    copy = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy")
    events = spark.read.parquet(f"{folder}/events.parquet")
    total = events.count()
    (
        events.select("*", copy)
        .withColumn("event_id", F.col("event_id") + F.col("copy") * total)
        .withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("copy")))
        .drop("copy").repartition(64).write.parquet(f"{out}/events.parquet")
    )
    for name in ("documents", "labels", "conversations", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


if __name__ == "__main__":
    main()
