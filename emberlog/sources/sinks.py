"""Report sink."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.files import Folder

# Fixed value.
REPORT_DAYS = 30


def write_reports(reports: DataFrame, path: str) -> None:
    """Write one text file per report, ``report_date=…/<file_name>``.

    ``reports`` has one row per configured host (report_date, file_name, body).
    Tasks write the texts into a folder of their own; the driver then only
    renames one file per report, over an earlier one of that name.
    """
    # the writer ends the row with the newline the report ends with
    text = F.when(F.endswith("body", F.lit("\n")), F.left("body", F.length("body") - 1)).otherwise(F.col("body"))
    folder, made = Folder(reports.sparkSession, path), f"_{uuid.uuid4().hex}"
    (
        reports.select(text.alias("value"), "report_date", "file_name")
        .write.partitionBy("report_date", "file_name").text(folder.at(made))
    )
    for day in folder.names(made):
        for report in folder.names(made, day) if "=" in day else ():
            for part in folder.names(made, day, report):
                folder.move(folder.at(made, day, report, part), day, report.partition("=")[2])
    folder.remove(made)


def sweep_reports(spark: SparkSession, path: str, now: datetime, days: int = REPORT_DAYS) -> list[str]:
    """Remove the reports of days more than ``days`` before ``now``; the names
    of their folders. What is not named by a date stays."""
    folder, oldest = Folder(spark, path), f"{now - timedelta(days=days):%Y-%m-%d}"
    old = [n for n in folder.names() if re.fullmatch(r"report_date=\d{4}-\d{2}-\d{2}", n) and n.partition("=")[2] < oldest]
    for name in old:
        folder.remove(name)
    return old


def write_daily(incidents: DataFrame, path: str) -> None:
    """Incident table laid out by digest day, which readers prune by."""
    (
        incidents.withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day").parquet(path)
    )
