"""Fingerprint history that is kept between digests.

Every digest window contributes a table of its own, ``windows/<window>/<attempt>``,
and the history is their fold: a window that is delivered again replaces its
earlier contribution, whatever has happened in between, and no update reads or
rewrites what other windows have left. The newest complete attempt counts, so
neither readers nor a writer that dies see half of one.

``compact`` folds the contributions into a base table, which remembers the
windows it holds; a window in the base is closed, and delivering it once more
changes nothing. There is one writer at a time.
"""

from __future__ import annotations

import time
import zlib
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.normalize import DEFAULT_PROFILE
from emberlog.functions.windows import Window, timestamp
from emberlog.schema import HISTORY_KEY
from emberlog.sources.files import Folder

# Fixed value.
HISTORY_DAYS = 90

HISTORY_COLUMNS = (
    "host string, app string, fingerprint string, first_seen timestamp_ntz, last_seen timestamp_ntz, "
    "count_total bigint, count_last_24h bigint, sample_msg string, updated_at timestamp_ntz, profile_version bigint"
)
# What a window contributes, and what the base holds of many windows.
PART_COLUMNS = (
    "host string, app string, fingerprint string, profile_version bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, "
    "count_total bigint, newest timestamp_ntz, count_newest bigint, sample_at timestamp_ntz, sample_msg string"
)


def profile_version(profile=DEFAULT_PROFILE) -> int:
    """Number of a profile: other rules give other fingerprints."""
    return zlib.crc32(repr([(r.pattern, r.replace) for r in profile]).encode())


def contribution(incidents: DataFrame, window: Window, profile=DEFAULT_PROFILE) -> DataFrame:
    """Incidents of a digest as its part of the history."""
    end = timestamp(window.end)
    return incidents.select(
        *HISTORY_KEY, F.lit(profile_version(profile)).cast("bigint").alias("profile_version"), "first_seen", "last_seen",
        F.col("cnt").alias("count_total"), end.alias("newest"), F.col("cnt").alias("count_newest"),
        end.alias("sample_at"), F.col("normalized_msg").alias("sample_msg"),
    )


def folded(parts: DataFrame) -> DataFrame:
    """One row per fingerprint and profile. Parts can be folded in any order
    and grouping, so that a fold can itself be a part."""
    return parts.groupBy(*HISTORY_KEY, "profile_version").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("count_total").alias("count_total"), F.max("newest").alias("newest"),
        F.max(F.struct("newest", "count_newest"))["count_newest"].alias("count_newest"),
        F.min(F.struct("sample_at", "sample_msg")).alias("sample"),
    ).select(
        *HISTORY_KEY, "profile_version", "first_seen", "last_seen", "count_total", "newest", "count_newest",
        F.col("sample.sample_at").alias("sample_at"), F.col("sample.sample_msg").alias("sample_msg"),
    )


class FingerprintHistory:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    @staticmethod
    def _name(window: Window) -> str:
        """Name of a window's folder: its end, then its start, to the microsecond."""
        return f"{window.end:%Y%m%dT%H%M%S%f}-{window.start:%Y%m%dT%H%M%S%f}"

    def _base(self) -> str | None:
        found = self.folder.complete("base")
        return found[-1] if found else None

    def _closed(self) -> set[str]:
        """Windows the base holds; one row each."""
        base = self._base()
        if base is None:
            return set()
        return {r["window"] for r in self.spark.read.schema("window string").json(self.folder.at("base", base, "windows")).collect()}

    def windows(self) -> list[str]:
        """Windows that stand on their own, oldest first."""
        closed = self._closed()
        return [w for w in self.folder.names("windows") if w not in closed and self.folder.complete("windows", w)]

    def _part(self, path: str) -> DataFrame:
        return self.spark.read.schema(PART_COLUMNS).parquet(path)

    def _parts(self) -> DataFrame:
        """Base and contributions, not folded."""
        base = self._base()
        parts = [self.spark.createDataFrame([], PART_COLUMNS)] if base is None else [self._part(self.folder.at("base", base, "rows"))]
        open_windows = [self.folder.at("windows", w, self.folder.complete("windows", w)[-1]) for w in self.windows()]
        if open_windows:  # one scan of all their folders
            parts.append(self.spark.read.schema(PART_COLUMNS).parquet(*open_windows))
        return reduce(DataFrame.unionByName, parts)

    def read(self) -> DataFrame:
        """The history, of whatever profiles; empty at first. The count of the
        last 24 hours is that of the newest digest, zero for what it has not seen."""
        ends = [datetime.strptime(w.partition("-")[0], "%Y%m%dT%H%M%S%f") for w in (*self.windows(), *self._closed())]
        newest = timestamp(max(ends)) if ends else F.lit(None).cast("timestamp_ntz")
        last = F.when(F.col("newest") == newest, F.col("count_newest")).otherwise(0)
        return folded(self._parts()).select(
            *HISTORY_KEY, "first_seen", "last_seen", "count_total", last.cast("bigint").alias("count_last_24h"),
            "sample_msg", F.col("newest").alias("updated_at"), "profile_version",
        )

    def current(self, profile=DEFAULT_PROFILE) -> DataFrame:
        """What the history knows under the profile."""
        return self.read().filter(F.col("profile_version") == profile_version(profile))

    def update(self, incidents: DataFrame, window: Window, profile=DEFAULT_PROFILE) -> bool:
        """Put the incidents of a window in place of what it has contributed
        before. False if the window is closed: nothing changes then."""
        name = self._name(window)
        if name in self._closed():
            return False
        before = self.folder.names("windows", name)
        contribution(incidents, window, profile).write.parquet(self.folder.at("windows", name, f"{time.time_ns():020d}"))
        for old in before:
            self.folder.remove("windows", name, old)
        return True

    def compact(self, forget: datetime | None = None) -> None:
        """Fold all windows into a new base, without the fingerprints last
        seen before ``forget``."""
        name = f"{time.time_ns():020d}"
        open_windows, closed, before = self.windows(), self._closed(), self.folder.names("base")
        rows = folded(self._parts())
        if forget is not None:
            rows = rows.filter(F.col("last_seen") >= timestamp(forget))
        rows.write.parquet(self.folder.at("base", name, "rows"))
        known = [(w,) for w in sorted({*open_windows, *closed})]
        self.spark.createDataFrame(known, "window string").coalesce(1).write.json(self.folder.at("base", name, "windows"))
        self.folder.claim("base", name, "_SUCCESS")  # from here on the new base counts
        for old in before:
            self.folder.remove("base", old)
        for w in open_windows:
            self.folder.remove("windows", w)

    def sweep(self, now: datetime, days: int = HISTORY_DAYS) -> None:
        """Remove what has not been seen for ``days``."""
        self.compact(now - timedelta(days=days))
