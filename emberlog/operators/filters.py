"""Record selection. All predicates stay on bare columns, so they are pushed
into the Parquet scan and prune partitions and row groups."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.windows import Window, timestamp


def by_host(df: DataFrame, host: str) -> DataFrame:
    return df.filter(F.col("host") == host)


def _named(values) -> list[str]:
    return [v.strip() for v in values if v.strip()]


def by_hosts(df: DataFrame, hosts) -> DataFrame:
    """No hosts means no host filter."""
    return df.filter(F.col("host").isin(list(hosts))) if hosts else df


def by_levels(df: DataFrame, levels) -> DataFrame:
    """Blank names are dropped; no names means no level filter."""
    names = _named(levels)
    return df.filter(F.col("level").isin(names)) if names else df


def in_window(df: DataFrame, window: Window) -> DataFrame:
    lo, hi = window.bounds
    return df.filter((F.col("event_time") >= lo) & (F.col("event_time") < hi))


def last(df: DataFrame, length: timedelta, now: datetime, offset: timedelta = timedelta(0)) -> DataFrame:
    """Records of the last ``length`` before ``now``, shifted back by ``offset``."""
    end = now - offset
    lo, hi = timestamp(end - length), timestamp(end)
    return df.filter((F.col("event_time") >= lo) & (F.col("event_time") <= hi))


@dataclass(frozen=True)
class LogQuery:
    """A checked selection: host and/or levels, a window, extra predicates."""

    window: Window
    host: str = ""
    levels: tuple[str, ...] = ()
    extra: tuple[Column | str, ...] = field(default=())

    def __post_init__(self):
        if not isinstance(self.window, Window):
            raise ValueError("a window is needed")
        if not self.host and not self.levels:
            raise ValueError("a host or levels are needed")

    def apply(self, df: DataFrame) -> DataFrame:
        if self.host:
            df = by_host(df, self.host)
        df = in_window(by_levels(df, self.levels), self.window)
        for predicate in self.extra:
            df = df.filter(predicate)
        return df


def digest_records(df: DataFrame, hosts, levels, window: Window) -> DataFrame:
    """Input of a digest: all hosts and levels of interest in one scan."""
    return in_window(by_levels(by_hosts(df, hosts), levels), window)


def first_n(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records by time, ties by all other columns; records
    without a time come last. Every task keeps ``n`` rows at most."""
    ties = [F.col(c) for c in df.columns if c != "event_time"]
    return df.orderBy(F.col("event_time").asc_nulls_last(), *ties).limit(n)
