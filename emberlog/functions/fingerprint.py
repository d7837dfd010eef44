"""Fingerprints and level ranks."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.schema import LEVEL_RANKS


def fingerprint(host="host", app="app", normalized_msg="normalized_msg") -> Column:
    """Lower-case hex sha1 over the three parts, a zero byte between them."""
    return F.sha1(F.concat_ws("\u0000", host, app, normalized_msg))


def short_fingerprint(fp="fingerprint") -> Column:
    return F.substring(fp, 1, 12)


def level_rank(level="level") -> Column:
    """Severity of a level; unknown levels rank 0."""
    table = F.create_map(*[F.lit(x) for x in chain(*LEVEL_RANKS.items())])
    return F.coalesce(F.element_at(table, F.col(level) if isinstance(level, str) else level), F.lit(0))
