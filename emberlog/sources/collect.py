"""Several sources as one input; a source that fails does not stop the rest.

Nothing is copied. A source that cannot be opened is left out at once. One that
turns out to be damaged while a result is made ends that attempt; the error
names the file, the file tells the source, and the result is made again without
it. As long as all files can be read, the sources cost what their union costs,
and filters and columns reach each scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TypeVar
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.schema import LOG_SCHEMA

_Result = TypeVar("_Result")
_FAILURES = (PySparkException, Py4JJavaError)


def _paths(frame: DataFrame) -> set[str]:
    """The manifest of a source: paths of the files it reads."""
    return {unquote(urlparse(f).path) for f in frame.inputFiles()}


class Collected:
    """The configured sources, those of them that can be read, and what was
    wrong with the others."""

    def __init__(self, spark: SparkSession, sources: dict[str, Callable[[], DataFrame]]):
        self.spark, self.names = spark, list(sources)
        self.frames: dict[str, DataFrame] = {}
        self.errors: dict[str, str] = {}
        for name, open_source in sources.items():
            try:
                frame = open_source().select(*LOG_SCHEMA.fieldNames())
                frame.schema  # a source that is not there shows here
                self.frames[name] = frame
            except _FAILURES as e:
                self.errors[name] = str(e).split("\n", 1)[0]

    @property
    def records(self) -> DataFrame:
        """Union of the sources not known to fail."""
        frames = list(self.frames.values())
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], LOG_SCHEMA)

    def attempt(self, action: Callable[[DataFrame], _Result]) -> _Result:
        """``action`` on the records, again without each source that fails in
        it. The action must be one that can be repeated. An error that no file
        of a source explains is raised."""
        while True:
            try:
                return action(self.records)
            except _FAILURES as e:
                lines = [x.strip() for x in unquote(str(e)).splitlines() if "/" in x]
                said = {n: [x for x in lines if any(p in x for p in _paths(frame))] for n, frame in self.frames.items()}
                damaged = {n: found[0] for n, found in said.items() if found}
                if not damaged:
                    raise
                for name, line in damaged.items():
                    del self.frames[name]
                    self.errors[name] = line

    @property
    def status(self) -> DataFrame:
        """(source, failed, error), as far as is known."""
        rows = [(n, n in self.errors, self.errors.get(n, "")) for n in self.names]
        return self.spark.createDataFrame(rows, "source string, failed boolean, error string")

    def failures(self) -> int:
        return len(self.errors)

    def is_partial(self) -> DataFrame:
        return self.status.agg(F.coalesce(F.bool_or("failed"), F.lit(False)).alias("partial"))


def union_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]]) -> Collected:
    """``sources`` is the configured list, one entry per host."""
    return Collected(spark, sources)
