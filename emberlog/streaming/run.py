"""Run a stream over a folder of record files until it is drained."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.schema import LOG_SCHEMA

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(
    spark: SparkSession, source: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
    max_files: int = 1000,
) -> DataFrame:
    """Process what is in ``source`` and not yet done, append the results to
    ``sink`` and return the whole sink. Progress and state live in
    ``checkpoint``, so a restarted stream goes on where it stopped. A
    micro-batch takes ``max_files`` files at most, the oldest first, so that
    its size does not follow what has piled up. State is kept in RocksDB, which
    spills and which timers need."""
    records = (
        spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files)
        .option("latestFirst", "false").parquet(source)
    )
    out = transform(records)
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        query = (
            out.writeStream.format("parquet").outputMode("append")
            .option("path", sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_STORE, before) if before is not None else spark.conf.unset(_STORE)
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
