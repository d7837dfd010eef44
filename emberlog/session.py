"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("emberlog")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors share, as the session names it.

    Only a local master may fall back to a temporary folder: on a cluster the
    tasks of a lost executor run elsewhere and would not find it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="emberlog-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


_PART = "_part"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Staged:
    """A staged table in two parts that can be read, and given up, one by one."""

    def __init__(self, df: DataFrame, first: str):
        """``first``: the condition of the rows of the first part."""
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = _written(df.withColumn(_PART, F.expr(first).cast("int")), _PART)

    def part(self, first: bool) -> DataFrame:
        """Rows of one part; only its folder is listed and read."""
        path = f"{self.path}/{_PART}={int(first)}"
        name = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not name.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(name):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path)

    def drop(self, first: bool) -> None:
        """Give up one part, once nothing that is still to be computed reads it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_PART}={int(first)}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch area and read it back.

    Use it where several results come from one expensive, much smaller table.
    Unlike a cached or checkpointed frame the table keeps column pruning,
    filter pushdown and size statistics, so joins against it choose their
    strategy from its real size; and it survives the loss of executors. The
    shuffle files behind it are of no more use once it is written, so Spark is
    asked to remove them then.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


def _written(df: DataFrame, *by: str) -> str:
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stage/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return path
