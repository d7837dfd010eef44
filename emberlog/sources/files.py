"""Small file operations of the driver, on whatever file system a path names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A folder of tables that is written once and listed. Only names pass the
    driver, never data."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str) -> str:
        return "/".join((self.path, *names))

    def names(self, *below: str) -> list[str]:
        """What the folder holds, in order; nothing if it is not there."""
        path = self._path(self.at(*below))
        if not self._files.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(path))

    def has(self, *names: str) -> bool:
        return self._files.exists(self._path(self.at(*names)))

    def complete(self, *below: str) -> list[str]:
        """Names of the tables whose writing has ended."""
        return [n for n in self.names(*below) if self.has(*below, n, "_SUCCESS")]

    def remove(self, *names: str) -> None:
        self._files.delete(self._path(self.at(*names)), True)

    def move(self, source: str, *names: str) -> None:
        """Put a file in the place of another. The new one replaces the old one
        in a single step, so there is no moment without a file."""
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        target = self._path(self.at(*names))
        self._files.mkdirs(target.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._files.makeQualified(self._path(source)), self._files.makeQualified(target), options)

    def append(self, rows: DataFrame) -> None:
        """Add a small table as one Parquet file. It is written aside and moved
        in, so that several jobs may append at once."""
        made = f"_{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(self.at(made))
        for part in self.names(made):
            if part.startswith("part-"):
                self.move(self.at(made, part), part)
        self.remove(made)

    def claim(self, *names: str) -> bool:
        """Create an empty file; False if it was there. Of several callers one
        succeeds, where the store creates files atomically (HDFS, a local disk)."""
        path = self._path(self.at(*names))
        self._files.mkdirs(path.getParent())
        if self._files.getUri().getScheme() == "file":  # Hadoop looks first and creates then
            return self.spark._jvm.java.io.File(path.toUri().getPath()).createNewFile()
        try:
            self._files.create(path, False).close()
        except Exception as e:
            if self._files.exists(path):
                return False
            raise e
        return True
