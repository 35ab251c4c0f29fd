"""A catalogue on disk: a folder with one sub-folder a table and, in it, one a version.

A new version is written beside the one being read and then named current in one step, so readers
see a whole table at any time and a failed write changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.schemas import TABLES


class Store:
    """Tables by name below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        # A version counts once Spark has marked it complete.
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.folder}/{name}/{n}/_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The current version; an empty table of the known schema if there is none."""
        schema, versions = TABLES[name], self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{versions[-1]}")

    def write(self, name: str, df: DataFrame, keep: int = 2) -> None:
        """Makes ``df`` (columns by name) the current version and deletes all but the last ``keep``."""
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        versions = self._versions(name)
        following = (versions[-1] if versions else 0) + 1
        df.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/v{following}")
        for old in [*versions, following][:-keep]:
            self._fs.delete(self._path(f"{self.folder}/{name}/v{old}"), True)

    def create(self) -> None:
        """Creates the tables that aren't there."""
        for name in TABLES:
            if not self._versions(name):
                self.write(name, self.read(name))
