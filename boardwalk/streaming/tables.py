"""Versioned tables for micro-batch state.

A table is a folder of versions named after the batch that wrote them.  A version
counts once its marker exists, so a batch that died halfway is written again and a
batch that is replayed finds its work done.  Everything goes through the session's
Hadoop file system: nothing is machine-local.
"""

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, version: int) -> str:
        return f"{self.root}/v={version:012d}"

    def has(self, version: int) -> bool:
        return self._fs.exists(self._path(f"{self._at(version)}/_SUCCESS"))

    def versions(self) -> list[int]:
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(v for v in (int(n[2:]) for n in found if n.startswith("v=")) if self.has(v))

    def before(self, version: int) -> DataFrame:
        """The newest finished state older than ``version``; empty at first."""
        older = [v for v in self.versions() if v < version]
        if not older:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._at(older[-1]))

    def latest(self) -> DataFrame:
        found = self.versions()
        return self.before(found[-1] + 1) if found else self.before(0)

    def write(self, version: int, df: DataFrame) -> None:
        if not self.has(version):
            df.write.mode("overwrite").parquet(self._at(version))

    def forget_before(self, version: int, keep: int = 2) -> None:
        """Drop versions no reader needs any more."""
        for v in [v for v in self.versions() if v < version][:-keep]:
            self._fs.delete(self._path(self._at(v)), True)
