"""Versioned tables, step tables and logs in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: str | None = None


def shared_folder(spark: SparkSession) -> str:
    global _OWN
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _OWN is None:
        _OWN = "file://" + tempfile.mkdtemp(prefix="tarnweave-")
    return _OWN


def write_step(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A table as numbered parquet folders; readers see the last one whose write was committed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.root}/{n}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in done)

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.root}/v{v[-1]}") if v else None

    def write(self, df: DataFrame) -> DataFrame:
        n = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v{n}")
        return self.spark.read.parquet(f"{self.root}/v{n}")


def append_log(rows: DataFrame, path: str, enabled: bool = True) -> None:
    """One JSON object for each line, appended."""
    if enabled:
        rows.write.mode("append").json(path)
