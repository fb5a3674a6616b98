"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_only: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local session without that setting, as in tests, gets a temporary folder of its own; on a
    cluster a machine-local folder would not survive the loss of an executor, so its absence is an error.
    """
    global _local_only
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_only is None:
        _local_only = tempfile.mkdtemp(prefix="shabdagrid-")
    return f"file://{_local_only}"


def fresh_name() -> str:
    """A name that no other run uses."""
    return uuid.uuid4().hex


class Scratch:
    """Written tables of one computation; old ones can be dropped as soon as nothing reads them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/shabdagrid/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df and read it back: later plans start from the files, whoever is lost meanwhile."""
        path = f"{self.base}/{self._n}"
        self._n += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that cut() returned."""
        path = getattr(df, "_scratch_path", None)
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """One-off Scratch.cut."""
    return Scratch(df.sparkSession, name).cut(df)


def clean(spark: SparkSession, older_than: float = 86_400) -> int:
    """Delete tables that computations left in the shared folder and that nothing has written to for `older_than` seconds; their number.

    A result reads such tables until it has been written itself, so none is deleted when its computation ends."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/shabdagrid")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return 0
    old = [s.getPath() for s in fs.listStatus(base) if s.getModificationTime() < (time.time() - older_than) * 1000]
    return sum(bool(fs.delete(p, True)) for p in old)
