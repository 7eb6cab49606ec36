"""Tables that outlive a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="textloom-"))
    return f"file://{_local[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one operator call.

    ``keep`` writes a table and reads it back, which cuts the lineage: a lost executor costs only
    the tasks it was running. ``drop`` removes a table that nothing reads any more; what a lazy
    result still reads stays until the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        _delete(self.spark, f"{self.root}/{table}")

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended first; the folder is then left
            return
