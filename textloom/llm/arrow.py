"""Small helpers around mapInArrow and the Arrow columns of results."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most rows and bytes of an Arrow batch; a larger row is a batch of its own.
BATCH, BATCH_BYTES = 1000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Gives executors this package where their Python path does not have it, and bounds the batches they get.

    Whole texts make large rows: ten thousand of them, Spark's default, are held by the JVM and by Python
    at once. Bytes are bounded too, so that a batch of long texts or of coded blocks is no larger.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    package = Path(__file__).resolve().parents[1]
    root = str(package.parent)
    if os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(":"):
        return
    if getattr(spark.sparkContext, "_textloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="textloom-code-")) / "textloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, str(f.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._textloom_shipped = True


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns an operator uses, under its own names; whatever else the table has cannot clash."""
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()])


def rows(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values[f.name] if isinstance(values[f.name], pa.Array) else pa.array(values[f.name], f.type) for f in schema], schema=schema)
