"""Vectors of texts: truncated singular value decomposition of TF-IDF rows by block power iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from . import features, svm

#: Columns beyond those asked for, most passes, and the relative change of the squared values at which they end.
EXTRA, PASSES, CHANGE = 8, 30, 1e-6


def singular(rows: DataFrame, size: int, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values, and the right vectors as columns, of rows (places, values) over ``size`` features.

    Each pass sums, over the tasks' rows, the rows times their products with the block, which has ``k`` and a few
    columns more; the driver makes it orthogonal again. Fewer than ``k`` come back where there are fewer features.
    A vector's largest entry is positive.
    """
    given = rows.select(F.lit(0).alias("label"), F.lit(0).alias("fold"), "places", "values")
    width = min(size, k + EXTRA)
    if not width:
        return np.zeros(0), np.zeros((0, 0))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    last, tasks = np.zeros(width), rows.rdd.getNumPartitions()
    for _ in range(PASSES):
        shared = rows.sparkSession.sparkContext.broadcast(q)

        def sums(batches, shared=shared):
            q = shared.value
            # The constant feature has no part in it.
            q = np.vstack([q, np.zeros(width)])
            total = np.zeros((width, size + 1))
            for b in svm.blocks(batches, size):
                b.turned(b.times(q), total)
            return total[:, :-1]

        y = svm.summed(given, sums, (width, size), tasks).T
        shared.destroy()
        values, turn = np.linalg.eigh(q.T @ y)
        values, turn = values[::-1], turn[:, ::-1]
        basis = q @ turn
        if np.abs(values - last)[:k].max() <= CHANGE * max(values[0], 1e-300):
            break
        last, q = values, np.linalg.qr(y @ turn)[0]
    basis = basis[:, :k]
    signs = np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    return np.sqrt(np.maximum(values[:k], 0)), basis * np.where(signs == 0, 1, signs)


def embedder(train: DataFrame, k: int = 64, size: int = 50_000):
    """Fits on a table with text; returns a function that adds ``embedding`` to any other. A text without known terms is the zero vector."""
    terms, transform = features.vectorizer(size)(train)
    rows = transform(train.select("text")).persist()
    try:
        _, basis = singular(rows, len(terms), k)
    finally:
        rows.unpersist()
    shared, wide = train.sparkSession.sparkContext.broadcast(basis), len(terms)

    def embed(table: DataFrame) -> DataFrame:
        kept = table.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis = np.vstack([shared.value, np.zeros(shared.value.shape[1])])
            for batch in batches:
                zero = pa.array(np.zeros(len(batch), np.int32))
                own = pa.RecordBatch.from_arrays([zero, zero, batch.column("places"), batch.column("values")], names=["label", "fold", "places", "values"])
                made = [b.times(basis) for b in svm.blocks([own], wide)]
                vectors = pa.array([v for m in made for v in m.tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column("__text" if c == "text" else c) for c in kept], vectors], names=[*kept, "embedding"])

        schema = StructType([table.schema[c] for c in kept]).add("embedding", ArrayType(DoubleType()))
        return transform(table.withColumn("__text", F.col("text"))).mapInArrow(run, schema)

    return embed
