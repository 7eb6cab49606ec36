"""Answers of a model kept by content: equal prompts are asked once, and no run asks what an earlier one has answered.

A prompt is known by a digest of the model's name, its sampling and the text. What is not yet known is written in
order of length, then asked slice by slice; the answers of a slice are published whole, so a run that dies loses
one slice or one further try at most and the next one goes on behind it. Prompts that failed are asked again, up to
``tries`` times.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.published import Published

from .generation import TextGenerator

#: Slices of a run's prompts; most prompts of a batch; most characters of a batch once all are as long as its longest.
SLICES, ROWS, WIDTH = 8, 256, 1 << 18
#: A part has the prompts that failed, so that they can be asked again without a join.
ANSWERS = "digest string, answer string, made_by string, failed string"


def batches(lengths: list[int], rows: int = ROWS, width: int = WIDTH) -> Iterator[tuple[int, int]]:
    """(start, end) of neighbours that fit one batch; a prompt longer than ``width`` is one alone."""
    start, longest = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or max(longest, n) * (i - start + 1) > width):
            yield start, i
            start, longest = i, 0
        longest = max(longest, n)
    if start < len(lengths):
        yield start, len(lengths)


def _asked(model: TextGenerator, prompts: list[str]) -> list[tuple[str | None, bool]]:
    """(answer, failed) of each prompt; where the batch fails, or has not one answer each, they are asked one by one."""
    try:
        found = model.generate(prompts)
        if len(found) == len(prompts):
            return [(a if a and a.strip() else None, False) for a in found]
    except Exception:  # noqa: BLE001  whatever a model raises, the prompts are asked one by one
        pass
    if len(prompts) == 1:
        return [(None, True)]
    return [x for p in prompts for x in _asked(model, [p])]


class Answers:
    """Answers of one model below ``root``. ``make`` takes the sampling by name; None if the model has none to set.

    Null prompts are not asked and have no answer. A blank answer counts as none, but as given. A prompt that failed
    in all tries has no answer in this run and is asked again by the next.
    """

    def __init__(self, spark: SparkSession, root: str, make: Callable[..., TextGenerator], model: str, sampling: dict | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.make, self.name = partial(make, **(sampling or {})), json.dumps([model, sampling or {}], sort_keys=True)
        self.parts = Published(spark, f"{self.root}/answers")

    def digest(self, prompt: Column) -> Column:
        return F.sha2(F.concat(F.lit(self.name), prompt), 256)

    def known(self) -> DataFrame:
        """(digest, answer, made_by), one row for each prompt answered."""
        paths = self.parts.paths()
        found = self.spark.read.schema(ANSWERS).parquet(*paths) if paths else self.spark.createDataFrame([], ANSWERS)
        return found.where("failed is null").select("digest", "answer", "made_by").dropDuplicates(["digest"])

    def _ask(self, prompts: DataFrame, made_by: str) -> DataFrame:
        make = self.make

        def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = make()
            for t in tables:
                texts, digests = t.column("prompt").to_pylist(), t.column("digest")
                for a, b in batches([len(x) for x in texts]):
                    found = _asked(model, texts[a:b])
                    yield pa.RecordBatch.from_arrays([digests.slice(a, b - a), pa.array([x for x, _ in found], pa.string()), pa.array([made_by] * (b - a), pa.string()), pa.array([p if x else None for p, (_, x) in zip(texts[a:b], found, strict=True)], pa.string())], ["digest", "answer", "made_by", "failed"])

        return prompts.select("digest", "prompt").mapInArrow(run, ANSWERS)

    def ask(self, df: DataFrame, made_by: str, prompt: str = "prompt", tries: int = 3) -> None:
        """Asks and keeps what is not known yet; ``made_by`` names the run."""
        wanted = df.select(F.col(prompt).alias("prompt")).dropna().select(self.digest(F.col("prompt")).alias("digest"), "prompt")
        fresh = wanted.groupBy("digest").agg(F.first("prompt").alias("prompt")).join(self.known().select("digest"), "digest", "left_anti")
        fresh = fresh.withColumn("slice", F.pmod(F.xxhash64("digest"), F.lit(SLICES))).withColumn("length", F.length("prompt"))
        path = f"{self.root}/asked/{uuid.uuid4().hex}"
        # A folder for each slice; rows are ordered where the aggregation left them, so that neighbours are about as long.
        fresh.sortWithinPartitions("slice", "length").write.partitionBy("slice").parquet(path)
        asked = self.spark.read.schema(fresh.schema).parquet(path)
        left = [asked.where(F.col("slice") == i) for i in range(SLICES)]
        for _ in range(tries):
            made = [self.parts.commit(uuid.uuid4().hex, self._ask(some, made_by)) for some in left]
            failed = reduce(DataFrame.unionByName, made).where("failed is not null").select("digest", F.col("failed").alias("prompt"))
            # Few as a rule, so one table for each further try.
            left = [failed]
            if failed.isEmpty():
                break
        self.parts.drop(path)

    def add(self, df: DataFrame, prompt: str = "prompt", out: str = "answer", made_by: str | None = None) -> DataFrame:
        """Adds the answers that are known, and in ``made_by`` the run that asked; null where there is none."""
        named = [F.col("answer").alias(out), *([F.col("made_by").alias(made_by)] if made_by else [])]
        found = self.known().select(F.col("digest").alias("__digest"), *named)
        kept = df.drop(out, *([made_by] if made_by else [])).withColumn("__digest", self.digest(F.col(prompt)))
        return kept.join(found, "__digest", "left").drop("__digest")
