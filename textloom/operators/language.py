"""The language of a text by character n-grams: ranks of its own most frequent ones against ranks of each language's.

A text's distance to a language sums, over its ``KEPT`` most frequent grams of one to three characters, how far
the gram's two ranks lie apart, and ``KEPT`` for a gram that the language's profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: Grams of a profile and of a text; texts that a task works on at once.
KEPT, TEXTS = 300, 256


def spelled(c: Column) -> Column:
    """The runs of letters, lower-cased, one underscore before, between and after them."""
    return F.concat(F.lit("_"), F.regexp_replace(F.regexp_replace(F.lower(c), r"^\P{L}+|\P{L}+$", ""), r"\P{L}+", "_"), F.lit("_"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), TEXTS):
            yield batch.slice(i, TEXTS)


def grams(spelled: str | None) -> np.ndarray:
    """Every gram of one to three characters of every word between its underscores, as a number in the order of the grams; the underscore alone is none."""
    if not spelled:
        return np.zeros(0, np.int64)
    # A number has 21 bits for each character, so shorter grams come before those that they begin.
    c = np.frombuffer(spelled.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = c != ord("_")
    if not letter.any():
        return np.zeros(0, np.int64)
    two = (c[:-1] << 42) + (c[1:] << 21)
    return np.concatenate([c[letter] << 42, two, (two[:-1] + c[2:])[letter[1:-1]]])


def most(numbers: np.ndarray, kept: int) -> np.ndarray:
    """The ``kept`` most frequent, in order; ties to the smaller."""
    distinct, n = np.unique(numbers, return_counts=True)
    return distinct[np.argsort(-n, kind="stable")[:kept]]


def profiles(labelled: DataFrame) -> DataFrame:
    """(lang, gram, place) of each language of (lang, text), from 1; ties by gram. Rows without a language teach nothing.

    Tasks count their own rows, so only a task's distinct grams by language are exchanged.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches):
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, []).append(grams(text))
            for lang, some in found.items():
                numbers, n = np.unique(np.concatenate(some), return_counts=True)
                if lang in held:
                    numbers, place = np.unique(np.concatenate([held[lang][0], numbers]), return_inverse=True)
                    n = np.bincount(place, np.concatenate([held[lang][1], n]), len(numbers)).astype(np.int64)
                held[lang] = numbers, n
        for lang, (numbers, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(numbers, pa.int64()), pa.array(n, pa.int64())], names=["lang", "number", "n"])

    named = labelled.where("lang is not null").select("lang", spelled(F.col("text")).alias("text"))
    counts = named.mapInArrow(count, "lang string, number long, n long").groupBy("lang", "number").agg(F.sum("n").alias("n"))
    # The order of numbers is that of grams.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "number")
    parts = [F.shiftright("number", 42), F.shiftright("number", 21).bitwiseAND(F.lit(0x1FFFFF)), F.col("number").bitwiseAND(F.lit(0x1FFFFF))]
    name = F.concat(*[F.when(x > 0, F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32")).otherwise("") for x in parts])
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= KEPT).select("lang", name.alias("gram"), "place")


def detect(df: DataFrame, known: DataFrame) -> DataFrame:
    """Adds detected and distance to every row of a table with text, by its own text; ties to the smaller name.

    ``detected`` is null where a text has no letter or shares no gram with any language. The profiles, ``KEPT`` grams a
    language, are collected and go out once; texts are counted where they are.
    """
    kept, columns = KEPT, df.columns
    found: dict[str, dict[int, int]] = {}
    for r in known.collect():
        c = [*map(ord, r["gram"]), 0, 0]
        found.setdefault(r["lang"], {})[(c[0] << 42) + (c[1] << 21) + c[2]] = r["place"]
    names = sorted(found, key=lambda x: x.encode())
    numbers = np.array(sorted({g for x in found.values() for g in x}), np.int64)
    shared = df.sparkSession.sparkContext.broadcast((numbers, np.array([[found[k].get(int(g), 0) for g in numbers] for k in names], np.int64).reshape(len(names), -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, places = shared.value

        def one(text: str | None) -> tuple[str | None, int | None]:
            own = most(grams(text), kept)
            if not len(own) or not len(numbers):
                return None, None
            at = np.minimum(np.searchsorted(numbers, own), len(numbers) - 1)
            theirs = places[:, at] * (numbers[at] == own)
            met = theirs > 0
            far = (np.abs(theirs - np.arange(1, len(own) + 1)) * met).sum(1) + kept * (len(own) - met.sum(1))
            far = np.where(met.any(1), far, np.iinfo(np.int64).max)
            best = int(far.argmin())
            return (names[best], int(far[best])) if met[best].any() else (None, None)

        for batch in slices(batches):
            made = [one(t) for t in batch.column(len(columns)).to_pylist()]
            parts = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *parts], names=[*columns, "detected", "distance"])

    schema = StructType([df.schema[c] for c in columns]).add("detected", StringType()).add("distance", LongType())
    return df.withColumn("__spelled", spelled(F.col("text"))).mapInArrow(run, schema)


def nearest(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, detected, distance) of every row of a table with text, as ``detect`` has them. Rows with equal keys count as one text.

    Most keys have one row, judged where it is; only the rows of others meet.
    """
    rows = df.select(key, "text")
    often = F.broadcast(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("__key")))
    same = rows[key].eqNullSafe(often["__key"])
    joined = rows.join(often, same, "left_semi").groupBy(key).agg(F.concat_ws("_", F.collect_list("text")).alias("text"))
    alone = rows.join(often, same, "left_anti")
    return detect(alone.unionByName(joined), known).select(key, "detected", "distance")
