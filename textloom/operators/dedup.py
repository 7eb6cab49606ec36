"""Row filters and dedup of a labelled text table (row_id, text, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def _digests(df: DataFrame, keys: list[str]) -> dict:
    """Keys for exchanges by name: for a string its SHA-256, of which no two texts are known with one digest."""
    return {f"__key{i}": F.sha2(F.col(f"`{k}`"), 256) if df.schema[k].dataType.typeName() == "string" else F.col(f"`{k}`") for i, k in enumerate(keys)}


def exact_dedup(df: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """The row with the smallest ``order`` of each combination of keys, by an aggregate that combines map-side, then a join on it.

    Only digests of the keys are grouped and sent twice; the rows meet the join spread by their order, however many copies one text has.
    """
    own = _digests(df, keys)
    keyed = df.withColumns(own)
    first = keyed.groupBy(*own).agg(F.min(order).alias("__first"))
    condition = keyed[order] == first["__first"]
    for k in own:
        condition &= keyed[k].eqNullSafe(first[k])
    return keyed.join(first, condition, "left_semi").select(df.columns)


def cross_label_dedup(df: DataFrame, dropped_label: str) -> DataFrame:
    """Rows whose text occurs more than once go if they carry ``dropped_label``."""
    own = _digests(df, ["text"])
    often = df.select(own["__key0"].alias("__key0")).groupBy("__key0").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    labelled = df.where(F.col("label") == dropped_label).withColumns(own).join(often, "__key0", "left_anti").select(df.columns)
    return df.where(F.col("label").isNull() | (F.col("label") != dropped_label)).unionByName(labelled)


def remove_anomalous(df: DataFrame, unique: int = 50, total: int = 200) -> DataFrame:
    """Many words, few of them different: more than ``total`` words with less than ``unique`` distinct ones."""
    return df.where(T.let(T.words(F.col("text")), lambda w: ~((F.size(F.array_distinct(w)) < unique) & (F.size(w) > total))))


def remove_empty(df: DataFrame) -> DataFrame:
    return df.where(F.col("text").isNotNull() & (T.strip(F.col("text")) != ""))


def clean_table(df: DataFrame, dropped_label: str) -> DataFrame:
    """Prune, dedup, anomaly, clean, empty; nulls are dropped at the start."""
    table = df.select("row_id", "text", "label").where("text is not null")
    table = remove_anomalous(cross_label_dedup(exact_dedup(table, ["text", "label"]), dropped_label))
    return remove_empty(table.withColumn("text", T.clean_text(F.col("text"))))


def new_against(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (cand_id, label, text) whose stripped lower-cased text is neither in the class already nor earlier in the batch."""
    # A digest stands for the text in the exchanges; SHA-256 has no known two texts with one digest.
    norm = F.sha2(F.lower(T.strip(F.col("text"))), 256)
    known = existing.select("label", norm.alias("norm")).distinct()
    fresh = candidates.select("label", "cand_id", norm.alias("norm")).join(known, ["label", "norm"], "left_anti")
    first = fresh.groupBy("label", "norm").agg(F.min("cand_id").alias("cand_id")).select("label", "cand_id")
    return candidates.join(first, ["label", "cand_id"], "left_semi").select(candidates.columns)


def top_by(df: DataFrame, k: int | str, by: list, partition: list[str]) -> DataFrame:
    """The first k rows of each partition; ``k`` may name a column. A partition is cut in salted parts first, so that a hot one is no task of its own."""
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*by_columns(df, partition)), F.lit(32)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*partition, "__salt").orderBy(*by))).where(F.col("rank") <= limit).drop("__salt", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*by))).where(F.col("rank") <= limit)


def by_columns(df: DataFrame, but: list[str]) -> list[str]:
    """Columns that can be hashed, other than these."""
    return [f.name for f in df.schema if f.name not in but and f.dataType.typeName() not in ("map", "variant")]
