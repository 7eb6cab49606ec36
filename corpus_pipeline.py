"""The corpus pipeline: quality rules, language ID, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the
columns of ``documents`` (the last: the packed pieces). A stage's result is written as Parquet and
read again before the next. Only near-dedup exchanges rows: the other filters decide where the rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import queries as q
from textloom.llm.store import Scratch

#: Least share of the main language.
MAIN_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier; rows without an id, which no later stage could name, go too."""
    from textloom.llm.quality import fit_quality, keep_good

    return keep_good(docs.where("doc_id is not null"), fit_quality(docs, q.table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, mainly in one language."""
    from textloom.llm.lang_id import fit_languages, keep_main

    return keep_main(docs, fit_languages(docs), MAIN_SHARE)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; repeated rows of it are one."""
    from textloom.llm.minmax_dedup import near_duplicates

    found = near_duplicates(docs, Scratch(spark, "pipeline-dedup")).where("kept")
    return docs.join(found, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their copies say: none, one or more rows.

    The classifier learns from ``documents``, where the domains still are; targets are those of what quality leaves.
    """
    return q.mixed_documents(spark, docs, sf_dir, repeat=True, taught=q.table(spark, sf_dir, "documents"), targets=q.KEPT_TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    from textloom.llm.packing import Capacity, pack

    return pack(docs, q.tokenizer_path(), 0, Scratch(spark, "pipeline-packing"), Capacity(tokens=q.LIMIT, documents=q.LIMIT, attention=q.LIMIT**2))


STAGES = [("quality", quality), ("language", language), ("dedup", dedup), ("mixing", mixing), ("packing", packing)]

#: Classifiers, expectation maximisation and bin packing are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages."""
    scratch = Scratch(spark, "pipeline")
    docs = q.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
