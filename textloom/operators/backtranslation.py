"""The third augmentation stage: a pool of back-translated pairs, gathered in attempts, then judged as a whole.

First phase: until each class has twice the pairs it needs, its sources are translated there and back and what
passes the filters joins the pool, all classes at once. Second phase: the judge scores the pool, and the best of
each class are kept. The plan, every attempt's pairs and the judged pool are published whole, each under its own
key, so a run that dies goes on after the last of them and ends with the rows of an unbroken one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.sources import io
from textloom.sources.published import Published

from . import filters, quota


@dataclass(frozen=True)
class Plan:
    """Classes below ``target`` grow to it. The judge's bar is lower than elsewhere: translation costs quality."""

    target: int
    attempts: int = 20
    oversample: int = 3
    pool: int = 2
    least_score: float = 2.5
    least_length: int = 500
    by_text: bool = False


def gather_pairs(data: DataFrame, needs: DataFrame, plan: Plan, store: Published, translate: Callable[[DataFrame, int], DataFrame], **checks) -> DataFrame | None:
    """Pairs (label, cand_id, text, original) of all attempts; None if there are none.

    ``translate(slots, attempt)`` adds ``translated`` to (label, slot, row_id, text); null or blank ones are no
    candidates. An attempt's candidates are held against the data and the pairs before it. ``plan.by_text``
    brings exact copies of a surviving candidate back with it.
    """
    held: list[DataFrame] = []
    for attempt in range(1, plan.attempts + 1):
        found = store.read(f"pairs-{attempt:03d}")
        if found is None:
            pool = reduce(DataFrame.unionByName, held) if held else None
            open_ = needs if pool is None else needs.join(pool.groupBy("label").agg(F.count(F.lit(1)).alias("got")), "label", "left")
            gap = F.col("need") * plan.pool - (F.coalesce("got", F.lit(0)) if pool is not None else F.lit(0))
            open_ = open_.select("label", gap.alias("gap")).where("gap > 0")
            if open_.isEmpty():
                break
            wanted = open_.select("label", (F.col("gap") * plan.oversample).alias("need"))
            slots = quota.round_robin(data, wanted, seed=42 + attempt).join(data.select("row_id", "text"), "row_id")
            made = translate(slots, attempt).select("label", "slot", T.strip(F.col("translated")).alias("translated"), F.col("text").alias("original")).where("translated <> ''")
            # In order of the attempt and the slot, as ties are broken.
            name = F.concat_ws("-", F.lit(f"{attempt:03d}"), F.lpad(F.col("slot").cast("string"), 12, "0"), "label")
            pairs = store.commit(f"candidates-{attempt:03d}", made.select("label", name.alias("cand_id"), F.col("translated").alias("text"), "original"))
            existing = data.select("label", "text") if pool is None else data.select("label", "text").unionByName(pool.select("label", "text"))
            valid = filters.validate(pairs.select("cand_id", "label", "text"), existing, least=plan.least_length, **checks)
            found = store.commit(f"pairs-{attempt:03d}", filters.restore_pairs(pairs, valid, by_text=plan.by_text).select("label", "cand_id", "text", "original"))
        held.append(found)
    return reduce(DataFrame.unionByName, held) if held else None


def augment_by_pairs(data: DataFrame, plan: Plan, store: Published, translate: Callable[[DataFrame, int], DataFrame], score: Callable[[DataFrame], DataFrame], **checks) -> DataFrame:
    """Rows (row_id, text, label) of the data and the best of the pool; ``score`` adds a score to the pairs.

    A class without pairs, or with fewer good ones than it needs, grows by what there is. ``data`` must be the
    same table when a run goes on. Null labels form no class and stay as they are.
    """
    needs = store.commit("needs", quota.need(data.where("label is not null"), 0, plan.target, plan.target).select("label", "need"))
    pool = gather_pairs(data, needs, plan, store, translate, **checks)
    if pool is None:
        return data.select("row_id", "text", "label")
    judged = store.read("judged")
    if judged is None:
        judged = store.commit("judged", score(pool))
    best = filters.select_scored(judged, needs, plan.least_score)
    fresh = best.select(F.xxhash64("label", "cand_id").alias("row_id"), "text", "label")
    return data.select("row_id", "text", "label").unionByName(fresh)


def run_stage(spark: SparkSession, root: str, plan: Plan, translate: Callable[[DataFrame, int], DataFrame], score: Callable[[DataFrame], DataFrame], **checks) -> DataFrame:
    """The third stage from the stage before it to its own checkpoint in ``root``.

    A checkpoint of it in which all classes have their rows is the result; one that lacks rows is gone on from,
    without pairs gathered for the stage before. Once the stage is saved its pairs are retired.
    """
    data, found = io.load_stage(spark, root, 3)
    if "row_id" not in data.columns:
        data = io.with_row_id(data)
    if quota.classes_to_augment(data.where("label is not null"), 0, plan.target).isEmpty():
        if found != 3:
            io.save_stage(data, root, 3)
        return io.load_stage(spark, root, 3)[0]
    store = Published(spark, f"{root.rstrip('/')}/pairs-after-{found}")
    io.save_stage(augment_by_pairs(data, plan, store, translate, score, **checks), root, 3)
    store.retire()
    return io.load_stage(spark, root, 3)[0]
