"""Connected components by alternating large-star and small-star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Fewer nodes than this are so hot that their rows meet their minimum by broadcast.
HOT = 4096


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Roots themselves are left out. Each round hangs the larger neighbours of a node, then the
    smaller ones, under the smallest it sees; it ends when nothing moves. Rounds are written to
    the shared folder. A hot node's edges meet its minimum by broadcast, so that no task reads them all.
    """
    held = scratch.keep(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), f"{name}-0")
    state, turn = _state(held), 0
    while state[0]:
        turn += 1
        both = held.unionByName(held.select(F.col("u").alias("v"), F.col("v").alias("u")))
        often = max(64, state[0] // HOT)
        least = both.groupBy("v").agg(F.count("*").alias("n"), F.least("v", F.min("u")).alias("m"))
        # Written between the stars: in one plan with the second, every branch of it would hold the first again.
        large = scratch.keep(_met(both.where("u > v"), least, often).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), f"{name}-{turn}-large")
        down = large.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("m"))
        small = _met(large, down, often).where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = scratch.keep(small.unionByName(down.select("v", F.col("m").alias("u"))).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn}-large")
        scratch.drop(f"{name}-{turn - 1}")
        held, before, state = now, state, _state(now)
        if state == before:
            break
    return held.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _met(edges: DataFrame, nodes: DataFrame, often: int) -> DataFrame:
    """The edges with m of their v; nodes (v, n, m) with n above ``often`` are few and broadcast."""
    hot = F.broadcast(nodes.where(F.col("n") > often).select("v", F.col("m").alias("hot")))
    marked = edges.join(hot, "v", "left")
    cold = marked.where("hot is null").join(nodes.where(F.col("n") <= often).select("v", "m"), "v").select("v", "u", "m")
    return cold.unionByName(marked.where("hot is not null").select("v", "u", F.col("hot").alias("m")))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
    return r["n"], r["x"]
