"""Vector best-fit packing of token sequences into bins.

An item needs tokens, one document place and attention cost (the square of its length); a bin has
a capacity of each. Items go in descending order of length into the bin that holds them under
every constraint and is left with the smallest weighted norm of relative residuals (``rule``
"norm") or that has the largest weighted dot product of need and residual ("dot").

All three needs follow from the length, so items of one length are alike and bins with equal
residuals are alike. The plan is therefore made from the histogram of lengths alone: at most
``tokens`` counts, whatever the corpus. It says which ranks of each length go to which bins; the
tasks that cut the texts number their pieces of each length, and a row's rank is that number after the
counts of the tasks before, so no window over equal rows is needed. Nothing but the
histogram (no more than ``tokens`` rows) comes to the driver, and the plan that goes out has a
size bounded by the capacity, not by the rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .arrow import columns, rows
from .store import Scratch
from .wordbpe import WordBpe


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: Weights of the three residuals in the choice of a bin.
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


@dataclass
class Plan:
    """Segments by length and rank: ranks from ``start`` fill bins from ``bin`` on, ``per`` in each, from ``offset``."""

    length: np.ndarray
    start: np.ndarray
    bin: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of items by length and rank within it."""
        where = np.zeros(len(length), np.int64)
        for size in np.unique(length):
            rows, own = np.flatnonzero(length == size), np.flatnonzero(self.length == size)
            where[rows] = own[np.searchsorted(self.start[own], rank[rows], "right") - 1]
        k = rank - self.start[where]
        return self.bin[where] + k // self.per[where], self.offset[where] + k % self.per[where] * length


def plan_bins(histogram: dict[int, int], capacity: Capacity) -> Plan:
    """Best-fit decreasing over classes of equal items and groups of equal bins."""
    limit = np.array([capacity.tokens, capacity.documents, capacity.attention], np.int64)
    weight = np.array(capacity.weights)
    groups: dict[tuple[int, int, int], list[list[int]]] = {}
    segments: list[tuple[int, int, int, int, int]] = []
    bins = 0
    sizes = sorted(histogram, reverse=True)
    smallest = min(sizes, default=0)

    def put(state: tuple[int, int, int], first: int, count: int) -> None:
        if state[0] >= smallest and state[1] > 0:
            groups.setdefault(state, []).append([first, count])

    def fill(state: tuple[int, int, int], first: int, count: int, size: int, rank: int, left: int, most: int) -> tuple[int, int]:
        """``most`` items into each of these bins in turn; returns the new rank and how many bins were used."""
        used = min(count, -(-left // most))
        whole = min(used, left // most)
        offset = capacity.tokens - state[0]
        if whole:
            segments.append((size, rank, first, most, offset))
            put((state[0] - most * size, state[1] - most, state[2] - most * size * size), first, whole)
            rank, left = rank + whole * most, left - whole * most
        if used > whole:
            segments.append((size, rank, first + whole, left, offset))
            put((state[0] - left * size, state[1] - left, state[2] - left * size * size), first + whole, 1)
            rank += left
        return rank, used

    def holds(state: tuple[int, int, int], size: int) -> int:
        return min(state[0] // size, state[1], state[2] // (size * size))

    for size in sizes:
        total, rank = histogram[size], 0
        need = np.array([size, 1, size * size], np.int64)
        if (need > limit).any():
            raise ValueError(f"an item of {size} tokens exceeds the capacity")
        while groups and rank < total:
            states = np.array(list(groups), np.int64)
            states = states[(states >= need).all(1)]
            if not len(states):
                break
            if capacity.rule == "dot":
                # One item changes which bin has the largest product: one for each bin of the best state, then anew.
                order = np.argsort(-((states / limit) * (need / limit) * weight).sum(1), kind="stable")[:1]
            else:
                # A bin that took an item is left with less and stays the best while the item fits.
                order = np.argsort((weight * ((states - need) / limit) ** 2).sum(1), kind="stable")
            for state in map(tuple, states[order].tolist()):
                waiting = groups.pop(state)
                most = 1 if capacity.rule == "dot" else holds(state, size)
                while waiting and rank < total:
                    first, count = waiting.pop()
                    rank, used = fill(state, first, count, size, rank, total - rank, most)
                    if used < count:
                        waiting.append([first + used, count - used])
                if waiting:
                    groups.setdefault(state, []).extend(waiting)
                if rank >= total:
                    break
        if rank < total:
            # No open bin holds the item; a new one is the only choice until it is full.
            state = tuple(limit.tolist())
            most = holds(state, size)
            count = -(-(total - rank) // most)
            fill(state, bins, count, size, rank, total - rank, most)
            bins += count
    table = np.array(sorted(segments), np.int64).reshape(-1, 5)
    return Plan(*table.T, bins)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_CUT_ARROW = _PIECES_ARROW.append(pa.field("part", pa.int64())).append(pa.field("nth", pa.int64()))
_PLACED_ARROW = _PIECES_ARROW.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))


def token_pieces(df: DataFrame, tokenizer: str, end_id: int, most: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each text and ``end_id`` after them, cut into pieces of ``most`` only where there are more.

    part: the task; nth: how many pieces of this length it made before. They hold only for a written result.
    """

    def cut(batches):
        bpe, task = WordBpe.at(tokenizer), TaskContext.get().partitionId()
        made = np.zeros(most + 1, np.int64)
        for part, docs, _ in textvec.chunks(batches):
            flat, at = bpe.ids(docs)
            size = np.diff(at) + 1
            whole = np.empty(int(size.sum()), "<u4")
            ends = np.cumsum(size)
            whole[ends - 1] = end_id
            whole[textvec.ragged(ends - size, size - 1)] = flat
            pieces = -(-size // most)
            doc = np.repeat(np.arange(len(docs)), pieces)
            piece = textvec.ragged(np.zeros(len(docs), np.int64), pieces)
            start = piece * most
            length = np.minimum(size[doc] - start, most)
            begin = (ends - size)[doc] + start
            raw = memoryview(whole.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            nth, count = np.empty(len(length), np.int64), np.bincount(length, minlength=most + 1)
            nth[order] = textvec.ragged(made, count)
            made += count
            yield rows(_CUT_ARROW, doc_id=part.column(0).cast(pa.int64()).take(pa.array(doc)), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=crc, part=np.full(len(nth), task), nth=nth)

    return columns(df, doc_id=id_col, text=text_col).mapInArrow(cut, f"{_PIECES}, part long, nth long")


def pack(df: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, capacity: Capacity = Capacity(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Null and empty texts are the end id alone. Repeated rows are packed each, equal pieces are
    interchangeable. An empty table has no sequences. Only the id and the text are read.
    """
    most = min(capacity.tokens, int(capacity.attention**0.5))
    pieces = scratch.keep(token_pieces(df, tokenizer, end_id, most, id_col=id_col, text_col=text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_bins(histogram, capacity)
    # A row for each task and length: the ranks that earlier tasks take.
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("lower"))
    ranked = pieces.join(counts, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("lower"))
    shared = scratch.spark.sparkContext.broadcast(plan)

    def assign(batches):
        plan = shared.value
        for batch in batches:
            if batch.num_rows:
                bin_, offset = plan.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield rows(_PLACED_ARROW, **{n: batch.column(i) for i, n in enumerate(_PIECES_ARROW.names)}, sequence_id=bin_, offset=offset)

    ordered = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ordered.mapInArrow(assign, f"{_PIECES}, sequence_id long, offset long")
