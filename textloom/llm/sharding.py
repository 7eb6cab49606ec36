"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 64-bit key: the top bits are a hash of the text, so that equal texts are
neighbours, the low bits a hash of the id, so that many copies of one text can still be divided.
The boundaries between shards are probed: all partitions count the exact bytes and rows below
candidate keys; the candidates on either side of each target bracket it, and the bracket is
divided anew, until a candidate lies within the tolerance. Only sums over candidates come to the
driver. Then every row goes to its place in one exchange.

To keep a task's share small each shard is made of ranges, whose boundaries are probed alike; the
rows below each range, counted exactly by then, number its rows. The driver holds the candidates of
a bounded number of ranges; for more data the tasks cut each range into parts of its stretch of keys
and count those themselves, in a table that is never collected.

Repeated rows share a key. Where they are more than a shard's tolerance, the table is written once with a
number for each row, which then is part of the key.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

_LOW_BITS = 24
#: Candidates between two neighbours of a bracket, as bits of the key.
_STEP = 8
#: Rows and bytes that one range of a shard has at most, about, and most ranges of all shards whose candidates the driver holds.
_RANGE, _RANGE_BYTES, _RANGES = 20_000, 8 << 20, 4096


def order_key(text: Column, *row_id: Column) -> Column:
    """The key as an unsigned number in the order of signed longs."""
    low = (1 << _LOW_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(*row_id).bitwiseAND(F.lit(low)))


@dataclass
class Splitters:
    #: First key of each range but the first, in order, and the rows and bytes below it.
    keys: list[int]
    rows: list[int]
    size: list[int]
    total_rows: int
    total_size: int
    rounds: int
    #: Whether one key alone kept a boundary off by more than the tolerance.
    stuck: bool = False


def probe(keyed: DataFrame, parts: int, tolerance: float) -> Splitters:
    """Boundaries that divide ``keyed`` (key long, size long) into ``parts`` ranges of equal size, each off by ``tolerance`` of a part at most.

    Where one key alone is larger than that, the nearer of its two sides is taken.
    """
    # Brackets as (low key, width in bits) -> (rows, size) below the low key.
    width, low_end = 64, -(1 << 63)
    step = 12
    brackets: dict[int, tuple[int, int]] = {low_end: (0, 0)}
    waiting: dict[int, list[int]] = {}
    found: dict[int, tuple[int, int, int]] = {}
    total = (0, 0)
    rounds, stuck = 0, False
    while True:
        rounds += 1
        shift = width - step
        inside = keyed.withColumn("low", F.shiftleft(F.shiftright("key", width), width)) if width < 64 else keyed.withColumn("low", F.lit(low_end))
        if width < 64:
            inside = inside.where(F.col("low").isin(list(brackets)))
        # The top bit of a signed long orders the other way round.
        digit = F.shiftright("key", shift).bitwiseAND(F.lit((1 << step) - 1)) if width < 64 else F.shiftright("key", shift) + (1 << (step - 1))
        counted = inside.groupBy("low", digit.alias("digit")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        table: dict[int, list[tuple[int, int, int]]] = {}
        for r in counted.collect():
            table.setdefault(r["low"], []).append((r["digit"], r["n"], r["size"]))
        if rounds == 1:
            total = (sum(x[1] for v in table.values() for x in v), sum(x[2] for v in table.values() for x in v))
            waiting = {low_end: list(range(1, parts))}
        bound = tolerance * total[1] / parts
        nearer: dict[int, list[int]] = {}
        below: dict[int, tuple[int, int]] = {}
        for low, targets in waiting.items():
            n, size = brackets[low]
            starts = []  # (size below, rows below, first key)
            for d, k, s in sorted(table.get(low, [])):
                starts.append((size, n, low + (d << shift)))
                n, size = n + k, size + s
            starts.append((size, n, low + (1 << width)))
            for t in targets:
                want = total[1] * t / parts
                i = bisect.bisect_right(starts, (want, float("inf"), 0))
                around = [x for x in starts[max(0, i - 1) : i + 1]]
                best = min(around, key=lambda x: abs(x[0] - want))
                if abs(best[0] - want) <= bound or shift == 0:
                    stuck |= abs(best[0] - want) > bound and around[-1][0] - around[0][0] > 2 * bound
                    found[t] = (best[2], best[1], best[0])
                else:
                    size_, n_, first = around[0]
                    nearer.setdefault(first, []).append(t)
                    below[first] = (n_, size_)
        if not nearer:
            break
        brackets, waiting, width, step = below, nearer, shift, min(_STEP, shift)
    ordered = [found[t] for t in sorted(found)]
    return Splitters([x[0] for x in ordered], [x[1] for x in ordered], [x[2] for x in ordered], *total, rounds, stuck)


def shard_by_size(df: DataFrame, size: Column, shards: int, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01) -> DataFrame:
    """All rows and columns of ``df`` with shard (0 to shards - 1) and slot (from 0 without gaps), by the ``bytes`` law.

    Within a shard rows are in the order of their keys. Null texts are equal to each other. Copies of a
    text stay in one shard unless a boundary within the tolerance needs them divided. Columns named shard
    or slot are replaced. ``size``: the size of a row, over columns of df.
    """
    names = df.columns
    own = {x: _free(x, names) for x in ("key", "size", "at", "number")}
    number: Column | None = None
    rows = df
    while True:
        ids = [F.col(f"`{id_col}`")] + ([] if number is None else [number])
        keyed = rows.withColumn(own["key"], order_key(F.col(f"`{text_col}`"), *ids)).withColumn(own["size"], size.cast("long"))
        digest = scratch.keep(keyed.select(F.col(own["key"]).alias("key"), F.col(own["size"]).alias("size")), "keys")
        whole = digest.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
        wanted = max(1, -(-whole["n"] // (shards * _RANGE)), -(-whole["size"] // (shards * _RANGE_BYTES)))
        ranges = min(wanted, max(1, _RANGES // shards))
        at = probe(digest, shards * ranges, tolerance if ranges == 1 else tolerance / 2)
        if not at.stuck or number is not None:
            break
        # Rows that are alike in id and text fill more than the tolerance: a written number tells them apart.
        rows = scratch.keep(df.withColumn(own["number"], F.monotonically_increasing_id()), "numbered")
        number = F.col(own["number"])
    keys = np.array([k if k < 1 << 63 else (1 << 63) - 1 for k in at.keys], np.int64)
    shared = scratch.spark.sparkContext.broadcast((keys, np.array([0, *at.rows], np.int64)))
    parts = -(-wanted // ranges)

    @F.pandas_udf("range int, part int, first long")
    def locate(key: pd.Series) -> pd.DataFrame:
        keys, rows = shared.value
        key = key.to_numpy()
        where = np.searchsorted(keys, key, "right")
        low, high = np.append(-(1 << 63), keys)[where], np.append(keys, (1 << 63) - 1)[where]
        # The share of the range's stretch that lies below the key; differences of longs may need 64 bits.
        below, width = (key.view(np.uint64) - low.view(np.uint64)), (high.view(np.uint64) - low.view(np.uint64))
        part = np.minimum(below / np.maximum(width, 1) * parts, parts - 1)
        return pd.DataFrame({"range": where.astype("int32"), "part": part.astype("int32"), "first": rows[where] - rows[where // ranges * ranges]})

    placed = keyed.withColumn(own["at"], locate(own["key"]))
    place = [F.col(own["at"])["range"], F.col(own["at"])["part"]]
    first = F.col(own["at"])["first"]
    if parts > 1:
        # A row for each part of a range; it meets the rows by the exchange that their numbering needs anyway.
        counts = digest.select(locate("key").alias("at")).groupBy(F.col("at.range").alias("range"), F.col("at.part").alias("part")).agg(F.count("*").alias("n"))
        lower = counts.select("range", "part", (F.sum("n").over(Window.partitionBy("range").orderBy("part")) - F.col("n")).alias("lower"))
        placed = placed.join(lower, [place[0] == lower["range"], place[1] == lower["part"]])
        first = first + F.col("lower")
    else:
        scratch.drop("keys")
    order = [own["key"], F.col(f"`{id_col}`")] + ([] if number is None else [number])
    slot = F.row_number().over(Window.partitionBy(*place).orderBy(*order)) - 1 + first
    shard = F.floor(place[0] / ranges).cast("int")
    return placed.select(*[F.col(f"`{c}`") for c in names if c not in ("shard", "slot")], slot.alias("slot"), shard.alias("shard"))


def _free(name: str, names: list[str]) -> str:
    """A name like this one that is no column yet."""
    while name in names or name in ("range", "part", "lower", "shard", "slot"):
        name += "_"
    return name
