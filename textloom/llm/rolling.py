"""Exact rolling median and median absolute deviation by sliding sparse two-level histograms.

A window holds the values of a series with a time more than its own minus the window's length and at most its
own. Rows of one series, time and value are one cell with a count. Series are cut into chunks of time; a cell
goes to its own chunk and, as halo, to the chunks whose windows reach back to it. A task slides over one chunk
after another: a histogram counts the high digits of the values (coarse) over the values themselves (fine), both
only where there are any. The median is walked to over the coarse counts and then the fine ones; for the
deviation the walk goes on from the median outward on both sides, and only the few fine counts around the ring
in which the wanted rank lies are opened.

Chunks are as long as leaves at most ``target`` rows of one series in them. Where one window's length alone holds
more, chunks are parts of it, and what cannot leave a window inside a chunk is sent as counts by value without
times, so the halo shrinks to the values there are. Nothing but one count comes to the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch

#: Rows of one series in a chunk; most window lengths in a chunk; most parts of a window's length.
TARGET, MOST_WINDOWS, MOST_PARTS = 1 << 13, 24, 256
#: Values beyond this are none: four of them must fit a long.
MOST_VALUE = 1 << 58


def micros(time: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp; of one without a zone as it stands, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        return ((time - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("decimal(18,6)") * F.lit(1000000)).cast("long")
    return F.unix_micros(time.cast("timestamp"))


class Histogram:
    """Counts by value, in buckets by the value's high digits; only values that occur take room."""

    def __init__(self, shift: int):
        self.shift, self.total = shift, 0
        self.highs: list[int] = []
        self.coarse: dict[int, int] = {}
        self.fine: dict[int, dict[int, int]] = {}

    def add(self, value: int, count: int) -> None:
        """``count`` may be negative; what comes to nothing leaves."""
        high = value >> self.shift
        self.total += count
        held = self.fine.get(high)
        if held is None:
            insort(self.highs, high)
            self.fine[high], self.coarse[high] = {value: count}, count
            return
        now = held.get(value, 0) + count
        if now:
            held[value] = now
        else:
            del held[value]
        left = self.coarse[high] = self.coarse[high] + count
        if not left:
            del self.fine[high], self.coarse[high], self.highs[bisect_left(self.highs, high)]

    def median2(self) -> int:
        """Sum of the two middle values; the only one twice."""
        low, high = (self.total - 1) // 2, self.total // 2
        first, coarse = None, self.coarse
        for bucket in self.highs:
            count = coarse[bucket]
            if high >= count and low >= count:
                low -= count
                high -= count
                continue
            held = self.fine[bucket]
            for value in sorted(held) if len(held) > 1 else held:
                count = held[value]
                if first is None and low < count:
                    first = value
                if high < count:
                    return first + value
                low -= count
                high -= count
        raise ValueError("no values")

    def deviation2(self, median2: int) -> int:
        """Sum of the two middle distances ``|2 * value - median2|``.

        Buckets are met by their distance ``k`` from the bucket of the median. With bucket width W, values in
        one at k lie between (k - 1) W and (k + 1) W from the median. If the buckets up to j - 1 hold at most
        r values and those up to j more, the distance of rank r is above (j - 1) W and below (j + 1) W: the
        buckets up to j - 2 come before it, those from j + 2 after it, and only the ring between is opened.
        """
        highs, coarse = self.highs, self.coarse
        low, high = (self.total - 1) // 2, self.total // 2
        centre = median2 >> (self.shift + 1)
        right = bisect_left(highs, centre)
        left, end = right - 1, len(highs)
        met: list[tuple[int, int]] = []
        seen, first, last = 0, None, None
        while left >= 0 or right < end:
            if right >= end or left >= 0 and centre - highs[left] <= highs[right] - centre:
                bucket = highs[left]
                k = centre - bucket
                left -= 1
            else:
                bucket = highs[right]
                k = bucket - centre
                right += 1
            if last is not None and k > last + 1:
                break
            met.append((k, bucket))
            seen += coarse[bucket]
            if first is None and seen > low:
                first = k
            if last is None and seen > high:
                last = k
        before, ring = 0, []
        for k, bucket in met:
            if k < first - 1:
                before += coarse[bucket]
            else:
                ring += [(abs(2 * value - median2), count) for value, count in self.fine[bucket].items()]
        low, high, start = low - before, high - before, None
        for distance, count in sorted(ring):
            if start is None and low < count:
                start = distance
            if high < count:
                return start + distance
            low -= count
            high -= count
        raise ValueError("no values")


def digits(values: np.ndarray, at: np.ndarray, window: int) -> int:
    """Low digits of a bucket: about as many buckets over the middle of the values as one holds values."""
    if len(values) < 2:
        return 0
    timed = at[at > np.iinfo(np.int64).min]
    length = int(timed.max() - timed.min()) if len(timed) else 0
    usual = len(values) * min(1.0, window / (length + 1)) if length else len(values)
    spread = float(np.subtract(*np.quantile(values, [0.9, 0.1])))
    return max(0, int(np.log2(max(spread / max(np.sqrt(usual), 1.0), 1.0))))


def slide(at: np.ndarray, value: np.ndarray, known: np.ndarray, count: np.ndarray, own: np.ndarray, window: int) -> list[tuple[int, int, int | None, int | None]]:
    """Time, number of values, doubled median and doubled-doubled deviation for each distinct own time.

    Cells are in order of time; the least long as a time is a cell that never leaves. A cell without a value only marks its time.
    """
    held = Histogram(digits(value[known], at[known], window))
    times, values, counts = at[known].tolist(), value[known].tolist(), count[known].tolist()
    never = int(np.iinfo(np.int64).min)
    into = out = 0
    while out < len(times) and times[out] == never:
        out += 1
    size, found = len(times), []
    for now in np.unique(at[own]).tolist():
        gone = now - window
        while into < size and times[into] <= now:
            held.add(values[into], counts[into])
            into += 1
        while out < into and times[out] <= gone:
            held.add(values[out], -counts[out])
            out += 1
        if held.total:
            middle = held.median2()
            found.append((now, held.total, middle, held.deviation2(middle)))
        else:
            found.append((now, 0, None, None))
    return found


def chunk_spans(most: int, window: int, target: int = TARGET) -> int:
    """Length of a chunk in time units for the largest count of rows of a series within one window's length."""
    if most <= target:
        return window * max(1, min(MOST_WINDOWS, target // max(most, 1)))
    parts = 1
    while parts < MOST_PARTS and most > target * parts and window % (2 * parts) == 0:
        parts *= 2
    return window // parts


def rolling_median(events: DataFrame, scratch: Scratch, *, id_col: str, time_col: str, series_col: str, value: Column, window: int, target: int = TARGET) -> DataFrame:
    """One row for each id with a time: id, series, at (microseconds), value, n, median2, mad4.

    ``value`` is a whole number or null, of the table's columns; null, or beyond ``MOST_VALUE``, is no value.
    ``n`` counts the values in the id's window, ``median2`` is their doubled median and ``mad4`` the doubled
    median of ``|2 * value - median2|``; without values both are null. A null series is a series. Of rows that
    share an id, a null id included, the one with the greatest time, then series, then value stands; ids whose
    rows have no time are left out. Equal values of different ids all count. An empty table gives none.
    """
    time = micros(F.col(f"`{time_col}`"), events.schema[time_col].dataType)
    kept = F.when(value.between(-MOST_VALUE, MOST_VALUE), value.cast("long"))
    slim = events.select(F.col(f"`{id_col}`").alias("id"), F.struct(time.alias("at"), F.col(f"`{series_col}`").alias("series"), kept.alias("value")).alias("x"))
    once = slim.groupBy("id").agg(F.max("x").alias("x")).select("id", "x.at", "x.series", "x.value").where("at is not null")
    once = scratch.keep(once, "once")
    most = once.groupBy("series", F.floor(F.col("at") / window)).count().agg(F.max("count")).first()[0] or 0
    span = chunk_spans(most, window, target)

    cells = once.groupBy("series", "at", "value").agg(F.count(F.lit(1)).alias("count"))
    chunk_of = lambda x: F.expr(f"(({x}) - pmod({x}, {span}L)) div {span}L")
    spread = cells.withColumn("first", chunk_of("at")).withColumn("chunk", F.explode(F.sequence("first", chunk_of(f"at + {window - 1}L"))))
    spread = spread.withColumn("own", F.col("chunk") == F.col("first")).where("own or value is not null")
    if span < window:
        leaves = F.col("own") | (F.col("at") + F.lit(window) < (F.col("chunk") + 1) * F.lit(span))
        spread = spread.withColumn("at", F.when(leaves, F.col("at"))).groupBy("series", "chunk", "at", "value", "own").agg(F.sum("count").alias("count"))
    spread = spread.select("series", "chunk", "at", "value", "count", "own").repartition("series", "chunk").sortWithinPartitions("series", "chunk", F.asc_nulls_first("at"))

    def run(batches):
        never = np.iinfo(np.int64).min
        for series, cells in chunked(batches):
            at, value = cells.column("at").fill_null(never).to_numpy(), cells.column("value")
            found = slide(at, value.fill_null(0).to_numpy(), value.is_valid().to_numpy(), cells.column("count").to_numpy(), cells.column("own").to_numpy(), window)
            parts = [pa.array(list(x), pa.int64()) for x in zip(*found, strict=True)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([series] * len(found), pa.string()), *parts], names=["series", "at", "n", "median2", "mad4"])

    found = spread.mapInArrow(run, "series string, at long, n long, median2 long, mad4 long")
    joined = once.join(found.withColumnsRenamed({"series": "_series", "at": "_at"}), F.col("series").eqNullSafe(F.col("_series")) & (F.col("at") == F.col("_at")))
    return joined.select("id", "series", "at", "value", "n", "median2", "mad4")


def chunked(batches):
    """Series and table of each chunk of the sorted batches; a chunk may span batches."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        series = batch.column(0).dictionary_encode()
        code = series.indices.fill_null(-1).to_numpy().astype(np.int64)
        chunk = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = (batch.column(0)[a].as_py(), int(chunk[a]))
            if held and own != key:
                yield key[0], pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key[0], pa.Table.from_batches(held)
