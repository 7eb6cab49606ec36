"""Sliding median and deviation against sorted windows, in whole chunks, cut windows and awkward rows."""

import datetime as dt
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import queries as q
from textloom.llm import rolling
from textloom.llm.store import Scratch


def plain(values):
    m = sorted(values)
    two = m[(len(m) - 1) // 2] + m[len(m) // 2]
    d = sorted(abs(2 * v - two) for v in m)
    return two, d[(len(d) - 1) // 2] + d[len(d) // 2]


@pytest.mark.parametrize("shift", [0, 1, 4, 9, 30])
def test_histogram_against_sorting(shift):
    draw = np.random.default_rng(shift)
    held, kept = rolling.Histogram(shift), []
    for _ in range(1500):
        if kept and draw.random() < 0.45:
            value = kept.pop(int(draw.integers(len(kept))))
            held.add(value, -1)
        else:
            value = int(draw.choice([draw.integers(-50, 50), draw.integers(-3000, 3000), draw.integers(-(10**9), 10**9)]))
            kept.append(value)
            held.add(value, 1)
        if kept:
            two = held.median2()
            assert (two, held.deviation2(two)) == plain(kept)


def test_spans():
    assert rolling.chunk_spans(0, 900, 100) == 900 * rolling.MOST_WINDOWS and rolling.chunk_spans(30, 900, 100) == 2700
    assert rolling.chunk_spans(101, 900, 100) == 450 and rolling.chunk_spans(390, 900, 100) == 225
    assert rolling.chunk_spans(10**12, 2**20, 100) == 2**20 // rolling.MOST_PARTS


@pytest.mark.parametrize("target", [1, 3, 20, 10**6])
def test_against_every_window(spark, tmp_path, target):
    """Small targets cut the window's length into parts; ids repeat, times tie, one time is hot, series and values are null."""
    draw = np.random.default_rng(7)
    base, rows = dt.datetime(2024, 3, 10, 1, 55), []
    for i in range(400):
        at = base if i % 3 == 0 else base + dt.timedelta(microseconds=int(draw.integers(0, 3_600_000_000)))
        rows.append((i, at, [None, "a", "b"][int(draw.integers(3))], None if i % 11 == 0 else int(draw.integers(-40, 40)), "x"))
    rows += [(1000, base + dt.timedelta(minutes=15), "a", 5, "x"), (1001, None, "a", 7, "x"), (None, base, "b", 9, "x"), (None, base, "b", 8, "x"), (1003, base, "a", 1 << 60, "x")]
    events = spark.createDataFrame(rows + rows[:50], "id long, at timestamp_ntz, series string, v long, n string").repartition(5)
    got = rolling.rolling_median(events, Scratch(spark, "t"), id_col="id", time_col="at", series_col="series", value=F.col("v"), window=900_000_000, target=target).collect()
    once = {}
    for i, at, series, v, _ in rows:
        if at is not None and (i not in once or v > once[i][2]):
            once[i] = (at, series, v if v is None or v < 1 << 58 else None)
    want = []
    for i, (at, series, v) in once.items():
        held = [w for a, s, w in once.values() if s == series and w is not None and at - dt.timedelta(minutes=15) < a <= at]
        want.append((i, series, v, len(held), *(plain(held) if held else (None, None))))
    order = lambda rows: sorted(rows, key=repr)
    assert order([(r["id"], r["series"], r["value"], r["n"], r["median2"], r["mad4"]) for r in got]) == order(want)


def test_zone_does_not_matter(spark):
    rows = [(i, dt.datetime(2024, 3, 10, 1, 50) + dt.timedelta(minutes=5 * i), "a", i) for i in range(20)]
    events = spark.createDataFrame(rows, "id long, at timestamp_ntz, series string, v long")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = rolling.rolling_median(events, Scratch(spark, "t"), id_col="id", time_col="at", series_col="series", value=F.col("v"), window=900_000_000).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert {r["id"]: (r["n"], r["median2"]) for r in got} == {i: (min(3, i + 1), int(2 * median(range(max(0, i - 2), i + 1)))) for i in range(20)}


def test_query_of_broken_values_and_empty_table(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day, None, 1, "view", v, None) for v in (1.005,)] + [(2, day, None, 1, "view", float("nan"), None), (3, day, None, 1, "view", float("inf"), None), (4, day, None, 1, "view", -2.5, None), (5, day, None, 1, None, None, "{}")]
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/clicks.parquet")
    got = {r["click_id"]: tuple(r)[1:] for r in q.op12_sliding_median(spark, f"{tmp_path}/a").collect()}
    assert got == {1: ("view", 2, -150, 700, False), 2: ("view", 2, -150, 700, None), 3: ("view", 2, -150, 700, None), 4: ("view", 2, -150, 700, False), 5: (None, 0, None, None, None)}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/clicks.parquet")
    assert q.op12_sliding_median(spark, f"{tmp_path}/b").count() == 0
