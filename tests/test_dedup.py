"""Dedup by digests against plain loops: nulls, repeated ids, hot copies, clashing names."""

import random

from textloom.operators import dedup


def test_exact_and_cross_label_against_loops(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(150), draw.choice(["hot", "hot", "a", "", None, "б" * 300]), draw.choice(["x", "y", None]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, text string, label string, __n int").repartition(5)
    first: dict = {}
    for i, t, x, _ in rows:
        first[t, x] = min(i, first.get((t, x), i))
    want = sorted((r for r in rows if r[0] == first[r[1], r[2]]), key=repr)
    got = dedup.exact_dedup(df, ["text", "label"])
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == want
    times: dict = {}
    for r in rows:
        times[r[1]] = times.get(r[1], 0) + 1
    kept = [r for r in rows if r[2] != "x" or r[1] is None or times[r[1]] == 1]
    assert sorted(map(tuple, dedup.cross_label_dedup(df, "x").collect()), key=repr) == sorted(kept, key=repr)
    assert dedup.exact_dedup(df.limit(0), ["text"]).count() == 0 and dedup.cross_label_dedup(df.limit(0), "x").count() == 0
