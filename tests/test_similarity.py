"""The largest cosine by cells around pivots against all pairs, and how many cells are looked into."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import filters


@pytest.fixture(scope="module")
def both(spark):
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(12, 16))
    near = lambda n: centre[draw.integers(0, 12, n)] + 0.05 * draw.normal(size=(n, 16))
    held, asked = np.vstack([near(500), np.zeros((1, 16))]), np.vstack([near(80), draw.normal(size=(20, 16)), np.zeros((1, 16))])
    name = lambda n: ["a" if i % 3 else "b" for i in range(n)]
    schema = "label string, embedding array<double>"
    e = spark.createDataFrame([*zip(name(len(held)), held.tolist(), strict=True)] + [("b", held[0].tolist())] * 40, schema)
    c = spark.createDataFrame([*zip(range(len(asked)), name(len(asked)), asked.tolist(), strict=True), (900, "none", asked[0].tolist())], "cand_id long, " + schema)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    cosine = unit(asked) @ unit(held).T
    cosine[np.array(name(len(asked)))[:, None] != np.array(name(len(held)))] = -2
    return c, e, cosine.max(1)


@pytest.mark.parametrize("block, cell", [(1024, 256), (7, 10)])
def test_against_all_pairs(both, monkeypatch, block, cell):
    monkeypatch.setattr(filters, "BLOCK", block)
    monkeypatch.setattr(filters, "CELL", cell)
    c, e, want = both
    got = {r["cand_id"]: r["similarity"] for r in filters.max_similarity(c, e).collect()}
    assert sorted(got) == list(range(len(want)))
    assert np.allclose([got[i] for i in range(len(want))], want, atol=1e-12)


def test_far_cells_are_not_visited(both, monkeypatch):
    monkeypatch.setattr(filters, "CELL", 10)
    c, e, want = both
    c, e = c.where("label = 'a' and cand_id < 80"), e.where("label = 'a'").distinct()
    centres = filters.pivots(e)
    reaches = filters.cells(e, centres).groupBy("label", "pivot").agg(F.max("angle").alias("reach"))
    known = c.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(want)], "cand_id long, known double")
    met = filters.visits(c.join(known, "cand_id").withColumn("seen", F.lit(-1)), centres, reaches, known=True).count()
    assert met < 0.5 * c.count() * reaches.count()


def test_nothing(both):
    c, e, _ = both
    assert filters.max_similarity(c, e.limit(0)).count() == 0 == filters.max_similarity(c.limit(0), e).count()
