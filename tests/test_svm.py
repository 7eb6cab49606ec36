"""The solver for all models at once against a plain one for each, and the search against its parts."""

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import functions as F

from textloom.operators import svm


def plain(x, sign, c):
    """Newton's method with halved steps on one model's dense problem."""
    w = np.zeros(x.shape[1])

    def value(w):
        return 0.5 * w @ w + c * (np.maximum(1 - sign * (x @ w), 0) ** 2).sum()

    for _ in range(200):
        miss = np.maximum(1 - sign * (x @ w), 0)
        g, on = w - 2 * c * x.T @ (sign * miss), miss > 0
        d = np.linalg.solve(np.eye(len(w)) + 2 * c * x[on].T @ x[on], -g)
        t = 1.0
        while value(w + t * d) > value(w) + 1e-4 * t * g @ d and t > 1e-10:
            t /= 2
        w = w + t * d
        if np.abs(g).max() < 1e-10:
            break
    return w


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(2)
    x = np.where(draw.random((90, 12)) < 0.4, draw.random((90, 12)), 0.0)
    y = (x[:, :3] + 0.3 * draw.random((90, 3))).argmax(1)
    fold = np.arange(90) % 3
    vector = [DenseVector(r) if i % 7 == 0 else SparseVector(12, [(j, v) for j, v in enumerate(r) if v]) for i, r in enumerate(x)]
    df = spark.createDataFrame([(int(a), int(f), v) for a, f, v in zip(y, fold, vector, strict=True)], ["label", "fold", "features"])
    return svm.sparse(df.select(F.col("label").cast("int"), F.col("fold").cast("int"), "features").repartition(6)).persist(), np.hstack([x, np.ones((90, 1))]), y, fold


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_weights_against_a_plain_solver(rows, monkeypatch, cells):
    monkeypatch.setattr(svm, "CELLS", cells)
    df, x, y, fold = rows
    models = [(k, c, left) for c in (0.01, 1.0, 10.0) for left in (-1, 1) for k in range(3)]
    if cells == 40:
        models = models[:4]
    w = svm.fit(df, 12, models, tolerance=1e-8, iterations=500)
    for i, (k, c, left) in enumerate(models):
        on = fold != left
        want = plain(x[on], np.where(y[on] == k, 1.0, -1.0), c)
        assert np.allclose(w[:, i], want, atol=1e-4), (k, c, left, np.abs(w[:, i] - want).max())


def test_search_against_its_parts(rows):
    df, x, y, fold = rows
    grid, mean = [0.01, 1.0, 10.0], {}
    for c in grid:
        score = []
        for f in range(3):
            on = fold != f
            w = np.stack([plain(x[on], np.where(y[on] == k, 1.0, -1.0), c) for k in range(3)], 1)
            p = (x[~on] @ w).argmax(1)
            score.append(svm.macro_f1([(a, b, 1) for a, b in zip(y[~on], p, strict=True)]))
        mean[c] = np.mean(score)
    assert svm.search(df, 12, 3, grid, 3, svm.macro_f1, tolerance=1e-6, iterations=300) == max(grid, key=mean.get)


def test_macro_f1():
    assert svm.macro_f1([(0, 0, 3), (1, 0, 1), (2, 2, 2)]) == pytest.approx((6 / 7 + 0 + 1) / 3) and svm.macro_f1([]) == 0.0
