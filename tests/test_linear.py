"""Softmax models and Naive Bayes of all folds at once against plain solvers; chunked starts and sliced sums against whole ones."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import svm


def softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def plain_softmax(x, y, classes, c):
    """Newton's method on the dense problem; the last column is the free bias."""
    d, hot = x.shape[1], np.eye(classes)[y]
    held = np.append(np.ones(d - 1), 0)
    w = np.zeros((d, classes))
    for _ in range(60):
        p = softmax(x @ w)
        g = (held[:, None] * w + c * x.T @ (p - hot)).T.ravel()
        h = np.kron(np.eye(classes), np.diag(held))
        for i in range(classes):
            for j in range(classes):
                h[i * d : (i + 1) * d, j * d : (j + 1) * d] += c * x.T @ (x * (p[:, i] * ((i == j) - p[:, j]))[:, None])
        w -= np.linalg.lstsq(h, g, rcond=1e-12)[0].reshape(classes, d).T
    return w


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(5)
    x = np.where(draw.random((80, 9)) < 0.5, draw.random((80, 9)), 0.0)
    return x, (x[:, :3] + 0.5 * draw.random((80, 3))).argmax(1), np.arange(80) % 3


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, fold = data
    held = [(int(a), int(f), [j for j in range(9) if r[j]], [float(v) for v in r if v]) for r, a, f in zip(x, y, fold, strict=True)]
    return spark.createDataFrame(held, "label int, fold int, places array<int>, values array<double>").repartition(12).persist()


@pytest.mark.parametrize("local", [1024, 3])
def test_softmax(rows, data, monkeypatch, local):
    monkeypatch.setattr(svm, "LOCAL", local)
    x, y, fold = data
    x = np.hstack([x, np.ones((80, 1))])
    for (c, left), w in svm.train("logreg", rows, 9, 3, [(0.1, -1), (10.0, 1)], tolerance=1e-7, iterations=500).items():
        want = plain_softmax(x[fold != left], y[fold != left], 3, c)
        assert np.allclose(softmax(x @ w), softmax(x @ want), atol=1e-4)
        assert np.allclose(w[:-1] - w[:-1].mean(1, keepdims=True), want[:-1] - want[:-1].mean(1, keepdims=True), atol=1e-3)


def test_bayes(rows, data):
    x, y, fold = data
    for (alpha, left), w in svm.train("nb", rows, 9, 3, [(0.01, -1), (1.0, 0), (0.5, 2)]).items():
        on = fold != left
        sums = np.stack([x[on & (y == k)].sum(0) for k in range(3)], 1) + alpha
        assert np.allclose(w[:-1], np.log(sums / sums.sum(0)))
        assert np.allclose(w[-1], np.log(np.bincount(y[on], minlength=3) / on.sum()))


def test_sums_of_many_tasks(rows, data, monkeypatch):
    monkeypatch.setattr(svm, "SLICE", 6)
    x, _, fold = data
    got = svm.by_fold(rows, 9, 3)
    assert np.allclose(got[:-1], np.stack([(x[fold == f] ** 2).sum(0) for f in (-1, 0, 1, 2)], 1)) and got[-1].tolist() == [0, 27, 27, 26]


def test_a_chunk_is_its_rows(data):
    """Weights in the rows' own dimensions are those of the features."""
    x, y, fold = data
    table = pa.table({"label": pa.array(y[:6], pa.int32()), "fold": pa.array(fold[:6], pa.int32()), "places": [np.flatnonzero(r).tolist() for r in x[:6]], "values": [r[r != 0].tolist() for r in x[:6]]})
    chunk = svm.Chunk(table, 9, [(k, 1.0, -1) for k in range(3)], 1)
    w = svm.minimise(chunk, chunk.curvature(chunk.squares(3)), np.full(3, 1e-9), 500)
    whole = np.hstack([x[:6], np.ones((6, 1))])
    back = chunk.back(w)
    miss = np.maximum(1 - np.where(y[:6, None] == np.arange(3), 1, -1) * (whole @ back), 0)
    assert np.allclose(back - 2 * whole.T @ (np.where(y[:6, None] == np.arange(3), 1, -1) * miss), 0, atol=1e-6)


@pytest.mark.parametrize("local, entries", [(4, 1 << 22), (100, 7), (1, 1)])
def test_chunks_hold_every_row_once(monkeypatch, local, entries):
    monkeypatch.setattr(svm, "LOCAL", local)
    monkeypatch.setattr(svm, "ENTRIES", entries)
    lengths = [3, 0, 9, 1, 1, 1, 0, 20, 2, 2, 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array([[0] * n for n in lengths], pa.list_(pa.int32()))], names=["label", "places"])
    got = [t.column("label").to_pylist() for t in svm.chunks([batch.slice(0, 5), batch.slice(5, 0), batch.slice(5, 6)])]
    assert sum(got, []) == list(range(11)) and max(map(len, got)) <= local
    assert all(len(g) == 1 or sum(lengths[i] for i in g) <= entries for g in got)
