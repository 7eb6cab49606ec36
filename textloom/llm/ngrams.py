"""Hashed word and character n-grams of whole texts, and a softmax regression over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .arrow import columns
from .store import Scratch
from .textvec import U

BITS = 18
#: Least share of the texts that have a feature, and its least chi-square statistic.
SHARE, SCREEN = 0.005, 15.0


def families(docs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 4-byte windows, words and word pairs: hashed features in order, and where those of each text start and end."""
    buf, at = textvec.joined(docs)
    out = []
    wide = np.zeros(len(buf), np.uint32)
    for k in range(4):
        wide[: len(buf) - k] |= buf[k:].astype(np.uint32) << np.uint32(8 * k)
    chars = ((wide * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    out.append((chars, at[:-1], np.maximum(at[1:] - 4, at[:-1])))
    starts, ends = textvec.word_spans(buf)
    word = textvec.span_hashes(buf, starts, ends)
    ptr = np.searchsorted(starts, at)
    out.append(((word >> U(64 - BITS)).astype(np.int32), ptr[:-1], ptr[1:]))
    pair = textvec.mix(word[:-1] * U(3) + word[1:]) if len(word) > 1 else np.zeros(0, U)
    # A last text without words begins behind the last pair.
    first = np.minimum(ptr[:-1], len(pair))
    out.append(((pair >> U(64 - BITS)).astype(np.int32), first, np.maximum(ptr[1:] - 1, first)))
    return out


def scores(docs: list[bytes], weights: np.ndarray, bias: np.ndarray, norm: float) -> np.ndarray:
    """(texts, classes): the bias and, for each family, the summed weights of n features by n to the power ``norm``."""
    if len(slices := list(textvec.parts(docs))) > 1:
        return np.concatenate([scores(docs[x], weights, bias, norm) for x in slices])
    out = np.tile(bias.astype(np.float64), (len(docs), 1))
    for f, (index, first, last) in enumerate(families(docs)):
        n = np.maximum(last - first, 1) ** norm
        for k in range(weights.shape[2]):
            total = np.zeros(len(index) + 1)
            np.cumsum(weights[f, :, k][index], out=total[1:])
            out[:, k] += np.where(last > first, (total[last] - total[first]) / n, 0)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    #: (families, buckets, classes), float32
    weights: np.ndarray
    bias: np.ndarray
    #: Slope and intercept of the calibration, for two classes.
    slope: float = 1.0
    shift: float = 0.0
    norm: float = 1.0

    def probabilities(self, docs: list[bytes]) -> np.ndarray:
        return softmax(self.slope * scores(docs, self.weights, self.bias, self.norm) + np.array([0.0] * (len(self.bias) - 1) + [self.shift]))


@dataclass
class Features:
    """Text, feature and value of every feature of ``size`` texts."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    size: int

    @classmethod
    def of(cls, docs: list[bytes], norm: float) -> "Features":
        row, column, value = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for part in textvec.parts(docs):
            for f, (index, first, last) in enumerate(families(docs[part])):
                for i in range(len(first)):
                    own, n = np.unique(index[first[i] : last[i]], return_counts=True)
                    if len(own):
                        row.append(np.full(len(own), part.start + i, np.int32))
                        column.append(own + np.int32(f << BITS))
                        value.append((n / n.sum() ** norm).astype(np.float32))
        return cls(np.concatenate(row), np.concatenate(column), np.concatenate(value), len(docs))

    def part(self, chosen: np.ndarray) -> "Features":
        """Those of the chosen texts (booleans), numbered anew."""
        place, own = np.cumsum(chosen, dtype=np.int32) - 1, chosen[self.row]
        return Features(place[self.row[own]], self.column[own], self.value[own], int(chosen.sum()))

    def scores(self, model: "Model") -> np.ndarray:
        """(texts, classes) under the model, whose ``norm`` is that of the values."""
        flat = model.weights.reshape(-1, len(model.bias))
        return np.stack([np.bincount(self.row, self.value * flat[self.column, k], minlength=self.size) for k in range(flat.shape[1])], 1) + model.bias


def sampled(documents: DataFrame, chosen: DataFrame, classes: int, norm: float, *, screen: float, share: float = SHARE, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, Features]:
    """Classes of the chosen (doc_id, y), which of them are held out, and their features, in order of id and class.

    Of several texts of an id the one with the smallest hash counts. About a quarter, by a hash of the id, is
    held out, but nothing of a class of which nothing else is left. Features are counted where the texts are; only
    those that pass ``fit``'s bounds on the texts not held out come to the driver, never the texts.
    """
    scratch = Scratch(documents.sparkSession, "sample")
    rows = columns(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(chosen), "doc_id")
    # Combined before the exchange, so that repeated rows never meet.
    once = rows.groupBy("doc_id", "y").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    once = scratch.keep(once.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 3), "texts")
    size = {(r["y"], r["held"]): r["n"] for r in once.groupBy("y", "held").agg(F.count("*").alias("n")).collect()}
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, bool), Features.of([], norm)
    alone = [y for y, h in size if h and (y, False) not in size]
    once = once.withColumn("held", F.col("held") & ~F.col("y").isin(alone))
    size |= {(y, False): size[y, True] for y in alone}
    sizes = [size.get((k, False), 0) for k in range(classes)]
    texts = sum(sizes)

    def presence(batches):
        n = np.zeros((classes, 3 << BITS), np.int32)
        for part, docs, _ in textvec.chunks(batches):
            own, y = Features.of(docs, norm), part.column(0).to_numpy()
            for k in range(classes):
                n[k] += np.bincount(own.column[y[own.row] == k], minlength=3 << BITS).astype(np.int32)
        for k in range(classes):
            at = np.flatnonzero(n[k])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), k), pa.int32()), pa.array(n[k][at])], names=["feature", "y", "n"])

    counts = once.where("not held").select("y", "text").mapInArrow(presence, "feature int, y int, n int").groupBy("feature")
    counts = counts.agg(*[F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(classes)])
    seen, chi = sum((F.col(f"n{k}") for k in range(classes)), F.lit(0)), F.lit(0.0)
    for k, n in enumerate(sizes):
        expected = seen * (n / texts)
        chi += (F.col(f"n{k}") - expected) ** 2 / (expected + 1e-9) / (1 - F.when(expected < texts, expected / texts).otherwise(0.0))
    # A hair below the bounds, which ``fit`` applies again.
    kept = counts.where((seen >= max(3, share * texts) - 1e-6) & (chi >= screen * (1 - 1e-6))).select("feature").collect()
    shared = scratch.spark.sparkContext.broadcast(np.sort(np.array([r["feature"] for r in kept], np.int32)))

    def count(batches):
        wanted = np.zeros(3 << BITS, bool)
        wanted[shared.value] = True
        for part, docs, _ in textvec.chunks(batches):
            own = Features.of(docs, norm)
            # One family follows the other; here all of a text come together.
            mine = np.flatnonzero(wanted[own.column])
            mine = mine[np.argsort(own.row[mine], kind="stable")]
            ends = pa.array(np.searchsorted(own.row[mine], np.arange(len(docs) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(ends, pa.array(own.column[mine])), pa.ListArray.from_arrays(ends, pa.array(own.value[mine]))], names=["doc_id", "y", "held", "feature", "value"])

    found = once.select("doc_id", "y", "held", "text").mapInArrow(count, "doc_id long, y int, held boolean, feature array<int>, value array<float>").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    feature, value = (found.column(k).combine_chunks() for k in ("feature", "value"))
    length = pc.list_value_length(feature).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(length), dtype=np.int32), length)
    features = Features(row, pc.list_flatten(feature).to_numpy(zero_copy_only=False), pc.list_flatten(value).to_numpy(zero_copy_only=False), len(length))
    scratch.close()
    return found.column("y").to_numpy().astype(np.int64), found.column("held").to_numpy(zero_copy_only=False).astype(bool), features


def fit(docs: list[bytes] | Features, y: np.ndarray, classes: int, *, steps: int = 80, penalty: float = 0.1, share: float = SHARE, screen: float = SCREEN, evenness: float = 0.5, norm: float = 1.0) -> Model:
    """Softmax regression by Adam on the relative frequencies of each family, for features that ``share`` of the texts have.

    screen: least chi-square statistic of a feature's presence by class.
    evenness: from 0, features count as they are, to 1, all are scaled to the same mean square.
    norm: at 1 a feature counts by its frequency, at 0.5 rare words of a long text weigh more.
    docs: the texts, or their features with the same ``norm``.
    """
    given = docs if isinstance(docs, Features) else Features.of(docs, norm)
    row, column, value, texts = given.row, given.column, given.value, given.size
    weights = np.zeros((3, 1 << BITS, classes), np.float32)
    base = np.log(np.bincount(y, minlength=classes) + 1.0)
    if not len(row):
        return Model(weights, base - base.mean(), norm=norm)
    used, column = np.unique(column, return_inverse=True)
    # Features of few texts, and those about as frequent in every class, say more about those texts than about the class.
    seen, size = np.bincount(column, minlength=len(used)), np.bincount(y, minlength=classes)
    common = seen >= max(3, share * texts)
    chi = np.zeros(len(used))
    for k in range(classes):
        expected = seen * size[k] / texts
        chi += (np.bincount(column[y[row] == k], minlength=len(used)) - expected) ** 2 / (expected + 1e-9) / (1 - expected / texts)
    common &= chi >= screen
    if not common.any():
        return Model(weights, base - base.mean(), norm=norm)
    keep = common[column]
    place = np.cumsum(common) - 1
    used, row, column, value = used[common], row[keep], place[column[keep]], value[keep]
    scale = np.sqrt(np.bincount(column, value**2, minlength=len(used)) / texts) + 1e-7
    scale = scale**evenness * scale.max(initial=1e-7) ** (1 - evenness)
    value = (value / scale[column]).astype(np.float32)
    target = np.eye(classes)[y]
    w, b = np.zeros((len(used), classes)), base - base.mean()
    m, v = np.zeros_like(w), np.zeros_like(w)
    mb, vb = np.zeros(classes), np.zeros(classes)
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(row, value * w[column, k], minlength=texts) for k in range(classes)], 1) + b
        gap = (softmax(z) - target) / texts
        grad = np.stack([np.bincount(column, value * gap[row, k], minlength=len(used)) for k in range(classes)], 1) + penalty / texts * w
        gb = gap.sum(0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.02 * (1 - t / (steps + 1)) + 0.001
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    w /= scale[:, None]
    weights[used >> BITS, used & ((1 << BITS) - 1)] = w
    return Model(weights, b, norm=norm)


def _scored(model: Model, docs: list[bytes] | Features) -> np.ndarray:
    return docs.scores(model) if isinstance(docs, Features) else scores(docs, model.weights, model.bias, model.norm)


def calibrate(model: Model, docs: list[bytes] | Features, y: np.ndarray, steps: int = 60) -> Model:
    """Platt's slope and intercept for the last of two classes, by Newton steps on rows the model has not seen."""
    z = _scored(model, docs)
    x = z[:, 1] - z[:, 0]
    good = y.sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        r, s = p - t, p * (1 - p) + 1e-6
        g = np.array([(r * x).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
    return Model(model.weights, model.bias, max(a, 0.05), c, model.norm)


def tempered(model: Model, docs: list[bytes] | Features, y: np.ndarray) -> tuple[float, Model]:
    """The model with the slope, of a fixed grid, under which rows it has not seen are likeliest; before it their mean loss."""
    if not len(y):
        return 0.0, model
    z = _scored(model, docs)

    def loss(slope: float) -> float:
        return -float(np.log(0.999 * softmax(slope * z)[np.arange(len(y)), y] + 0.001 / z.shape[1]).sum()) + 1e-3 * slope

    best = min((2.0**k for k in np.arange(-8, 3.5, 0.5)), key=loss)
    return loss(best) / len(y), Model(model.weights, model.bias, best, 0.0, model.norm)
