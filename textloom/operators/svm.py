"""Linear models for all classes, penalties and folds at once: squared hinge one against the rest, and softmax over the classes.

Weights minimise ``|w|**2 / 2 + C * loss``. The hinge model of a class sums ``max(0, 1 - y * w @ x)**2`` and its
bias is the weight of a constant feature, penalised like any other; the softmax model of all classes sums
``-log p(class)`` and leaves its biases free. All models go through the same passes: each task sums loss and
gradient of every model over blocks of its rows, slices of the sums meet in a few tasks and then on the driver, and
L-BFGS, preconditioned by the diagonal of the curvature, takes every model's own steps, so that no model waits for
another's. Passes start at the mean of what chunks of at most ``LOCAL`` rows, a task's first ``STARTS``, give by
themselves: a chunk's problem has as many dimensions as rows, so it is solved in those. What the driver holds and
sends is bounded by the vocabulary times the models; models beyond ``CELLS`` weights are fitted in turns. Models that
have converged leave the passes. ``bayes`` needs no passes: every fold's Naive Bayes model comes from one count by
class and fold.
"""

from __future__ import annotations

from collections import deque
from itertools import islice, pairwise, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights fitted at once; cells of a chunk's dense stripe; remembered steps, and of few models, as many cells as of many; cuts of a step; cells of a slice of sums; tasks, and cells of all of them, whose sums go straight to the driver.
CELLS, BLOCK, MEMORY, LONGER, HALVED, SLICE, DIRECT, GATHERED = 1 << 22, 1 << 23, 8, 32, 20, 1 << 17, 8, 1 << 24
#: Rows and entries of a chunk that is solved by itself; how much wider its tolerance is; chunks of a task.
LOCAL, ENTRIES, WIDER, STARTS = 1024, 1 << 22, 100, 2
#: Entries of a block; columns from which rows are multiplied by all of them at once.
LISTED, WIDE = 1 << 18, 16


def sparse(rows: DataFrame) -> DataFrame:
    """(label, fold, places, values) of (label, fold, features): vectors as arrays, made once."""

    def run(batches):
        for batch in batches:
            places, values = [], []
            for x in batch.column("features").to_pylist():
                at = x["indices"] if x["type"] == 0 else [i for i, v in enumerate(x["values"]) if v]
                places.append(at)
                values.append(x["values"] if x["type"] == 0 else [x["values"][i] for i in at])
            parts = [batch.column("label"), batch.column("fold"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(parts, names=["label", "fold", "places", "values"])

    return rows.select("label", "fold", "features").mapInArrow(run, "label int, fold int, places array<int>, values array<double>")


class Block:
    """Some rows (class, fold, places, values) for products with a few columns at a time; a row's places are distinct."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        self.y, self.fold = (batch.column(c).to_numpy().astype(np.int64) for c in ("label", "fold"))
        self.size, self.n = size, len(batch)
        self.at, self.val = batch.column("places").flatten().to_numpy().astype(np.int64), batch.column("values").flatten().to_numpy()
        self.sizes = pc.fill_null(batch.column("places").value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends, self.row = np.append(0, np.cumsum(self.sizes)), np.repeat(np.arange(self.n), self.sizes)

    def times(self, w: np.ndarray) -> np.ndarray:
        """Rows times ``w``, whose last row is the constant feature's."""
        if w.shape[1] < WIDE:
            z, full = np.zeros((self.n, w.shape[1])), np.flatnonzero(self.sizes)
            for j, own in enumerate(np.ascontiguousarray(w.T)):
                z[full, j] = np.add.reduceat(self.val * own[self.at], self.ends[full]) if len(full) else 0
            return z + w[-1]
        # Row by row: what is taken of the weights stays in the processor's cache until it is summed.
        z, w = np.empty((self.n, w.shape[1])), np.ascontiguousarray(w)
        for i, (start, stop) in enumerate(pairwise(self.ends.tolist())):
            np.dot(self.val[start:stop], w.take(self.at[start:stop], 0), out=z[i])
        return z + w[-1]

    def turned(self, pull: np.ndarray, total: np.ndarray, power: int = 1) -> None:
        """Adds the rows (their values to this power), turned, times each column of ``pull`` to a row of ``total``; rows of which a column has zero cost it nothing."""
        val = self.val if power == 1 or not len(total) else self.val**power
        for own, sums in zip(pull.T, total, strict=True):
            some = np.flatnonzero(own)
            sums[-1] += own.sum()
            if 2 * len(some) > self.n:
                sums[:-1] += np.bincount(self.at, val * own[self.row], self.size)
            elif len(some):
                sizes = self.sizes[some]
                ends = np.cumsum(sizes)
                entries = np.repeat(self.ends[some] - ends + sizes, sizes) + np.arange(ends[-1])
                sums[:-1] += np.bincount(self.at[entries], val[entries] * np.repeat(own[some], sizes), self.size)


def blocks(batches, size: int):
    """Blocks of about ``LISTED`` entries."""
    for batch in batches:
        ends, start = np.cumsum(pc.fill_null(batch.column("places").value_lengths(), 0).to_numpy(zero_copy_only=False) + 1), 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LISTED, "right")))
            yield Block(batch.slice(start, stop - start), size)
            start = stop


def summed(rows: DataFrame, sums, shape: tuple[int, int], tasks: int | None = None) -> np.ndarray:
    """The total of each task's ``sums(batches)``, arrays of one shape; of many tasks, slices meet by an exchange, so the driver gets each once."""
    height = max(1, SLICE // max(shape[1], 1))

    def cut(batches):
        total = sums(batches)
        parts = [(i // height, total[i : i + height].tobytes()) for i in range(0, shape[0], height)]
        for part, own in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own], pa.binary())], names=["part", "sums"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(own.as_py())
                held[part] = held[part] + got if part in held else got
        for part, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    schema, tasks = "part int, sums binary", tasks or rows.rdd.getNumPartitions()
    out = rows.mapInArrow(cut, schema)
    if tasks > DIRECT or tasks * shape[0] * shape[1] > GATHERED:
        out = out.repartition(DIRECT, "part").mapInArrow(add, schema)
    total = np.zeros(shape)
    found = out.toArrow()
    for part, sums_ in zip(found.column("part").to_pylist(), found.column("sums"), strict=True):
        own = total[part * height : (part + 1) * height]
        own += np.frombuffer(sums_.as_buffer()).reshape(own.shape)
    return total


def by_fold(rows: DataFrame, size: int, folds: int) -> np.ndarray:
    """Sums of squared features (and of the constant) by fold from -1, one column each."""

    def sums(batches):
        total = np.zeros((size + 1, folds + 1))
        for b in blocks(batches, size):
            total[:-1] += np.bincount(b.at * (folds + 1) + b.fold[b.row] + 1, b.val**2, size * (folds + 1)).reshape(size, -1)
            total[-1] += np.bincount(b.fold + 1, minlength=folds + 1)
        return total

    return summed(rows, sums, (size + 1, folds + 1))


def losses(z: np.ndarray, y: np.ndarray, fold: np.ndarray, of: np.ndarray, left: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each model, its first and second derivative by the rows' products ``z``; rows of a model's left-out fold count nothing."""
    on, hit = fold[:, None] != left, y[:, None] == of
    if width == 1:
        sign = np.where(hit, 1.0, -1.0)
        miss = np.maximum(1 - sign * z, 0) * on
        return (miss**2).sum(0), -2 * sign * miss, 2.0 * (miss > 0)
    z = z.reshape(len(y), -1, width)
    z = z - z.max(2, keepdims=True)
    z = (z - np.log(np.exp(z).sum(2, keepdims=True))).reshape(len(y), -1)
    p = np.exp(z)
    return -np.where(hit & on, z, 0).sum(0), (p - hit) * on, p * (1 - p) * on


class Problem:
    """Models (class, C, fold left out; -1 leaves none out); ``width`` of them in a row are one problem: 1 for hinge, all classes of one C and fold for softmax."""

    def __init__(self, size: int, models: list[tuple[int, float, int]], width: int):
        self.size, self.models, self.width = size, models, width
        self.held = np.ones((size + 1, 1))
        if width > 1:
            self.held[-1] = 0

    def columns(self, which: np.ndarray) -> np.ndarray:
        return (which[:, None] * self.width + np.arange(self.width)).ravel()

    def curvature(self, squares: np.ndarray) -> np.ndarray:
        """The diagonal of the second derivative at its largest, of sums of squares by fold from -1."""
        c, left = np.array([m[1] for m in self.models]), [m[2] for m in self.models]
        own = squares.sum(1, keepdims=True) - np.stack([squares[:, f + 1] if 0 <= f < squares.shape[1] - 1 else np.zeros(len(squares)) for f in left], 1)
        return np.maximum(self.held + c * own * (2.0 if self.width == 1 else 0.25), 1e-12)

    def __call__(self, w: np.ndarray, which: np.ndarray, bent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value by problem, gradient by model and, of the problems ``bent``, the curvature by model, of the problems ``which`` at weights ``w``, a row each."""
        own = [self.models[i] for i in self.columns(which)]
        c, held, wide = np.array([m[1] for m in own]), self.held.T, np.repeat(bent, self.width)
        loss, pull, bend = self.total(w, np.array([m[0] for m in own]), np.array([m[2] for m in own]), wide)
        value = 0.5 * (held * w**2).sum(1) + c * loss
        return value.reshape(-1, self.width).sum(1), held * w + c[:, None] * pull, np.maximum(held + c[wide, None] * bend, 1e-12)


class Passes(Problem):
    """Over rows as ``sparse`` makes them, a pass for each call."""

    def __init__(self, rows: DataFrame, size: int, models: list[tuple[int, float, int]], width: int = 1):
        super().__init__(size, models, width)
        self.rows, self.tasks = rows, rows.rdd.getNumPartitions()

    def total(self, w: np.ndarray, of: np.ndarray, left: np.ndarray, bent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, width, n = self.size, self.width, len(w)
        shared = self.rows.sparkSession.sparkContext.broadcast((w, of, left, bent))

        def sums(batches):
            w, of, left, bent = shared.value
            w = np.ascontiguousarray(w.T) if n >= WIDE else w.T
            total = np.zeros((n + bent.sum(), size + 2))
            for b in blocks(batches, size):
                loss, pull, bend = losses(b.times(w), b.y, b.fold, of, left, width)
                total[:n, 0] += loss
                b.turned(pull, total[:n, 1:])
                b.turned(bend[:, bent], total[n:, 1:], 2)
            return total

        total = summed(self.rows, sums, (n + int(bent.sum()), size + 2), self.tasks)
        shared.destroy()
        return total[:n, 0], total[:n, 1:], total[n:, 1:]


class Chunk(Problem):
    """Over a chunk's rows in the dimensions that they span; ``back`` gives weights of the features."""

    def __init__(self, table: pa.Table, size: int, models: list[tuple[int, float, int]], width: int):
        n = len(table)
        self.y, self.fold = table.column("label").to_numpy().astype(np.int64), table.column("fold").to_numpy().astype(np.int64)
        places = table.column("places").combine_chunks()
        at, val = places.flatten().to_numpy(), table.column("values").combine_chunks().flatten().to_numpy()
        order = np.argsort(at, kind="stable")
        self.at, self.val, self.row = at[order], val[order], np.repeat(np.arange(n), places.value_lengths().to_numpy())[order]
        gram = np.zeros((n, n))
        for _, x in self.stripes():
            gram += x @ x.T
        values, vectors = np.linalg.eigh(gram)
        on = values > 1e-12 * max(values.max(initial=0), 1e-300)
        self.turn = vectors[:, on] / np.sqrt(values[on])
        self.x = np.hstack([vectors[:, on] * np.sqrt(values[on]), np.ones((n, 1))])
        self.features = size
        super().__init__(int(on.sum()), models, width)

    def stripes(self):
        """The rows over some of their features at a time: the features, dense cells."""
        distinct, first = np.unique(self.at, return_index=True)
        first, step = np.append(first, len(self.at)), max(1, BLOCK // max(len(self.y), 1))
        for i in range(0, len(distinct), step):
            own, some = distinct[i : i + step], slice(first[i], first[min(i + step, len(distinct))])
            x = np.zeros((len(self.y), len(own)))
            x[self.row[some], np.searchsorted(own, self.at[some])] = self.val[some]
            yield own, x

    def total(self, w: np.ndarray, of: np.ndarray, left: np.ndarray, bent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        loss, pull, bend = losses(self.x @ w.T, self.y, self.fold, of, left, self.width)
        return loss, pull.T @ self.x, bend[:, bent].T @ self.x**2 if bent.any() else np.zeros((0, self.x.shape[1]))

    def squares(self, folds: int) -> np.ndarray:
        return np.stack([(self.x[self.fold == f] ** 2).sum(0) for f in range(-1, folds)], 1)

    def back(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.features + 1, w.shape[1]))
        turned = self.turn @ w[:-1]
        for own, x in self.stripes():
            out[own] = x.T @ turned
        out[-1] = w[-1]
        return out


def chunks(batches):
    """Tables of at most ``LOCAL`` rows and about ``ENTRIES`` entries."""
    held, rows, entries = [], 0, 0
    for batch in batches:
        ends, start = np.cumsum(batch.column("places").value_lengths().to_numpy()), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = min(start + LOCAL - rows, int(np.searchsorted(ends, before + ENTRIES - entries, "right")))
            stop = max(stop, start if held else start + 1)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                rows, entries, start = rows + stop - start, entries + int(ends[stop - 1] - before), stop
            if start < len(ends):
                yield pa.Table.from_batches(held)
                held, rows, entries = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def first_weights(passes: Passes, n: int, folds: int, tolerance: np.ndarray, iterations: int) -> np.ndarray:
    """The mean of some chunks' own weights, by their rows; a chunk stands for all ``n`` rows, so its losses count more.

    Only where the passes start depends on the chunks; what they end at is the whole table's.
    """
    size, models, width = passes.size, passes.models, passes.width

    def sums(batches):
        total = np.zeros((size + 2, len(models)))
        for table in islice(chunks(batches), STARTS):
            chunk = Chunk(table, size, [(k, c * n / len(table), left) for k, c, left in models], width)
            own = minimise(chunk, chunk.curvature(chunk.squares(folds)), WIDER * tolerance, iterations)
            total[:-1] += len(table) * chunk.back(own)
            total[-1] += len(table)
        return total

    total = summed(passes.rows, sums, (size + 2, len(models)), passes.tasks)
    return total[:-1] / np.maximum(total[-1], 1)


def steps(scale: np.ndarray, tolerance: float, iterations: int, first: np.ndarray | None, memory: int):
    """Weights of one problem, a row a model, by L-BFGS; yields weights and whether it needs the curvature there, gets value, gradient and curvature.

    ``scale`` is the inverse of a bound of the curvature's diagonal. After 4, 8, 16, ... steps the diagonal itself takes its
    place: of the hinge, only rows inside the margin bend.
    """
    hinge, w = len(scale) == 1, np.zeros(scale.shape)
    size = np.linalg.norm if hinge else lambda g: np.abs(g).max()
    if hinge or first is None:
        f, g, _ = yield w, False
    bound = tolerance * (size(g) if hinge else 1.0)
    if first is not None:
        w = first
        f, g, h = yield w, True
        scale = 1 / h
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    for step in range(iterations):
        if size(g) <= bound:
            break
        d, held = -g, []
        for s, y, r in reversed(past):
            held.append(r * np.vdot(s, d))
            d -= held[-1] * y
        if past:
            s, y, r = past[-1]
            d *= 1 / max(r * np.vdot(y, y * scale), 1e-300) if r > 0 else 1.0
        d *= scale
        for (s, y, r), a in zip(past, reversed(held), strict=True):
            d += (a - r * np.vdot(y, d)) * s
        slope, t, bent = np.vdot(g, d), 1.0, step > 2 and not step & (step + 1)
        for _ in range(HALVED):
            trial = w + t * d
            f2, g2, h = yield trial, bent
            if f2 <= f + 1e-4 * t * slope + 1e-12 * abs(f):
                break
            # The parabola through both values and the slope says where to look next.
            t = min(max(-slope * t**2 / max(2 * (f2 - f - t * slope), 1e-300), 0.1 * t), 0.5 * t)
        s, y = trial - w, g2 - g
        past.append((s, y, 1 / np.vdot(s, y) if np.vdot(s, y) > 1e-300 else 0.0))
        w, f, g, scale = trial, f2, g2, 1 / h if bent else scale
    return w


def minimise(passes: Problem, curvature: np.ndarray, tolerance: np.ndarray, iterations: int, first: np.ndarray | None = None) -> np.ndarray:
    """Weights of every problem from ``first`` or zero. Each takes its own steps; a pass serves whatever point each of them asks for.

    A hinge problem ends when its gradient's length is below its tolerance times that at zero, a softmax problem when
    the largest entry is below its tolerance.
    """
    own = [slice(i, i + passes.width) for i in range(0, curvature.shape[1], passes.width)]
    memory = min(max(MEMORY * CELLS // max(2 * curvature.size, 1), MEMORY), LONGER)
    out, going, asked = np.zeros(curvature.shape), {}, {}
    for i, at in enumerate(own):
        going[i] = steps(np.ascontiguousarray(1 / curvature[:, at].T), tolerance[i], iterations, None if first is None else np.ascontiguousarray(first[:, at].T), memory)
        asked[i] = next(going[i])
    while going:
        live, bent = np.array(list(going)), np.array([asked[i][1] for i in going])
        f, g, h = passes(np.vstack([asked[i][0] for i in going]), live, bent)
        h = iter(h.reshape(-1, passes.width, h.shape[1]))
        for i, f_, g_, bends in zip(live.tolist(), f, g.reshape(len(live), passes.width, -1), bent, strict=True):
            try:
                asked[i] = going[i].send((f_, g_.copy(), next(h).copy() if bends else None))
            except StopIteration as end:
                out[:, own[i]] = end.value.T
                del going[i], asked[i]
    return out


def counts(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Rows by class and fold."""
    return {(r["label"], r["fold"]): r["n"] for r in rows.groupBy(F.col("label").cast("int").alias("label"), "fold").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit(rows: DataFrame, size: int, models: list[tuple[int, float, int]], *, tolerance: float = 1e-4, iterations: int = 1000, width: int = 1, first: np.ndarray | None = None) -> np.ndarray:
    """Weights (``size`` and the bias, by models), from ``first``, if it is given; with a ``width``, that many models in a row are the classes of one softmax.

    As in the scripts' library, a hinge model's tolerance is scaled by its rarer side, and a softmax's is that of the mean loss.
    """
    found, scaled = counts(rows), []
    for k, c, left in models[::width]:
        total = sum(n for (_, f), n in found.items() if f != left)
        own = sum(n for (y, f), n in found.items() if f != left and y == k)
        scaled.append(tolerance * (max(min(own, total - own), 1) / max(total, 1) if width == 1 else c * max(total, 1)))
    squares = by_fold(rows, size, max((f for _, f in found), default=-1) + 1)
    out, at_once = [], max(1, CELLS // (size + 1) // width)
    for start in range(0, len(scaled), at_once):
        passes = Passes(rows, size, models[start * width : (start + at_once) * width], width)
        bound = np.array(scaled[start : start + at_once])
        begin = first_weights(passes, sum(found.values()), squares.shape[1] - 1, bound, iterations) if first is None else first[:, start * width : (start + at_once) * width]
        out.append(minimise(passes, passes.curvature(squares), bound, iterations, begin))
    return np.hstack(out)


def class_sums(rows: DataFrame, size: int, classes: int) -> np.ndarray:
    """Sums of features, and of rows last, by class and fold from -1; one pass."""
    folds = max((f for _, f in counts(rows)), default=-1) + 2

    def sums(batches):
        total = np.zeros((size + 1, classes * folds))
        for b in blocks(batches, size):
            group = b.y * folds + b.fold + 1
            np.add.at(total.reshape(-1), b.at * np.int64(classes * folds) + group[b.row], b.val)
            total[-1] += np.bincount(group, minlength=classes * folds)
        return total

    return summed(rows, sums, (size + 1, classes * folds)).reshape(size + 1, classes, folds)


def bayes(sums: np.ndarray, models: list[tuple[float, int]]) -> dict[tuple[float, int], np.ndarray]:
    """Multinomial Naive Bayes of each (smoothing, fold left out), as weights whose last row is the log prior.

    Of ``class_sums``: a model's counts are all folds' less the one left out. A class without rows outside that fold
    has prior zero.
    """
    out = {}
    for alpha, left in models:
        own = sums.sum(2) - (sums[:, :, left + 1] if left >= 0 else 0)
        smooth = np.maximum(own[:-1], 0) + alpha
        with np.errstate(divide="ignore"):
            prior = np.log(np.round(own[-1]) / max(np.round(own[-1]).sum(), 1))
        out[(alpha, left)] = np.vstack([np.log(smooth) - np.log(smooth.sum(0)), prior])
    return out


def predictions(rows: DataFrame, size: int, weights: dict[tuple[float, int], np.ndarray], held_out: bool, made=iter) -> DataFrame:
    """(c, left, label, prediction) of each row by the models of each (C, fold left out); ``held_out``: only of that fold's rows.

    ``made`` gives vectors from a task's batches, so that texts need no second Python process.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        all_ = np.hstack(list(shared.value.values()))
        for b in blocks(made(batches), size):
            best = b.times(all_).reshape(b.n, len(shared.value), -1).argmax(2)
            for i, (c, left) in enumerate(shared.value):
                on = b.fold == left if held_out else np.ones(b.n, bool)
                parts = [np.full(on.sum(), c), np.full(on.sum(), left), b.y[on].astype(float), best[on, i].astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(parts, (pa.float64(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["c", "left", "label", "prediction"])

    return rows.mapInArrow(run, "c double, left int, label double, prediction double")


def train(kind: str, rows: DataFrame, size: int, classes: int, asked: list[tuple[float, int]], *, tolerance: float = 1e-4, iterations: int = 1000, sums: np.ndarray | None = None, first: np.ndarray | None = None) -> dict[tuple[float, int], np.ndarray]:
    """Weights of 'svm', 'logreg' or 'nb' for each (penalty or smoothing, fold left out), the optimisers' from ``first``; ``sums``: nb's ``class_sums``, if they are there."""
    if kind == "nb":
        return bayes(class_sums(rows, size, classes) if sums is None else sums, asked)
    w = fit(rows, size, [(k, c, f) for c, f in asked for k in range(classes)], tolerance=tolerance, iterations=iterations, width=classes if kind == "logreg" else 1, first=first)
    return {own: w[:, i * classes : (i + 1) * classes] for i, own in enumerate(asked)}


def searched(rows: DataFrame, size: int, classes: int, grid: list[float], folds: int, score, *, tolerance: float = 1e-4, iterations: int = 1000, kind: str = "svm", sums: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The value of the grid with the best mean ``score(label, prediction table)`` over the folds, the first of equals; and the mean of its folds' weights."""
    by = train(kind, rows, size, classes, list(product(grid, range(folds))), tolerance=tolerance, iterations=iterations, sums=sums)
    found = predictions(rows, size, by, held_out=True).groupBy("c", "left", "label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()
    mean = {c: np.mean([score([(r["label"], r["prediction"], r["n"]) for r in found if (r["c"], r["left"]) == (c, f)]) for f in range(folds)]) for c in grid}
    best = max(grid, key=lambda c: mean[c])
    return best, sum(by[best, f] for f in range(folds)) / folds


def search(rows: DataFrame, size: int, classes: int, grid: list[float], folds: int, score, **given) -> float:
    """``searched``, without the weights."""
    return searched(rows, size, classes, grid, folds, score, **given)[0]


def macro_f1(counts: list[tuple[float, float, int]]) -> float:
    """Macro F1 over the labels that occur or are predicted; 0 where nothing is."""
    names = {y for y, _, _ in counts} | {p for _, p, _ in counts}
    value = []
    for k in names:
        hit = sum(n for y, p, n in counts if y == p == k)
        all_ = sum(n * ((y == k) + (p == k)) for y, p, n in counts)
        value.append(2 * hit / all_ if all_ else 0.0)
    return float(np.mean(value)) if value else 0.0
