"""Steps that were too slow or too large at size: what they exchange and hold, and that results are whole."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import features, filters, generation, language, quota, svm


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grams_are_counted_in_the_row(spark):
    df = spark.createDataFrame([(1, "the dog", "en"), (1, "der hund", "de"), (2, "the cat", "en"), (None, "das haus", "de"), (3, None, None)], "row_id long, text string, lang string")
    known = language.profiles(df.select("lang", "text"))
    near = language.nearest(df.select("row_id", "text"), known, "row_id")
    assert "Generate" not in plan(near)
    got = {r["row_id"]: r["detected"] for r in near.collect()}
    assert got[2] == "en" and got[None] == "de" and got[3] is None and len(got) == 4
    pooled = spark.createDataFrame([(1, "der hund the dog")], "row_id long, text string")
    assert near.where("row_id = 1").collect() == language.nearest(pooled, known, "row_id").collect()


def test_a_vocabulary_is_exact_when_bounded(spark, monkeypatch):
    monkeypatch.setattr(features, "_BITS", 16)
    monkeypatch.setattr(features, "_TEXTS", 3)
    texts = [f"alpha beta w{i % 7} w{i % 7} rare{i}x gamma{i % 3}" for i in range(60)] + [None, ""]
    has, total = Counter(), Counter()
    for t in texts:
        own = features.counted(t or "")
        has.update(own.keys())
        total.update(own)
    want = [(t, has[t]) for t in sorted((t for t in has if has[t] >= 2), key=lambda t: (-total[t], t.encode()))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for size in (3, 8, 50_000):
        assert {tuple(r) for r in features.vocabulary(df, size).collect()} == set(want[:size])


def test_a_classes_texts_are_not_gathered(spark):
    rows = [(i, "a", f"text {i}", float(i % 4)) for i in range(40)] + [(7, "a", "text 7", 3.0)]
    scored = spark.createDataFrame(rows, "cand_id long, label string, text string, score double")
    best = filters.select_scored(scored, spark.createDataFrame([("a", 12)], "label string, need long"), 1.0)
    got = [(r["cand_id"], r["rank"]) for r in best.orderBy("rank").collect()]
    assert got == [(i, k + 1) for k, i in enumerate([3, 7, 7, 11, 15, 19, 23, 27, 31, 35, 39, 2])] and best.columns == ["label", "cand_id", "text", "score", "rank"]
    judged = generation.score_texts(scored.select("cand_id", "label", "text"), scored.select("label", F.col("text").alias("examples")).limit(1), scored.select("label", F.lit("c").alias("context")).limit(1), generation.EchoGenerator, F.lit("{text}"))
    assert plan(judged).count("strategy=broadcast") == 2


def test_batches_are_cut(monkeypatch):
    monkeypatch.setattr(T, "_ROWS", 4)
    monkeypatch.setattr(T, "_BYTES", 10)
    seen = []
    out = T.by_slices(pa.array(["aaaa", None, "bb", "c", "d", "e", "x" * 30]), lambda some: seen.append(len(some)) or some, pa.string())
    assert out.to_pylist() == ["aaaa", None, "bb", "c", "d", "e", "x" * 30] and seen == [4, 2, 1]
    assert len(T.by_slices(pa.array([], pa.string()), list, pa.bool_())) == 0


def test_the_split_deals_no_texts_by_class(spark):
    df = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2]) for i in range(40)] + [(None, "none", "a"), (99, "no class", None)], "row_id long, text string, label string")
    split = quota.stratified_split(df)
    assert plan(split).count("strategy=broadcast") == 1
    assert {(r["label"], r["part"]): r["count"] for r in split.groupBy("label", "part").count().collect()} == {("a", "test"): 4, ("a", "train"): 17, ("b", "test"): 4, ("b", "train"): 16, (None, "train"): 1}


def test_bayes_is_counted_once_from_every_row(spark, monkeypatch):
    """Rows without an id, or of one id, all have a fold; the sums of the search are those of the last fit."""
    seen, whole = [], svm.class_sums
    monkeypatch.setattr(svm, "class_sums", lambda *given: seen.append(whole(*given)) or seen[-1])
    texts = [(None if i < 4 else 7 if i < 8 else i, f"{'cat meow' if i % 2 else 'dog woof'} w{i % 5}", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(texts, "row_id long, text string, label string")
    assert features.evaluate("nb", df, df, search=True, size=100).first()["macro_f1"] == 1.0
    assert len(seen) == 1
    by = seen[0][-1].sum(0)
    assert by.sum() == 40 and by[0] == 0 and by.min(initial=99, where=np.arange(4) > 0) >= 12


def test_words_of_many_texts_are_those_of_each():
    draw = np.random.default_rng(3)
    letters = list("aB_9 .\n\t-ÄßİΣς中文\u0301é\u200d𝒳😀١")
    texts = [None, "", "a", "ab", "ΑΣ ΑΣ"] + ["".join(draw.choice(letters, n)) for n in draw.integers(0, 30, 300)]
    for some in (texts, texts[::-1], ["plain words only", None], [None], []):
        words, sizes = features.worded(some)
        assert words.to_pylist() == [w for t in some for w in features._WORD.findall((t or "").lower())]
        assert sizes.tolist() == [len(features._WORD.findall((t or "").lower())) for t in some]
        at = Counter(map(tuple, np.stack(features.coded(some, features._hashed)).T.tolist()))
        hashed = dict(zip(words.dictionary.to_pylist(), features._hashed(words.dictionary).tolist(), strict=True))
        assert sum(at.values()) == sum(sum(features.counted(t or "").values()) for t in some) and all((hashed[w] << 32, i) in at for i, t in enumerate(some) for w in features._WORD.findall((t or "").lower()))


def sparse_rows(draw, n, size):
    x = np.where(draw.random((n, size)) < 0.3, draw.random((n, size)), 0)
    x[[0, n // 2, n - 1]] = 0
    lists = [[np.flatnonzero(r).tolist() for r in x], [r[r != 0].tolist() for r in x]]
    return x, pa.RecordBatch.from_arrays([pa.array(draw.integers(0, 3, n), pa.int32()), pa.array(np.arange(n) % 3, pa.int32()), pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.float64()))], names=["label", "fold", "places", "values"])


def test_products_of_blocks(monkeypatch):
    monkeypatch.setattr(svm, "LISTED", 40)
    draw = np.random.default_rng(6)
    x, batch = sparse_rows(draw, 50, 20)
    for columns in (1, 5, svm.WIDE + 1):
        w, pull = draw.normal(size=(21, columns)), np.where(draw.random((50, columns)) < np.linspace(0, 1, columns), draw.normal(size=(50, columns)), 0)
        z, total, squares, at = [], np.zeros((columns, 21)), np.zeros((columns, 21)), 0
        for b in svm.blocks([batch], 20):
            z.append(b.times(w))
            b.turned(pull[at : at + b.n], total)
            b.turned(pull[at : at + b.n], squares, 2)
            at += b.n
        one = np.hstack([x, np.ones((50, 1))])
        assert len(z) > 5 and np.allclose(np.vstack(z), one @ w) and np.allclose(total, pull.T @ one) and np.allclose(squares, pull.T @ one**2)


def test_no_model_waits_for_anothers_steps(monkeypatch):
    """All models together need about as many passes as the slowest alone, and each ends where it ends alone."""
    seen, whole = [], svm.Chunk.total
    monkeypatch.setattr(svm.Chunk, "total", lambda *given: seen.append(1) or whole(*given))
    table = pa.Table.from_batches([sparse_rows(np.random.default_rng(7), 200, 12)[1]])
    for width, models in ((1, [(k, c, left) for c in (0.01, 1.0, 30.0) for left in (-1, 1) for k in range(3)]), (3, [(k, c, 0) for c in (0.01, 1.0, 30.0) for k in range(3)])):
        alone, weights = [], []
        for i in range(0, len(models), width):
            chunk = svm.Chunk(table, 12, models[i : i + width], width)
            seen.clear()
            weights.append(svm.minimise(chunk, chunk.curvature(chunk.squares(3)), np.array([1e-6]), 500))
            alone.append(len(seen))
        chunk = svm.Chunk(table, 12, models, width)
        seen.clear()
        together = svm.minimise(chunk, chunk.curvature(chunk.squares(3)), np.full(len(models) // width, 1e-6), 500)
        assert min(alone) < len(seen) <= 1.1 * max(alone) and np.allclose(together, np.hstack(weights), atol=1e-4)


def test_few_passes(spark, monkeypatch):
    """Models of words as frequent as in texts, where few rows lie inside the margin: passes for all penalties at once."""
    seen, whole = [], svm.Passes.total
    monkeypatch.setattr(svm.Passes, "total", lambda *given: seen.append(1) or whole(*given))
    draw = np.random.default_rng(8)
    held = []
    for i in range(240):
        words = np.unique(np.append((draw.zipf(1.3, 60) - 1) % 500, 500 + 100 * (i % 3) + (draw.zipf(1.5, 12) - 1) % 100))
        value = 1 / (1 + draw.random(len(words)))
        held.append((i % 3, i // 3 % 3, words.tolist(), (value / np.linalg.norm(value)).tolist()))
    rows = spark.createDataFrame(held, "label int, fold int, places array<int>, values array<double>").repartition(2).persist()
    svm.train("svm", rows, 800, 3, [(c, -1) for c in (0.01, 1.0, 10.0, 100.0)], iterations=500)
    assert len(seen) < 120, len(seen)
