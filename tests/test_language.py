"""Languages by n-gram ranks against counting by hand, and vectors against numpy's decomposition."""

from collections import Counter

import numpy as np
import pytest

from textloom.operators import embedding, filters, language

ROWS = [(0, "der hund und die katze", "de"), (1, "the dog and the cat", "en"), (2, "und der", "de"), (3, "the and of", None), (4, "12 !?", None), (5, None, "en"), (6, "", None), (7, "漢字", None)]


def by_hand(texts):
    n = Counter()
    for t in texts:
        for w in (t or "").split():
            if w.isalpha():
                w = f"_{w.lower()}_"
                n.update(w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1) if w[i : i + k] != "_")
    return {g: i + 1 for i, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[: language.KEPT])}


@pytest.mark.parametrize("kept", [300, 9])
def test_nearest_language(spark, monkeypatch, kept):
    monkeypatch.setattr(language, "KEPT", kept)
    df = spark.createDataFrame(ROWS, "row_id long, text string, lang string")
    known = language.profiles(df.select("lang", "text"))
    plain = {k: by_hand([t for _, t, lang in ROWS if lang == k]) for k in ("de", "en")}
    assert {(r["lang"], r["gram"]): r["place"] for r in known.collect()} == {(k, g): i for k, p in plain.items() for g, i in p.items()}
    got = {r["row_id"]: (r["detected"], r["distance"]) for r in language.nearest(df.select("row_id", "text"), known, "row_id").collect()}
    for i, text, _ in ROWS:
        own = by_hand([text])
        far = [(sum(abs(p - of[g]) if g in of else kept for g, p in own.items()), k) for k, of in plain.items() if set(of) & set(own)]
        assert got[i] == ((min(far)[1], min(far)[0]) if far else (None, None)), i
    assert got[3][0] == "en" and got[4] == got[5] == got[7] == (None, None)


def test_singular_vectors(spark):
    draw = np.random.default_rng(4)
    x = np.where(draw.random((60, 20)) < 0.4, draw.random((60, 20)), 0) * np.linspace(3, 0.1, 20)
    rows = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in x], "places array<int>, values array<double>")
    values, basis = embedding.singular(rows, 20, 5)
    want = np.linalg.svd(x)
    assert np.allclose(values, want[1][:5], rtol=1e-4) and np.allclose(np.abs((basis * want[2][:5].T).sum(0)), 1, atol=1e-2)
    values, basis = embedding.singular(rows.limit(0), 20, 3)
    assert np.allclose(values, 0) and basis.shape == (20, 3)


def test_validation_with_language_and_vectors(spark):
    en = [f"the quick dog number {i % 4} and the lazy cat went over hill {i}" for i in range(12)]
    existing = spark.createDataFrame([(t, "a") for t in en], "text string, label string")
    asked = [*en[:2], "the quick dog number 2 and the lazy cat went over hill 99", "der hund und die katze gehen mit dem mann und der frau", "the cat and the dog of the town", None]
    candidates = spark.createDataFrame([(i, "a", t) for i, t in enumerate(asked)], "cand_id long, label string, text string")
    taught = spark.createDataFrame([(t, "en") for t in en] + [("der hund und die katze gehen mit dem mann und der frau nach haus", "de"), ("das ist nicht der weg", "de")], "text string, lang string")
    given = {"least": 5, "wanted": "en", "known": language.profiles(taught)}
    assert sorted(r["cand_id"] for r in filters.validate(candidates, existing, **given).collect()) == [2, 4]
    embed = embedding.embedder(existing, k=4)
    made = {r["cand_id"]: np.array(r["embedding"]) for r in embed(candidates).collect()}
    assert not made[5].any() and len(made[5]) == 4
    held = np.array([r["embedding"] for r in embed(existing).collect()])
    near = {i: (held @ made[i] / np.linalg.norm(held, axis=1) / max(np.linalg.norm(made[i]), 1e-12)).max() for i in (2, 4)}
    got = filters.validate(candidates, existing, embed=embed, keep=lambda table, _: table.persist(), **given).collect()
    assert sorted(r["cand_id"] for r in got) == sorted(i for i in (2, 4) if 0.5 <= near[i] < 0.95)
