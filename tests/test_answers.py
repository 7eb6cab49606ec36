"""Answers kept by content: calls are counted in a file that the model's stand-in appends to."""

from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st

from textloom.operators import answers
from textloom.sources.published import Published


def model(log: Path):
    class Logged:
        def __init__(self, mark=""):
            self.mark = mark

        def generate(self, prompts):
            with log.open("a") as f:
                f.writelines(f"{p}\n" for p in prompts)
            if any("bad" in p for p in prompts):
                raise RuntimeError("a prompt that fails")
            return [" " if p == "blank" else p.upper() + self.mark for p in prompts]

    return Logged


def calls(log: Path) -> Counter:
    return Counter(log.read_text().splitlines()) if log.exists() else Counter()


def test_equal_prompts_are_asked_once(spark, tmp_path):
    log = tmp_path / "calls"
    df = spark.createDataFrame([(i, p, "old") for i, p in enumerate(["a", "b", "a", None, "", "blank", "long " * 100_000] + ["hot"] * 200)], "row_id long, prompt string, answer string")
    store = answers.Answers(spark, str(tmp_path / "s"), model(log), "m")
    store.ask(df, "one")
    assert set(calls(log).values()) == {1} and len(calls(log)) == 6
    store.ask(df.unionByName(spark.createDataFrame([(900, "new", "")], df.schema)), "two")
    assert calls(log)["new"] == 1 and set(calls(log).values()) == {1}
    got = {r["row_id"]: (r["answer"], r["by"]) for r in store.add(df, made_by="by").collect()}
    assert len(got) == df.count() and got[0] == got[2] == ("A", "one") and got[3] == (None, None) and got[4] == got[5] == (None, "one")
    assert got[6] == ("LONG " * 100_000, "one") and got[150] == ("HOT", "one")


def test_failures_are_tried_again_row_by_row(spark, tmp_path):
    log = tmp_path / "calls"
    df = spark.createDataFrame([(p,) for p in ["x", "bad one", "y", "z"]], "prompt string").coalesce(1)
    store = answers.Answers(spark, str(tmp_path / "s"), model(log), "m")
    store.ask(df, "one", tries=2)
    assert {r["prompt"]: r["answer"] for r in store.add(df).collect()} == {"x": "X", "bad one": None, "y": "Y", "z": "Z"}
    first = calls(log)
    store.ask(df, "two", tries=1)
    assert {p: n for p, n in (calls(log) - first).items()} == {"bad one": 1}


def test_sampling_and_model_are_part_of_the_key(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "prompt string")
    for sampling, want in (({"mark": "?"}, "A?"), ({"mark": "!"}, "A!"), (None, "A")):
        store = answers.Answers(spark, str(tmp_path / "s"), model(tmp_path / "calls"), "m", sampling)
        store.ask(df, "one")
        assert store.add(df).first()["answer"] == want
    assert answers.Answers(spark, str(tmp_path / "s"), model(tmp_path / "calls"), "other").add(df).first()["answer"] is None


def test_a_killed_run_goes_on_behind_its_last_slice(spark, tmp_path, monkeypatch):
    log = tmp_path / "calls"
    df = spark.createDataFrame([(i, f"prompt {i}") for i in range(60)], "row_id long, prompt string")
    store, commit, done = answers.Answers(spark, str(tmp_path / "s"), model(log), "m"), Published.commit, []

    def dying(self, key, table, **given):
        if len(done) == 3:
            raise KeyboardInterrupt
        done.append(key)
        return commit(self, key, table, **given)

    monkeypatch.setattr(Published, "commit", dying)
    with pytest.raises(KeyboardInterrupt):
        store.ask(df, "one")
    before = calls(log)
    assert 0 < len(before) < 60
    monkeypatch.setattr(Published, "commit", commit)
    store.ask(df, "two")
    assert set(calls(log).values()) == {1} and len(calls(log)) == 60
    assert {r["row_id"]: r["answer"] for r in store.add(df).collect()} == {i: f"PROMPT {i}" for i in range(60)}


def test_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "prompt string")
    store = answers.Answers(spark, str(tmp_path / "s"), model(tmp_path / "calls"), "m")
    store.ask(df, "one")
    assert store.add(df).count() == 0 and not calls(tmp_path / "calls")


@given(st.lists(st.integers(0, 50), max_size=60))
def test_batches_cover_all_and_fit(lengths):
    got = list(answers.batches(lengths, rows=7, width=100))
    assert [i for a, b in got for i in range(a, b)] == list(range(len(lengths)))
    assert all(b - a <= 7 and (b - a == 1 or max(lengths[a:b]) * (b - a) <= 100) for a, b in got)
