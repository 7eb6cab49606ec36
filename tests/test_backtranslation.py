"""The third stage against a plain loop, killed at every step, and tables published whole or not at all."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import backtranslation as bt
from textloom.sources import io
from textloom.sources.published import Published

ROWS = [(i, f"исходный текст номер {i} про дело{i}", "a" if i < 3 else "b" if i < 5 else "c") for i in range(14)] + [(90, "без класса", None)]
PLAN = bt.Plan(target=8, attempts=6, oversample=1, least_length=5)


class Died(RuntimeError):
    pass


def table(spark):
    return spark.createDataFrame(ROWS, "row_id long, text string, label string").repartition(3)


def steps(calls, die=None):
    """A translator whose every third text is blank and every fourth a copy, and a score; ``die`` names the call that fails."""

    def at(name):
        calls.append(name)
        if name == die:
            raise Died(name)

    def translate(slots, attempt):
        at(f"translate {attempt}")
        n = F.col("slot")
        text = F.when(n % 3 == 1, " ").when(n % 4 == 3, F.col("text")).otherwise(F.concat_ws(" ", F.lit(" перевод"), F.lit(attempt), n.cast("string"), "text"))
        return slots.withColumn("translated", text)

    def score(pairs):
        at("score")
        return pairs.withColumn("score", (F.crc32(F.col("text").cast("binary")) % 10).cast("double"))

    return translate, score


def plain():
    """The same stage in Python's own lists."""
    import hashlib
    import zlib

    out, used = [(t, x) for _, t, x in ROWS], 0
    own = {x: [(i, t) for i, t, y in ROWS if y == x] for x in "abc"}
    pool: dict = {x: [] for x in own}
    need = {x: PLAN.target - len(v) for x, v in own.items() if len(v) < PLAN.target}
    for attempt in range(1, PLAN.attempts + 1):
        gaps = {x: 2 * n - len(pool[x]) for x, n in need.items() if 2 * n > len(pool[x])}
        if not gaps:
            break
        used = attempt
        for x, gap in gaps.items():
            order = sorted(own[x], key=lambda r: (hashlib.md5(f"{42 + attempt}:{r[0]}".encode()).hexdigest(), r[0]))
            known, fresh = {t.lower() for _, t in own[x]} | {t.lower() for t, _ in pool[x]}, []
            for slot in range(gap):
                text = order[slot % len(order)][1]
                made = " " if slot % 3 == 1 else text if slot % 4 == 3 else f"перевод {attempt} {slot} {text}"
                if made.strip() and made.lower() not in known:
                    known.add(made.lower())
                    fresh.append((made, zlib.crc32(made.encode()) % 10))
            pool[x] += fresh
    for x, n in need.items():
        best = sorted((p for p in pool[x] if p[1] >= PLAN.least_score), key=lambda p: -p[1])[:n]
        out += [(t, x) for t, _ in best]
    return sorted(out, key=repr), used


def rows(df):
    return sorted([(r["text"], r["label"]) for r in df.collect()], key=repr)


def test_against_lists_and_killed_at_every_step(spark, tmp_path):
    want, used = plain()
    calls: list = []
    io.save_stage(table(spark), str(tmp_path / "whole"), 2)
    got = bt.run_stage(spark, str(tmp_path / "whole"), PLAN, *steps(calls))
    assert rows(got) == want and calls == [*(f"translate {i}" for i in range(1, used + 1)), "score"] and used > 1
    again: list = []
    assert rows(bt.run_stage(spark, str(tmp_path / "whole"), bt.Plan(target=3), *steps(again))) == want and not again
    root = str(tmp_path / "killed")
    io.save_stage(table(spark), root, 2)
    made: list = []
    for name in calls:
        with pytest.raises(Died):
            bt.run_stage(spark, root, PLAN, *steps(made, die=name))
        assert io.load_stage(spark, root, 3)[1] == 2
    assert rows(bt.run_stage(spark, root, PLAN, *steps(made))) == want
    # What was published was not made again: each step ran once and died once.
    assert sorted(made) == sorted(calls * 2) and io.load_stage(spark, root, 3)[1] == 3
    assert not io.exists(spark, f"{root}/pairs-after-2") and io.exists(spark, f"{root}/pairs-after-2.bak")


def test_a_checkpoint_that_lacks_rows_is_gone_on_from(spark, tmp_path):
    root = str(tmp_path)
    io.save_stage(table(spark), root, 2)
    with pytest.raises(Died):
        bt.run_stage(spark, root, PLAN, *steps([], die="score"))
    io.save_stage(table(spark).where("row_id <> 4"), root, 3)
    got = {r["label"]: r["count"] for r in bt.run_stage(spark, root, PLAN, *steps([])).groupBy("label").count().collect()}
    assert got[None] == 1 and got["b"] > 2 and got["c"] == 9


def test_copies_come_back_by_text(spark, tmp_path):
    data = spark.createDataFrame([(1, "один два три", "a"), (2, "один два три", "a")], "row_id long, text string, label string")
    same = lambda slots, attempt: slots.withColumn("translated", F.lit(f"новый текст {attempt}"))
    score = lambda pairs: pairs.withColumn("score", F.lit(9.0))
    for by_text, n in ((False, 4), (True, 5)):
        plan = bt.Plan(target=5, attempts=2, oversample=1, least_length=1, by_text=by_text)
        assert bt.augment_by_pairs(data, plan, Published(spark, f"{tmp_path}/{by_text}"), same, score).count() == n


def test_published_tables(spark, tmp_path):
    store = Published(spark, f"{tmp_path}/p")
    assert store.read("k") is None and store.keys() == []
    one, two = spark.range(3), spark.range(5)
    assert store.commit("k", one).count() == 3 and store.commit("k", two).count() == 3
    held = store.read("k")
    assert store.commit("k", two, replace=True).count() == 5 and held.count() == 3
    failing = spark.range(4).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        store.commit("k", failing, replace=True)
    assert store.read("k").count() == 5 and store.keys() == ["k"]
    # A stage made from its own older version, and one whose writing fails.
    root = f"{tmp_path}/s"
    io.save_stage(table(spark), root, 1)
    io.save_stage(io.load_stage(spark, root, 1)[0].where("row_id < 4"), root, 1)
    with pytest.raises(Exception, match="no"):
        io.save_stage(table(spark).withColumn("text", F.raise_error(F.lit("no"))), root, 1)
    assert io.load_stage(spark, root, 3)[0].count() == 4
