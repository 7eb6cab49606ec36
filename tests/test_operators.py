import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import dedup, features, filters, generation, metrics, quota
from textloom.sources import io


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, text string, label string")


def ids(df, c="row_id"):
    return sorted(r[c] for r in df.collect())


def test_dedup(spark):
    t = table(spark, [(3, "a", "x"), (1, "a", "x"), (2, "a", "z"), (4, "b", "z"), (5, None, None), (6, None, None)])
    assert ids(dedup.exact_dedup(t, ["text", "label"])) == [1, 2, 4, 5]
    assert ids(dedup.cross_label_dedup(t.where("text is not null"), "z")) == [1, 3, 4]
    assert ids(dedup.cross_label_dedup(t.where("text is not null"), "other")) == [1, 2, 3, 4]


@pytest.mark.parametrize(("total", "unique", "kept"), [(201, 49, False), (201, 50, True), (200, 49, True)])
def test_anomalous(spark, total, unique, kept):
    t = table(spark, [(1, " ".join(f"w{min(i, unique - 1)}" for i in range(total)), "x")])
    assert (dedup.remove_anomalous(t).count() == 1) == kept


@pytest.mark.parametrize(("n", "tests"), [(1, 0), (2, 1), (5, 1), (9, 1), (10, 2), (15, 3), (35, 7), (200, 40)])
def test_split(spark, n, tests):
    t = table(spark, [(i, f"t{i}", "x") for i in range(n)])
    s = quota.stratified_split(t)
    assert s.where("part = 'test'").count() == tests and s.count() == n
    if n == 1:
        assert quota.stratified_split(t, keep_singletons=False).where("part = 'test'").count() == 1


def test_quota(spark):
    t = table(spark, [(i, "t", "a") for i in range(14)] + [(20 + i, "t", "b") for i in range(15)])
    assert [(r["label"], r["need"]) for r in quota.need(t, 0, 15, 15).collect()] == [("a", 1)]
    slots = quota.round_robin(t.where("label = 'a'").limit(3), spark.createDataFrame([("a", 7)], "label string, need long"))
    used = sorted(r["count"] for r in slots.groupBy("row_id").count().collect())
    assert used == [2, 2, 3] and ids(slots, "slot") == list(range(7))


def test_filters(spark):
    c = F.col("text")

    def keeps(rule, value):
        return spark.createDataFrame([(value,)], "text string").where(rule(c)).count() == 1

    assert not keeps(filters.long_enough, " " + "x" * 499) and keeps(filters.long_enough, "x" * 500)
    assert keeps(filters.varied, "a a") and keeps(filters.varied, "a a a a b c d e f g") and not keeps(filters.varied, " ".join(["a"] * 6))
    assert not keeps(filters.not_stuck, "один два три один два три один два три") and keeps(filters.not_stuck, "один два три один два три")
    assert not keeps(filters.no_foreign_script, "абв 漢")
    assert not keeps(filters.no_prompt_leak, "x\n## Заголовок") and not keeps(filters.no_prompt_leak, "[НАЗВАНИЕ_КО]") and keeps(filters.no_prompt_leak, "# x")
    assert not keeps(filters.no_prompt_leak, "Конечно, вот") and keeps(filters.no_prompt_leak, "x" * 151 + "конечно,")


def test_stuck_guard_against_the_regex():
    draw = random.Random(3)
    for _ in range(3000):
        w = [draw.choice(["a", "b", "ab", "abc", "c"]) for _ in range(draw.randint(0, 5))]
        t = " ".join([draw.choice("ab")] + w * draw.randint(1, 4) + [draw.choice(["a", "abc"])]) + draw.choice(["", ".", " x"])
        assert filters.stuck(t) == (filters.STUCK.search(t) is not None), t


def test_similarity_bounds(spark):
    old = spark.createDataFrame([("x", [1.0, 0.0])], "label string, embedding array<double>")
    cos = [0.95, 0.949, 0.5, 0.499]
    new = spark.createDataFrame([(i, "x", [s, (1 - s * s) ** 0.5]) for i, s in enumerate(cos)] + [(9, "y", [1.0, 0.0])], "cand_id long, label string, embedding array<double>")
    kept = filters.max_similarity(new, old).withColumn("s", F.round("similarity", 9)).where("s >= 0.5 and s < 0.95")
    assert ids(kept, "cand_id") == [1, 2]
    assert 9 in ids(filters.filter_by_similarity(new, old), "cand_id")


def test_schedule_and_selection(spark):
    t = spark.createDataFrame([(i,) for i in range(1, 7)], "a int").select(filters.similarity_threshold(F.col("a")).alias("t"))
    assert [r["t"] for r in t.collect()] == [0.95, 0.95, 0.96, 0.97, 0.98, 0.98]
    scored = spark.createDataFrame([(1, "x", 5.0), (2, "x", 9.0), (3, "x", 4.0), (4, "x", 9.0)], "cand_id long, label string, score double")
    assert ids(filters.select_scored(scored, spark.createDataFrame([("x", 2)], "label string, need long")), "cand_id") == [2, 4]


def test_pairs_with_equal_candidates(spark):
    pairs = spark.createDataFrame([(1, "x", "t"), (2, "x", "t")], "cand_id long, label string, text string")
    left = filters.new_against(pairs, spark.createDataFrame([("x", "other")], "label string, text string"))
    assert ids(filters.restore_pairs(pairs, left), "cand_id") == [1] and ids(filters.restore_pairs(pairs, left, by_text=True), "cand_id") == [1, 2]


def test_metrics(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "d")], "label string, prediction string")
    got = {r["label"]: r for r in metrics.report(p).collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["support"]) == (0.5, 0.5, 2) and got["c"]["f1"] == 0 and got["d"]["support"] == 0
    s = metrics.summary(p).first()
    assert s["balanced_accuracy"] == pytest.approx(0.5) and s["macro_f1"] == pytest.approx((0.5 + 2 / 3) / 4)


def test_classifiers_learn(spark):
    rows = [(i, f"{'кот мяу лапа' if i % 2 else 'пес гав хвост'} слово{i % 5}", "cat" if i % 2 else "dog") for i in range(24)]
    t = quota.stratified_split(table(spark, rows))
    for kind in ("svm", "logreg", "nb"):
        assert features.evaluate(kind, t.where("part = 'train'"), t.where("part = 'test'"), size=100, iterations=5).first()["macro_f1"] == 1.0
    with pytest.raises(ValueError):
        features.classifier("none", 1)


def test_classifier_queries_do_the_whole_job(spark, monkeypatch):
    from textloom.plans import queries

    asked = {}
    monkeypatch.setattr(queries, "_labelled", lambda spark, d: spark.createDataFrame([], "part string"))
    monkeypatch.setattr(features, "evaluate", lambda kind, train, test, **given: asked.__setitem__(kind, given))
    for kind in ("svm", "logreg", "nb"):
        queries.QUERIES[kind](spark, "")
    assert all(x["search"] and x.get("size", 50_000) == 50_000 for x in asked.values())
    assert asked["svm"]["iterations"] == 10_000 and asked["logreg"]["iterations"] == 1000


def test_generation(spark):
    class Broken:
        def generate(self, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [p + "!" for p in prompts]

    got = generation.run_generator(spark.createDataFrame([("a",), ("bad",)], "prompt string").coalesce(1), Broken).collect()
    assert sorted((r["prompt"], r["answer"]) for r in got) == [("a", "a!"), ("bad", None)]
    back = generation.back_translate(spark.createDataFrame([(" x [PERSON] y ",)], "text string"), generation.EchoTranslator).first()
    assert back["back_translated"] == "x [PERSON] y"
    judged = generation.judge(spark.createDataFrame([("score 8",), ("nothing",)], "prompt string"), Broken).collect()
    assert sorted((r["score"], r["parse_ok"]) for r in judged) == [(5.0, False), (8.0, True)]


def test_augment_meets_quota(spark):
    data = table(spark, [(i, f"one two three four {i} " + "word%d " % i * 3, "a" if i < 3 else "b") for i in range(12)])
    propose = lambda slots, attempt: slots.select(F.xxhash64("label", "slot").alias("cand_id"), "label", F.concat_ws(" ", F.lit("new"), F.lit(attempt), "slot", "text").alias("text"))
    out = generation.augment(data, generation.Stage(target=6, least_length=5), propose, lambda d: d.withColumn("score", F.lit(9.0)), lambda d, n: d.persist())
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"a": 6, "b": 9}


def test_csv_keeps_blanks_empty_texts_and_nulls(spark, tmp_path):
    draw = random.Random(3)
    texts = [None, "", " ", "a ", "\ta", "\n", "a\r", '"', '" ', "\0", '"\0"', "null"] + ["".join(draw.choices(['"', ",", "\n", "\r\n", " ", "\t", "\0", "#", "\\", "\ufeff", "я"], k=draw.randint(1, 9))) for _ in range(400)]
    rows = [(t, texts[-i]) for i, t in enumerate(texts)]
    io.write_csv(spark.createDataFrame(rows, io.TABLE).select("label", "text"), str(tmp_path / "c"))
    assert sorted(map(repr, map(tuple, io.read_csv(spark, str(tmp_path / "c")).collect()))) == sorted(map(repr, rows))


def test_sources(spark, tmp_path):
    rows = [(1, 'a "q"\nline, two', "x"), (2, "b", "y")]
    t = table(spark, rows)
    io.write_csv(t.select("text", "label"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in io.read_csv(spark, str(tmp_path / "c")).collect()) == sorted((r[1], r[2]) for r in rows)
    (tmp_path / "raw.json").write_text('[{"text": "a", "label": "x", "idx": 1}, {"text": null, "label": "y"}]')
    assert io.read_raw_json(spark, str(tmp_path / "raw.json")).columns == ["text", "label"]
    root = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        io.load_stage(spark, root, 2)
    io.save_split(quota.stratified_split(t), root)
    io.save_stage(t, root, 1)
    assert io.load_stage(spark, root, 3)[1] == 1 and io.load_stage(spark, root, 0)[1] == 0 and io.load_test(spark, root).count() == 0
    for bad in (lambda: io.load_stage(spark, root, 7), lambda: io.save_stage(t, root, 0)):
        with pytest.raises(ValueError):
            bad()
    cache = io.PairCache(spark, root)
    cache.append(spark.createDataFrame([("x", "t", "o"), ("y", "t", "o")], io.PAIRS))
    assert cache.read(spark.createDataFrame([("x",)], "label string")).count() == 1
    assert cache.retire().endswith(".bak") and cache.read(t).count() == 0
    with pytest.raises(KeyError):
        io.check_columns(t.select("text"), "p")


def test_empty_tables(spark):
    t = table(spark, [])
    assert dedup.clean_table(t, "x").count() == 0 and quota.stratified_split(t).count() == 0 and metrics.report(spark.createDataFrame([], "label string, prediction string")).count() == 0


def test_rounds_with_pairs_and_a_cache(spark, tmp_path):
    data = table(spark, [(i, f"one two three four {i} " + "word%d " % i * 3, "a" if i < 3 else "b") for i in range(12)])

    def propose(slots, attempt):
        return slots.select(F.xxhash64("label", "slot").alias("cand_id"), "label", F.concat_ws(" ", F.lit("new"), F.lit(attempt), "slot", "text").alias("text"), F.col("text").alias("original"))

    cache = io.PairCache(spark, str(tmp_path / "pairs"))
    cache.append(spark.createDataFrame([("a", "kept of an earlier run", "x"), ("zz", "of no needy class", "x")], io.PAIRS))
    calls = []

    def on_pairs(pairs):
        calls.append(pairs.count())
        cache.append(pairs)

    stage = generation.Stage(target=6, least_length=5, schedule=False)
    out = generation.augment(data, stage, propose, lambda d: d.withColumn("score", F.lit(9.0)), lambda d, n: d.persist(), on_pairs=on_pairs, cached=cache.read(data.where("label = 'a'").select("label")))
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"a": 6, "b": 9}
    assert "kept of an earlier run" in {r["text"] for r in out.collect()} and "of no needy class" not in {r["text"] for r in out.collect()}
    assert calls == [2] and cache.read(data.select("label")).count() == 3


def test_ranks_equal_one_window(spark):
    from pyspark.sql import Window

    t = table(spark, [(i, "t", "hot" if i % 10 else f"c{i}") for i in range(5000)])
    got = quota.seeded_rank(t, ["label"], quota.seeded(42, "row_id"))
    plain = t.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(quota.seeded(42, "row_id"), "row_id")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_features_of_the_same_terms(spark):
    texts = ["Кот и пес, кот", "", None, "a bb_1 bb_1 ß ½ ²", "İstanbul ǅ ΑΣ"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    for r in df.withColumn("t", features.terms(F.col("text"))).collect():
        assert sorted(features.counted(r["text"] or "").elements()) == sorted(r["t"] or [])


def test_small_operators(spark, tmp_path):
    assert generation.generate_text(lambda: generation.EchoGenerator(), "a b") in ("a b", "b a") and generation.generate_text(lambda: generation.EchoGenerator(), " ") is None
    (tmp_path / "c.json").write_text('{"gpu_profiles": {"L4": {"x": 1}}, "pipeline": {}}')
    assert io.load_pipeline_config(tmp_path / "c.json", "l4").gpu == {"x": 1}
    with pytest.raises(ValueError):
        io.load_pipeline_config(tmp_path / "c.json", "none")
    (tmp_path / "m.json").write_text('{"model_name": "m"}')
    with pytest.raises(KeyError):
        io.load_model_config(tmp_path / "m.json")
    (tmp_path / "p.txt").write_text(" hi \n")
    assert io.load_prompt_template("p", tmp_path) == "hi"
    with pytest.raises(FileNotFoundError):
        io.load_prompt(tmp_path / "none.txt")
