"""Queries over the synthetic tables, one for each operator, and the SQL that says what they return.

``documents`` stands for the labelled table: row_id is doc_id, the label is source (or lang).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import answers, backtranslation, dedup, embedding, features, filters, generation, language, metrics, quota
from textloom.sources import io

DROPPED = "src0"


def documents(spark: SparkSession, d: str, label: str = "source") -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text", F.col(label).alias("label"))


def _scalar(rule: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: documents(spark, d).select("row_id", rule(F.col("text")).alias("text"))


def _odd(spark: SparkSession, d: str, label: str = "source") -> DataFrame:
    """Every document with something of its own that the rules are about, by its id: lists, attachments, blanks, other scripts."""
    text, n = F.col("text"), F.col("row_id") % 6
    own = (
        F.when(n == 0, F.concat(text, F.lit(" дело-1, дело-2, дело-3 дело-4, дело-5, дело-66 конец")))
        .when(n == 1, F.concat(F.repeat(text, F.lit(3)), F.lit(" Публичная оферта "), text))
        .when(n == 2, F.concat(F.replace(text, F.lit(" "), F.lit(" \t ")), F.lit("\n \n\n"), text))
        .when(n == 3, F.concat(text, F.lit(" 漢字 かな")))
        .when(n == 4, F.lit(" \n\t "))
        .otherwise(F.concat(F.lit("Конечно, вот письмо работа работа РАБОТА. [НАЗВАНИЕ_КО] "), text))
    )
    return documents(spark, d, label).withColumn("text", own)


def _odd_scalar(rule: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _odd(spark, d).select("row_id", rule(F.col("text")).alias("text"))


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Existing rows: English documents; candidates: all documents, as a generator would hand them in."""
    all_ = spark.read.parquet(f"{d}/documents.parquet")
    existing = all_.where("lang = 'en'").select("text", F.col("source").alias("label"))
    return all_.select(F.col("doc_id").alias("cand_id"), F.col("source").alias("label"), "text"), existing


def clean_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole cleaning driver."""
    return dedup.clean_table(documents(spark, d), DROPPED)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Line dedup, exact dedup, anomalies, empties, rows by label."""
    table = documents(spark, d).withColumn("text", T.remove_duplicate_lines(F.col("text")))
    kept = dedup.remove_empty(dedup.remove_anomalous(dedup.exact_dedup(table, ["text", "label"])))
    return kept.groupBy("label").agg(F.count("*").alias("n"))


def exact_dedup(spark, d):
    return dedup.exact_dedup(documents(spark, d), ["text", "label"]).select("row_id")


def cross_label_dedup(spark, d):
    return dedup.cross_label_dedup(documents(spark, d), DROPPED).select("row_id")


def anomalous_texts(spark, d):
    return dedup.remove_anomalous(documents(spark, d)).select("row_id")


def empty_filter(spark, d):
    return dedup.remove_empty(_odd(spark, d)).select("row_id")


def class_distribution(spark, d):
    return quota.distribution(documents(spark, d, "lang"))


def classes_to_augment(spark, d):
    return quota.classes_to_augment(documents(spark, d, "lang"), 0, 150)


def need_per_class(spark, d):
    docs = documents(spark, d, "lang")
    return quota.need(docs, 0, 200, 200, docs.where("length(text) >= 1000"))


def stratified_split(spark, d):
    return quota.stratified_split(documents(spark, d)).select("row_id", "label", "part")


def train_test_counts(spark, d):
    split = quota.stratified_split(documents(spark, d))
    return quota.split_counts(split.where("part = 'train'"), split.where("part = 'test'"))


def threshold_counts(spark, d):
    return quota.thresholds(documents(spark, d, "lang"), [15, 35, 150])


def report_markers(spark, d):
    return quota.marked(documents(spark, d, "lang"), 140)


def prompt_examples(spark, d):
    return quota.examples(documents(spark, d))


def dedup_vs_existing(spark, d):
    return filters.new_against(*_candidates(spark, d)).select("cand_id", "label")


def short_filter(spark, d):
    return documents(spark, d).where(filters.long_enough(F.col("text"))).select("row_id")


def language_filter(spark, d):
    detect = lambda t: "other" if set("éèêçàùäöüßñóíá") & set(t.lower()) else "en"
    return documents(spark, d).where(filters.in_language(F.col("text"), detect, "en")).select("row_id")


def degenerate_ratio(spark, d):
    return documents(spark, d).where(filters.varied(F.col("text"))).select("row_id")


def degenerate_phrase(spark, d):
    return documents(spark, d).where(filters.not_stuck(F.col("text"))).select("row_id")


def foreign_scripts(spark, d):
    return _odd(spark, d).where(filters.no_foreign_script(F.col("text"))).select("row_id")


def prompt_leak(spark, d):
    return _odd(spark, d).where(filters.no_prompt_leak(F.col("text"))).select("row_id")


def cosine_filter(spark, d):
    # Two roles in one table: vectors 0, 5, 10, ... are the candidates, the others what the class has.
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    found = filters.filter_by_similarity(v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("cand_id"), "label", "embedding"), v.where("vec_id % 5 <> 0").select("label", "embedding"), 0.35, 0.2, _keep(spark, "cosine"))
    return found.select("cand_id", F.round("similarity", 6).alias("similarity"))


def validation_chain(spark, d):
    return filters.validate(*_candidates(spark, d), least=500).select("cand_id", "label")


def language_profiles(spark, d):
    """Every document's nearest language by n-gram ranks; the profiles are all documents' own."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text", "lang")
    return language.nearest(docs.select("row_id", "text"), language.profiles(docs), "row_id")


def validation_whole(spark, d):
    """All seven steps: English by n-gram ranks, and similarity by vectors from what the class has: here, its shorter documents."""
    candidates, _ = _candidates(spark, d)
    existing = candidates.where("length(text) < 1500").select("text", "label")
    known = language.profiles(spark.read.parquet(f"{d}/documents.parquet").select("text", "lang"))
    return filters.validate(candidates, existing, least=500, wanted="en", known=known, embed=embedding.embedder(existing), keep=_keep(spark, "validation")).select("cand_id", "label")


def similarity_schedule(spark, d):
    return documents(spark, d).select("row_id", filters.similarity_threshold((F.col("row_id") % 8 + 1).cast("int")).alias("threshold"))


def _answers(spark, d):
    return documents(spark, d).select("row_id", "label", F.concat(F.lit("Оценка: "), (F.col("row_id") % 14).cast("string"), F.element_at(F.array(F.lit("/10"), F.lit("балл"), F.lit(" из 10"), F.lit(".5")), (F.col("row_id") % 4 + 1).cast("int"))).alias("answer"))


def parse_score(spark, d):
    return _answers(spark, d).select("row_id", T.parse_score(F.col("answer")).alias("score"))


def _scored(spark, d):
    return _answers(spark, d).select(F.col("row_id").alias("cand_id"), "label", T.parse_score(F.col("answer")).alias("score"))


def _needs(spark, d):
    return quota.need(documents(spark, d), 0, 1 << 62, 0).select("label", F.lit(7).cast("long").alias("need"))


def judge_topk(spark, d):
    return filters.select_scored(_scored(spark, d), _needs(spark, d), 5.0).select("cand_id", "label", "score", F.col("rank").cast("int").alias("rank"))


def judge_topk_pairs(spark, d):
    return filters.select_scored(_scored(spark, d), _needs(spark, d), 2.5).select("cand_id", "label", "score", F.col("rank").cast("int").alias("rank"))


def mean_scores(spark, d):
    scored = _scored(spark, d)
    out = filters.score_means(scored, filters.select_scored(scored, _needs(spark, d)))
    return out.select("label", F.round("mean_all", 6).alias("mean_all"), F.round("mean_selected", 6).alias("mean_selected"))


def round_robin_sources(spark, d):
    docs = documents(spark, d, "lang")
    sizes = quota.need(docs, 0, 1 << 62, 0).select("label", (F.col("n") * 2 + 3).alias("need"))
    return quota.round_robin(docs, sizes)


def round_robin_reshuffled(spark, d):
    docs = documents(spark, d, "lang")
    sizes = quota.need(docs, 0, 1 << 62, 0).select("label", (F.col("n") * 2 + 3).alias("need"))
    return quota.round_robin(docs, sizes, reshuffle=True)


def _placeheld(spark, d):
    return documents(spark, d).select("row_id", F.concat(F.lit("From [PERSON] at [ORGANIZATION]: "), F.substring("text", 1, 1 << 30), F.lit(" on [DATE_TIME] [PERSON]")).alias("text"))


def mask_placeholders(spark, d):
    m = T.mask_placeholders(F.col("text"))
    return _placeheld(spark, d).select("row_id", m["masked"].alias("masked"), F.array_join(m["found"], "|").alias("found"))


def unmask_placeholders(spark, d):
    m = T.mask_placeholders(F.col("text"))
    masked = _placeheld(spark, d).select("row_id", m["masked"].alias("masked"), m["found"].alias("found"))
    return masked.select("row_id", T.unmask_placeholders(F.replace(F.col("masked"), F.lit("<1>"), F.lit("")), F.col("found")).alias("text"))


def first_paragraph(spark, d):
    return documents(spark, d).select("row_id", T.first_paragraph(F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n"))).alias("text"))


def fill_prompt(spark, d):
    filled = T.fill_template(F.lit("Класс {class_name}:\n{text}\nЕще {class_name}."), {"class_name": F.col("label"), "text": F.col("text")})
    return documents(spark, d).select("row_id", filled.alias("prompt"))


def pair_semi_join(spark, d):
    cands, existing = _candidates(spark, d)
    return filters.restore_pairs(cands, filters.new_against(cands, existing)).select("cand_id")


def pair_restore_by_text(spark, d):
    cands, existing = _candidates(spark, d)
    return filters.restore_pairs(cands, filters.new_against(cands, existing), by_text=True).select("cand_id")


def union_stages(spark, d):
    docs = documents(spark, d)
    return docs.withColumn("stage", F.lit(0)).unionByName(docs.where("length(text) < 500").withColumn("stage", F.lit(1))).groupBy("stage", "label").agg(F.count("*").alias("n"))


def _predicted(spark, d):
    wrong = F.when(F.col("row_id") % 7 == 0, "en").when(F.col("row_id") % 11 == 0, "xx").otherwise(F.col("label"))
    return documents(spark, d, "lang").select("label", wrong.alias("prediction"))


def confusion(spark, d):
    return metrics.confusion(_predicted(spark, d))


def class_report(spark, d):
    return metrics.report(_predicted(spark, d)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def balanced_accuracy(spark, d):
    return metrics.summary(_predicted(spark, d)).select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


def macro_f1(spark, d):
    return metrics.summary(_predicted(spark, d)).select(F.round("macro_f1", 6).alias("macro_f1"))


def delta_table(spark, d):
    both = _predicted(spark, d)
    stages = [metrics.summary(x).select(F.lit(s).alias("stage"), F.lit("m").alias("model"), "balanced_accuracy", "macro_f1") for s, x in (("baseline", both), ("augmented", both.withColumn("prediction", F.when(F.col("prediction") == "xx", F.col("label")).otherwise(F.col("prediction")))))]
    return metrics.delta(stages[0].unionByName(stages[1]))


def label_index(spark, d):
    docs = documents(spark, d)
    return features.index_labels(docs).transform(docs).select("row_id", F.col("label_index").cast("int").alias("label_index"))


def cv_folds(spark, d):
    return features.folds(documents(spark, d)).select("row_id", "fold")


def tfidf_weights(spark, d):
    docs = documents(spark, d)
    out = features.tfidf(docs, features.vocabulary(docs), docs.count())
    return out.select("row_id", "term", F.round("weight", 6).alias("weight"))


class Reverse:
    """A stand-in for a model: the prompt backwards. It fails on prompts of a multiple of 7 characters and has no answer to those of 5."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        if any(len(p) % 7 == 0 for p in prompts):
            raise RuntimeError("a prompt that fails")
        return [None if len(p) % 5 == 0 else p[::-1] for p in prompts]


class Length:
    """A judge's stand-in: the prompt's length, to the base of 12, out of ten."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        return [f"Оценка {len(p) % 12}/10" for p in prompts]


class Shift:
    """A translator's stand-in: a mark for each direction."""

    def translate(self, texts: list[str], source: str, target: str) -> list[str]:
        return [f"{t}~{target}" for t in texts]


def classes_ascending(spark, d):
    return quota.by_count(documents(spark, d, "lang"))


def generate_batch(spark, d):
    return generation.run_generator(documents(spark, d).select("row_id", F.col("text").alias("prompt")), Reverse).select("row_id", "answer")


def answers_once(spark, d):
    """Two runs over one store of answers: the English documents first, then all; equal texts are asked once."""
    docs = documents(spark, d, "lang").select("row_id", "label", F.col("text").alias("prompt"))
    store = answers.Answers(spark, _folder(spark, "answers"), Reverse, "reverse")
    store.ask(docs.where("label = 'en'"), "first")
    store.ask(docs, "second")
    return store.add(docs, made_by="made_by").select("row_id", "answer", "made_by")


def class_context(spark, d):
    shown = documents(spark, d).groupBy("label").agg(F.max("text").alias("examples"))
    return generation.class_context(shown, Reverse, F.lit("{class_name}: {examples}"), "none")


def judge_examples(spark, d):
    return generation.judge_examples(documents(spark, d, "lang"), 5)


def score_texts(spark, d):
    docs = documents(spark, d, "lang")
    context = docs.groupBy("label").agg(F.lit("ctx").alias("context")).where("label <> 'en'")
    candidates = docs.select(F.col("row_id").alias("cand_id"), "label", "text")
    return generation.score_texts(candidates, generation.judge_examples(docs, 3), context, Length, F.lit("{class_name} {context} {examples} {text}")).drop("text")


def back_translate(spark, d):
    return generation.back_translate(_placeheld(spark, d), Shift).select("row_id", "back_translated")


def results_pivot(spark, d):
    rows = documents(spark, d, "lang").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 1000).alias("k"))
    both = [rows.select(F.lit(s).alias("stage"), F.col("label").alias("model"), F.col(c).alias("macro_f1")) for s, c in (("baseline", "n"), ("augmented", "k"))]
    return metrics.results_pivot(both[0].unionByName(both[1].where("model <> 'fr'")))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both see it, deleted when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    path = f"{root.rstrip('/')}/textloom-queries/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _keep(spark: SparkSession, name: str) -> filters.Keep:
    """Writes tables in a folder of their own."""
    folder = _folder(spark, name)

    def keep(table: DataFrame, part: str) -> DataFrame:
        table.write.parquet(f"{folder}/{part}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{part}")

    return keep


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended first; the folder is then left
        return


def raw_json(spark, d):
    """Documents written as JSON arrays of objects, read as the raw input is."""
    path = _folder(spark, "json")
    rows = documents(spark, d).select(F.struct("text", "label", F.col("row_id").alias("idx")).alias("row"), F.pmod(F.xxhash64("row_id"), F.lit(16)).alias("part"))
    # One array is one file, as a reader of whole files needs it.
    rows.groupBy("part").agg(F.to_json(F.collect_list("row")).alias("value")).write.partitionBy("part").text(path)
    return io.read_raw_json(spark, path).select("text", "label")


def csv_round_trip(spark, d):
    path = _folder(spark, "csv")
    io.write_csv(documents(spark, d).select("label", "row_id", "text"), path)
    return io.read_csv(spark, path)


def stage_fallback(spark, d):
    """Stage 1 is written; stages 3 and 0 are asked for, and the test set."""
    root, split = _folder(spark, "stages"), quota.stratified_split(documents(spark, d))
    io.save_split(split, root)
    io.save_stage(split.where("part = 'train'").withColumn("text", F.concat("text", F.lit("!"))), root, 1)
    found = [(f"asked {n}", *io.load_stage(spark, root, n)) for n in (3, 0)] + [("test", io.load_test(spark, root), 0)]
    parts = [t.groupBy("label").agg(F.lit(asked).alias("asked"), F.lit(s).alias("stage"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")) for asked, t, s in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pair_cache(spark, d):
    """Pairs appended twice and read for the classes that are pending."""
    cache, docs = io.PairCache(spark, _folder(spark, "pairs")), documents(spark, d, "lang")
    pairs = docs.select("label", F.reverse("text").alias("translated"), F.col("text").alias("original"))
    cache.append(pairs.where("label <> 'en'"))
    cache.append(pairs.where("label = 'en'"))
    return cache.read(quota.classes_to_augment(docs, 0, 150))


def feature_cache(spark, d):
    """Weights kept under the key of their tables and found again."""
    docs, root = documents(spark, d), _folder(spark, "features")
    key = features.cache_key(docs, docs)
    features.save_features(docs.select("row_id", F.length("text").alias("n")), root, key, "train")
    found = features.load_features(spark, root, key, "train", docs.count())
    assert found is not None and features.load_features(spark, root, key, "train", 1) is None and features.load_features(spark, root, key, "test", 1) is None
    return found


def _labelled(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label"))
    return quota.stratified_split(docs)


#: Most iterations of the optimisers, as the scripts give them; Naive Bayes has none.
ITERATIONS = {"svm": 10_000, "logreg": 1000, "nb": 0}


def _model(kind):
    def run(spark, d):
        both = _labelled(spark, d)
        return features.evaluate(kind, both.where("part = 'train'"), both.where("part = 'test'"), search=True, iterations=ITERATIONS[kind])

    return run


def stage3(spark, data, target, folder):
    """The third stage in a folder of its own, from the table as stage 2 to its checkpoint, with the stand-in translator and a score by length."""

    def translate(slots: DataFrame, attempt: int) -> DataFrame:
        back = generation.back_translate(slots, generation.EchoTranslator)
        return back.withColumn("translated", F.concat("back_translated", F.lit(f" {attempt} "), F.col("slot").cast("string")))

    io.save_stage(data, folder, 2)
    return backtranslation.run_stage(spark, folder, backtranslation.Plan(target), translate, lambda pairs: pairs.withColumn("score", (F.length("text") % 10 + 1).cast("double")))


def _augmented(stage):
    def run(spark, d):
        data = documents(spark, d, "lang")
        folder = _folder(spark, f"augment-{stage}")

        def keep(table: DataFrame, name: str) -> DataFrame:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
            return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

        def propose(slots: DataFrame, attempt: int) -> DataFrame:
            made = generation.run_generator(slots.withColumn("prompt", F.concat("text", F.lit(f" {attempt} "), F.col("slot").cast("string"))), generation.EchoGenerator)
            return made.where("answer is not null").select(F.xxhash64("label", "slot").alias("cand_id"), "label", F.col("answer").alias("text"))

        def score(good: DataFrame) -> DataFrame:
            return good.withColumn("score", (F.length("text") % 10 + 1).cast("double"))

        n = data.count()
        if stage == 3:
            return stage3(spark, data, n // 6, folder).groupBy("label").agg(F.count("*").alias("n"))
        plan = {1: generation.Stage(target=n // 8), 2: generation.Stage(target=n // 7, oversample=3)}[stage]
        out = generation.augment(data, plan, propose, score, keep)
        return out.groupBy("label").agg(F.count("*").alias("n"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    "repeated_words": _odd_scalar(T.remove_repeated_words),
    "repeated_sequences": _scalar(T.remove_repeated_sequences),
    "remove_duplicate_lines": _scalar(T.remove_duplicate_lines),
    "remove_duplicate_sentences": _scalar(T.remove_duplicate_sentences),
    "comma_phrases": _scalar(T.remove_repeated_comma_phrases),
    "cycling_numbered_lines": _scalar(T.remove_cycling_numbered_lines),
    "incremental_list": _odd_scalar(T.remove_incremental_list),
    "trim_attached": _odd_scalar(T.trim_attached_documents),
    "normalize_ws": _odd_scalar(T.normalize_whitespace),
    "clean_chain": clean_pipeline,
}
for _f in (exact_dedup, cross_label_dedup, anomalous_texts, empty_filter, class_distribution, classes_to_augment, need_per_class, stratified_split, train_test_counts, threshold_counts, report_markers, prompt_examples, dedup_vs_existing, short_filter, language_filter, degenerate_ratio, degenerate_phrase, foreign_scripts, prompt_leak, cosine_filter, validation_chain, language_profiles, validation_whole, similarity_schedule, parse_score, judge_topk, judge_topk_pairs, mean_scores, round_robin_sources, round_robin_reshuffled, mask_placeholders, unmask_placeholders, first_paragraph, fill_prompt, pair_semi_join, pair_restore_by_text, union_stages, confusion, class_report, balanced_accuracy, macro_f1, delta_table, label_index, cv_folds, tfidf_weights, classes_ascending, generate_batch, answers_once, class_context, judge_examples, score_texts, back_translate, results_pivot, raw_json, csv_round_trip, stage_fallback, pair_cache, feature_cache):
    QUERIES[_f.__name__] = _f
for _k in ("svm", "logreg", "nb"):
    QUERIES[_k] = _model(_k)
for _n in (1, 2, 3):
    QUERIES[f"augment_stage{_n}"] = _augmented(_n)
