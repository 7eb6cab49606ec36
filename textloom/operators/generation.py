"""Augmentation: generators, judges and translators behind interfaces, and the quota-driven rounds around them.

No model runs here. ``EchoGenerator`` and ``EchoTranslator`` are deterministic stand-ins for tests; what
they make says nothing about any model.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

from . import filters, quota


class TextGenerator(Protocol):
    """Made once in each Python worker; answers a batch of prompts, None where there is no answer."""

    def generate(self, prompts: list[str]) -> list[str | None]: ...


class Translator(Protocol):
    def translate(self, texts: list[str], source: str, target: str) -> list[str]: ...


class EchoGenerator:
    """The prompt's last lines with words turned by a checksum."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            words = p.split()
            turn = zlib.crc32(p.encode()) % max(1, len(words))
            out.append(" ".join(words[turn:] + words[:turn]) or None)
        return out


class EchoTranslator:
    def translate(self, texts: list[str], source: str, target: str) -> list[str]:
        return [f"{t} " for t in texts]


def run_generator(df: DataFrame, make: Callable[[], TextGenerator], prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """Adds the answers. A batch that fails is asked prompt by prompt; a prompt that fails has a null answer."""

    @F.arrow_udf("string")
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()

        def answered(given: list[str]) -> list[str | None]:
            try:
                answers = model.generate(given)
            except Exception:  # noqa: BLE001  whatever a model raises, the rest of the batch is still asked
                answers = []
                for p in given:
                    try:
                        answers += model.generate([p])
                    except Exception:  # noqa: BLE001
                        answers.append(None)
            return [a if a and a.strip() else None for a in answers]

        for prompts in batches:
            yield T.by_slices(prompts, answered, pa.string())

    return df.withColumn(out, ask(prompt))


def back_translate(df: DataFrame, make: Callable[[], Translator], column: str = "text", there: tuple[str, str] = ("ru", "en")) -> DataFrame:
    """Adds back_translated: masked, there and back, stripped, unmasked; a failing batch gives empty texts."""

    @F.arrow_udf("string")
    def turn(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()

        def turned(texts: list[str]) -> list[str]:
            try:
                return model.translate(model.translate(texts, *there), there[1], there[0])
            except Exception:  # noqa: BLE001
                return [""] * len(texts)

        for texts in batches:
            yield T.by_slices(texts, turned, pa.string())

    masked = df.withColumn("__m", T.mask_placeholders(F.col(column)))
    back = masked.withColumn("__t", T.strip(turn(F.col("__m.masked"))))
    return back.withColumn("back_translated", T.unmask_placeholders(F.col("__t"), F.col("__m.found"))).drop("__m", "__t")


def judge(df: DataFrame, make: Callable[[], TextGenerator], prompt: str = "prompt") -> DataFrame:
    """Adds score and parse_ok; an answer without a score counts as 5.0, which passes, as ``parse_ok`` shows."""
    answered = run_generator(df, make, prompt, "__answer")
    ok = F.regexp_extract(F.coalesce("__answer", F.lit("")), r"(?U)\b(10|[1-9])\b", 1) != ""
    return answered.withColumn("score", T.parse_score(F.coalesce("__answer", F.lit("")))).withColumn("parse_ok", ok).drop("__answer")


#: How a judge is asked: sure of itself and brief.
JUDGE_SAMPLING = {"temperature": 0.1, "top_p": 0.9, "max_tokens": 8}


def generate_text(make: Callable[[], TextGenerator], prompt: str) -> str | None:
    """The answer to one prompt, on the driver; None if there is none."""
    (answer,) = make().generate([prompt])
    return answer.strip() or None if answer else None


def class_context(examples: DataFrame, make: Callable[[], TextGenerator], template: Column, fallback: str = "Письма этого класса похожи на примеры.") -> DataFrame:
    """(label, context) for (label, examples): the first paragraph of the answer to the template, or the fixed sentence.

    ``template`` names the fields {class_name} and {examples}. A class whose prompt fails has the fallback.
    """
    prompt = T.fill_template(template, {"class_name": F.col("label"), "examples": F.col("examples")})
    answered = run_generator(examples.select("label", prompt.alias("prompt")), make)
    first = T.first_paragraph(F.col("answer"))
    return answered.select("label", F.coalesce(F.when(first != "", first), F.lit(fallback)).alias("context"))


def judge_examples(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(label, examples): one draw of up to k texts of a class, shared by all candidates that are judged."""
    return quota.examples(df, k, seed=seed)


def score_texts(candidates: DataFrame, examples: DataFrame, context: DataFrame, make: Callable[[], TextGenerator], template: Column) -> DataFrame:
    """Candidates (cand_id, label, text) with score and parse_ok, best first in each class, ties by cand_id.

    ``template`` names the fields {class_name}, {context}, {examples} and {text}; a class without examples or context has empty ones.
    """
    # Both have a row a class; sent out, so that no task gathers a class's candidates.
    known = candidates.join(F.broadcast(examples.select("label", "examples")), "label", "left").join(F.broadcast(context.select("label", "context")), "label", "left")
    fields = {"class_name": F.col("label"), "context": F.coalesce("context", F.lit("")), "examples": F.coalesce("examples", F.lit("")), "text": F.col("text")}
    scored = judge(known.withColumn("prompt", T.fill_template(template, fields)), make)
    return scored.select(*candidates.columns, "score", "parse_ok").orderBy("label", F.desc("score"), "cand_id")


@dataclass(frozen=True)
class Stage:
    """Classes with low <= n < high grow to target. ``schedule``: whether the bound on similarity rises by attempt."""

    target: int
    low: int = 0
    high: int | None = None
    oversample: int = 5
    rounds: int = 5
    least_score: float = 5.0
    least_length: int = 500
    schedule: bool = True


def augment(
    data: DataFrame,
    stage: Stage,
    propose: Callable[[DataFrame, int], DataFrame],
    score: Callable[[DataFrame], DataFrame],
    keep: Callable[[DataFrame, str], DataFrame],
    embed: Callable[[DataFrame], DataFrame] | None = None,
    on_pairs: Callable[[DataFrame], None] | None = None,
    cached: DataFrame | None = None,
    **checks,
) -> DataFrame:
    """Rounds for all needy classes at once, until quotas are met or rounds run out; returns data and the new rows.

    propose(slots, attempt): candidates (cand_id, label, text), with ``original`` where they come in pairs, for
    slots (label, slot, row_id, text); on_pairs: gets the pairs (label, translated, original) of each round, to be
    cached; cached: such pairs of an interrupted run, which count as accepted;
    score: adds a score; keep(table, name): writes a round's table and reads it back, which cuts the
    lineage. The driver holds only whether any class still needs rows.
    """
    needs = keep(quota.need(data, stage.low, stage.high or stage.target, stage.target), "needs")
    accepted = None
    if cached is not None:
        held = cached.join(needs.select("label"), "label", "left_semi").select("label", F.col("translated").alias("text"), F.concat(F.lit("0-"), F.sha2("translated", 256)).alias("made"))
        accepted = keep(held.dropDuplicates(["label", "made"]), "accepted-0")
    for attempt in range(1, stage.rounds + 1):
        open_ = needs if accepted is None else needs.join(accepted.groupBy("label").agg(F.count("*").alias("got")), "label", "left").withColumn("need", F.col("need") - F.coalesce("got", F.lit(0))).drop("got")
        open_ = keep(open_.where("need > 0"), f"open-{attempt}")
        if open_.isEmpty():
            break
        wanted = open_.withColumn("need", F.col("need") * stage.oversample + 1)
        slots = quota.round_robin(data, wanted, seed=42 + attempt).join(data.select("row_id", "text"), "row_id")
        existing = data if accepted is None else data.select("label", "text").unionByName(accepted.select("label", "text"))
        threshold = min(0.95 + max(0, attempt - 2) * 0.01, 0.98) if stage.schedule else 0.95
        proposed = propose(slots, attempt)
        good = filters.validate(proposed, existing, least=stage.least_length, embed=embed, high=threshold, **checks)
        best = filters.select_scored(score(good), open_, stage.least_score)
        if on_pairs is not None:
            best = keep(best, f"pairs-{attempt}")
            on_pairs(best.select("label", F.col("text").alias("translated"), "original"))
        best = best.select("label", "text", F.concat_ws("-", F.lit(str(attempt)), F.col("cand_id").cast("string")).alias("made"))
        best = best if accepted is None else accepted.unionByName(best)
        accepted = keep(best, f"accepted-{attempt}")
    if accepted is None:
        return data
    fresh = accepted.select(F.xxhash64("label", "made", "text").alias("row_id"), "text", "label")
    return data.select("row_id", "text", "label").unionByName(fresh)
