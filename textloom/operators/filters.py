"""The validation chain for candidate texts (cand_id, label, text), cheap filters first."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

from .dedup import new_against
from .language import detect as detect_language

#: What a leaked prompt looks like in the first 150 characters, and anywhere.
LEAK_START = [
    "конечно,",
    "конечно!",
    "генерирую",
    "вот несколько",
    "вот примеры",
    "вот образцы",
    "вот еще одно письмо",
    "вот ещё одно письмо",
    "несколько примеров",
    "пример письма:",
    "текущий текст:",
    "как вы можете видеть",
]
LEAK_ANYWHERE = [
    "напиши одно письмо",
    "напиши пример письма",
    "напиши одно новое письмо",
    "на основе этих примеров",
    "tokenname:",
    "без пояснений и комментариев",
    "не используй markdown",
    "не добавляй ничего после письма",
    "перепиши это письмо другими словами",
    "переформулированное письмо:",
    "только текст письма:",
    "предоставьте пример",
    "предоставь пример",
    "можно ли составить",
    "какие типичные элементы",
    "письмо такого же типа",
    "такого же формата",
    "прошу вас создать",
    "пожалуйста, создайте",
    "создайте ещё одно письмо",
    "создайте еще одно письмо",
    "ваш запрос не совсем",
    "какие параметры можно изменить",
    "используя предоставленный шаблон",
    "я создам",
    "для указанного класса",
    "для класса «",
    'для класса "',
    "эти письма содержат",
    "эти метки нужно",
    "[person] - имя",
    "[person] — имя",
    "[organization] - название",
    "[organization] — название",
    "[date_time] - дата",
    "[date_time] — дата",
]
#: Markdown bold and headings, numbered letters, role marks, Russian entity marks.
LEAK_PATTERNS = [
    r"\*\*[^*\n]{3,}?\*\*",
    r"(?:^|\n)###?\s",
    r"(?:^|\n)\s*(?:###?\s+)?(?:[Пп]исьмо)\s+\d+\s*[:\n]",
    r"(?:^|\n)user\s*\n",
    r"\[[А-ЯЁ_]{4,}\]",
]
#: Fixed value: a phrase of three or more words three times in a row.
STUCK = re.compile(r"(\b\w+(?:\s+\w+){2,})\s+\1\s+\1")


def long_enough(c: Column, least: int = 500) -> Column:
    return F.length(T.strip(c)) >= least


def no_foreign_script(c: Column) -> Column:
    return ~F.rlike(c, F.lit(T.FOREIGN))


def no_prompt_leak(c: Column, start: list[str] = LEAK_START, anywhere: list[str] = LEAK_ANYWHERE, patterns: list[str] = LEAK_PATTERNS) -> Column:

    def marked(lower: Column) -> Column:
        bad = F.lit(False)
        for m in start:
            bad |= F.contains(F.substring(lower, 1, 150), F.lit(m))
        for m in anywhere:
            bad |= F.contains(lower, F.lit(m))
        return bad

    bad = T.let(F.lower(T.strip(c)), marked)
    if patterns:
        bad |= F.rlike(c, F.lit("(?Umd)(?:" + "|".join(patterns) + ")"))
    return ~bad


def varied(c: Column, least: float = 0.2) -> Column:
    """At least this share of the words (by white space) differ; texts under three words pass."""
    w = F.filter(F.split(F.lower(c), r"(?U)\s+", -1), lambda x: x != "")
    return T.let(w, lambda x: (F.size(x) < 3) | (F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)) >= least))


def stuck(text: str) -> bool:
    """Whether a phrase of three or more words comes three times in a row.

    Words separated by white space alone must repeat with some period; only then is the regex asked,
    whose time grows with the square of the text.
    """
    low = text.lower()
    code = pd.factorize(np.array(re.findall(r"\w+", low), dtype=object))[0]
    n = len(code)
    for period in range(3, n // 3 + 1):
        same = code[period:] == code[:-period]
        if same.sum() < 2 * period - 1:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        # The first word of the phrase and the last of its last copy may match in part only.
        if (edge[1::2] - edge[::2]).max(initial=0) >= 2 * period - 2:
            return STUCK.search(low) is not None
    return False


def not_stuck(c: Column) -> Column:
    @F.arrow_udf("boolean")
    def run(s: pa.Array) -> pa.Array:
        return T.by_slices(s, lambda some: [None if t is None else not (len(t.split()) >= 3 and stuck(t)) for t in some], pa.bool_())

    return run(c)


def in_language(c: Column, detect: Callable[[str], str], wanted: str) -> Column:
    """By a detector of the caller's; texts on which it fails do not pass."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str) -> bool:
            try:
                return t is not None and detect(t) == wanted
            except Exception:  # noqa: BLE001  any failure of the detector means that the text does not pass
                return False

        return s.map(one)

    return run(c)


def similarity_threshold(attempt: Column) -> Column:
    """0.95 for the first two attempts, then 0.01 more each, 0.98 at most."""
    return F.round(F.least(F.lit(0.95) + F.greatest(F.lit(0), attempt - 2) * 0.01, F.lit(0.98)), 2)


#: Vectors in one block, about; most pivots of a class; vectors by pivot, about, below that; what rounding may hide of a bound.
BLOCK, PIVOTS, CELL, SLACK = 1024, 256, 256, 1e-9


def _unit(vectors: np.ndarray | pa.ChunkedArray) -> np.ndarray:
    v = vectors if isinstance(vectors, np.ndarray) else np.stack(vectors.to_numpy())
    v = v.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _parts(rows: DataFrame, keys: list[str], size: int, *salt: str) -> tuple[DataFrame, DataFrame]:
    """Adds ``part``, by which rows of one key are divided into about ``size`` each; and the keys with their ``parts``."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    return rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(*salt), F.col("parts")).cast("int")).drop("parts"), sizes


def _each(column: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(column) - 1))


def pivots(existing: DataFrame) -> DataFrame:
    """(label, pivot, embedding): some vectors of each class, one for about ``CELL``, ``PIVOTS`` at most, the first by hash.

    The first of each of ``PIVOTS`` buckets of hashes is found where the rows are, so copies are never two pivots and
    only buckets meet by class.
    """
    hashed = existing.withColumn("hash", F.xxhash64("embedding")).withColumn("bucket", F.pmod("hash", F.lit(PIVOTS)))
    buckets = hashed.groupBy("label", "bucket").agg(F.count("*").alias("n"), F.min("hash").alias("hash"), F.min_by("embedding", "hash").alias("embedding"))
    by_class = Window.partitionBy("label")
    ranked = buckets.select("label", "embedding", F.row_number().over(by_class.orderBy("hash")).alias("pivot"), F.sum("n").over(by_class).alias("n"))
    return ranked.where(F.col("pivot") <= F.ceil(F.col("n") / CELL)).select("label", "pivot", "embedding")


def _with_pivots(rows: DataFrame, salt: str, centres: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run(rows, pivots)`` of parts of each class; a class's pivots go to each of its parts."""
    parted, sizes = _parts(rows, ["label"], 16 * BLOCK, salt)
    sent = centres.join(sizes, "label").withColumn("part", _each("parts")).drop("parts")
    parted, sent = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (parted, sent))
    return parted.groupBy("label", "part").cogroup(sent.groupBy("label", "part")).applyInArrow(run, schema)


def cells(existing: DataFrame, centres: DataFrame) -> DataFrame:
    """(label, pivot, angle, embedding): every distinct vector with the nearest pivot of its class; copies lie in one part."""

    def run(some: pa.Table, those: pa.Table) -> pa.Table:
        if not len(some) or not len(those):
            return some.select(["label", "embedding"]).slice(0, 0).append_column("pivot", pa.array([], pa.int32())).append_column("angle", pa.array([], pa.float64())).select(["label", "pivot", "angle", "embedding"])
        those = those.sort_by("pivot")
        own, first = np.unique(np.stack(some.column("embedding").to_numpy()), axis=0, return_index=True)
        some = some.take(pa.array(first))
        near = _unit(own) @ _unit(np.stack(those.column("embedding").to_numpy())).T
        best = near.argmax(1)
        angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
        return pa.table({"label": some.column("label"), "pivot": those.column("pivot").take(pa.array(best)).cast(pa.int32()), "angle": pa.array(angle), "embedding": some.column("embedding")})

    kinds = {f.name: f.dataType.simpleString() for f in existing.schema}
    return _with_pivots(existing, "embedding", centres, run, f"label {kinds['label']}, pivot int, angle double, embedding {kinds['embedding']}")


def visits(candidates: DataFrame, centres: DataFrame, reaches: DataFrame, known: bool) -> DataFrame:
    """(cand_id, label, pivot, embedding): the cells in which a candidate must look.

    ``reaches`` has the largest angle of each cell. At first that is the one with the nearest pivot. Once a
    similarity is ``known`` (a column of ``candidates``, with the cell it came from as ``seen``), by the triangle
    inequality a cell is worth a look only if the angle to its pivot less the cell's own could give a larger one.
    """

    def run(some: pa.Table, those: pa.Table) -> pa.Table:
        out = some.select(["cand_id", "label", "embedding"])
        if not len(some) or not len(those):
            return out.slice(0, 0).append_column("pivot", pa.array([], pa.int32()))
        those = those.sort_by("pivot")
        near, names = _unit(some.column("embedding")) @ _unit(those.column("embedding")).T, those.column("pivot").to_numpy()
        if known:
            least = np.maximum(np.arccos(np.clip(near, -1, 1)) - those.column("reach").to_numpy(), 0)
            open_ = np.cos(least) > some.column("known").to_numpy()[:, None] - SLACK
            row, cell = np.nonzero(open_ & (names != some.column("seen").to_numpy()[:, None]))
        else:
            row, cell = np.arange(len(some)), near.argmax(1)
        return out.take(pa.array(row)).append_column("pivot", pa.array(names[cell], pa.int32()))

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    sent = centres.join(reaches, ["label", "pivot"])
    return _with_pivots(candidates, "cand_id", sent, run, f"cand_id {kinds['cand_id']}, label {kinds['label']}, embedding {kinds['embedding']}, pivot int")


def _looked_up(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(cand_id, label, pivot, similarity) of candidates and all vectors of the cells that they visit, block by block, one product each."""
    keys = ["label", "pivot"]
    a, a_sizes = _parts(asked, keys, BLOCK, "cand_id")
    b, b_sizes = _parts(held, keys, BLOCK, "embedding")
    a = a.join(b_sizes, keys).withColumn("other", _each("parts")).select(*keys, "part", "other", "cand_id", "embedding")
    b = b.join(a_sizes, keys).withColumn("other", _each("parts")).select(*keys, F.col("other").alias("part"), F.col("part").alias("other"), "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}

    def best(some: pa.Table, those: pa.Table) -> pa.Table:
        out = some.select(["cand_id", "label", "pivot"])
        if not len(some) or not len(those):
            return out.slice(0, 0).append_column("similarity", pa.array([], pa.float64()))
        return out.append_column("similarity", pa.array((_unit(some.column("embedding")) @ _unit(those.column("embedding")).T).max(1)))

    on = [*keys, "part", "other"]
    a, b = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (a, b))
    return a.groupBy(*on).cogroup(b.groupBy(*on)).applyInArrow(best, f"cand_id {kinds['cand_id']}, label {kinds['label']}, pivot int, similarity double")


#: Writes a table under a name and reads it again.
Keep = Callable[[DataFrame, str], DataFrame]


def max_similarity(candidates: DataFrame, existing: DataFrame, keep: Keep = lambda table, name: table) -> DataFrame:
    """(cand_id, similarity): the largest cosine with a vector of the same class; candidates of classes without any are left out.

    Both have (id column, label, embedding). A class's distinct vectors lie in cells around pivots. A candidate
    looks in the cell of its nearest pivot first, then in those alone that may hold a nearer vector, so the
    result is exact and cells far away never meet it. A null label has no class; rows without a vector are left out.
    ``keep`` cuts what is used several times; by default it is made anew each time.
    """
    candidates, existing = candidates.select("cand_id", "label", "embedding").dropna(), existing.select("label", "embedding").dropna()
    centres = keep(pivots(existing), "pivots")
    held = keep(cells(existing, centres), "cells")
    reaches = held.groupBy("label", "pivot").agg(F.max("angle").alias("reach"))
    held = held.select("label", "pivot", "embedding")
    first = keep(_looked_up(keep(visits(candidates, centres, reaches, known=False), "asked-first"), held).groupBy("cand_id", "label", "pivot").agg(F.max("similarity").alias("similarity")), "first")
    again = candidates.join(first.select("cand_id", "label", F.col("pivot").alias("seen"), F.col("similarity").alias("known")), ["cand_id", "label"])
    then = _looked_up(keep(visits(again, centres, reaches, known=True), "asked-then"), held)
    return first.select("cand_id", "similarity").unionByName(then.select("cand_id", "similarity")).groupBy("cand_id").agg(F.max("similarity").alias("similarity"))


def filter_by_similarity(candidates: DataFrame, existing: DataFrame, high: float = 0.95, low: float = 0.5, keep: Keep = lambda table, name: table) -> DataFrame:
    """Candidates whose largest similarity is in [low, high); a class without vectors lets all pass."""
    found = candidates.join(max_similarity(candidates, existing, keep), "cand_id", "left")
    return found.where(F.col("similarity").isNull() | ((F.col("similarity") >= low) & (F.col("similarity") < high)))


def validate(candidates: DataFrame, existing: DataFrame, *, least: int = 500, detect: Callable[[str], str] | None = None, wanted: str = "ru", known: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, high: float = 0.95, low: float = 0.5, keep: Keep = lambda table, name: table) -> DataFrame:
    """The filters in order; native ones before those in Python.

    ``known`` are the languages' profiles, by which ``wanted`` is found without a detector; ``embed`` adds an embedding to a table with text.
    """
    c = F.col("text")
    out = new_against(candidates, existing).where(long_enough(c, least))
    out = out.where(varied(c) & no_foreign_script(c) & no_prompt_leak(c))
    if known is not None:
        out = detect_language(out, known).where(F.col("detected") == wanted).select(candidates.columns)
    if detect is not None:
        out = out.where(in_language(c, detect, wanted))
    out = out.where(not_stuck(c))
    if embed is not None:
        out = filter_by_similarity(keep(embed(out), "candidates"), keep(embed(existing), "existing"), high, low, keep).select(candidates.columns)
    return out


def restore_pairs(pairs: DataFrame, survivors: DataFrame, by_text: bool = False) -> DataFrame:
    """Pairs (cand_id, label, text, ...) whose candidate survived; ``by_text`` also brings back its exact copies in the class."""
    keys = ["label", "text"] if by_text else ["cand_id"]
    return pairs.join(survivors.select(*keys).distinct(), keys, "left_semi")


def select_scored(scored: DataFrame, needs: DataFrame, least: float = 5.0) -> DataFrame:
    """The ``need`` best candidates of each class with score >= least; ties to the smaller cand_id."""
    good = scored.where(F.col("score") >= least).join(F.broadcast(needs.select("label", "need")), "label")
    # Scores and ids alone are ranked by class; only rows above the cut are exchanged with their texts.
    slim = good.groupBy("label", "need", "score", "cand_id").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("label").orderBy(F.desc("score"), F.asc("cand_id"))) - F.col("__n")
    cut = slim.withColumn("__before", before).where(F.col("__before") < F.col("need")).select("label", F.col("score").alias("__score"), F.col("cand_id").alias("__id"), "__before")
    own = good.join(cut.withColumnRenamed("label", "__label"), (F.col("label") == F.col("__label")) & (F.col("score") == F.col("__score")) & F.col("cand_id").eqNullSafe(F.col("__id")))
    copy = F.row_number().over(Window.partitionBy("label", "score", "cand_id").orderBy("cand_id"))
    return own.withColumn("rank", (F.col("__before") + copy).cast("int")).where(F.col("rank") <= F.col("need")).drop("need", "__before", "__label", "__score", "__id")


def score_means(scored: DataFrame, selected: DataFrame) -> DataFrame:
    """Mean score of all and of the selected candidates of each class, 0 where there are none."""
    a = scored.groupBy("label").agg(F.avg("score").alias("mean_all"))
    b = selected.groupBy("label").agg(F.avg("score").alias("mean_selected"))
    return a.join(b, "label", "left").withColumn("mean_selected", F.coalesce("mean_selected", F.lit(0.0)))
