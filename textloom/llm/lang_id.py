"""Language proportions of documents by expectation maximisation over n-gram likelihoods.

Each language is a distribution over hashed 4-byte windows of the lower-cased text, learnt from at
most ``SAMPLE`` labelled texts of that language (those with the smallest hash of the id). A text's
windows are a mixture of the languages. EM estimates the proportions for nested sets of languages,
taken in order of their share, and the set with the greatest likelihood less half the logarithm of
the sample size for each language is chosen; overlapping windows count as a quarter each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .arrow import columns, rows

SAMPLE, BITS, WINDOW, ROUNDS = 800, 15, 4, 25
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))])
_KINDS = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"


def window_codes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed windows of the lower-cased texts, and where those of each start; line feeds around a text are part of it."""
    buf, at = textvec.joined([b"", *(x.decode().lower().encode() for x in docs), b""])
    wide = np.zeros(len(buf), np.uint32)
    for k in range(WINDOW):
        wide[: len(buf) - k] |= buf[k:].astype(np.uint32) << np.uint32(8 * k)
    return ((wide * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), at[1:] - 1


class Languages:
    """Names and window probabilities, (buckets, languages)."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        share = (counts + 0.05) / (counts.sum(0) + 0.05 * len(counts))
        self.share = np.ascontiguousarray(share)
        self.log = np.log(share)

    def mixture(self, codes: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The chosen languages in descending order of share, and their shares."""
        n = np.bincount(codes, minlength=len(self.share))
        used = np.flatnonzero(n)
        n = n[used].astype(np.float64)
        total = n.sum()
        alone = n @ self.log[used]
        best = int(alone.argmax())
        if len(self.names) == 1:
            return [best], np.ones(1)
        price = 0.5 * np.log(max(total / WINDOW, 2))
        p = self.share[used]
        share = self._em(p, n, total)
        order = np.argsort(-share, kind="stable")
        chosen, shares, value = [best], np.ones(1), alone[best] / WINDOW - price
        for k in range(2, len(order) + 1):
            own = order[:k]
            part = p[:, own]
            s = self._em(part, n, total)
            now = n @ np.log(part @ s + 1e-300) / WINDOW - price * k
            if now <= value:
                break
            value, rank = now, np.argsort(-s, kind="stable")
            chosen, shares = [int(own[i]) for i in rank], s[rank]
        return chosen, shares

    @staticmethod
    def _em(p: np.ndarray, n: np.ndarray, total: float) -> np.ndarray:
        share = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(ROUNDS):
            new = share * ((n / (p @ share + 1e-300)) @ p) / total
            if np.abs(new - share).max() < 1e-4:
                return new
            share = new
        return share


def fit_languages(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, where=None) -> Languages | None:
    """Learns from the rows with a language, at most ``sample`` ids of each; None if there are none.

    Repeated rows of a chosen id all count.
    """
    usable = columns(df, doc_id=id_col, lang=lang_col, text=text_col)
    known = usable.where("lang is not null and doc_id is not null")
    known = known if where is None else known.where(where)
    ids, place = known.select("doc_id", "lang"), F.xxhash64("doc_id")
    # Ids far beyond the sample go before the shuffle, so that a frequent language does not fill one task.
    sizes = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"), F.min(place).alias("least"))
    near = (F.lit(0.5) + place / 2.0**64) * F.col("ids") <= 2 * sample + 50
    ids = ids.join(F.broadcast(sizes), "lang").where(near | (place == F.col("least"))).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    chosen = ids.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang")

    def count(batches):
        own: dict[str, np.ndarray] = {}
        for part, docs, _ in textvec.chunks(batches):
            codes, at = window_codes(docs)
            for i, lang in enumerate(part.column(0).to_pylist()):
                if lang not in own:
                    own[lang] = np.zeros(1 << BITS, np.int64)
                own[lang] += np.bincount(codes[at[i] : at[i + 1]], minlength=1 << BITS)
        for lang, n in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n.tolist()], pa.list_(pa.int64()))], names=["lang", "n"])

    # ``sample`` rows of an id and a name for each language; counts come back as one array for each task and language.
    texts = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
    total: dict[str, np.ndarray] = {}
    for r in texts.mapInArrow(count, "lang string, n array<long>").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["n"])
    names = sorted(total)
    return Languages(names, np.stack([total[x] for x in names], 1).astype(np.float64)) if names else None


def predicted(docs: list[bytes], model: Languages | None) -> tuple[list[str], list[float], list[list[str]], list[list[float]]]:
    """For each text its main language and that one's share, the chosen languages and their shares."""
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = True
    codes, at = window_codes(docs)
    name, score, sets, shares = [], [], [], []
    for i, doc in enumerate(docs):
        if model is None or not (letters[np.frombuffer(doc, np.uint8)].any() or any(map(str.isalpha, doc.decode()))):
            name.append("und"), score.append(0.0), sets.append([]), shares.append([])
            continue
        own, share = model.mixture(codes[at[i] : at[i + 1]])
        name.append(model.names[own[0]])
        score.append(float(min(1.0, share[0])))
        sets.append([model.names[k] for k in own])
        shares.append(share.tolist())
    return name, score, sets, shares


def infer_languages(df: DataFrame, model: Languages | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: lang_pred, its share as score, and the chosen languages and shares.

    Null texts, texts without a letter and all texts without a model are ``und`` with score 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def infer(batches):
        for part, docs, _ in textvec.chunks(batches):
            name, score, sets, shares = predicted(docs, shared.value)
            yield rows(_ARROW, doc_id=part.column(0).cast(pa.int64()), lang_pred=name, score=score, languages=sets, proportions=shares)

    return columns(df, doc_id=id_col, text=text_col).mapInArrow(infer, _KINDS)


def keep_main(df: DataFrame, model: Languages | None, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of which one language has this share; decided where they are, without an exchange."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for part, docs, _ in textvec.chunks(batches, text_col):
            name, score, *_ = predicted(docs, shared.value)
            yield part.filter(pa.array([n != "und" and s >= least for n, s in zip(name, score, strict=True)], pa.bool_()))

    return df.mapInArrow(keep, df.schema)
