"""Quality rules: exact base rules, then a hashed n-gram logistic regression with calibrated probabilities.

The classifier is fitted on at most ``SAMPLE`` labelled rows (those with the smallest hash of the
id), a quarter of which only calibrate it. Texts are scored whole, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams, textvec
from .arrow import columns, rows

#: Most labelled rows for fitting and calibrating; least probability of good quality to keep.
SAMPLE, THRESHOLD = 2400, 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in _NAMES), ("p_good", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def base_counts(docs: list[bytes]) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    buf, at = textvec.joined(docs)
    starts, ends = textvec.word_spans(buf)
    ptr = np.searchsorted(starts, at)

    def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[edges])

    out = {"n_words": np.diff(ptr)}
    out["word_chars"] = per_text(~textvec.translated(buf, textvec.SPACE) & (buf & 0xC0 != 0x80), at)
    out["n_symbols"] = per_text(_SYMBOL[buf], at)
    # Lines: spans between line feeds; the one after each text closes its last line.
    feed = np.flatnonzero(buf == 10)
    line = np.concatenate([[0], feed[:-1] + 1])
    doc = np.searchsorted(at, line, "right") - 1
    worded = np.searchsorted(starts, feed) > np.searchsorted(starts, line)
    line, feed, doc = line[worded], feed[worded], doc[worded]
    out["n_dup_lines"] = np.bincount(doc[_later(textvec.span_hashes(buf, line, feed), doc)], minlength=len(docs)).astype(np.int64)
    h, first = textvec.windows(textvec.span_hashes(buf, starts, ends), ptr, 8)
    again = _repeated(h, np.searchsorted(ptr, first, "right") - 1)
    cover = np.zeros(len(starts) + 9, np.int64)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + 8, -1)
    out["n_repeat_words"] = per_text(np.cumsum(cover)[: len(starts)] > 0, ptr)
    return out


def _sorted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by text and hash (stable), and which entry equals the one before it."""
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return order, same


def _later(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries equal to an earlier one of the same text."""
    order, same = _sorted(h, doc)
    return order[same]


def _repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries found twice or more in their text, the first included."""
    order, same = _sorted(h, doc)
    before = np.append(same[1:], False) if len(same) else same
    return order[same | before]


def fit_quality(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> ngrams.Model | None:
    """The classifier, or None if the labelled rows at hand are of one kind only.

    Repeated ids count once; what comes to the driver are hashed features of at most ``sample`` texts.
    """
    chosen = columns(labels, doc_id=id_col, y=label_col).where("y in (0, 1) and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    # At most ``sample`` rows of two numbers.
    chosen = chosen.select(F.col("doc_id").cast("long"), F.col("y").cast("int"))
    y, held, features = ngrams.sampled(documents, chosen, 2, 1.0, screen=ngrams.SCREEN, id_col=id_col, text_col=text_col)
    if len(set(y.tolist())) < 2:
        return None
    model = ngrams.fit(features.part(~held), y[~held], 2)
    return ngrams.calibrate(model, features.part(held), y[held]) if len(set(y[held].tolist())) == 2 else model


def verdicts(docs: list[bytes], model: ngrams.Model | None, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """The base counts of each text, p_good, base_failed and kept."""
    out = base_counts(docs)
    out["p_good"] = model.probabilities(docs)[:, 1] if model is not None else np.ones(len(docs))
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["p_good"] >= threshold)
    return out


def score_quality(df: DataFrame, model: ngrams.Model | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row: the base counts, base_failed, p_good and kept.

    Null and empty texts have no words and fail. Without a model the base rules alone decide.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for part, docs, _ in textvec.chunks(batches):
            yield rows(_ARROW, doc_id=part.column(0).cast(pa.int64()), **verdicts(docs, shared.value, threshold))

    kinds = ", ".join(f"{n} long" for n in _NAMES)
    return columns(df, doc_id=id_col, text=text_col).mapInArrow(score, f"doc_id long, {kinds}, p_good double, base_failed boolean, kept boolean")


def keep_good(df: DataFrame, model: ngrams.Model | None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that ``score_quality`` keeps; decided where they are, without an exchange."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for part, docs, _ in textvec.chunks(batches, text_col):
            yield part.filter(pa.array(verdicts(docs, shared.value, threshold)["kept"]))

    return df.mapInArrow(keep, df.schema)
