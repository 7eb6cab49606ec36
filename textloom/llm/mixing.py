"""Soft-membership mixing: document rates whose expected domain token totals meet target shares.

A softmax regression fitted on labelled rows gives each document a posterior over domains. With
``n`` tokens and posterior ``p`` a document at rate ``r`` adds ``r * n * p`` to the domain totals.
Of all rates from 0 to ``MOST`` that meet the wanted totals, those nearest to 1 (least squares by
tokens, and by a pull to exactly 1) are a projection: ``r = clip(1 - shrunk(p @ asked), 0, MOST)``,
where ``asked`` has one number for each domain. It is fitted by projected gradient in its lazy form:
the gradients of the squared misses are summed, and the sum is projected. First on a histogram of
the posteriors with a bounded number of cells, on the driver, each step through the inverse
curvature of the documents that move and with a line search on the dual of the squares, which is
concave; then in passes over all documents, whose sums correct it, until the gap is closed.

The overall size is what leaves the ``anchor`` domain as it is: the others shrink or grow to their
shares beside it. A domain whose share cannot be reached with rates up to ``MOST`` is left out, with
a warning: it then moves as the others need, and they meet their targets as without it. Copies are
the rate's whole part and, by a hash of the id, its fraction.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams, textvec
from .arrow import columns
from .store import Scratch
from .wordbpe import WordBpe

#: Most labelled rows of the classifier's fit; passes over all documents; relative miss at which they end.
SAMPLE, PASSES, TOLERANCE = 2000, 12, 1e-3
#: What is asked of a rate counts only beyond this, so that documents near 1 stay at 1; highest rate; relative miss of a domain that is not met.
PULL, MOST, REPORTED = 0.05, 16.0, 0.01
#: Most cells of the histogram of posteriors, steps on it, and the unit of its whole-number sums.
CELLS, STEPS, UNIT = 1 << 15, 150, 1 << 16
#: Least chi-square statistics of a feature to choose from: of 3 * 2**18 features, and with copies among
#: the rows, hundreds reach the usual bounds by chance; few rows cannot reach high ones.
SCREENS = (15.0, 30.0, 60.0)


def fit_domains(documents: DataFrame, labels: DataFrame, domain, names: list[str], *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ngrams.Model:
    """The classifier from at most ``sample`` labelled rows; ``domain`` is a column of ``labels`` with a name or null.

    A quarter of the rows, which the fits have not seen, choose the screen and the slope. Repeated ids count
    once; what comes to the driver are hashed features of at most ``sample`` texts.
    """
    chosen = labels.select(F.col(f"`{id_col}`").alias("doc_id"), domain.alias("domain")).where(F.col("domain").isin(names) & F.col("doc_id").isNotNull())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("domain")) - 1
    chosen = chosen.select(F.col("doc_id").cast("long"), place.cast("int").alias("y"))
    y, held, features = ngrams.sampled(documents, chosen, len(names), 0.5, screen=min(SCREENS), id_col=id_col, text_col=text_col)
    seen, unseen = features.part(~held), features.part(held)
    best = None
    for screen in SCREENS:
        model = ngrams.fit(seen, y[~held], len(names), steps=60, screen=screen, evenness=1.0, norm=0.5)
        found = ngrams.tempered(model, unseen, y[held])
        if best is None or found[0] < best[0]:
            best = found
    return best[1]


def posteriors(df: DataFrame, model: ngrams.Model, tokenizer: str, *, text_col: str = "text", names: tuple[str, str] = ("n_tokens", "posterior")) -> DataFrame:
    """All rows and columns, then the tokens (by the tokenizer) and the posterior over the domains under these names."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model, bpe = shared.value, WordBpe.at(tokenizer)
        for part, docs, _ in textvec.chunks(batches, text_col):
            p = model.probabilities(docs)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(docs) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bpe.counts(docs), pa.int64()), flat], names=[*part.schema.names, *names])

    kinds = T.StructType([*df.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(score, kinds)


def rates(p: np.ndarray, asked: np.ndarray, pull: float = PULL) -> np.ndarray:
    """Document rates for what is asked of the domains."""
    s = p @ asked
    return np.clip(1 - np.sign(s) * np.maximum(np.abs(s) - pull, 0), 0, MOST)


def _gain(s: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The least value of half the squared move, the pull and ``s * r`` over the rates, which ``r`` takes."""
    return 0.5 * (r - 1) ** 2 + PULL * np.abs(r - 1) + s * r


def solve(n: np.ndarray, p: np.ndarray, wanted: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, bool]:
    """What to ask of the domains ``live`` so that tokens ``n`` with posteriors ``p`` meet the totals wanted, and whether they do."""
    asked, k = np.zeros(p.shape[1]), np.flatnonzero(live)
    full = (p * n[:, None]).T @ p
    scale = np.maximum(wanted[k], 1.0)

    def at(x):
        s, r = p @ x, rates(p, x)
        return (n * r) @ p - wanted, s, r, float(n @ _gain(s, r) - x[k] @ wanted[k])

    gap, s, r, value = at(asked)
    for _ in range(STEPS):
        if np.abs(gap[k] / scale).max(initial=0.0) < 1e-9:
            return asked, True
        moving = (np.abs(s) > PULL) & (r > 0) & (r < MOST)
        curve = (p * (n * moving)[:, None]).T @ p
        curve = curve[np.ix_(k, k)] + np.diag(1e-6 * np.diag(full)[k] + 1e-9)
        if not moving.any():
            curve = full[np.ix_(k, k)] + np.diag(1e-6 * np.diag(full)[k] + 1e-9)
        step = np.zeros_like(asked)
        step[k] = np.linalg.solve(curve, gap[k])
        for halved in range(40):
            trial = asked + step * 0.5**halved
            found = at(trial)
            if found[3] >= value + 1e-4 * 0.5**halved * float(step[k] @ gap[k]):
                break
        else:
            break
        asked, (gap, s, r, value) = trial, found
    return asked, bool(np.abs(gap[k] / scale).max(initial=0.0) < TOLERANCE)


def histogram(scored: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and mean posteriors of at most ``CELLS`` cells of the posteriors; the sums are whole numbers, alike in any order."""
    grid = 1
    while math.comb(2 * grid + k - 1, k - 1) <= CELLS and grid < 1 << 10:
        grid *= 2

    def gather(batches):
        for batch in batches:
            n = batch.column(0).to_numpy().astype(np.int64)
            p = batch.column(1).flatten().to_numpy().reshape(-1, k)
            cell = np.minimum((p[:, :-1] * grid).astype(np.int64), grid - 1) @ (grid ** np.arange(k - 1)) if k > 1 else np.zeros(len(n), np.int64)
            cells, at = np.unique(cell, return_inverse=True)
            sums = np.zeros((len(cells), k + 1), np.int64)
            np.add.at(sums, at, np.column_stack([n, n[:, None] * np.rint(p * UNIT).astype(np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(cells), *[pa.array(x) for x in sums.T]], names=["cell", "n", *[f"p{i}" for i in range(k)]])

    names = ["n", *[f"p{i}" for i in range(k)]]
    held = scored.where("n_tokens > 0").select("n_tokens", "posterior").mapInArrow(gather, "cell long, " + ", ".join(f"{x} long" for x in names))
    cells = held.groupBy("cell").agg(*[F.sum(x).alias(x) for x in names]).orderBy("cell").collect()
    sums = np.array([[r[x] for x in names] for r in cells], np.float64).reshape(-1, k + 1)
    return sums[:, 0], sums[:, 1:] / UNIT / np.maximum(sums[:, :1], 1)


def fit_rates(scored: DataFrame, targets: np.ndarray, *, anchor: int = 0, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is asked of the domains, the domain totals it leads to and those wanted; a domain left out is wanted as it comes."""
    spark, k = scored.sparkSession, len(targets)

    def gathered(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals at the present rates, and the curvature over documents that move."""
        shared = spark.sparkContext.broadcast(asked)

        def gather(batches):
            total, curve = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    n = batch.column(0).to_numpy().astype(np.float64)
                    p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                    r = rates(p, shared.value)
                    total += (r * n) @ p
                    curve += (p * (n * (np.abs(p @ shared.value) > PULL) * (r > 0) * (r < MOST))[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist() + curve.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

        sums = scored.select("n_tokens", "posterior").mapInArrow(gather, "s array<double>")
        # One short row for each task, summed by place before it comes here.
        got = sums.select(F.posexplode("s").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(k + k * k)
        for r in got:
            flat[r["place"]] = r["x"]
        return flat[:k], flat[k:].reshape(k, k)

    n, p = histogram(scored, k)
    mass = n @ p if len(n) else np.zeros(k)
    share = targets / targets.sum()
    live = (share > 0) & (mass > 0)
    if not live.any():
        return np.zeros(k), mass, mass
    at = anchor if live[anchor] else int(np.flatnonzero(live)[0])
    left: list[int] = []
    while True:
        wanted = np.where(live, share * mass[at] / share[at], mass)
        asked, met = solve(n, p, wanted, live)
        if met:
            total, best = None, None
            for _ in range(passes):
                asked = np.round(asked * 2**24) / 2**24  # the order in which tasks are summed does not show
                total, curve = gathered(asked)
                miss = float(np.abs((total - wanted)[live] / np.maximum(wanted[live], 1.0)).max())
                if best is None or miss < best[0]:
                    best = miss, asked, total
                if best[0] < TOLERANCE:
                    break
                own = np.ix_(live, live)
                step = np.zeros(k)
                step[live] = np.linalg.solve(curve[own] + np.diag(1e-6 * mass[live] + 1e-9), (total - wanted)[live])
                asked = best[1] + (step if miss == best[0] else (asked - best[1]) / 2)
            met = best[0] < REPORTED
            asked, total = best[1], best[2]
        if met:
            break
        # The domain furthest from its share is left out; the anchor alone is always met.
        apart = np.abs(np.log(wanted / np.maximum(mass, 1e-9)))
        apart[~live] = apart[at] = -1.0
        live[int(apart.argmax())] = False
        left.append(int(apart.argmax()))
    if left:
        missed = "; ".join(f"{i}: {total[i]:.0f} tokens, wanted {share[i] * mass[at] / share[at]:.0f}, would have to grow {share[i] * mass[at] / share[at] / max(mass[i], 1e-9):.1f} times" for i in left)
        warnings.warn(f"the rates miss their targets; left out, beyond rates of {MOST:g}: {missed}", stacklevel=2)
    return asked, total, np.where(live, wanted, total)


def mix(df: DataFrame, model: ngrams.Model, names: list[str], targets: dict[str, float], tokenizer: str, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", anchor: str | None = None) -> DataFrame:
    """One row for each row: doc_id, n_tokens, posterior, rate, copies.

    Null and empty texts have no tokens and the posterior of the classifier's bias. Repeated rows are mixed
    each, alike. Domains without tokens are left out of the fit, and so, with a warning, are those out of reach
    (see above). An empty table gives an empty result.
    """
    scored = posteriors(columns(df, doc_id=id_col, text=text_col), model, tokenizer).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = scratch.keep(scored.drop("text"), "posteriors")
    return _mixed(scored, names, targets, anchor, F.col("doc_id"), ("n_tokens", "posterior")).select("doc_id", "n_tokens", "posterior", "rate", "copies")


def mix_rows(df: DataFrame, model: ngrams.Model, names: list[str], targets: dict[str, float], tokenizer: str, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", anchor: str | None = None) -> DataFrame:
    """Every row with all its columns as often as ``mix`` says; scored rows are written and read again, without an exchange."""
    own = []
    for name in ("n_tokens", "posterior", "rate", "copies"):
        while name in df.columns:
            name += "_"
        own.append(name)
    scored = scratch.keep(posteriors(df, model, tokenizer, text_col=text_col, names=(own[0], own[1])), "posteriors")
    mixed = _mixed(scored, names, targets, anchor, F.col(f"`{id_col}`"), (own[0], own[1]), own[2], own[3])
    # Rows without copies go first, so that no sequence is empty.
    repeated = mixed.where(F.col(own[3]) > 0).withColumn(own[3], F.explode(F.sequence(F.lit(1), F.col(own[3]))))
    return repeated.select(*[F.col(f"`{c}`") for c in df.columns])


def _mixed(scored: DataFrame, names: list[str], targets: dict[str, float], anchor: str | None, row_id: Column, given: tuple[str, str], rate: str = "rate", copies: str = "copies") -> DataFrame:
    """Adds the rate and the copies."""
    fitted = scored.select(F.col(given[0]).alias("n_tokens"), F.col(given[1]).alias("posterior"))
    asked, _, _ = fit_rates(fitted, np.array([targets[n] for n in names], np.float64), anchor=names.index(anchor) if anchor else 0)
    shared = scored.sparkSession.sparkContext.broadcast(asked)

    @F.pandas_udf("double")
    def found(posterior):
        import pandas as pd

        if not len(posterior):
            return pd.Series([], dtype="float64")
        return pd.Series(rates(np.stack(posterior.to_numpy()), shared.value))

    draw = F.pmod(F.xxhash64(row_id.cast("long"), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    mixed = scored.withColumn(rate, found(F.col(given[1])))
    return mixed.withColumn(copies, F.floor(F.col(rate) + draw).cast("int"))
