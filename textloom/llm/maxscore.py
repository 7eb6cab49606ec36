"""Exact top-k by inner product with MaxScore over the components as terms.

A vector is a document whose terms are its non-zero components. A shard of candidates keeps a posting
array for each term and its smallest and largest value, which bound what the term can add to a
query's score. Each query has a running k-th best score. A query's terms are ordered by the spread of
their bounds; the non-essential ones are the longest tail whose upper bounds stay below the running
score together: a document without essential terms can't reach it. The essential postings are traversed for all documents of a block, the others are probed, a group of terms
at a time, only for documents whose score so far plus the remaining bounds still reaches the running
score. Shards return their k best; a merge keeps the k best of all.

Blocks of queries meet shards of candidates by an exchange: every block goes to every shard once and
every shard to every block, both of bounded size. Nothing is collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import columns
from .store import Scratch

#: Numbers in a block of queries and in a shard of candidates, about; candidates traversed at once.
QUERIES, SHARD, TRAVERSED = 1 << 18, 1 << 21, 1 << 12
_ARROW = pa.schema([(n, pa.int64()) for n in ("query_id", "vec_id", "score")])
#: Above this, products are summed as Python integers.
_EXACT = 2.0**52


def quantised(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, as double; rows that are null or hold null or non-finite components are left out.

    A vector without components has no terms: its score with every query is 0.
    """
    x = F.col("v")
    usable = columns(df, vec_id=id_col, v=vector_col).where("vec_id is not null and v is not null")
    usable = usable.withColumn("v", F.transform(x, lambda c: c.cast("double")))
    usable = usable.where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # Past 2 to the 53rd every double is an integer already, and floor of a long would overflow.
    return usable.withColumn("v", F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(F.when(F.abs(c * scale) < 2.0**53, c * scale).otherwise(0.0)).cast("double")).otherwise(c * scale)))


class Shard:
    """Postings of some candidates: one array for each term, absent terms as 0."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(vectors[order].T)
        if len(ids):
            self.least, self.most = self.postings.min(1), self.postings.max(1)
        else:
            self.least = self.most = np.zeros(len(self.postings))
        #: Postings read in traversal and in probing, and all there were.
        self.traversed = self.probed = self.all = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the rows (query number, position, score) of its k best other candidates, ties to the smaller id."""
        terms = len(self.postings)
        q = np.zeros((len(queries), terms))
        width = min(terms, queries.shape[1])
        q[:, :width] = queries[:, :width]
        if np.abs(q).max(initial=0) * max(np.abs(self.least).max(initial=0), np.abs(self.most).max(initial=0)) * max(terms, 1) >= _EXACT:
            return self._plain(q, own, k)
        high = np.maximum(q * self.least, q * self.most)
        low = np.minimum(q * self.least, q * self.most)
        out = [self._one(q[i], int(own[i]), high[i], low[i], k) for i in range(len(q))]
        number = np.repeat(np.arange(len(out)), [len(at) for at, _ in out])
        return number, np.concatenate([at for at, _ in out] or [np.zeros(0, int)]), np.concatenate([s for _, s in out] or [np.zeros(0)])

    def _one(self, q: np.ndarray, own: int, high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        term = np.argsort(low - high, kind="stable")
        q, postings = q[term], self.postings
        # What the terms from each one on can add at most.
        rest = np.append(np.cumsum(high[term][::-1])[::-1], 0.0)
        best_at, best, running = np.zeros(0, np.int64), np.zeros(0), -np.inf
        for begin in range(0, len(self.ids), TRAVERSED if len(self.ids) > TRAVERSED else max(1, len(self.ids))):
            block = slice(begin, min(begin + TRAVERSED, len(self.ids)))
            size = block.stop - block.start
            self.all += size * len(term)
            # Essential: until the rest alone can't reach the running score; bounds may rise where they are negative.
            reach = np.flatnonzero(rest >= running)
            essential = min(int(reach[-1]) + 1, len(term)) if len(reach) else 0
            score = q[:essential] @ postings[term[:essential], block]
            self.traversed += size * essential
            alive = np.flatnonzero((score + rest[essential] >= running) & (self.ids[block] != own))
            score, done = score[alive], essential
            while done < len(term) and len(alive):
                step = slice(done, min(len(term), done + max(2, (len(term) - done) // 3)))
                score = score + q[step] @ postings[np.ix_(term[step], alive + begin)]
                self.probed += len(alive) * (step.stop - done)
                done = step.stop
                keep = score + rest[done] >= running
                alive, score = alive[keep], score[keep]
            if len(alive):
                best_at, best = np.concatenate([best_at, alive + begin]), np.concatenate([best, score])
                # Positions are in the order of ids.
                first = np.lexsort((best_at, -best))[:k]
                best_at, best = best_at[first], best[first]
                running = best[-1] if len(best) == k else -np.inf
        return best_at, best

    def _plain(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple:
        """Components too large for exact sums of doubles: Python integers, all terms."""
        exact = [[int(x) for x in c] for c in self.postings.T]
        out = []
        for i in range(len(q)):
            mine = [int(x) for x in q[i]]
            scored = sorted((-sum(a * b for a, b in zip(mine, c, strict=True)), j) for j, c in enumerate(exact) if self.ids[j] != own[i])[:k]
            out += [(i, j, -s) for s, j in scored]
        return tuple(np.array(x, dtype=object) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def top_k(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k best candidates of each query, ties to the smaller id; a query's own id is no candidate.

    Both tables have (vec_id, v) as ``quantised`` gives them. Vectors of unlike length meet in the terms
    they share. Repeated ids are candidates each. Scores beyond a long fail the job.
    """
    vectors, queries = scratch.keep(vectors, "vectors"), scratch.keep(queries, "queries")

    def parts(df: DataFrame, numbers: int) -> int:
        held = df.agg(F.sum(F.greatest(F.size("v"), F.lit(1))).alias("n")).first()["n"] or 0
        return max(1, -(-held // numbers))

    shards, blocks = parts(vectors, SHARD), parts(queries, QUERIES)
    # By the row's place in the written table, so that repeated rows are divided too.
    turn = F.xxhash64(F.monotonically_increasing_id())
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = vectors.withColumn("shard", F.pmod(turn, F.lit(shards)).cast("int")).withColumn("block", spread(blocks))
    asked = queries.withColumn("block", F.pmod(turn, F.lit(blocks)).cast("int")).withColumn("shard", spread(shards))

    def search(some: pa.Table, those: pa.Table) -> pa.Table:
        if not len(some) or not len(those):
            return _ARROW.empty_table()
        shard = Shard(some.column("vec_id").to_numpy(), _rectangle(some.column("v")))
        own = those.column("vec_id").to_numpy()
        i, at, score = shard.search(_rectangle(those.column("v")), own, k)
        return pa.table([pa.array(own[np.asarray(i, np.int64)], pa.int64()), pa.array(shard.ids[np.asarray(at, np.int64)], pa.int64()), pa.array([int(x) for x in score], pa.int64())], schema=_ARROW)

    met = candidates.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    found = met.applyInArrow(search, "query_id long, vec_id long, score long")
    best = [F.desc("score"), F.asc("vec_id")]
    # Many shards meet in two steps, so that no task gets a query's rows of all shards.
    partial = found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    partial = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*best))).where(F.col("rank") <= k)
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _rectangle(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of the vectors, shorter ones filled with 0."""
    held = vectors.combine_chunks()
    held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
    size = np.diff(held.offsets.to_numpy())
    out = np.zeros((len(size), size.max(initial=0)))
    out[np.arange(out.shape[1]) < size[:, None]] = held.flatten().to_numpy(zero_copy_only=False)
    return out
