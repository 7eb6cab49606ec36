"""Near-duplicates by min-max hashing, with every link confirmed on the full shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so
65 permutations give 130 values: 26 bands of 5. At a similarity of 0.85 a pair shares no band with
a chance of about 2e-7. Documents with equal sets become one class first, which takes copies out
of all that follows.

Classes that share a band are candidates. They are joined to the band's smallest class (a star, not
all pairs), and the components of the stars are the clusters outside which no candidate pair lies.
Inside a cluster an inverted index over the full sets counts the exact intersections of every
document with the earlier ones, so that no link is lost; what comes out is one link per document
and component, never the pairs. A cluster above a bound of documents or shingles is cut into
blocks, and each pair of blocks is a task of its own, so memory is bounded whatever the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .arrow import columns, rows
from .components import components
from .store import Scratch
from .textvec import U

PERMUTATIONS, BAND = 65, 5
#: Most documents and shingles of a block, about.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 20
#: Most classes of copies that are broadcast.
HOT = 4096
_draw = np.random.Generator(np.random.PCG64(40487))
_XOR, _ODD = _draw.integers(0, 2**63, PERMUTATIONS, dtype=U), _draw.integers(0, 2**63, PERMUTATIONS, dtype=U) * U(2) + U(1)

_FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
_FEATURES_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(docs: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each document, one after the other, and where each begins (and ends).

    Words are lower-cased in A-Z. A document of fewer words has its whole sequence as one shingle,
    one without words has none.
    """
    buf, at = textvec.joined(docs)
    buf = textvec.translated(buf, textvec.LOWER)
    starts, ends = textvec.word_spans(buf)
    word = textvec.span_hashes(buf, starts, ends)
    ptr = np.searchsorted(starts, at)
    h, first = textvec.windows(word, ptr, words)
    doc = np.searchsorted(ptr, first, "right") - 1
    size = np.diff(ptr)
    short = np.flatnonzero((size > 0) & (size < words))
    if len(short):
        extra = np.empty(len(short), U)
        for i, d in enumerate(short):
            total = size[d : d + 1].astype(U)
            for k in range(ptr[d], ptr[d + 1]):
                total = textvec.mix(total * U(0xD6E8FEB86659FD93) + word[k : k + 1])
            extra[i] = total[0]
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(docs) + 1))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The band hashes of each non-empty set: minimum and maximum under each permutation in turn, ``BAND`` values to a band."""
    begin = at[:-1]
    values = np.empty((2 * PERMUTATIONS, len(begin)), U)
    for k in range(PERMUTATIONS):
        p = (h ^ _XOR[k]) * _ODD[k]
        values[2 * k] = np.minimum.reduceat(p, begin)
        values[2 * k + 1] = np.maximum.reduceat(p, begin)
    bands = values.reshape(-1, BAND, len(begin))
    out = np.arange(len(bands), dtype=U)[:, None] + np.zeros(len(begin), U)
    for k in range(BAND):
        out = textvec.mix(out * U(0xD6E8FEB86659FD93) + bands[:, k])
    return out.T.copy()


def features(df: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and its band keys (null for an empty set)."""

    def compute(batches):
        for part, docs, _ in textvec.chunks(batches):
            h, at = shingle_sets(docs, words)
            n = np.diff(at)
            full = np.flatnonzero(n)
            d1, d2 = np.zeros(len(docs), U), np.zeros(len(docs), U)
            bands: list = [None] * len(docs)
            if len(full):
                edges = at[:-1][full]
                d1[full] = np.add.reduceat(textvec.mix(h), edges)
                d2[full] = np.add.reduceat(textvec.mix(h ^ U(0xA5A5A5A5A5A5A5A5)), edges)
                keys = signatures(h, np.append(edges, len(h))).view(np.int64)
                offsets = np.zeros(len(docs) + 1, np.int32)
                offsets[1:] = np.cumsum((n > 0) * keys.shape[1])
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
            yield rows(_FEATURES_ARROW, doc_id=part.column(0).cast(pa.int64()), n_shingles=n, d1=d1.view(np.int64), d2=d2.view(np.int64), bands=bands)

    return df.mapInArrow(compute, _FEATURES)


def links(h: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Component labels of the documents by all links between ``left`` and ``right`` (numbers of documents).

    Counts exact intersections through an inverted index of the right side.
    """
    n = np.diff(at)
    label = np.arange(len(n))
    values, code = np.unique(h, return_inverse=True)
    member = np.zeros(len(n), bool)
    member[right] = True
    doc = np.repeat(np.arange(len(n)), n)
    inside = member[doc]
    order = np.argsort(code[inside], kind="stable")
    posting = doc[inside][order]
    begin = np.searchsorted(code[inside][order], np.arange(len(values) + 1))
    for i in left:
        own = code[at[i] : at[i + 1]]
        # Long sets go through in parts, so that the gathered postings stay small.
        both = np.zeros(len(n), np.int64)
        for k in range(0, len(own), 4096):
            part = own[k : k + 4096]
            both += np.bincount(posting[textvec.ragged(begin[part], begin[part + 1] - begin[part])], minlength=len(n))
        linked = np.flatnonzero((both > 0) & (100 * both >= percent * (n[i] + n - both)))
        if len(linked):
            old = np.unique(np.append(label[linked], label[i]))
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    return label


def _confirm(words: int, percent: int):
    """Reads rows (unit, side, node, text) in order of unit; yields links (a, b) that span each unit's components."""

    def flush(nodes: list[int], sides: list[int], texts: list[bytes]) -> pa.RecordBatch | None:
        if len(nodes) < 2:
            return None
        h, at = shingle_sets(texts, words)
        side = np.array(sides)
        one = not side.any()
        label = links(h, at, np.arange(len(nodes)) if one else np.flatnonzero(side == 0), np.arange(len(nodes)) if one else np.flatnonzero(side == 1), percent)
        node = np.array(nodes)
        order = np.lexsort((node, label))
        first = np.ones(len(order), bool)
        first[1:] = label[order][1:] != label[order][:-1]
        root = node[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        far = root != node[order]
        return rows(_LINKS_ARROW, a=root[far], b=node[order][far]) if far.any() else None

    def run(batches) -> Iterator[pa.RecordBatch]:
        unit, nodes, sides, texts = None, [], [], []
        for batch in batches:
            units, side, node = (batch.column(i).to_pylist() for i in range(3))
            text = batch.column(3).cast(pa.large_binary() if pa.types.is_large_string(batch.column(3).type) else pa.binary()).to_pylist()
            for u, s, k, t in zip(units, side, node, text, strict=True):
                if u != unit:
                    if (out := flush(nodes, sides, texts)) is not None:
                        yield out
                    unit, nodes, sides, texts = u, [], [], []
                nodes.append(k)
                sides.append(s)
                texts.append(t or b"")
        if (out := flush(nodes, sides, texts)) is not None:
            yield out

    return run


def near_duplicates(df: DataFrame, scratch: Scratch, *, words: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_shingles, component_id, kept.

    Links hold between documents with 100 * intersection >= percent * union of their sets of
    ``words``-word shingles. component_id is the smallest id reachable. Null and empty texts have no
    set and no links. Rows with one id are one document. A row without an id is its component's
    member; alone, it has a null component_id and is kept. An empty table gives an empty result.
    """
    texts = columns(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    table = scratch.keep(features(texts, words), "features")
    sets = table.where("n_shingles > 0")
    # One row for each class, combined before the exchange, so that copies never meet in a task.
    classes = sets.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("doc_id").alias("node"), F.min_by(F.struct("n_shingles", "bands"), "doc_id").alias("own"))
    classes = scratch.keep(classes.select("d1", "d2", "n", "node", "own.*"), "classes")
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    # Fewer than HOT classes have more rows than this.
    often = max(64, total // HOT)
    keyed = classes.where("node is not null").select("node", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").drop("last")
    stars = keyed.join(hubs, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    cluster = components(stars, scratch, "stars")
    members = cluster.unionByName(cluster.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(classes.select("node", "n_shingles").dropDuplicates(["node"]), "node")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = members.select("node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = scratch.keep(
        units.select(
            F.col("node").alias("doc_id"),
            F.struct("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).alias("unit"),
            F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
        ),
        "units",
    )
    members_text = texts.join(units, "doc_id").select(F.xxhash64("unit").alias("unit"), "side", F.col("doc_id").alias("node"), "text")
    found = members_text.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(_confirm(words, percent), "a long, b long")
    linked = components(found, scratch, "links")
    roots = classes.select("d1", "d2", "n", "node").join(linked, "node", "left").select("d1", "d2", "n", F.coalesce("root", "node").alias("component"))
    # Rows of the few hot classes meet their roots by broadcast, so that no task reads a class of copies.
    hot = F.broadcast(roots.where(F.col("n") > often).select("d1", "d2", F.col("component").alias("hot"), F.lit(True).alias("is_hot")))
    met = sets.select("doc_id", "n_shingles", "d1", "d2").join(hot, ["d1", "d2"], "left")
    cold = met.where("is_hot is null").join(roots.where(F.col("n") <= often), ["d1", "d2"], "left").select("doc_id", "n_shingles", "component")
    out = cold.unionByName(met.where("is_hot").select("doc_id", "n_shingles", F.col("hot").alias("component")))
    out = out.unionByName(table.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    component = F.col("component")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))
