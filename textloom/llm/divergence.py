"""Source divergence audit: how far the term shares of sources of one language lie apart, in exact whole numbers.

Tasks count the terms of their documents by (language, source), and the documents that hold a term by language;
when what they hold reaches a bound they write it as radix tries, one below each short prefix. Written tries are
exchanged by ranges of prefixes and merged; terms in enough documents of a language are written as leaves with
their counts by source, in byte order. Totals of the groups follow from the leaves. Groups are then taken in
blocks of ``BLOCK``: a pass over the leaves for each two blocks sums the divergence of every pair of sources and
keeps each source's highest terms, so what is broadcast has a fixed bound however many sources there are.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec, trie
from .arrow import columns
from .store import Scratch

#: Fixed values of the contract: bytes of terms (letters, and all of UTF-8 beyond ASCII), the scale of shares.
TERM, SCALE = re.compile(rb"[A-Za-z\x80-\xff]+"), 10**9
#: Bytes of the prefixes; counters held before they are written, and merged at once; groups of a block; cells of a matrix.
WIDTH, HELD, MERGED, BLOCK, CELLS = 3, 600_000, 300_000, 512, 1 << 19
#: Longest text whose terms are listed at once.
LISTED = 1 << 20


def count_terms(batches):
    """Written tries of the batches' terms; the root's counters are the documents of each group."""
    tallies: dict[tuple[str, str | None], Counter] = {}
    for part, texts, _ in textvec.chunks(batches):
        for text, lang, source in zip(texts, part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True):
            group, whole = tallies.setdefault((lang, source), Counter()), tallies.setdefault((lang, None), Counter())
            text = text.translate(textvec.LOWER.tobytes())
            if len(text) <= LISTED:
                terms = TERM.findall(text)
                group.update(terms)
                whole.update(set(terms))
            else:
                own = Counter(m[0] for m in TERM.finditer(text))
                group.update(own)
                whole.update(own.keys())
            group[b""] += 1
        if sum(map(len, tallies.values())) > HELD:
            yield from written(tallies)
            tallies = {}
    if tallies:
        yield from written(tallies)


def written(tallies: dict[tuple[str, str | None], Counter]):
    made = []
    for name, counter in tallies.items():
        n = len(counter)
        made.append((list(counter), [name], np.arange(n), np.zeros(n, np.int64), np.fromiter(counter.values(), np.int64, n)))
    yield from trie.Trie.of(made).below(WIDTH)


def merge(batches, least: int):
    """Kept leaves of the tries, which come in order of their prefix: lang, term, sources, counts. The root is always kept.

    Neighbouring prefixes are merged together; what lies below one that is larger by itself is merged as it comes.
    """
    held, size, before = [], 0, None
    for batch in batches:
        for prefix, parts in trie.read(batch):
            if size > MERGED:
                if prefix != before:
                    yield from _leaves(trie.Trie.of(held), least)
                    held, size = [], 0
                else:
                    held = [trie.Trie.of(held).parts()]
                    size = 0
            before = prefix
            held.append(parts)
            size += len(parts[4])
    if held:
        yield from _leaves(trie.Trie.of(held), least)
    textvec.trim()


def _leaves(t: trie.Trie, least: int):
    langs = sorted({x[0] for x in t.names})
    lang = np.array([langs.index(x[0]) for x in t.names], np.int64)[t.group]
    of_lang = np.array([x[1] is None for x in t.names])[t.group]
    key = t.leaf * len(langs) + lang
    root = np.array([p == b"" for p in t.paths])[t.leaf]
    kept = np.unique(key[of_lang & (t.count >= least) | root & ~of_lang])
    at = np.flatnonzero(~of_lang & np.isin(key, kept))
    # Counters are in order of the leaf, then of the group's language and source: a key's are neighbours.
    first = np.flatnonzero(np.concatenate([[True], key[at][1:] != key[at][:-1]])) if len(at) else at
    offsets = pa.array(np.concatenate([first, [len(at)]]).astype(np.int32))
    if len(at):
        sources = pa.ListArray.from_arrays(offsets, pa.array([t.names[g][1] for g in t.group[at]], pa.string()))
        counts = pa.ListArray.from_arrays(offsets, pa.array(t.count[at], pa.int64()))
        keys = key[at][first]
        terms = pa.array([t.paths[k // len(langs)] for k in keys], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([langs[k % len(langs)] for k in keys], pa.string()), terms, sources, counts], names=["lang", "term", "sources", "counts"])


def shares(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """p of the contract; where 64 bits do not hold the product, by Python's whole numbers."""
    if not count.size:
        return count
    if int(count.max()) + 2 > (2**63 - 1) // SCALE:
        count, total = count.astype(object), np.asarray(total, object)
    return (1 + SCALE * (count + 2) // (total + 2 * kept)).astype(np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Block:
    """Groups of a block by language: sources, their totals, and the language's."""

    def __init__(self, groups: list[tuple[str, str, int, int, int]]):
        self.langs: dict[str, tuple[list[str], np.ndarray, int, int]] = {}
        for lang in dict.fromkeys(g[0] for g in groups):
            own = [g for g in groups if g[0] == lang]
            self.langs[lang] = [g[1] for g in own], np.array([g[2] for g in own], np.int64), own[0][3], own[0][4]

    def counts(self, lang: str, rows: pa.RecordBatch) -> np.ndarray:
        """Terms by sources."""
        sources = self.langs[lang][0]
        out = np.zeros((rows.num_rows, len(sources)), np.int64)
        lists = rows.column("sources")
        at = pc.index_in(lists.flatten(), value_set=pa.array(sources, pa.string())).fill_null(-1).to_numpy()
        row = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
        seen = at >= 0
        out[row[seen], at[seen]] = rows.column("counts").flatten().to_numpy()[seen]
        return out


def compare(batches, a: Block, b: Block, same: bool, top: int):
    """Partial sums of the pairs of a source in ``a`` and one in ``b``, and the highest terms of those in ``a`` if both are one.

    The task that meets the root of a language gives all its pairs, so that pairs without a term are there too.
    """
    langs = [x for x in a.langs if x in b.langs]
    sums = {x: np.zeros((len(a.langs[x][0]), len(b.langs[x][0])), np.int64) for x in langs}
    rooted, best = set(), {}
    for batch in batches:
        column = batch.column("lang").to_numpy(zero_copy_only=False)
        for lang in langs:
            own = batch.filter(pa.array(column == lang))
            is_root = pc.equal(own.column("term"), "")
            if pc.any(is_root).as_py():
                rooted.add(lang)
            own = own.filter(pc.invert(is_root))
            step = max(1, CELLS // max(sums[lang].shape))
            for start in range(0, own.num_rows, step):
                _pass(own.slice(start, step), lang, a, b, same, top, sums[lang], best)
    made = []
    for lang, found in sums.items():
        for i, source in enumerate(a.langs[lang][0]):
            for j in range(i + 1 if same else 0, found.shape[1]):
                if found[i, j] or lang in rooted:
                    made.append((lang, source, "pair", b.langs[lang][0][j], int(found[i, j])))
    made += [(lang, source, "term", term, -value) for (lang, source), held in best.items() for value, term in held]
    for i in range(0, len(made), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*made[i : i + 10_000], strict=True)], names=["lang", "source", "part", "item", "value"])


def _pass(rows: pa.RecordBatch, lang: str, a: Block, b: Block, same: bool, top: int, sums: np.ndarray, best: dict) -> None:
    sources, totals, kept, total = a.langs[lang]
    count = a.counts(lang, rows)
    p = shares(count, totals, kept)
    q = p if same else shares(b.counts(lang, rows), b.langs[lang][1], kept)
    for i in range(len(sources)):
        start = i + 1 if same else 0
        sums[i, start:] += apart(p[:, i : i + 1], q[:, start:]).sum(axis=0)
    if not same:
        return
    lists = rows.column("counts")
    row = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
    of_lang = np.zeros(rows.num_rows, np.int64)
    np.add.at(of_lang, row, lists.flatten().to_numpy())
    whole = shares(of_lang, total, kept)
    value = apart(p, whole[:, None])
    fits = (count > 0) & (p > whole[:, None])
    for i, source in enumerate(sources):
        at, held = np.flatnonzero(fits[:, i]), best.get((lang, source), [])
        own = value[at, i]
        if len(at) > top:
            at, own = at[least := own >= np.partition(own, -top)[-top]], own[least]
        if len(held) == top:  # those that tie with the last may come before it in byte order
            at, own = at[least := own >= -held[-1][0]], own[least]
        if len(at):
            terms = rows.column("term").take(pa.array(at)).cast(pa.binary()).to_pylist()
            merged = sorted([(v, t.encode()) for v, t in held] + list(zip((-own).tolist(), terms, strict=True)))[:top]
            best[lang, source] = [(v, t.decode()) for v, t in merged]


def divergence(df: DataFrame, scratch: Scratch, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, top: int = 10, block: int = BLOCK) -> DataFrame:
    """Ranked divergences: lang, source, part, item, value, rank.

    Part ``pair`` has each other source of the language, summed over the terms in at least ``least`` of its
    documents; part ``term`` the ``top`` terms of which the source has a larger share than its language. Null
    texts, languages and sources are empty strings; each row is a document, repeated ones too. A language without
    such terms has pairs of value 0 and no terms; a language of one source has no pairs. An empty table gives none.
    """
    spark = df.sparkSession
    slim = columns(df, text=text_col, lang=lang_col, source=source_col)
    slim = slim.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    tries = scratch.keep(slim.mapInArrow(count_terms, trie.KINDS), "tries")
    ranged = tries.repartitionByRange("prefix").sortWithinPartitions("prefix")
    kinds = "lang string, term string, sources array<string>, counts array<long>"
    leaves = scratch.keep(ranged.mapInArrow(lambda batches: merge(batches, least), kinds), "leaves")
    scratch.drop("tries")

    by_source = leaves.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    by_source = by_source.groupBy("lang", F.col("x.sources").alias("source")).agg(F.coalesce(F.sum(F.when(F.col("term") != "", F.col("x.counts"))), F.lit(0)).alias("n"))
    kept = leaves.groupBy("lang").agg(F.sum(F.when(F.col("term") != "", 1).otherwise(0)).alias("kept"))
    by_source = scratch.keep(by_source, "sources")
    totals = by_source.groupBy("lang").agg(F.sum("n").alias("total")).join(kept, "lang")
    groups = scratch.keep(by_source.join(totals, "lang").select("lang", "source", "n", "kept", "total"), "groups")

    def blocks(start: int, after: tuple | None):
        """Numbered blocks in order, from the group after ``after``."""
        while True:
            rest = groups if after is None else groups.where((F.col("lang") > after[0]) | (F.col("lang") == after[0]) & (F.col("source") > after[1]))
            own = [tuple(r) for r in rest.orderBy("lang", "source").limit(block).collect()]
            if not own:
                return
            yield start, own
            start, after = start + 1, own[-1][:2]
            if len(own) < block:
                return

    def passed(i: int, a: list[tuple], j: int, b: list[tuple]) -> DataFrame:
        pair = spark.sparkContext.broadcast((Block(a), Block(b)))
        asked = leaves.where(F.col("lang").isin(*sorted({g[0] for g in a} & {g[0] for g in b})))
        found = asked.mapInArrow(lambda batches: compare(batches, *pair.value, i == j, top), "lang string, source string, part string, item string, value long")
        return scratch.keep(found, f"compared/{i}-{j}")

    found = None
    for i, a in blocks(0, None):
        found = passed(i, a, i, a)
        if len(a) == block:
            for j, b in blocks(i + 1, a[-1][:2]):
                if b[0][0] > a[-1][0]:
                    break  # later blocks have other languages only
                passed(i, a, j, b)
    if found is None:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    found = spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(f"{scratch.root}/compared")
    half = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = half.select("lang", "part", "value", F.explode(ends).alias("x")).select("lang", "x.source", "part", "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
