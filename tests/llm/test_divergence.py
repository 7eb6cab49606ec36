"""Radix tries against dictionaries, and the audit against whole-number arithmetic over all groups and terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import divergence as dv
from textloom.llm import trie
from textloom.llm.store import Scratch


def made(counters):
    return [([*c], [name], np.arange(len(c)), np.zeros(len(c), np.int64), np.array([*c.values()], np.int64)) for name, c in counters.items()]


def held(t):
    return {(t.paths[a], t.names[g]): int(n) for a, g, n in zip(t.leaf, t.group, t.count, strict=True)}


@pytest.mark.parametrize("width", [1, 2, 3, 9])
def test_tries_merge_as_counters_add(width):
    draw = random.Random(width)
    whole, written = Counter(), defaultdict(list)
    for _ in range(4):
        counters = {(draw.choice("ab"), draw.choice(["x", "y", None])): Counter(bytes(draw.choice(b"\x61\x62\xc3") for _ in range(draw.randrange(7))) for _ in range(200)) for _ in range(4)}
        counters[("a", "x")] = Counter([b"", b"a" * 9000, b"a" * 9000 + b"b"])
        for name, c in counters.items():
            whole.update({(p, name): n for p, n in c.items()})
        for batch in trie.Trie.of(made(counters)).below(width):
            for prefix, parts in trie.read(batch):
                written[prefix].append(parts)
                assert all(p[:width] == prefix for p in parts[0])
    got = {}
    for tries in written.values():
        merged = trie.Trie.of([trie.Trie.of(tries[:2]).parts(), *tries[2:]])
        assert merged.paths == sorted(merged.paths)
        got |= held(merged)
    assert got == whole


def test_common():
    draw = random.Random(1)
    for _ in range(500):
        a, b = (bytes(draw.choice(b"ab") for _ in range(draw.randrange(12))) for _ in range(2))
        n = trie.common(a, b)
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_shares_beyond_64_bits():
    count = np.array([[0, 10**13], [3 * 10**14, 5]])
    got = dv.shares(count, np.array([10**15, 2 * 10**15]), 77)
    assert got.tolist() == [[1 + 10**9 * (int(c) + 2) // (n + 154) for c, n in zip(r, (10**15, 2 * 10**15), strict=True)] for r in count]


def plain(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        within = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in within.items() if n >= least]
        counts = {s: Counter() for s in {d[1] for d in docs if d[0] == lang}}
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if within[t] >= least)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, held, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(held, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_bounds_of_memory_change_nothing(monkeypatch, small):
    """The tasks' own functions in this process: tries written after every chunk, merged one by one, in slices of one term."""
    if small:
        for name, value in (("HELD", 5), ("MERGED", 4), ("CELLS", 1), ("LISTED", 40)):
            monkeypatch.setattr(dv, name, value)
    draw = random.Random(9)
    rows = [(" ".join(draw.choices(["Abc", "abd", "ab", "é", "the"], k=30)), draw.choice(["en", "de"]), draw.choice("stu")) for _ in range(90)]
    tries = []
    for i in range(0, 90, 6):
        batch = pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), r, strict=True)) for r in rows[i : i + 6]])
        tries += [r for b in dv.count_terms([batch]) for r in b.to_pylist()]
    tries.sort(key=lambda r: r["prefix"])
    leaves = list(dv.merge([pa.RecordBatch.from_pylist(tries, trie.SCHEMA)], 10))
    want = Counter((lang, source, t.lower()) for text, lang, source in rows for t in text.split())
    got = {(r["lang"], s, r["term"]): n for b in leaves for r in b.to_pylist() if r["term"] for s, n in zip(r["sources"], r["counts"], strict=True)}
    assert got == want
    totals = {k: sum(n for (a, b, _), n in want.items() if (a, b) == k) for k in sorted({k[:2] for k in want})}
    of = lambda lang: sum(n for k, n in totals.items() if k[0] == lang)
    block = dv.Block([(*k, n, 5, of(k[0])) for k, n in totals.items()])
    found = sorted(tuple(r.values()) for b in dv.compare(leaves, block, block, True, 3) for r in b.to_pylist())
    ranked = plain(rows, 10, 3)
    assert found == sorted(r[:5] for r in ranked if r[2] == "term" or r[1] < r[3])


@pytest.mark.parametrize("block", [512, 2, 3, 5])
def test_against_all_groups_and_terms(spark, block):
    """Blocks that cut languages, long texts and terms, nulls and clashing names."""
    draw = random.Random(block)
    words = ["Abc", "abd", "ab", "a", "été", "漢字", "zİ", "The", "there", "😀x"]
    rows = [(" ".join(draw.choices(words, k=draw.randrange(1, 12))) + draw.choice(["", "-", "\x00", "1"]), draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", None, "é"])) for _ in range(160)]
    rows += [(None, "en", "s4"), ("", "", "s5"), ("rare", "xx", "s1"), ("rarer", "xx", "s2"), ("1 2 3", "yy", "s1"), ("q" * 5000 + " abc " * 400, "en", "s1")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "text string, lang string, source string, value string, rank int").repartition(5)
    got = dv.divergence(df, Scratch(spark, "t"), least=10, top=4, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 10, 4)


def test_empty(spark):
    assert dv.divergence(spark.createDataFrame([], "text string, lang string, source string"), Scratch(spark, "t")).count() == 0
