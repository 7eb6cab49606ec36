"""The operators against brute force, exact round trips and held-out labels on small tables with awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import license_scan, maxscore, minmax_dedup, ngrams, packing, quality, sharding, textvec, token_codec, token_counts
from textloom.llm import queries as q
from textloom.llm.store import Scratch
from textloom.llm.wordbpe import WordBpe

TEXTS = [None, "", " \n ", "one two", "Don't we'll 'tis 12 ÀÉ×", "a b c d e f " * 40, "Ünïcode ½ ñ 中文 <|endoftext|>", "x" * 3000, "word " * 3000, "same text here for all", "same text here for all"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src", f"en{i}") for i, t in enumerate(TEXTS)] + [(9, TEXTS[9], "src", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, size string").repartition(3)


@pytest.fixture(scope="module")
def bpe():
    return WordBpe.at(q.tokenizer_path())


def library(bpe, text):
    return bpe.library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(bpe):
    draw = random.Random(1)
    texts = ["".join(draw.choices("abcstmdrevl ABCÀÉÖß×÷éü'\"!?.,0123\n\t½中<|", k=draw.randint(0, 50))) for _ in range(3000)] + [t or "" for t in TEXTS]
    ids, at = bpe.ids([t.encode() for t in texts])
    assert all(ids[at[i] : at[i + 1]].tolist() == library(bpe, t) for i, t in enumerate(texts))


def test_prefix_counts(bpe):
    for t in ("Don't we'll go-thing, unbelievably!!", "étranges ÀÖ it's'll 12ab"):
        table = token_counts.PrefixTable(bpe, t.encode())
        for n in range(len(t) + 1):
            assert table.at(len(t[:n].encode())) == len(library(bpe, t[:n]))


def test_counts(spark, docs, bpe):
    got = token_counts.count_tokens(docs, q.tokenizer_path(), budget=100).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        t = (TEXTS[r["doc_id"]] or "").encode()
        assert r["n_tokens"] == len(library(bpe, TEXTS[r["doc_id"]])) and r["n_bytes"] == len(t)
        assert len(library(bpe, t[: r["fit_bytes"]].decode())) <= 100
    assert token_counts.count_tokens(docs.limit(0), q.tokenizer_path()).count() == 0


def test_fit_is_the_longest_prefix(bpe):
    draw = random.Random(8)
    texts = ["a" * 700, "unbelievably" * 60, "?!*" * 200, "中文字符很长的一段话没有空格" * 15, "mixed 中文ünd İx e\u0301te\u0301 don't we'll <|endoftext|>\u3000½ñ!! " * 8, "e\u0301o\u0308" * 60, "ends in a run " + "xyz" * 180]
    texts += ["".join(draw.choices("abcst ÀÉöß'\"!?0 中文ñ\u0301\n", k=200)) for _ in range(20)]
    for t in texts:
        table = token_counts.PrefixTable(bpe, t.encode())
        counts = [len(library(bpe, t[:n])) for n in range(len(t) + 1)]
        assert table.total() == counts[-1]
        assert [table.at(len(t[:n].encode())) for n in range(0, len(t) + 1, 7)] == counts[::7]
        for budget in {1, 50, 100, max(counts[-1] - 1, 1)}:
            want = len(t) if counts[-1] <= budget else max([n for n in range(1, len(t) + 1) if counts[n] <= budget and not t[n - 1].isspace()], default=0)
            assert table.fit(budget) == len(t[:want].encode()), (t[:30], budget)


def test_prefixes_of_composing_characters(bpe):
    """Every prefix of words whose characters compose, equal to encoding it; long words take no time that grows with the square."""
    import random
    import time
    import unicodedata

    draw = random.Random(11)
    pool = [unicodedata.normalize("NFD", c) for c in "éạüÅ가한Ñ"] + ["x", "q", "ß", "I", "\u3131"]
    for _ in range(60):
        part = "".join(draw.choices(pool, k=draw.randrange(6, 24)))
        assert token_counts.composed_prefixes(bpe, part) == [len(bpe.whole(part[:k].encode())) for k in range(1, len(part) + 1)], part
        table = token_counts.PrefixTable(bpe, part.encode())
        assert [table.at(len(part[:k].encode())) for k in range(1, len(part) + 1)] == [len(bpe.whole(part[:k].encode())) for k in range(1, len(part) + 1)]
        for budget in (1, 3, 7):
            fits = [k for k in range(len(part) + 1) if len(bpe.whole(part[:k].encode())) <= budget]
            assert len(part.encode()) if max(fits) == len(part) else table.fit(budget) == len(part[: max(fits)].encode())
    began = time.process_time()
    for word in ("e\u0301" * 30_000, "a" + "\u0301" * 30_000):
        table = token_counts.PrefixTable(bpe, word.encode())
        cut = word.encode()[: table.fit(2048)].decode()
        assert len(bpe.whole(cut.encode())) <= 2048 < len(bpe.whole(word[: len(cut) + 2].encode()))
    assert time.process_time() - began < 60


def test_prefixes_of_long_runs_need_no_memory(bpe, monkeypatch):
    import base64
    import time

    draw = random.Random(9)
    run, began = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=20000)), time.time()
    table = token_counts.PrefixTable(bpe, run.encode())
    fit = table.fit(2048)
    assert len(library(bpe, run[:fit])) <= 2048 < min(len(library(bpe, run[: fit + k])) for k in range(1, 40)) and time.time() - began < 60
    text = base64.b64encode(draw.randbytes(9000)).decode()
    table = token_counts.PrefixTable(bpe, text.encode())
    fit = table.fit(500)
    assert len(library(bpe, text[:fit])) <= 500 < min(len(library(bpe, text[: fit + k])) for k in range(1, 40))
    # With room for next to no pairs the answers are the same.
    word = "unbelievably" * 3 + "straße"
    want = [len(library(bpe, word[:n])) for n in range(1, len(word) + 1)]
    monkeypatch.setattr(token_counts._Entries, "PAIRS", 2)
    bpe.__dict__.pop("_entries", None)
    ends, tokens = token_counts.PrefixTable(bpe, word.encode()).inside(1)
    assert tokens.tolist() == want and len(ends) == len(word)
    bpe.__dict__.pop("_entries", None)


@pytest.mark.parametrize("n", [0, 1, 2, 257, 5000])
def test_codec(n):
    for ids in (np.random.default_rng(n).integers(0, 65536, n), np.zeros(n, int), np.arange(n) % 7):
        assert (token_codec.decode_ids(token_codec.encode_ids(ids), n) == ids).all()
    block = token_codec.encode_block(np.arange(n), [1, None], [n, 0], 3, 4)
    ids, keys, sizes, first, begun = token_codec.decode_block(block)
    assert ids.tolist() == list(range(n)) and keys == [1, None] and sizes.tolist() == [n, 0] and (first, begun) == (3, 4)
    if n:
        with pytest.raises(ValueError):
            token_codec.decode_block(block[:-1] + bytes([block[-1] ^ 1]))
    assert token_codec.crc32_join(zlib.crc32(b"a" * n), zlib.crc32(b"bc"), 2) == zlib.crc32(b"a" * n + b"bc")


def test_files(spark, docs, bpe, monkeypatch):
    got = token_codec.read_ids(token_codec.write_ids(docs, q.tokenizer_path(), 1, Scratch(spark, "t"))).orderBy("start").collect()
    start = 0
    for r in got:
        ids = library(bpe, TEXTS[r["doc_id"]]) + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r["doc_id"] for r in got] == sorted([*range(len(TEXTS)), 9])


def test_files_of_one_row_many_times(spark):
    df = spark.createDataFrame([(7, "the same row")], "doc_id long, text string").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(20000)))).drop("x").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = token_codec.write_ids(df, q.tokenizer_path(), 1, Scratch(spark, "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n"] for r in blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_codec.read_ids(blocks).collect())
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
    assert got == [(k * got[0][2], 7, got[0][2]) for k in range(20000)]


def test_packing(spark, docs):
    got = packing.pack(docs, q.tokenizer_path(), 0, Scratch(spark, "t"), packing.Capacity(tokens=64, documents=5, attention=3000)).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 64 and len(held) <= 5 and sum(n * n for _, n in held) <= 3000
    assert packing.pack(docs.limit(0), q.tokenizer_path(), 0, Scratch(spark, "t")).count() == 0


def test_plan_is_tight():
    draw = np.random.default_rng(2)
    sizes = draw.integers(1, 400, 20000)
    plan = packing.plan_bins(dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)], strict=True)), packing.Capacity())
    assert plan.bins == -(-int(sizes.sum()) // 2048)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_against_item_by_item_packing(rule):
    draw = np.random.default_rng(3)
    for _ in range(30):
        sizes = sorted(draw.integers(1, 40, draw.integers(1, 60)).tolist(), reverse=True)
        limit, weight = np.array([50, 7, 1700]), np.array([1.0, 0.37, 0.71])
        bins = []
        for size in sizes:
            need = np.array([size, 1, size * size])
            open_ = [(b, limit - np.sum([[x, 1, x * x] for x in b], axis=0)) for b in bins]
            fits = [(float((weight * (((r - need) / limit) ** 2 if rule == "norm" else -(r / limit) * (need / limit))).sum()), b) for b, r in open_ if (r >= need).all()]
            if fits:
                min(fits, key=lambda x: x[0])[1].append(size)
            else:
                bins.append([size])
        histogram = {x: sizes.count(x) for x in set(sizes)}
        plan = packing.plan_bins(histogram, packing.Capacity(50, 7, 1700, tuple(weight), rule))
        got = {}
        for size, n in histogram.items():
            for b in plan.place(np.full(n, size), np.arange(n))[0]:
                got.setdefault(int(b), []).append(size)
        assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in bins)


def test_packing_one_row_many_times(spark):
    df = spark.createDataFrame([(7, "the same row")], "doc_id long, text string").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(30000)))).repartition(4)
    got = packing.pack(df, q.tokenizer_path(), 0, Scratch(spark, "t"))
    n = got.first()["length"]
    assert got.count() == 30000 and got.select("sequence_id", "offset").distinct().count() == 30000
    assert got.agg(F.countDistinct("sequence_id").alias("n")).first()["n"] == -(-30000 // (2048 // n))


def test_shards(spark):
    rows = [(i, f"text {i % 300} " * (1 + i % 9)) for i in range(2000)] + [(5000 + i, "hot") for i in range(1000)] + [(9000, None), (9001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    got = sharding.shard_by_size(df, size, 8, Scratch(spark, "t")).collect()
    total, slots = {}, {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + len((r["text"] or "").encode()) + 16
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(total.values()) / 8
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(total.values()) < 1.05 * mean and min(total.values()) > 0.95 * mean
    assert sharding.shard_by_size(df.limit(0), size, 8, Scratch(spark, "t")).count() == 0


def placed_well(got, rows, shards, near=0.05):
    total, slots = {}, {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + len((r["text"] or "").encode()) + 16
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(total.values()) / shards
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(total) == shards and max(total.values()) < (1 + near) * mean and min(total.values()) > (1 - near) * mean


def test_shards_of_one_row_many_times_and_clashing_columns(spark):
    rows = [(i, f"text {i}", i, i, i, i) for i in range(2000)] + [(7, "the same row", 0, 0, 0, 0)] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, at long, shard long, size long").repartition(5)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    got = sharding.shard_by_size(df, size, 8, Scratch(spark, "t"))
    assert sorted(got.columns) == sorted([*df.columns, "slot"])
    placed_well(got.collect(), rows, 8)


def test_ranges_beyond_the_drivers_are_cut_by_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_RANGE", 20)
    monkeypatch.setattr(sharding, "_RANGES", 8)
    rows = [(i, f"text {i % 700} " * (1 + i % 3)) for i in range(3000)] + [(9000 + i, "hot") for i in range(500)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_by_size(df, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, 4, Scratch(spark, "t")).collect()
    placed_well(got, rows, 4)
    copies = {}
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        copies.setdefault(r["text"], []).append((r["shard"], r["slot"]))
    # Copies are neighbours in a shard.
    for held in copies.values():
        assert all(b[0] != a[0] or b[1] == a[1] + 1 for a, b in zip(held, held[1:], strict=False))


def test_near_duplicates_against_all_pairs(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.randint(3, 120))]
        for _ in range(6):
            own = list(base)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = draw.choice(words)
            texts.append(" ".join(own))
    texts += [None, "", "  ", "A b", "a B", "a b c"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in minmax_dedup.near_duplicates(df, Scratch(spark, "t")).collect()}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root[i], root[i] == i)
    assert minmax_dedup.near_duplicates(df.limit(0), Scratch(spark, "t")).count() == 0


def test_blocks_of_a_hot_cluster_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "BLOCK_DOCS", 3)
    base = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(i, " ".join(base[: 50 + i] + [f"x{i}"] + base[50 + i :])) for i in range(20)], "doc_id long, text string")
    assert {r["component_id"] for r in minmax_dedup.near_duplicates(df, Scratch(spark, "t")).collect()} == {0}


def test_hot_copies_and_empty_texts(spark):
    rows = [(i, "one two three four five six") for i in range(50, 450)] + [(i, None if i % 2 else " ") for i in range(1000, 1300)] + [(i, f"w{i} x y z v u") for i in range(30)] + [(None, "one two three four five six"), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minmax_dedup.near_duplicates(df, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["n_shingles"] == 0 or r["doc_id"] is not None and r["doc_id"] < 30:
            assert (r["component_id"], r["kept"]) == (r["doc_id"], True)
        elif r["doc_id"] is not None:
            assert (r["component_id"], r["kept"]) == (50, r["doc_id"] == 50)
    assert sorted((r["component_id"] or 0, r["kept"]) for r in got if r["doc_id"] is None) == [(0, True), (50, False)]


def test_components_of_stars_and_chains(spark):
    from textloom.llm.components import components

    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(1040, 150), (5, 5), (7001, 7000), (7000, 7002)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3), Scratch(spark, "t"), "x")
    assert {r["node"]: r["root"] for r in got.collect()} == {**{i: 0 for i in [*range(1, 300), *range(1000, 1041)]}, 7001: 7000, 7002: 7000}


def test_top_k(spark):
    draw = np.random.default_rng(3)
    vectors = [[float(x) for x in draw.normal(size=6)] for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(400, vectors[3]), (500, None), (600, [float("nan")] * 6), (700, [None] * 6), (800, [0.5])]
    v = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = maxscore.top_k(v, v.where("vec_id % 50 = 0"), Scratch(spark, "t")).collect()
    exact = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows[:301] + rows[-1:]}
    for query in (0, 50, 400, 800):
        scored = sorted((-sum(a * b for a, b in zip(exact[query], e, strict=False)), i) for i, e in exact.items() if i != query)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == query) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]


def test_top_k_prunes_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(maxscore, "TRAVERSED", 64)
    draw = np.random.default_rng(6)
    # Sizes fall off by term, as after a rotation onto principal axes; many ties.
    vectors = np.floor(draw.normal(size=(1500, 24)) * 40 / (1 + np.arange(24)))
    vectors[700:720] = vectors[3]
    ids = draw.permutation(5000)[:1500]
    shard = maxscore.Shard(ids, vectors)
    i, at, score = shard.search(vectors[:40], ids[:40], 5)
    for n in range(40):
        want = sorted((-float(vectors[n] @ v), int(d)) for d, v in zip(ids, vectors, strict=True) if d != ids[n])[:5]
        assert [(-s, int(shard.ids[p])) for s, p in zip(score[i == n], at[i == n], strict=True)] == want
    assert shard.traversed + shard.probed < 0.8 * shard.all


def test_top_k_of_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 300)
    monkeypatch.setattr(maxscore, "QUERIES", 40)
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 5)]) for i in range(400)] + [(7, [1.0] * 5)] * 200
    v = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    got = maxscore.top_k(v, v.where("vec_id % 20 = 0"), Scratch(spark, "t")).collect()
    for query, own in rows[:400:20]:
        want = sorted((-int(np.dot(own, e)), i) for i, e in rows if i != query)[:5]
        assert sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == query) == [(n + 1, *x) for n, x in enumerate(want)]
    assert maxscore.top_k(v.limit(0), v.limit(0), Scratch(spark, "t")).count() == 0


def test_base_counts():
    text = "a b\na b\n\n#x $y\na b c d e f g h a b c d e f g h"
    c = quality.base_counts([text.encode(), b"", b"\n\n"])
    assert [x.tolist() for x in c.values()] == [[22, 0, 0], [sum(map(len, text.split())), 0, 0], [2, 0, 0], [1, 0, 0], [16, 0, 0]]


def test_classifier_learns_rare_marks():
    draw = random.Random(7)
    make = lambda bad: " ".join(draw.choice("one two three four five six".split()) for _ in range(60)) + (" %%% $$$" if bad else "")
    y = np.array([i % 4 != 0 for i in range(240)], np.int64)
    docs = [make(k == 0).encode() for k in y]
    model = ngrams.calibrate(ngrams.fit(docs[:160], y[:160], 2), docs[160:200], y[160:200])
    assert ((model.probabilities(docs[200:])[:, 1] > 0.5) == y[200:]).mean() > 0.95


def test_licenses():
    m = license_scan.Matcher(license_scan.TEMPLATES)
    doc = b"Some text. Released under the MIT License.\nMore text here."
    spans = license_scan.blocks(doc)
    assert [doc[a:b] for a, b in spans] == [b"Released under the MIT License."]
    assert m.match(doc[slice(*spans[0])])[0] == "MIT" and m.match(b"Licensed under CC BY-NC 4.0.")[0] == "CC-BY-NC-4.0"
    name, *_, exact, missing, extra = m.match(b"This work is licensed under the GNU General Public Licence, version 3.")
    assert name == "GPL-3.0" and not exact and missing == ["license"] and extra == ["licence"]
    assert m.match(b"the license plate of a car") is None and license_scan.blocks(b"") == []


def test_wrapped_licenses():
    import textwrap

    m = license_scan.Matcher(license_scan.TEMPLATES)
    for name in ("Apache-2.0-header", "MIT-text", "GPL-3.0-header", "BSD-3-Clause"):
        for width, mark in ((72, ""), (60, "# "), (40, " * ")):
            lines = textwrap.wrap(license_scan.TEMPLATES[name], width, break_long_words=False, break_on_hyphens=False)
            lines.insert(len(lines) // 2, "")
            doc = ("Füller words before it.\n\n" + "\n".join(mark + x for x in lines) + "\n\nWords after it.\n").encode()
            ((a, b, got),) = m.notices(doc)
            assert got[0] == name and not got[5] and set(got[6]) <= {mark.strip()}
            assert doc[a:b].decode().split()[-1] == lines[-1].split()[-1] and lines[0] in doc[a:b].decode()


def test_every_license_of_a_block():
    m = license_scan.Matcher(license_scan.TEMPLATES)
    T = license_scan.TEMPLATES
    for names in (["all-rights-reserved", "Apache-2.0"], ["MIT", "MIT"], ["CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0"], ["MIT-text", "Apache-2.0-header", "MIT"], ["MIT"] * 50):
        for between in ("\n", " or ", "\n\nSome words.\n"):
            doc = ("Title. " + between.join(T[n] for n in names)).encode()
            got = m.notices(doc)
            assert [x[0] for *_, x in got] == names and all(not x[5] for *_, x in got)
            assert all(T[n].encode() in doc[a:b] for n, (a, b, _) in zip(names, got, strict=True))
            assert all(b <= a for (_, b, _), (a, _, _) in zip(got, got[1:], strict=False))


def test_a_place_that_lacks_what_it_may_still_holds_a_mark():
    m = license_scan.Matcher(license_scan.TEMPLATES)
    for name, words in m.words.items():
        marks, may = license_scan.marks(words), int(license_scan.MISSING * len(words))
        # The worst places: as many marks go as may go.
        gone, left = may, []
        for w in words:
            if w in marks and gone:
                gone -= 1
            else:
                left.append(w)
        text = " ".join(["some"] * 20 + left + ["words"] * 20).encode()
        assert license_scan.blocks(text, m.marker), name
        assert license_scan.regions(text, m.reach, m.marker) == [(0, len(text))]


def test_scan_of_awkward_rows_against_every_window(spark):
    m = license_scan.Matcher(license_scan.TEMPLATES)
    draw, rows = random.Random(11), [(1, None, "x"), (2, "", "x"), (None, "All rights reserved.", "x"), (3, "All rights reserved.", "x"), (3, "All rights reserved.", "x"), (4, "word " * 30000, "x")]
    for i in range(10, 60):
        name = draw.choice(m.names)
        own = license_scan.TEMPLATES[name].split()
        if draw.random() < 0.4:
            own[draw.randrange(len(own))] = "zzz"
        rows.append((i, " ".join(["lorem ipsum dolor."] * draw.randint(0, 9) + own + ["Sit amet."] * draw.randint(0, 9)), "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, license string").repartition(3)
    got = license_scan.scan_licenses(df).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(r)
    assert len(found[3]) == 2 and len(found[None]) == 1 and not {1, 2, 4} & set(found)
    for i, text, _ in rows[6:]:
        words = [w.lower() for w in license_scan._WORD.findall(text)]
        # By brute force: the fewest words of a template that any window of its length or one less lacks.
        lacks = {}
        for name, own in m.words.items():
            for size in (len(own), len(own) - 1):
                for k in range(max(1, len(words) - size + 1)):
                    missing, _ = license_scan.differences(own, words[k : k + size])
                    lacks[name] = min(lacks.get(name, (9, 0)), (len(missing) / len(own), -len(own)))
        best = min(lacks.values())
        if best[0] <= license_scan.MISSING:
            assert len(found[i]) == 1 and lacks[found[i][0]["license"]][0] <= license_scan.MISSING
            assert found[i][0]["exact"] == (best[0] == 0 and "zzz" not in words)
        else:
            assert i not in found
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_chunks_cover_everything():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a" * 10, None, "b" * 10])], names=["doc_id", "text"])
    assert [x for _, docs, _ in textvec.chunks([batch], limit=8) for x in docs] == [b"a" * 10, b"", b"b" * 10]


def test_languages_held_out_and_awkward_rows(spark):
    got = q.op1_language_mixture(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_mixtures_against_all_sets_and_small_shares(spark):
    from itertools import combinations

    from textloom.llm.lang_id import ROUNDS, WINDOW, Languages, window_codes

    draw, names = random.Random(12), ["aa", "bb", "cc"]
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    make = lambda k, n: " ".join("".join(draw.choices(letters[k], k=5)) for _ in range(n))
    counts = np.stack([np.bincount(window_codes([make(k, 4000).encode()])[0], minlength=1 << 15) for k in names], 1).astype(float)
    model = Languages(names, counts)
    for text in (make("aa", 50), make("aa", 30) + " " + make("bb", 20), make("bb", 40) + " " + make("cc", 40) + " " + make("aa", 40), make("aa", 4000) + " " + make("cc", 30)):
        codes, _ = window_codes([text.encode()])
        best = None
        for size in (1, 2, 3):
            for own in combinations(range(3), size):
                share = np.full(size, 1 / size)
                for _ in range(ROUNDS * 20):
                    p = model.share[codes][:, own] * share
                    share = (p / p.sum(1, keepdims=True)).mean(0)
                value = np.log((model.share[codes][:, own] * share).sum(1)).sum() / WINDOW - 0.5 * np.log(max(len(codes) / WINDOW, 2)) * size
                best = max(best or (-np.inf,), (value, own, share))
        chosen, shares = model.mixture(codes)
        assert sorted(chosen) == list(best[1]) and np.allclose(shares, [best[2][best[1].index(c)] for c in chosen], atol=0.01)
    # The last text has less than one part in a hundred of its third language, and it is found.
    assert len(chosen) == 2 and shares[1] < 0.01


def test_languages_of_a_sample_with_repeated_ids(spark):
    from textloom.llm.lang_id import fit_languages, infer_languages

    texts = {"aa": "the cat sat on the mat and the dog", "bb": "zorqu vexil klamp druun pozzik wravel"}
    rows = [(1, texts["aa"], "aa")] * 300 + [(i, texts["bb"], "bb") for i in range(2, 200)] + [(None, "x", "aa"), (500, None, "bb"), (501, "12 ! 3", None), (502, "", "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for sample in (1, 40):
        model = fit_languages(table, sample=sample)
        assert model.names == ["aa", "bb"]
        found = {(r.doc_id, r.lang_pred) for r in infer_languages(table, model).collect()}
        assert {(1, "aa"), (7, "bb"), (500, "und"), (501, "und"), (502, "und")} <= found
    assert fit_languages(table.limit(0)) is None
    assert infer_languages(table.limit(0), None).count() == 0


def test_shards_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_RANGE_BYTES", 500)
    rows = [(i, f"text {i % 300} " * (1 + i % 9)) for i in range(900)] + [(5000 + i, "hot") for i in range(600)] + [(9000, None), (9001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_by_size(df, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, 4, Scratch(spark, "t")).collect()
    total, slots = {}, {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + len((r["text"] or "").encode()) + 16
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(total.values()) / 4
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(total) == 4 and max(total.values()) < 1.05 * mean and min(total.values()) > 0.95 * mean


def test_places_find_what_was_added():
    from textloom.llm.wordbpe import _Places

    draw, places, all_keys = np.random.default_rng(5), _Places(), np.zeros(0, np.uint64)
    # Runs of keys that begin at one slot, the key 0, and enough of them to double the table several times.
    step = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
    for n in (0, 1, 3000, 9000, 40000):
        near = (np.arange(min(n, 300), dtype=np.uint64) + np.uint64(n)) * step
        keys = np.setdiff1d(np.concatenate([near, draw.integers(0, 2**63, n, dtype=np.uint64), np.zeros(int(n == 1), np.uint64)]), all_keys)
        assert (places.find(keys) == -1).all()
        places.add(keys)
        all_keys = np.concatenate([all_keys, keys])
        assert (places.find(all_keys) == np.arange(len(all_keys))).all()
    assert places.size == len(all_keys)


def test_words_are_learnt_anew_when_the_memory_is_full(monkeypatch):
    from textloom.llm import wordbpe

    bpe = wordbpe.WordBpe(q.tokenizer_path())
    monkeypatch.setattr(wordbpe, "MEMORY", 40)
    for k in range(8):
        texts = [f"{'abcdefgh'[k]}{a}one twos{b} it's 42" for a in "xyz" for b in "pqr"] + ["it's again", ""]
        flat, at = bpe.ids([t.encode() for t in texts])
        assert [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_hashes_tell_spans_apart():
    words = sorted({b"a" * k + bytes([c]) * m for k in range(30) for m in range(3) for c in b"ab\0"} - {b""})
    buf, at = textvec.joined(words + words)
    starts = at[:-1]
    h = textvec.word_hashes(buf, starts, at[1:] - 1)
    assert (h[: len(words)] == h[len(words) :]).all() and len(set(h.tolist())) == len(words)


def test_translated_is_the_table_by_byte():
    buf = np.arange(256, dtype=np.uint8).repeat(2)
    for table in (textvec.LOWER, textvec.SPACE):
        got = textvec.translated(buf, table)
        assert (got == table[buf]).all() and got.dtype == table.dtype and got.flags.writeable
