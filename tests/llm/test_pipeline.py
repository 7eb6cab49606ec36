"""Each stage of the pipeline on its predecessor's rows against a plain version of the same decision; mixing on small tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from textloom.llm import lang_id, mixing, quality
from textloom.llm import queries as q
from textloom.llm.store import Scratch
from textloom.llm.wordbpe import WordBpe

D = "/root/testdata/sf0.001"


def key(r):
    return (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])


@pytest.fixture(scope="module")
def steps(spark):
    """The tables before, between and after the stages, with null and awkward rows added to the first."""
    docs = q.table(spark, D, "documents")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "x", 0), (None, "a b c " * 30, "en", "x", 1), (90003, "word " * 9, None, "x", 45)], docs.schema)
    held, scratch = [docs.unionByName(odd).unionByName(docs.where("doc_id % 40 = 0"))], Scratch(spark, "test-pipeline")
    for name, stage in pipeline.STAGES:
        held.append(scratch.keep(stage(spark, held[-1], D), name))
    return held


def words(text):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]


def test_quality_stage(spark, steps):
    model = quality.fit_quality(steps[0], q.table(spark, D, "labels"))
    want = Counter()
    for r in steps[0].collect():
        own = words(r["text"])
        seen = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
        covered = {j for i in range(len(own) - 7) if seen[tuple(own[i : i + 8])] > 1 for j in range(i, i + 8)}
        good = len(own) >= 20 and 100 * len(covered) <= 30 * len(own) and model.probabilities([r["text"].encode()])[0, 1] >= quality.THRESHOLD
        if good and r["doc_id"] is not None:
            want[key(r)] += 1
    assert steps[1].columns == steps[0].columns and Counter(map(key, steps[1].collect())) == want


def test_language_stage(spark, steps):
    model, want = lang_id.fit_languages(steps[1]), Counter()
    for r in steps[1].collect():
        codes, at = lang_id.window_codes([r["text"].encode()])
        if any(c.isalpha() for c in r["text"]) and model.mixture(codes[at[0] : at[1]])[1][0] >= pipeline.MAIN_SHARE:
            want[key(r)] += 1
    assert steps[2].columns == steps[0].columns and Counter(map(key, steps[2].collect())) == want


def test_dedup_stage(steps):
    rows = {r["doc_id"]: r for r in steps[2].collect()}
    sets = {}
    for i, r in rows.items():
        own = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
        sets[i] = {tuple(own[j : j + 5]) for j in range(max(1, len(own) - 4))}
    ids = sorted(rows)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert sorted(map(key, steps[3].collect())) == sorted(key(rows[i]) for i in ids if top(i) == i)


def plain_rates(n, p, wanted):
    """Rates from 0 to MOST nearest to 1 that meet the totals wanted (none where nan), by bisection of one domain after another."""
    asked = np.zeros(p.shape[1])

    def rate(x):
        s = p @ x
        return np.clip(1 - np.sign(s) * np.maximum(np.abs(s) - 0.05, 0), 0, 16)

    for _ in range(400):
        for k in np.flatnonzero(~np.isnan(wanted)):
            low, high = asked.copy(), asked.copy()
            low[k], high[k] = -1e4, 1e4
            for _ in range(60):
                asked[k] = (low[k] + high[k]) / 2
                (low if n * rate(asked) @ p[:, k] > wanted[k] else high)[k] = asked[k]
    return rate(asked)


def test_mixing_stage(spark, steps):
    """Posteriors and rates reckoned here from the texts; copies by the draw the docstring names."""
    model = mixing.fit_domains(q.table(spark, D, "documents"), q.table(spark, D, "labels"), q.domain_label(), q.DOMAINS)
    library, own = WordBpe.at(q.tokenizer_path()).library, steps[3].collect()
    n = np.array([len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in own], float)
    p = model.probabilities([(r["text"] or "").encode() for r in own])
    clean = n @ p[:, 0]
    r = plain_rates(n, p, np.array([clean, clean * 5 / 95, np.nan]))
    assert np.allclose(n * r @ p[:, :2], [clean, clean * 5 / 95], rtol=1e-3)
    ids = spark.createDataFrame([(x["doc_id"],) for x in own], "doc_id long")
    draw = {x[0]: x[1] for x in ids.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)).collect()}
    got, sure = Counter(map(key, steps[4].collect())), 0
    for x, rate in zip(own, r, strict=True):
        low, high = (int(np.floor(rate * f + draw[x["doc_id"]])) for f in (0.98, 1.02))
        assert low <= got[key(x)] <= high
        sure += low == high
    assert sure > 0.9 * len(own) and steps[4].columns == steps[0].columns and sum(got[key(x)] for x in own) == sum(got.values())
    kept = sum(1 for x in own if got[key(x)])
    assert kept > 0.7 * len(own) and max(got.values()) <= 7


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_rates_agree_with_bounded_least_squares(spark, sf):
    """op10 over whole tables: every domain meets its share, with the rates of an independent solver."""
    got = q.op10_soft_membership_mixing(spark, f"/root/testdata/{sf}").collect()
    p, n, rate = np.array([r["posterior"] for r in got]), np.array([r["n_tokens"] for r in got], float), np.array([r["rate"] for r in got])
    share = np.array([q.TARGETS[d] for d in q.DOMAINS])
    total, wanted = rate * n @ p, share * (n @ p[:, 0]) / share[0]
    assert np.abs(total / wanted - 1).max() < mixing.TOLERANCE and rate.min() >= 0 and rate.max() <= mixing.MOST
    plain = plain_rates(n, p, wanted)
    assert np.allclose(n * plain @ p, wanted, rtol=1e-3) and np.abs(plain - rate).max() < 0.1 and np.average(np.abs(plain - rate), weights=n) < 0.005


def test_packing_stage(steps):
    library = WordBpe.at(q.tokenizer_path()).library
    want = Counter()
    for r in steps[4].collect():
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), q.LIMIT)):
            own = np.array(ids[start : start + q.LIMIT], "<u4")
            want[(r["doc_id"], n, start, len(own), zlib.crc32(own.tobytes()))] += 1
    got, bins = steps[5].collect(), {}
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= q.LIMIT


def test_rates_meet_the_targets(spark):
    draw = np.random.default_rng(5)
    p, n = draw.dirichlet([0.2] * 3, 3000), draw.integers(1, 900, 3000)
    scored = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>").repartition(5)
    targets = np.array([0.6, 0.1, 0.3])
    history, total, wanted = mixing.fit_rates(scored, targets, anchor=0)
    r = mixing.rates(p, history, mixing.PULL)
    assert r.min() >= 0 and np.allclose((r * n) @ p, total)
    assert np.abs(total / wanted - 1).max() < 0.01 and np.allclose(total / total.sum(), targets, atol=0.005)


def test_mixing_awkward_rows(spark):
    rows = [(i, "good plain words here " * 5, 1, "x") for i in range(30)] + [(100 + i, "vile nasty slur spit " * 5, 0, "x") for i in range(30)] + [(200, None, 1, "x"), (201, "", 1, "x"), (None, "good", 1, "x"), (5, "good plain words here " * 5, 1, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int, n_tokens string")
    labels = table.select("doc_id", "quality").where("doc_id < 150").distinct()
    domain, names = F.when(F.col("quality") == 1, "a").when(F.col("quality") == 0, "b"), ["a", "b", "none"]
    model = mixing.fit_domains(table, labels, domain, names)
    targets = {"a": 0.5, "b": 0.5, "none": 0.0}
    got = mixing.mix(table, model, names, targets, q.tokenizer_path(), Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and all(r["copies"] >= 0 and len(r["posterior"]) == 3 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (200, 201)} == {0}
    assert mixing.mix(table.limit(0), model, names, targets, q.tokenizer_path(), Scratch(spark, "t")).count() == 0
    untaught = mixing.fit_domains(table, labels.limit(0), domain, names)
    assert mixing.mix(table, untaught, names, targets, q.tokenizer_path(), Scratch(spark, "t")).count() == len(rows)


def test_emitted_rates_and_copies_meet_the_targets(spark):
    got = q.op10_soft_membership_mixing(spark, "/root/testdata/sf0.01").collect()
    p, n = np.array([r["posterior"] for r in got]), np.array([r["n_tokens"] for r in got], float)
    rate, copies = (np.array([r[c] for r in got], float) for c in ("rate", "copies"))
    want = np.array([q.TARGETS[d] for d in q.DOMAINS])
    total = (rate * n) @ p
    assert np.abs(total / total.sum() / want - 1).max() < 3 * mixing.TOLERANCE
    # Copies round by a draw; four standard deviations of it.
    part = rate - np.floor(rate)
    assert (np.abs((copies * n) @ p - total) <= 4 * np.sqrt((part * (1 - part) * n**2) @ p**2) + 1e-6).all()
    # An independent nonnegative least-squares solution, by coordinates, does no better than to meet them.
    wanted = want * total[0] / want[0]
    a, r = (n[:, None] * p).T, np.ones(len(n))
    gap, norm = a @ r - wanted, (a**2).sum(0) + 1e-12
    for _ in range(60):
        for i in range(len(r)):
            new = max(r[i] - a[:, i] @ gap / norm[i], 0.0)
            gap += a[:, i] * (new - r[i])
            r[i] = new
    assert np.abs(total / wanted - 1).max() <= np.abs(gap / wanted).max() + 3 * mixing.TOLERANCE


def test_targets_out_of_reach_are_reported(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} plain words {i}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = mixing.fit_domains(table, table.limit(0), F.lit(None).cast("string"), ["a", "b"])
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.mix(table, model, ["a", "b"], {"a": 0.99, "b": 0.01}, q.tokenizer_path(), Scratch(spark, "t"), anchor="a").count()


def test_a_domain_out_of_reach_is_left_out(spark):
    p = np.concatenate([np.tile([0.99, 0.005, 0.005], (2000, 1)), np.tile([0.1, 0.9, 0.0], (200, 1)), np.tile([0.02, 0.0, 0.98], (4, 1))])
    scored = spark.createDataFrame([(100, x.tolist()) for x in p], "n_tokens long, posterior array<double>").repartition(3)
    with pytest.warns(UserWarning, match="left out"):
        asked, total, wanted = mixing.fit_rates(scored, np.array([0.8, 0.1, 0.1]))
    r = mixing.rates(p, asked)
    assert asked[2] == 0 and np.allclose((100 * r) @ p, total) and np.abs(total[:2] / np.array([1, 0.125]) / (100 * p[:, 0].sum()) - 1).max() < mixing.TOLERANCE
    assert np.abs(r - plain_rates(np.full(len(p), 100.0), p, np.array([100 * p[:, 0].sum(), 12.5 * p[:, 0].sum(), np.nan]))).max() < 0.02
    assert r.max() < 2 and abs(r[:2000].mean() - 1) < 0.1


def test_rows_are_repeated_with_all_their_columns(spark):
    rows = [(i, f"good plain words {i}", i, "r") for i in range(40)] + [(None, None, 0, "r"), (3, "good plain words 3", 3, "r")]
    table = spark.createDataFrame(rows, "doc_id long, text string, copies long, rate string")
    model = mixing.fit_domains(table, table.limit(0), F.lit(None).cast("string"), ["a", "b"])
    args = (model, ["a", "b"], {"a": 0.5, "b": 0.5}, q.tokenizer_path())
    times = Counter()
    for r in mixing.mix(table, *args, Scratch(spark, "t")).collect():
        times[r["doc_id"]] += r["copies"]
    got = mixing.mix_rows(table, *args, Scratch(spark, "t"))
    assert got.columns == table.columns and Counter(r["doc_id"] for r in got.collect()) == +times
    assert mixing.mix_rows(table.limit(0), *args, Scratch(spark, "t")).count() == 0


def test_quality_of_awkward_rows(spark):
    good, bad = " ".join(f"word{i}" for i in range(40)), " ".join(["a b c d e f g h"] * 9)
    rows = [(1, good, 7), (1, good, 7), (2, bad, 7), (3, None, 7), (4, "", 7), (None, good, 7), (5, good + " x" * 100000, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept long").repartition(3)
    for model in (None, quality.fit_quality(table, spark.createDataFrame([(1, 1), (2, 0), (9, 1)], "doc_id long, quality int"))):
        got = quality.score_quality(table, model).collect()
        assert len(got) == len(rows) and {r["doc_id"] for r in got if r["base_failed"]} == {2, 3, 4, 5}
        kept = quality.keep_good(table, model)
        assert kept.columns == table.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
        assert quality.score_quality(table.limit(0), model).count() == 0
    # Repeated rows and labels of an id count once in the fit.
    chosen = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (9, 1)], "doc_id long, y int")
    y, held, features = quality.ngrams.sampled(table, chosen, 2, 1.0, screen=0.0, share=0.0, id_col="doc_id", text_col="text")
    assert y.tolist() == [1, 0] and not held.any() and features.size == 2


def test_sampled_features_are_those_a_fit_on_the_texts_uses(spark):
    ngrams = quality.ngrams
    docs = q.table(spark, "/root/testdata/sf0.01", "documents")
    chosen = q.table(spark, "/root/testdata/sf0.01", "labels").where("quality is not null").select("doc_id", F.col("quality").alias("y")).distinct()
    y, held, features = ngrams.sampled(docs, chosen, 2, 1.0, screen=ngrams.SCREEN, id_col="doc_id", text_col="text")
    rows = sorted((r["doc_id"], r["y"], (r["text"] or "").encode()) for r in docs.join(chosen, "doc_id").select("doc_id", "y", "text").collect())
    assert y.tolist() == [r[1] for r in rows] and 0.1 < held.mean() < 0.4
    plain = ngrams.fit([t for (_, _, t), h in zip(rows, held, strict=True) if not h], y[~held], 2)
    model = ngrams.fit(features.part(~held), y[~held], 2)
    assert (model.weights != 0).sum() > 0 and np.allclose(model.weights, plain.weights, atol=1e-5) and np.allclose(model.bias, plain.bias, atol=1e-5)
    assert np.allclose(features.scores(model), ngrams.scores([r[2] for r in rows], plain.weights, plain.bias, 1.0), atol=1e-3)


CONTRACTS = {
    "op1_language_mixture": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_histogram_sort_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_maxscore_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_conditional_license_scan": "doc_id bigint, start bigint, length bigint, license string",
    "op6_context_mixing_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_prefix_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op8_minmax_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_calibrated_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_soft_membership_mixing": "doc_id bigint, n_tokens bigint, rate double, copies int",
}
EACH = {"op1", "op3", "op6", "op7", "op8", "op9", "op10"}


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    """The smallest tables with awkward rows added: nulls, empty and very long texts, clashing columns; and empty ones."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path_factory.mktemp("tables")
    for name in ("documents", "labels", "embeddings"):
        t = pq.read_table(f"{D}/{name}.parquet")
        (root / "none").mkdir(exist_ok=True)
        pq.write_table(t.slice(0, 0), root / "none" / f"{name}.parquet")
        if name == "documents":
            more = [(70001, None), (70002, ""), (70003, " \n\t "), (70004, "word " * 60000), (70005, "中文 текст ½ e\u0301 <|endoftext|>"), (70006, "a" * 30000)]
            extra = pa.Table.from_pylist([{f.name: {"doc_id": i, "text": x}.get(f.name) for f in t.schema} for i, x in more], schema=t.schema)
            t = pa.concat_tables([t, extra])
            for clash in ("key", "length", "shard_", "tokens", "features"):
                t = t.append_column(clash, pa.array([1] * len(t)))
        (root / "odd").mkdir(exist_ok=True)
        pq.write_table(t, root / "odd" / f"{name}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_registered_queries_keep_their_contracts(spark, awkward, name):
    got = getattr(q, name)(spark, str(awkward / "odd"))
    kinds = dict(got.dtypes)
    for each in CONTRACTS[name].split(", "):
        column, kind = each.split(" ")
        assert kinds.get(column) == kind, (name, column, kinds.get(column))
    rows, n = got.collect(), spark.read.parquet(str(awkward / "odd" / "documents.parquet")).count()
    if name.split("_")[0] in EACH:
        assert len(rows) == n and len({r["doc_id"] for r in rows}) == n
    if name.startswith("op9"):
        held = {r["doc_id"]: r for r in rows}
        for r in spark.read.parquet(str(awkward / "odd" / "documents.parquet")).select("doc_id", "text").collect():
            text, own = r["text"] or "", words(r["text"])
            lines = [x for x in text.split("\n") if words(x)]
            want = (len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
            assert tuple(held[r["doc_id"]][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")) == want
    assert getattr(q, name)(spark, str(awkward / "none")).count() == 0
