"""Cases by hand from the rules; none is a recording."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T


def one(spark, rule, value):
    return spark.createDataFrame([(value,)], "text string").select(rule(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("rule", "given", "wanted"),
    [
        (T.remove_repeated_words, "работа работа работа", "работа"),
        (T.remove_repeated_sequences, "a b c d e a b c d e x", "a b c d e x"),
        (T.remove_repeated_sequences, "a b c d a b c d", "a b c d a b c d"),
        (T.remove_duplicate_lines, "a\nB\n b \n\nA\nc", "a\nB\nc"),
        (T.remove_duplicate_sentences, "Да. Нет! да. Нет? Нет!", "Да. Нет! Нет?"),
        (T.remove_repeated_comma_phrases, "пожалуйста оплатите счет, Пожалуйста оплатите счет, пожалуйста оплатите счет конец", "пожалуйста оплатите счет конец"),
        (T.remove_cycling_numbered_lines, "1. a\n2. a\n3. a\n4. b\n5. b", "a\nb"),
        (T.remove_cycling_numbered_lines, "1. a\n2. a\n3. b\n4. b", "1. a\n2. a\n3. b\n4. b"),
        (T.remove_incremental_list, "дело-1, дело-2, дело-3 дело-4, дело-5, дело-66 конец", "дело-1 ... дело-66 конец"),
        (T.remove_incremental_list, "a-1, a-2, a-3, a-4", "a-1, a-2, a-3, a-4"),
        (T.trim_attached_documents, "x" * 3990 + " таблица 1", "x" * 3990 + " таблица 1"),
        (T.trim_attached_documents, "Таблица" + "x" * 4000, ""),
        (T.trim_attached_documents, "y" * 10 + " Публичная оферта " + "x" * 4000, "y" * 10),
        (T.normalize_whitespace, " a \t b\n \n\n\nc ", "a b\n\nc"),
        (T.clean_text, "a\nb", "a b"),
        (T.clean_text_by_line, "a\nb\na", "a\nb"),
        (T.first_paragraph, " a\nb\n\nc", "a\nb"),
    ],
)
def test_rule(spark, rule, given, wanted):
    assert one(spark, rule, given) == wanted
    assert one(spark, rule, None) is None


@pytest.mark.parametrize(("given", "wanted"), [("7", 7), ("10/10", 10), ("0", 5), ("11", 5), ("7.5", 7), ("8балл", 5), ("1-10: 8", 1), ("", 5)])
def test_score(spark, given, wanted):
    assert one(spark, T.parse_score, given) == wanted


def test_placeholders(spark):
    df = spark.createDataFrame([("Hi [PERSON] and [DATE_TIME] [PERSON]",), ("none",)], "text string")
    m = T.mask_placeholders(F.col("text"))
    got = df.select(m["masked"].alias("m"), m["found"].alias("f"), T.unmask_placeholders(F.lit("Hi <0> <2>"), m["found"]).alias("u"), T.unmask_placeholders(m["masked"], m["found"]).alias("back"), "text").collect()
    assert got[0]["m"] == "Hi <0> and <1> <2>" and got[0]["f"] == ["[PERSON]", "[DATE_TIME]", "[PERSON]"] and got[0]["u"] == "Hi [PERSON] [PERSON]"
    assert all(r["back"] == r["text"] for r in got) and got[1]["f"] == []


def test_template_values_are_not_searched(spark):
    df = spark.createDataFrame([("{b}", "B")], "a string, b string")
    assert df.select(T.fill_template(F.lit("{a}-{b}-{c}"), {"a": F.col("a"), "b": F.col("b")}).alias("x")).first()["x"] == "{b}-B-{c}"


def slow_repeats(words, least=5, most=30):
    out, i = [], 0
    while i < len(words):
        fits = [n for n in range(least, most + 1) if words[i : i + n] == words[i + n : i + 2 * n] and i + 2 * n <= len(words)]
        if not fits:
            out.append(words[i])
            i += 1
            continue
        block, out = words[i : i + max(fits)], out + words[i : i + max(fits)]
        while words[i : i + len(block)] == block:
            i += len(block)
    return out


def test_repeats_against_brute_force():
    draw = random.Random(5)
    for _ in range(500):
        base = [draw.choice("abc") for _ in range(draw.randint(0, 12))]
        words = base * draw.randint(1, 4) + [draw.choice("abcd") for _ in range(draw.randint(0, 9))] + base * draw.randint(0, 2)
        assert T.collapse_repeats(" ".join(words)).split() == slow_repeats(words)


def test_comma_guard_never_hides_a_match():
    draw = random.Random(6)
    for _ in range(3000):
        p = "".join(draw.choice("ab ,") for _ in range(draw.randint(18, 26)))
        t = ("x" * draw.randint(0, 3)) + p + "".join("," + " " * draw.randint(0, 2) + draw.choice([p, p.upper(), p[:-1]]) for _ in range(draw.randint(0, 4)))
        if re.search(r"(.{20,200}?)(?:,\s*\1){2,}", t, re.IGNORECASE):
            assert T._may_repeat(t)


LONG = 100_000


@pytest.mark.parametrize(
    ("rule", "given", "wanted"),
    [
        (T.remove_repeated_words, "Да " * LONG + "конец", "Да конец"),
        (T.remove_repeated_words, " ".join(f"w{i} W{i}" for i in range(LONG)), " ".join(f"w{i}" for i in range(LONG))),
        (T.remove_incremental_list, "x " + ", ".join(f"дело-{i}" for i in range(LONG)) + " y", f"x дело-0 ... дело-{LONG - 1} y"),
        (T.remove_incremental_list, "[A_b]-1 " * LONG + "z-", "[A_b]-1 ... [A_b]-1 z-"),
        (T.clean_text, "Да " * LONG + ", ".join(f"дело-{i}" for i in range(LONG)), f"Да дело-0 ... дело-{LONG - 1}"),
        (T.remove_duplicate_lines, "\n".join(f" L{i % 70_000} " for i in range(LONG)), "\n".join(f"L{i}" for i in range(70_000))),
        (T.remove_duplicate_sentences, " ".join(f"s{i % 70_000}." for i in range(LONG)), " ".join(f"s{i}." for i in range(70_000))),
    ],
)
def test_rules_on_the_texts_they_are_for(spark, rule, given, wanted):
    """A hundred thousand repeats: no recursion, no time that grows with the square."""
    assert one(spark, rule, given) == wanted


def test_possessive_patterns_match_as_the_greedy_ones(spark):
    """The patterns with plain loops, by Python's engine, on random short texts."""
    draw = random.Random(8)
    words = lambda: "".join(draw.choice(["да", "Да", "нет", " ", "  ", "\n", ",", ".", "д"]) for _ in range(draw.randint(0, 14)))
    items = lambda: "".join(draw.choice(["a-1", "[b]-22", "c-3d", "-4", ", ", " ", ",", "e"]) for _ in range(draw.randint(0, 22)))
    texts = [words() for _ in range(1500)] + [items() for _ in range(1500)]
    token = r"\[?\w+\]?-\d+"
    want = [(re.sub(r"\b(\w+)(\s+\1\b)+", r"\1", t, flags=re.IGNORECASE), re.sub(rf"({token})(?:[,\s]+{token}){{3,}}[,\s]+({token})", r"\1 ... \2", t)) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select("i", T.remove_repeated_words(F.col("text")).alias("a"), T.remove_incremental_list(F.col("text")).alias("b")).orderBy("i").collect()
    assert [(r["a"], r["b"]) for r in got] == want
