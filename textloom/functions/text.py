"""Text cleaning as column expressions; Python only where a rule needs state or a regex the JVM cannot run safely."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where attached documents begin.
TRIGGERS = [
    r"[Тт]абл[а-я]*\.?",
    r"Публичная оферта",
    r"заключили настоящий Договор о нижеследующем",
    r"1\.\s*Предмет договора",
    r"Термины и определения",
    r"Акт сверки взаимных расчетов",
    r"Акт\s+№?\s*\d+\s+о\s+нарушении",
    r"Приложение\s+\d+\s+к\s+приказу",
    r"ПОЛОЖЕНИЕ\s+О\s+",
    r"1\.\s*Общие положения",
]
#: Fixed value: an entity placeholder.
PLACEHOLDER = r"\[[A-Z][A-Z_]*(?:\s[A-Z_]*)?\]"
#: Han, Hiragana, Katakana, Hangul.
FOREIGN = "[一-鿿぀-ゟ゠-ヿ가-힯]"
WORD = r"[\p{L}\p{N}_]+"


def let(c: Column, body) -> Column:
    """``body`` of a value that is computed once, however often body mentions it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


#: Rows, and about how many bytes, whose Python objects a task holds at once.
_ROWS, _BYTES = 256, 1 << 20


def by_slices(batch: pa.Array, run: Callable[[list], list], kind: pa.DataType) -> pa.Array:
    """``run`` over slices of an Arrow batch, so that a task never holds the whole batch as Python objects."""
    ends, out, start = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64), [], 0
    while start < len(batch):
        full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _BYTES, "right"))
        stop = min(max(full, start + 1), start + _ROWS, len(batch))
        out.append(pa.array(run(batch.slice(start, stop - start).to_pylist()), kind))
        start = stop
    return pa.concat_arrays(out) if out else pa.array([], kind)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def first_of_each(items: Column) -> Column:
    """Items that are not blank and, in lower case, have not come before: the first of each key once sorted, in their old order."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at"), x.alias("item"))))
    first = lambda b: F.filter(b, lambda x, i: (x["key"] != "") & ((i == 0) | (F.get(b, i - 1)["key"] != x["key"])))
    placed = let(keyed, lambda b: F.sort_array(F.transform(first(b), lambda x: F.struct(x["at"], x["item"]))))
    return F.transform(placed, lambda x: x["item"])


#: A word with its copies, and five or more numbered items with commas or white space between. Loops over a
#: group are possessive: the JVM runs those without recursion, and nothing follows them that could ask for a copy back.
_COPIES = r"(?iuU)\b(\w+)(?:\s+\1\b)++"
_ITEM = r"\[?\w+\]?-\d+"
_ITEMS = rf"(?U)({_ITEM})(?:[,\s]+({_ITEM})){{4,}}+"


def remove_repeated_words(c: Column) -> Column:
    """Consecutive copies of a word, whatever their case, become the first."""
    return F.regexp_replace(c, _COPIES, "$1")


def collapse_repeats(text: str, least: int = 5, most: int = 30) -> str:
    """At each word the longest block of ``least`` to ``most`` words that is followed by its copy is kept once.

    For a block length n, ``run[n][i]`` counts the words from i on that equal the word n later; the
    block at i has a copy where that is n or more, and as many copies as n fits into it.
    """
    parts = text.split()
    count = len(parts)
    if count < 2 * least:
        return " ".join(parts)
    code = pd.factorize(np.array(parts, dtype=object))[0]
    longest = np.zeros(count, np.int64)
    copies = np.zeros(count, np.int64)
    for n in range(least, min(most, count // 2) + 1):
        same = code[n:] == code[:-n]
        # A block and its copy agree in n places.
        if np.count_nonzero(same) < n:
            continue
        same = np.append(same, False)
        at = np.arange(len(same))
        stop = np.minimum.accumulate(np.where(same, len(same), at)[::-1])[::-1]
        run = stop - at
        found = np.flatnonzero(run >= n)
        longest[found], copies[found] = n, run[found] // n
    if not longest.any():
        return " ".join(parts)
    out: list[str] = []
    i = 0
    while i < count:
        n = int(longest[i])
        out += parts[i : i + max(n, 1)]
        i += n * (1 + int(copies[i])) if n else 1
    return " ".join(out)


def remove_repeated_sequences(c: Column, least: int = 5, most: int = 30) -> Column:
    @F.arrow_udf(T.StringType())
    def run(s: pa.Array) -> pa.Array:
        return by_slices(s, lambda some: [None if t is None else collapse_repeats(t, least, most) for t in some], pa.string())

    return run(c)


def remove_duplicate_lines(c: Column) -> Column:
    return F.array_join(first_of_each(F.transform(F.split(c, "\n", -1), strip)), "\n")


def remove_duplicate_sentences(c: Column) -> Column:
    return F.array_join(first_of_each(F.transform(F.split(strip(c), r"(?U)(?<=[.!?])\s+", -1), strip)), " ")


#: Fixed value: three or more copies of a phrase with commas between.
_COMMA = re.compile(r"(.{20,200}?)(?:,\s*\1){2,}", re.IGNORECASE)


def _may_repeat(text: str, least: int = 20, most: int = 200) -> bool:
    """Whether any phrase can come three times with commas between, by the places of the commas alone.

    A copy lies between the white space after one comma and a later comma, so only such stretches
    are compared with what stands before and after; the regex tries every length at every place.
    """
    low = text.lower()
    if len(low) != len(text):
        return True
    at = [m.start() for m in re.finditer(",", low)]
    for k, e in enumerate(at):
        begin = e + 1
        while True:
            for e2 in at[k + 1 :]:
                size = e2 - begin
                if size > most:
                    break
                if size < least or e < size or low[e - size : e] != low[begin:e2]:
                    continue
                after = e2 + 1
                while True:
                    if low[after : after + size] == low[begin:e2]:
                        return True
                    if after >= len(low) or not low[after].isspace():
                        break
                    after += 1
            if begin >= len(low) or not low[begin].isspace():
                break
            begin += 1
    return False


def remove_repeated_comma_phrases(c: Column) -> Column:
    """Three or more copies of a phrase of 20 to 200 characters with commas between become one."""

    @F.arrow_udf(T.StringType())
    def run(s: pa.Array) -> pa.Array:
        return by_slices(s, lambda some: [_COMMA.sub(r"\1", t) if t is not None and _may_repeat(t) else t for t in some], pa.string())

    return run(c)


def remove_cycling_numbered_lines(c: Column) -> Column:
    """If fewer than half of the lines differ once their numbers are off: those, in order; else the text as it is."""
    bare = lambda x: F.transform(F.split(x, "\n", -1), lambda y: F.regexp_replace(strip(y), r"(?U)^\d+\.\s*", ""))
    parts = lambda x: let(bare(x), lambda b: F.struct(F.size(b).alias("n"), F.array_distinct(b).alias("once")))
    return let(c, lambda x: let(parts(x), lambda p: F.when(F.size(p["once"]) * 2 < p["n"], F.array_join(p["once"], "\n")).otherwise(x)))


def remove_incremental_list(c: Column) -> Column:
    """Five or more items in a row become the first and the last."""
    return F.regexp_replace(c, _ITEMS, "$1 ... $2")


def trim_attached_documents(c: Column, longest: int = 4000, triggers: list[str] | None = None) -> Column:
    """A longer text ends where its first trigger begins."""
    pattern = "(?U)(?:" + "|".join(TRIGGERS if triggers is None else triggers) + ")"
    cut = lambda x: let(F.regexp_instr(x, F.lit(pattern)), lambda at: F.when(at > 0, strip(F.substring(x, F.lit(1), at - 1))).otherwise(x))
    return let(c, lambda x: F.when(F.length(x) > longest, cut(x)).otherwise(x))


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"(?U)\n\s*\n+", "\n\n"))


def distinct_parts(parts: list[str]) -> list[str]:
    """Stripped parts that are not blank, each lower-cased form once."""
    kept: dict[str, str] = {}
    for p in map(str.strip, parts):
        kept.setdefault(p.lower(), p)
    kept.pop("", None)
    return list(kept.values())


def _in_workers(c: Column, by_line: bool) -> Column:
    """The rules that need Python and those between them, in one pass; ``by_line`` applies them to each distinct line."""

    def block(t: str) -> str:
        return " ".join(distinct_parts(re.split(r"(?<=[.!?])\s+", collapse_repeats(t))))

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = "\n".join(distinct_parts([block(x) for x in t.split("\n")])) if by_line else block(t)
        return _COMMA.sub(r"\1", t) if _may_repeat(t) else t

    @F.arrow_udf(T.StringType())
    def run(s: pa.Array) -> pa.Array:
        return by_slices(s, lambda some: [one(t) for t in some], pa.string())

    return run(c)


def clean_text(c: Column) -> Column:
    """All nine rules in order. The second flattens line ends, so that the third and sixth find single lines here."""
    return _after(_in_workers(remove_repeated_words(c), by_line=False))


def clean_text_by_line(c: Column) -> Column:
    """The same rules with lines kept apart, so that the line rules have lines to work on."""
    return _after(_in_workers(remove_repeated_words(c), by_line=True))


def _after(c: Column) -> Column:
    for rule in (remove_cycling_numbered_lines, remove_incremental_list, trim_attached_documents, normalize_whitespace):
        c = rule(c)
    return c


def mask_placeholders(c: Column) -> Column:
    """STRUCT(masked, found): the placeholders replaced by <0>, <1>, ... in order, and what they were."""
    found = F.regexp_extract_all(c, F.lit(f"({PLACEHOLDER})"), F.lit(1))
    pieces = F.split(c, PLACEHOLDER, -1)
    masked = F.array_join(F.transform(pieces, lambda x, i: F.when(i > 0, F.concat(F.lit("<"), (i - 1).cast("string"), F.lit(">"), x)).otherwise(x)), "")
    return F.struct(masked.alias("masked"), found.alias("found"))


def unmask_placeholders(c: Column, found: Column) -> Column:
    """The first <i> of each i becomes the i-th placeholder; lost marks stay lost."""
    pairs = F.transform(found, lambda x, i: F.struct(F.concat(F.lit("<"), i.cast("string"), F.lit(">")).alias("mark"), x.alias("was")))

    def put(text: Column, pair: Column) -> Column:
        at = F.instr(text, pair["mark"])
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), pair["was"], F.substring(text, at + F.length(pair["mark"]), F.length(text)))).otherwise(text)

    return F.aggregate(pairs, c, put)


def parse_score(c: Column, default: float = 5.0) -> Column:
    """The first whole number from 1 to 10, else ``default``."""
    return F.coalesce(F.regexp_extract(c, r"(?U)\b(10|[1-9])\b", 1).try_cast("double"), F.lit(default))


def first_paragraph(c: Column) -> Column:
    return strip(F.split_part(c, F.lit("\n\n"), F.lit(1)))


def fill_template(template: Column, fields: dict[str, Column]) -> Column:
    """The named fields of the template itself are filled; braces in the values are text."""
    # Marks that no template holds stand for the fields, so that a value is never searched.
    for name in fields:
        template = F.replace(template, F.lit("{" + name + "}"), F.lit(f"\u0001{name}\u0001"))
    out = F.split(template, "\u0001", -1)
    value = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return F.array_join(F.transform(out, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.coalesce(F.element_at(value, x), F.lit("")))), "")
