"""Exact token counts by prefix dynamic programming.

``counts[k]``, the number of tokens of the text's first k pre-tokens, follows from ``counts[k - 1]``
and the merges of pre-token k alone, because merges never cross pre-tokens. Inside a pre-token the
recurrence runs over its characters: the last token of a prefix is the one token that ends there
and merges with nothing of the prefix before it. The table answers how many tokens any prefix has
and which prefix fits a budget without encoding the text again.

Nulls and empty texts have no tokens. A text left to the library (see ``wordbpe``) has its table from
one encoding by it; inside its pre-tokens the recurrence is the same. Repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec
from .arrow import columns, rows
from .wordbpe import WordBpe, byte_chars

_SCHEMA = "doc_id long, n_bytes long, n_tokens long, fit_bytes long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("fit_bytes", pa.int64())])


#: White space as the tokenizer's pattern has it; longest pre-token whose prefixes are encoded one by one.
_SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SHORT = 16
CHARS = byte_chars()
_BYTES = {c: b for b, c in enumerate(CHARS)}


class PrefixTable:
    """The counts of one text: ``ends[i]`` bytes hold ``counts[i]`` tokens; between them the last word is split."""

    def __init__(self, bpe: WordBpe, text: bytes):
        self.bpe, self.text = bpe, text
        self._held: tuple[int, tuple[np.ndarray, np.ndarray]] | None = None
        running, ptr, other = bpe.running([text]) if bpe.known else (None, None, [0])
        self.simple = not len(other)
        if self.simple:
            buf, _ = textvec.joined([text])
            low = textvec.translated(buf, textvec.LOWER)
            after = np.zeros(len(buf), bool)
            after[1:] = buf[:-1] == 0xC3
            low[after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 32
            self.low = low
            starts, ends = bpe.pretokens(buf, low)
            self.starts = np.concatenate([[0], starts])
            self.ends, self.counts = np.concatenate([[0], ends]), running[: len(ends) + 1]
        else:
            self.starts, self.ends, self.counts = self._encoded()

    def _encoded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and counts from one encoding; pre-tokens made of one character are one entry."""
        text = self.text.decode()
        done = self.bpe.library.encode(text, add_special_tokens=False)
        begun, chars, counts, reach, last = [], [], [0], 0, None
        for (a, b), word in zip(done.offsets, done.word_ids, strict=True):
            if word != last and a >= reach:
                begun.append(a)
                counts.append(counts[-1])
            counts[-1] += 1
            reach, last = max(reach, b), word
        for a, b in zip(begun, [*begun[1:], len(text)], strict=True):
            chars.append(a + len(text[a:b].rstrip(_SPACES)))
        at = _char_ends(text)
        return at[[0, *begun]], at[[0, *chars]], np.array(counts, np.int64)

    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, n: int) -> int:
        """Tokens of the first n bytes; n is at the end of a character."""
        i = int(np.searchsorted(self.ends, n, "right")) - 1
        if i + 1 >= len(self.starts) or n <= self.starts[i + 1]:
            return int(self.counts[i])
        ends, tokens = self.inside(i + 1)
        return int(self.counts[i] + tokens[np.searchsorted(ends, min(n, int(ends[-1])))])

    def inside(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the characters of pre-token i end, and the tokens of the pre-token up to there; the last one asked for is held."""
        if self._held is None or self._held[0] != i:
            self._held = i, self._inside(i)
        return self._held[1]

    def _inside(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = int(self.starts[i]), int(self.ends[i])
        part = self.text[a:b].decode()
        ends = _char_ends(part)[1:]
        if len(part) <= _SHORT:
            return a + ends, np.array([len(self.bpe.whole(part[:k].encode())) for k in range(1, len(part) + 1)])
        if self.simple:
            return a + ends, np.array(word_prefixes(self.bpe, self.low[a:b].tobytes()))[ends - 1]
        normal = self.bpe.library.normalizer.normalize_str
        each, word = [normal(c).encode() for c in part], normal(part).encode()
        if self.bpe.known and b"".join(each) == word and len(self.bpe.library.pre_tokenizer.pre_tokenize_str(word.decode())) == 1:
            return a + ends, np.array(word_prefixes(self.bpe, word))[np.cumsum([len(x) for x in each]) - 1]
        if self.bpe.known and all(unicodedata.category(c).startswith("L") for c in word.decode()):
            return a + ends, np.array(composed_prefixes(self.bpe, part))
        # A file or a word of another kind: the library encodes each prefix.
        return a + ends, np.array([len(self.bpe.whole(part[:k].encode())) for k in range(1, len(part) + 1)])

    def fit(self, budget: int) -> int:
        """Bytes of the longest prefix that ends with a word's character and fits the budget; all, if the text does."""
        if self.counts[-1] <= budget:
            return len(self.text)
        i = int(np.searchsorted(self.counts, budget, "right")) - 1
        if self.counts[i] == budget:
            return int(self.ends[i])
        ends, tokens = self.inside(i + 1)
        return int(ends[self.counts[i] + tokens <= budget].max(initial=int(self.ends[i])))


def _char_ends(text: str) -> np.ndarray:
    """Bytes of the text's first 0, 1, 2, ... characters."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])


def word_prefixes(bpe: WordBpe, word: bytes) -> list[int]:
    """``[tokens of word[:1], tokens of word[:2], ...]``, each prefix taken as a whole word, by dynamic programming."""
    held, out = _Prefixes(bpe), []
    for k in range(len(word)):
        held.extend(word[k : k + 1])
        out.append(held.tokens(k + 1))
    return out


class _Prefixes:
    """The recurrence over the bytes of a word that can grow and be cut back.

    ``inner[k]`` is the last token of the first k bytes when more letters follow and its count; the last
    token of a complete prefix is the only vocabulary entry ending there that is stable after
    the inner prefix it leaves. Both depend on the bytes before them alone.
    """

    def __init__(self, bpe: WordBpe):
        self.entries = _Entries.of(bpe)
        self.chars: list[str] = []
        self.inner: list[tuple[int, int] | None] = [(-1, 0)]

    def extend(self, more: bytes) -> None:
        for b in more:
            self.chars.append(CHARS[b])
            self.inner.append(self._last(len(self.chars), ""))

    def cut(self, n: int) -> None:
        del self.chars[n:], self.inner[n + 1 :]

    def tokens(self, n: int) -> int:
        """Of the first n bytes as a whole word."""
        return self._last(n, "</w>")[1] if n else 0

    def _last(self, k: int, mark: str) -> tuple[int, int] | None:
        entries, start = self.entries, max(0, k - self.entries.longest)
        written = "".join(self.chars[start:k]) + mark
        for j in range(start, k):
            token = entries.ids.get(written[j - start :])
            if token is not None and entries.symbols(token) and (j == 0 or self.inner[j] is not None and entries.stable(self.inner[j][0], token)):
                return token, self.inner[j][1] + 1
        return None


def composed_prefixes(bpe: WordBpe, part: str) -> list[int]:
    """Tokens of ``part[:1], part[:2], ...`` where characters compose with their neighbours, so that the bytes of the end may change.

    A character that starts anew settles all before it: what is normalised again is the cluster at the end, and
    the recurrence is cut back to the bytes that stayed. A mark behind one of its own class is only added.
    """
    normal = bpe.library.normalizer.normalize_str
    held, out, known = _Prefixes(bpe), [], {}
    settled = start = 0
    last, tail = "", b""  # the normalised cluster's last character, and its bytes unless it is long
    for k, c in enumerate(part):
        pair = last, c
        if pair not in known:
            known[pair] = not unicodedata.combining(c) and normal(last + c) == normal(last) + normal(c)
        if last and unicodedata.combining(c) and unicodedata.combining(c) == unicodedata.combining(last) and normal(c) == c:
            held.extend(c.encode())
            tail = None
            last = c
        else:
            if known[pair]:
                settled, start, tail = len(held.chars), k, b""
            now = normal(part[start : k + 1])
            data = now.encode()
            old = b"" if tail is None else tail
            same = len(os.path.commonprefix([old, data]))
            held.cut(settled + same)
            held.extend(data[same:])
            last, tail = now[-1:], data
        out.append(_tokens_of_end(bpe, held, settled))
    return out


def _tokens_of_end(bpe: WordBpe, held: _Prefixes, settled: int) -> int:
    """Of all bytes held; letters and what follows them in the last cluster are pre-tokens of their own."""
    n = len(held.chars)
    end = bytes(_BYTES[c] for c in held.chars[settled:]).decode()
    letters = next((i for i, c in enumerate(end) if not unicodedata.category(c).startswith("L")), len(end))
    if letters == len(end):
        return held.tokens(n)
    return held.tokens(settled + len(end[:letters].encode())) + len(bpe.whole(end[letters:].encode()))


class _Entries:
    """The vocabulary with what is known of its entries and, up to a bound, of pairs of them; forgetting costs only time."""

    PAIRS = 1 << 18

    def __init__(self, bpe: WordBpe):
        self.ids: dict[str, int] = bpe.library.get_vocab(with_added_tokens=False)
        self.written = {i: x for x, i in self.ids.items()}
        #: Characters (bytes of text) of the longest entry.
        self.longest = max(len(x.removesuffix("</w>")) for x in self.ids)
        self.rank = {k: i for i, k in enumerate(bpe.pairs.keys[: bpe.pairs.size].tolist())}
        self.made, self.inner, self.final = bpe.made.tolist(), bpe.inner.tolist(), bpe.final.tolist()
        self.byte = {c: b for b, c in enumerate(CHARS)}
        self._symbols: dict[int, list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def of(cls, bpe: WordBpe) -> "_Entries":
        if "_entries" not in bpe.__dict__:
            bpe.__dict__["_entries"] = cls(bpe)
        return bpe.__dict__["_entries"]

    def merged(self, symbols: list[int]) -> list[int]:
        """The lowest-ranked pair merges, leftmost first, until none is left."""
        out = list(symbols)
        while len(out) > 1:
            rank, at = min((self.rank.get((a << 16) + b, len(self.made)), i) for i, (a, b) in enumerate(zip(out, out[1:], strict=False)))
            if rank == len(self.made):
                break
            out[at : at + 2] = [self.made[rank]]
        return out

    def symbols(self, token: int) -> list[int]:
        """The entry's symbols; none if these do not merge to it alone."""
        if token not in self._symbols:
            text = self.written[token].removesuffix("</w>")
            own = [self.inner[self.byte[c]] for c in text] if all(c in self.byte for c in text) else []
            if own and self.written[token].endswith("</w>"):
                own[-1] = self.final[self.byte[text[-1]]]
            self._symbols[token] = own if self.merged(own) == [token] else []
        return self._symbols[token]

    def stable(self, left: int, right: int) -> bool:
        """Whether the two entries stay as they are when their symbols are merged together."""
        if (left, right) not in self._pairs:
            if len(self._pairs) >= self.PAIRS:
                self._pairs.clear()
            self._pairs[left, right] = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        return self._pairs[left, right]


def count_tokens(df: DataFrame, tokenizer: str, *, budget: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: n_bytes, n_tokens, and fit_bytes, the bytes of the prefix that fits the budget."""

    def count(batches):
        bpe = WordBpe.at(tokenizer)
        for part, docs, _ in textvec.chunks(batches):
            n = bpe.counts(docs)
            size = np.array([len(x) for x in docs], np.int64)
            fit = size.copy()
            for i in np.flatnonzero(n > budget):
                fit[i] = PrefixTable(bpe, docs[i]).fit(budget)
            yield rows(_ARROW, doc_id=part.column(0).cast(pa.int64()), n_bytes=size, n_tokens=n, fit_bytes=fit)

    return columns(df, doc_id=id_col, text=text_col).mapInArrow(count, _SCHEMA)
