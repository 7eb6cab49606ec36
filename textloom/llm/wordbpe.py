"""Exact ids of a word-end BPE tokenizer for whole batches of texts.

The tokenizers library spends most of its time on words it has met before. Here each text is cut
into the tokenizer's own pre-tokens on its byte buffer, each distinct pre-token is merged once by
the same merge ranks, and ids are gathered by word. Texts outside the part of Unicode whose
normalisation is spelt out here (ASCII and U+00C0 to U+00FF), and texts that hold a special
string, go to the library whole, as do all texts if the file is not of this kind.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd

from . import textvec
from .textvec import U, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Distinct words remembered before the memory starts afresh, and the longest word merged here.
MEMORY, LONGEST = 3 << 18, 48
_NONE = np.int32(1 << 30)
_S, _L, _N, _O = range(4)
#: The split pattern and the normalizers this module spells out.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_chars() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


def _extended(array: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
    """The array, doubled as often as needed, with the values behind its first ``used`` entries."""
    while used + len(values) > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    array[used : used + len(values)] = values
    return array


class _Places:
    """Places of distinct 64-bit keys in the order they came, looked up by whole arrays: open addressing, at most half full."""

    def __init__(self):
        self.keys, self.size, self.bits = np.zeros(1 << 12, U), 0, 13
        self.table = np.full(1 << self.bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self._slots(keys)
        found = self.table[slot]
        # -1 reads the last key, which says nothing.
        left = np.flatnonzero((self.keys[found] != keys) & (found >= 0))
        slot, wanted = slot[left], keys[left]
        while len(left):
            slot = (slot + 1) & (len(self.table) - 1)
            got = self.table[slot]
            found[left] = got
            on = (self.keys[got] != wanted) & (got >= 0)
            left, slot, wanted = left[on], slot[on], wanted[on]
        return found

    def add(self, keys: np.ndarray) -> None:
        """Keys that are distinct and not yet here."""
        self.keys, first = _extended(self.keys, self.size, keys), self.size
        self.size += len(keys)
        if 2 * self.size > len(self.table):
            while 2 * self.size > len(self.table):
                self.bits += 1
                self.table = np.zeros(2 * len(self.table), np.int32)
            self.table[:] = -1
            first = 0
        place = np.arange(first, self.size, dtype=np.int32)
        slot = self._slots(self.keys[first : self.size])
        while len(place):
            free = self.table[slot] < 0
            self.table[slot[free]] = place[free]
            # Of several that took one slot, one did.
            on = self.table[slot] != place
            place, slot = place[on], (slot[on] + 1) & (len(self.table) - 1)


class WordBpe:
    """``ids(docs)`` and ``counts(docs)`` for lists of UTF-8 texts; equal to the library's without added tokens."""

    _open: dict[str, "WordBpe"] = {}

    @classmethod
    def at(cls, path: str) -> "WordBpe":
        """One instance for each file and Python worker."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.known = (
            (spec.get("normalizer") or {}).get("normalizers") == _NORMAL
            and len(split) == 2
            and split[0].get("pattern") == {"Regex": _PATTERN}
            and split[0].get("behavior") == "Removed"
            and split[0].get("invert") is True
            and split[1].get("type") == "ByteLevel"
            and not split[1].get("add_prefix_space")
            and not split[1].get("use_regex")
            and model.get("end_of_word_suffix") == "</w>"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and all(x["content"].startswith("<|") and " " not in x["content"] and not x["lstrip"] and not x["rstrip"] for x in spec["added_tokens"])
            and max(model["vocab"].values()) < 1 << 16
        )
        if not self.known:
            return
        vocab, chars = model["vocab"], byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + "</w>"] for c in chars], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        # Merges are in the order of their rank.
        self.pairs = _Places()
        self.pairs.add(np.array([(vocab[a] << 16) + vocab[b] for a, b in pairs], U))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        kind = np.full(256, _O, np.uint8)
        kind[97:123] = kind[0x80:] = _L
        kind[48:58] = _N
        kind[textvec.SPACE] = _S
        self.kind = kind
        self._forget()

    def _forget(self) -> None:
        self.words, self.offset, self.length = _Places(), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ranks = np.full(a.shape, _NONE)
        both = (a >= 0) & (b >= 0)
        found = self.pairs.find((a[both].astype(U) << U(16)) + b[both].astype(U))
        ranks[both] = np.where(found >= 0, found, _NONE)
        return ranks

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols (-1 after the end): the lowest-ranked pair of each row merges, leftmost first, until none is left."""
        out = np.full_like(symbols, -1)
        rows, ranks = np.arange(len(symbols)), self._ranks(symbols[:, :-1], symbols[:, 1:])
        while len(rows) and symbols.shape[1] > 1:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best < _NONE
            if not live.all():
                out[rows[~live], : symbols.shape[1]] = symbols[~live]
                rows, symbols, ranks, at, best = rows[live], symbols[live], ranks[live], at[live], best[live]
                if not len(rows):
                    return out
            width = symbols.shape[1]
            symbols = np.where(np.arange(width - 1) <= at[:, None], symbols[:, :-1], symbols[:, 1:])
            each = np.arange(len(rows))
            symbols[each, at] = self.made[best]
            if width == 2:
                break
            ranks = np.where(np.arange(width - 2) < at[:, None], ranks[:, :-1], ranks[:, 1:])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranks(symbols[left, at[left] - 1], symbols[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self._ranks(symbols[right, at[right]], symbols[right, at[right] + 1])
        out[rows, : symbols.shape[1]] = symbols
        return out

    def _learn(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Merges new words and remembers them by hash."""
        size = ends - starts
        offset, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        low = 0
        for high in (4, 8, 12, 16, 24, 32, LONGEST):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            for part in np.array_split(rows, max(1, len(rows) >> 14)):
                if not len(part):
                    continue
                at = starts[part][:, None] + np.arange(high)
                inside = np.arange(high) < size[part][:, None]
                raw = buf[np.minimum(at, len(buf) - 1)]
                symbols = np.where(inside, self.inner[raw], -1).astype(np.int32)
                each = np.arange(len(part))
                symbols[each, size[part] - 1] = self.final[raw[each, size[part] - 1]]
                done = self.merge(symbols)
                used = done >= 0
                length[part] = used.sum(1)
                offset[part] = self.used + np.cumsum(length[part]) - length[part]
                self._append(done[used])
        for i in np.flatnonzero(size > LONGEST):
            ids = self.library.encode(buf[starts[i] : ends[i]].tobytes().decode(), add_special_tokens=False).ids
            offset[i], length[i] = self.used, len(ids)
            self._append(np.array(ids))
        self.offset = _extended(self.offset, self.words.size, offset)
        self.length = _extended(self.length, self.words.size, length)
        self.words.add(keys)

    def _append(self, ids: np.ndarray) -> None:
        self.flat = _extended(self.flat, self.used, ids)
        self.used += len(ids)

    def pretokens(self, buf: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the pre-tokens in a buffer of lower-cased ASCII and Latin-1 letters in UTF-8."""
        kind = textvec.translated(low, self.kind)
        sign = np.flatnonzero((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))
        kind[sign] = kind[sign + 1] = _O
        start = np.ones(len(kind) + 3, bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1 : len(kind)])
        start[: len(kind)] |= kind == _N
        quote = np.flatnonzero((low == 39) & start[: len(low)])
        if len(quote):
            quote = quote[kind[np.minimum(quote + 1, len(kind) - 1)] == _L]
            pad = np.concatenate([low, np.zeros(3, np.uint8)])
            a, b = pad[quote + 1], pad[quote + 2]
            one = np.isin(a, [115, 116, 109, 100])  # s t m d
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # re ve ll
            start[quote[one | two] + 1] = False
            start[quote[one] + 2] = True
            start[quote[two] + 3] = True
        starts = np.flatnonzero(start[: len(kind)])
        ends = np.append(starts[1:], len(kind))
        words = kind[starts] != _S
        return starts[words], ends[words]

    def _codes(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pre-token its entry in the memory; the first pre-token of each text; texts left to the library."""
        buf, at = textvec.joined(docs)
        low = textvec.translated(buf, textvec.LOWER)
        after = np.zeros(len(buf), bool)
        after[1:] = buf[:-1] == 0xC3
        odd = (buf < 32) & ~textvec.translated(buf, textvec.SPACE) | (buf == 127) | (buf >= 0x80) & (buf != 0xC3) & ~after
        odd[:-1] |= (buf[:-1] == 60) & (buf[1:] == 124)  # <|
        upper = after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
        low[upper] += 32
        other = np.unique(np.searchsorted(at, np.flatnonzero(odd), "right") - 1)
        starts, ends = self.pretokens(buf, low)
        ptr = np.searchsorted(starts, at)
        hashes = textvec.word_hashes(low, starts, ends)
        code = self.words.find(hashes)
        missing = np.flatnonzero(code < 0)
        if len(missing):
            place, keys = pd.factorize(hashes[missing])
            if self.words.size + len(keys) > MEMORY and self.words.size:
                self._forget()
                missing = np.arange(len(code))
                place, keys = pd.factorize(hashes)
            first = np.empty(len(keys), np.int64)
            first[place[::-1]] = missing[::-1]
            code[missing] = self.words.size + place
            self._learn(keys, low, starts[first], ends[first])
        return code, ptr, other

    def whole(self, doc: bytes) -> list[int]:
        return self.library.encode(doc.decode(), add_special_tokens=False).ids

    def counts(self, docs: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        if not self.known:
            return np.array([len(self.whole(x)) for x in docs], np.int64)
        running, ptr, other = self.running(docs)
        out = np.diff(running[ptr])
        for i in other:
            out[i] = len(self.whole(docs[i]))
        return out

    def running(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens before each pre-token of the batch, the first pre-token of each text, texts left to the library."""
        code, ptr, other = self._codes(docs)
        running = np.zeros(len(code) + 1, np.int64)
        np.cumsum(self.length[code], out=running[1:])
        return running, ptr, other

    def ids(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and where those of each text start (and end)."""
        if not self.known:
            code, ptr, other = np.zeros(0, np.int64), np.zeros(len(docs) + 1, np.int64), np.arange(len(docs))
            flat = np.zeros(0, np.uint32)
        else:
            code, ptr, other = self._codes(docs)
            flat = self.flat[ragged(self.offset[code], self.length[code])].astype(np.uint32)
        running = np.zeros(len(code) + 1, np.int64)
        if len(code):
            np.cumsum(self.length[code], out=running[1:])
        at = running[ptr]
        if len(other):
            parts = [flat[at[i] : at[i + 1]] for i in range(len(docs))]
            for i in other:
                parts[i] = np.array(self.whole(docs[i]), np.uint32)
            flat = np.concatenate(parts)
            at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return flat, at
