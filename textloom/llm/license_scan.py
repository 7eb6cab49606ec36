"""License notices by conditional compression.

A place can only be confirmed if it holds at least one of a template's marks, more of its rarest-looking words
than a confirmed place may lack. Runs of sentences that hold a mark, with the text around them by the length of
the longest template, are searched for every template's words in order, across sentences and line ends. Each place
found is compressed by zstandard alone and with every template as raw dictionary; the template that
saves the largest share of it wins. A winner counts only if its wording is confirmed: the words of the
template that the place lacks, and those it has besides, are aligned and listed.
"""

from __future__ import annotations

import difflib
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec
from .arrow import columns, rows

#: Notices by identifier; texts of public licenses and the usual short forms of their notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
_SENTENCE = re.compile(rb"(?<=[.!?:;])[\x20\x09]+|\n")
_EDGE = b" \t\n\v\f\r"
_WORD = re.compile(r"[^\s.,;:!?()\"']+(?:[.\-][^\s.,;:!?()\"']+)*")
#: Least share of a block that the winner must save, most missing words per word of the template.
SAVED, MISSING = 0.25, 0.2
#: Words of the templates that much other text holds; they are marks only where a template has no others.
_PLAIN = frozenset(
    "a all and any are as be by conditions either following for form forms free general in included including is it language may met modify not "
    "of option or persons program provided public publish published required rights software specific terms that the this to under use used "
    "version with without work".split()
)
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("plain_bytes", pa.int64()), ("conditional_bytes", pa.int64()), ("exact", pa.bool_()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))])
_KINDS = "doc_id long, start long, length long, license string, saved double, plain_bytes long, conditional_bytes long, exact boolean, missing array<string>, extra array<string>"


def sentences(doc: bytes) -> tuple[list[int], list[int]]:
    """Where the sentences or lines begin and end."""
    edges, end = [0], []
    for m in _SENTENCE.finditer(doc):
        end.append(m.start())
        edges.append(m.end())
    end.append(len(doc))
    return edges, end


def marks(words: list[str]) -> set[str]:
    """Words of which a confirmed place holds at least one: it lacks fewer than these occurrences."""
    least = int(MISSING * len(words) + 1e-9) + 1
    return set(sorted(words, key=lambda w: (w in _PLAIN, -len(w), w))[:least])


def marker(templates: dict[str, str]) -> re.Pattern[bytes]:
    """What finds the marks of all templates."""
    found = sorted({m for t in templates.values() for m in marks([w.lower() for w in _WORD.findall(t)])}, key=lambda m: (-len(m), m))
    return re.compile(rb"(?<!\w)(?:" + b"|".join(re.escape(m.encode()) for m in found) + rb")(?!\w)" if found else rb"(?!)", re.I)


def blocks(doc: bytes, mark: re.Pattern[bytes] | None = None) -> list[tuple[int, int]]:
    """Byte spans of candidate blocks: sentences or lines with a mark, and neighbours with one joined."""
    at = [m.start() for m in (mark or marker(TEMPLATES)).finditer(doc)]
    if not at:
        return []
    edges, end = sentences(doc)
    hit = sorted({int(x) for x in np.searchsorted(edges, at, "right") - 1})
    out: list[tuple[int, int]] = []
    last = -2
    for i in hit:
        if i == last + 1 and out:
            out[-1] = (out[-1][0], end[i])
        else:
            out.append((edges[i], end[i]))
        last = i
    return out


def regions(doc: bytes, reach: int, mark: re.Pattern[bytes] | None = None) -> list[tuple[int, int]]:
    """Byte spans of the candidate blocks with ``reach`` bytes on both sides, out to white space; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in blocks(doc, mark):
        a, b = max(a - reach, 0), min(b + reach, len(doc))
        while a and doc[a - 1] not in _EDGE:
            a -= 1
        while b < len(doc) and doc[b] not in _EDGE:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def nearest(template: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each end in ``words`` the run up to it that is nearest to all of ``template``: cost, words it lacks, start.

    A word of the template that the run lacks costs 2, one that it has besides 1.
    """
    place = np.arange(len(words) + 1, dtype=np.int64)
    extra, lack = 1 << 38, (2 << 38) + (1 << 24)
    # The cost, below it the words lacking, below them len(words) minus the start: of equal costs the shortest run.
    best = place[::-1].copy()
    for w in template:
        step = best + lack
        step[1:] = np.where(words == w, np.minimum(step[1:], best[:-1]), step[1:])
        best = np.minimum.accumulate(step - place * extra) + place * extra
    return best >> 38, (best >> 24) & 0x3FFF, len(words) - (best & 0xFFFFFF)


class Matcher:
    """Finds the places of the templates in a text, ranks the templates for each and aligns the winner's words."""

    def __init__(self, templates: dict[str, str], level: int = 9):
        import zstandard as z

        self.names = sorted(templates)
        self.words = {k: [w.lower() for w in _WORD.findall(templates[k])] for k in self.names}
        self.marker = marker(templates)
        known = sorted({w for own in self.words.values() for w in own})
        self.code = {w: i for i, w in enumerate(known)}
        self.codes = {k: np.array([self.code[w] for w in own], np.int64) for k, own in self.words.items()}
        self.bags = np.array([np.bincount(self.codes[k], minlength=len(known)) for k in self.names])
        #: A notice's words may lie that far from its marker; wrapped and commented lines take more bytes than the template.
        self.reach = 2 * max((len(_flat(t)) for t in templates.values()), default=0)
        own = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = z.ZstdCompressor(**own)
        self.given = {k: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(_flat(templates[k]), dict_type=z.DICT_TYPE_RAWCONTENT), **own) for k in self.names}
        self.match = functools.lru_cache(1 << 14)(self._match)

    def _match(self, block: bytes) -> tuple | None:
        text = _flat(block.decode(errors="replace"))
        plain = len(self.plain.compress(text))
        ranked = sorted((len(c.compress(text)), k) for k, c in self.given.items())
        words = [w.lower() for w in _WORD.findall(text.decode())]
        best, least = None, 0
        for size, name in ranked:
            # Sizes are whole bytes: among those within two bytes of the least confirmed, the wording decides.
            if best and size > least + 2 or (plain - size) < SAVED * plain:
                break
            missing, extra = differences(self.words[name], words)
            if len(missing) <= MISSING * len(self.words[name]):
                key, least = (len(missing) + len(extra), size, name), least if best else size
                if best is None or key < best[0]:
                    best = key, (name, (plain - size) / plain, plain, size, not missing and not extra, missing, extra)
        return best and best[1]

    def places(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words nearest to a whole template that lack few enough of its words; none overlap, those that hold most go first."""
        out: list[tuple[int, int]] = []
        pieces = [(0, len(words))]
        while pieces:
            lo, hi = pieces.pop()
            own = words[lo:hi]
            bag = np.bincount(own[own >= 0], minlength=len(self.code))
            found = []
            for name, most in zip(self.names, np.minimum(self.bags, bag).sum(1), strict=True):
                template = self.codes[name]
                if len(template) and len(template) - most <= MISSING * len(template):
                    cost, lacking, start = nearest(template, own)
                    for end in np.flatnonzero((lacking <= MISSING * len(template)) & (cost < 2 * len(template))).tolist():
                        found.append((int(cost[end]) - len(template), int(start[end]), end))
            taken, held = np.zeros(hi - lo, bool), []
            for _, i, j in sorted(found):
                if not taken[i:j].any():
                    taken[i:j] = True
                    held.append((i, j))
            if held:
                held.sort()
                out += [(lo + i, lo + j) for i, j in held]
                # What lies between may hold notices whose nearest run overlapped a better one.
                between = zip([0, *(j for _, j in held)], [*(i for i, _ in held), hi - lo], strict=True)
                pieces += [(lo + i, lo + j) for i, j in between if i < j]
        return sorted(out)

    def notices(self, doc: bytes) -> list[tuple]:
        """(start, end, what ``match`` says) of each confirmed notice; it takes in the rest of its first and last sentence."""
        out: list[tuple] = []
        around = regions(doc, self.reach, self.marker)
        edges, ends = sentences(doc) if around else ([], [])
        for lo, hi in around:
            text = doc[lo:hi].decode(errors="surrogateescape")
            spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
            codes = np.array([self.code.get(text[a:b].lower(), -1) for a, b in spans], np.int64)
            at = [(_bytes(text, lo, spans[i][0]), _bytes(text, lo, spans[j - 1][1])) for i, j in self.places(codes)]
            for n, (a, b) in enumerate(at):
                first = max(edges[int(np.searchsorted(edges, a, "right")) - 1], out[-1][1] if out else 0)
                last = ends[int(np.searchsorted(ends, b))]
                if n + 1 < len(at):
                    last = min(last, at[n + 1][0])
                for x, y in ((first, last), (a, b)):
                    x, y = y - len(doc[x:y].lstrip(_EDGE)), x + len(doc[x:y].rstrip(_EDGE))
                    if got := self.match(doc[x:y]):
                        out.append((x, y, got))
                        break
        return out


def _bytes(text: str, start: int, n: int) -> int:
    """Where the text's first n characters end, in bytes, if it begins at ``start``."""
    return start + (n if text.isascii() else len(text[:n].encode(errors="surrogateescape")))


def _flat(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def differences(template: list[str], words: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words of the block that the template lacks, in order."""
    missing: list[str] = []
    extra: list[str] = []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, template, words, autojunk=False).get_opcodes():
        if kind != "equal":
            missing += template[a:b]
            extra += words[c:d]
    return missing, extra


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each confirmed notice, also of several in one block: where it is (bytes), which license, what it saved, how its wording differs.

    Null and empty texts have none; repeated rows give their rows each.
    """
    templates = dict(TEMPLATES if templates is None else templates)

    def scan(batches):
        matcher = Matcher(templates)
        for part, docs, _ in textvec.chunks(batches):
            ids = part.column(0).to_pylist()
            found = [(ids[i], a, b - a, *got) for i, doc in enumerate(docs) for a, b, got in matcher.notices(doc)]
            if found:
                yield rows(_ARROW, **dict(zip(_ARROW.names, map(list, zip(*found, strict=True)), strict=True)))

    return columns(df, doc_id=id_col, text=text_col).mapInArrow(scan, _KINDS)
