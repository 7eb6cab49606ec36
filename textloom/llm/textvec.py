"""Whole texts of an Arrow batch as one byte buffer: word spans and hashes without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 19
#: The word separators of the contracts: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_draw = np.random.Generator(np.random.PCG64(1009))
_BYTE = _draw.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
#: The first k bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_powers: dict[str, np.ndarray] = {"n": np.zeros(0, U)}


def translated(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[buf]`` for one-byte entries, without an index of eight bytes for each byte."""
    return np.frombuffer(bytearray(buf.tobytes().translate(table.tobytes())), table.dtype)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["n"]) < n:
        size = max(n, CHUNK + 4096)
        up, down = np.full(size, _BASE, U), np.full(size, _UNBASE, U)
        up[0] = down[0] = 1
        _powers["n"], _powers["inverse"] = np.cumprod(up), np.cumprod(down)
    return _powers["n"], _powers["inverse"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the buffer."""
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time: quicker than ``span_hashes`` for short spans."""
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    h = mix((eight[starts] & _FIRST[np.minimum(size, 8)]) + size.astype(U) * U(_BASE))
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest):
        more = eight[starts[rest] + at] & _FIRST[np.minimum(size[rest] - at, 8)]
        h[rest] = mix(h[rest] * U(0xD6E8FEB86659FD93) + more)
        at += 8
        rest = rest[size[rest] > at]
    return h


def chunks(batches, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Slices of the batches of about ``limit`` text bytes, their texts as UTF-8, and which were null."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(sizes):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
            part = texts.slice(at, to - at)
            null = part.is_null().to_numpy(zero_copy_only=False)
            kind = pa.large_binary() if pa.types.is_large_string(part.type) else pa.binary()
            yield batch.slice(at, to - at), [x or b"" for x in part.cast(kind).to_pylist()], null
            at = to
    trim()


def trim() -> None:
    """Gives freed memory back: a Python worker outlives its task, beside the executor's heap."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        return


def parts(docs: list[bytes]) -> Iterator[slice]:
    """Slices of the list of about ``CHUNK`` bytes each."""
    at = total = 0
    for i, doc in enumerate(docs):
        if total and total + len(doc) > CHUNK:
            yield slice(at, i)
            at, total = i, 0
        total += len(doc)
    if at < len(docs):
        yield slice(at, len(docs))


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line feed after each text, and where each text starts (and where the next would)."""
    buf = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in docs], out=starts[1:])
    return buf, starts


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not word separators; the buffer ends with one."""
    space = translated(buf, SPACE)
    edge = np.empty(len(buf), bool)
    edge[0] = not space[0]
    np.not_equal(space[1:], space[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


def windows(word: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows within documents, and each window's first word.

    ``ptr`` has the first word of each document, and the number of words at its end.
    """
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = word[:m].copy()
    for k in range(1, n):
        h = h * U(0xD6E8FEB86659FD93) + word[k : m + k]
    left = np.repeat(ptr[1:], np.diff(ptr))[:m] - np.arange(m)
    at = np.flatnonzero(left >= n)
    return mix(h[at]), at


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs: offsets[0], offsets[0] + 1, ... for lengths[0], and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(offsets - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
