"""Byte radix tries in preorder: mergeable, cut by prefix, with counters at their leaves.

A trie is held as its walk in byte order, which for UTF-8 is the order of the code points: each leaf says how
many bytes of its path it shares with the leaf before it (the depth at which its edge leaves) and the bytes of
that edge. Its counters are (group, count) pairs, sparse and in order of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Columns of a written trie below one prefix. A group without a source counts documents of its language.
KINDS = "prefix binary, langs array<string>, sources array<string>, shared array<int>, edges array<binary>, widths array<int>, groups array<int>, counts array<long>"
SCHEMA = pa.schema(
    [("prefix", pa.binary()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("shared", pa.list_(pa.int32())), ("edges", pa.list_(pa.binary())), ("widths", pa.list_(pa.int32())), ("groups", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)


def common(a: bytes, b: bytes) -> int:
    """Bytes at the start of both."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


class Trie:
    """Paths in order; of each counter its leaf, group and count, in that order."""

    def __init__(self, paths: list[bytes], names: list[tuple[str, str | None]], leaf: np.ndarray, group: np.ndarray, count: np.ndarray):
        self.paths, self.names, self.leaf, self.group, self.count = paths, names, leaf, group, count

    @staticmethod
    def of(tallies: list[tuple[list[bytes], list[tuple[str, str | None]], np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
        """The union of counters given as paths, names, and per counter the place of its path, of its name, and the count."""
        paths = sorted(set().union(*[t[0] for t in tallies]))
        names = sorted(set().union(*[t[1] for t in tallies]), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        at, place = {p: i for i, p in enumerate(paths)}, {n: i for i, n in enumerate(names)}
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, groups, leaf, group, count in tallies:
            if len(leaf):
                leaves = np.fromiter(map(at.__getitem__, own), np.int64, len(own))
                placed = np.array([place[g] for g in groups], np.int64)
                keys.append(leaves[leaf] * len(names) + placed[group])
                counts.append(count)
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, first) if len(first) else count
        key = key[first]
        return Trie(paths, names, key // max(len(names), 1), key % max(len(names), 1), total)

    def parts(self) -> tuple:
        """As ``of`` takes them: merging is ``Trie.of([a.parts(), b.parts()])``."""
        return self.paths, self.names, self.leaf, self.group, self.count

    def below(self, width: int) -> Iterator[pa.RecordBatch]:
        """A written trie for each prefix of at most ``width`` bytes."""
        if not self.paths:
            return
        shared = depths(self.paths)
        # Neighbours that share fewer bytes than the prefix has are below different prefixes.
        starts = np.flatnonzero(shared < width)
        shared[starts] = 0
        part = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(self.paths))))[self.leaf]
        names, local = np.unique(part * len(self.names) + self.group, return_inverse=True)
        first = np.searchsorted(names, np.arange(len(starts) + 1) * len(self.names))
        own = [self.names[i] for i in (names % len(self.names)).tolist()]
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
        leaves, counters = np.append(starts, len(self.paths)), np.append(np.searchsorted(self.leaf, starts), len(self.leaf))
        columns = [
            pa.array([self.paths[i][:width] for i in starts.tolist()], pa.binary()),
            lists(first, pa.array([x[0] for x in own], pa.string())),
            lists(first, pa.array([x[1] for x in own], pa.string())),
            lists(leaves, pa.array(shared.astype(np.int32))),
            lists(leaves, pa.array([p[n:] for p, n in zip(self.paths, shared.tolist(), strict=True)], pa.binary())),
            lists(leaves, pa.array(np.bincount(self.leaf, minlength=len(self.paths)).astype(np.int32))),
            lists(counters, pa.array((local - first[part]).astype(np.int32))),
            lists(counters, pa.array(self.count)),
        ]
        made = pa.RecordBatch.from_arrays(columns, schema=SCHEMA)
        for i in range(0, made.num_rows, 512):
            yield made.slice(i, 512)


def depths(paths: list[bytes]) -> np.ndarray:
    """Bytes that each of the sorted paths shares with the one before it."""
    head = np.array(paths, "S8").view(np.uint8).reshape(-1, 8)
    size = np.fromiter(map(len, paths), np.int64, len(paths))
    differ = head[1:] != head[:-1]
    out = np.zeros(len(paths), np.int64)
    out[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), 8), np.minimum(size[1:], size[:-1]))
    for i in np.flatnonzero((out == 8) & (size > 8) & (np.concatenate([[0], size[:-1]]) > 8)).tolist():
        out[i] = common(paths[i - 1], paths[i])
    return out


def read(batch: pa.RecordBatch) -> Iterator[tuple[bytes, tuple]]:
    """Prefix and parts of each written trie."""
    flat = {f: batch.column(f).flatten() for f in SCHEMA.names[1:]}
    ends = {f: np.concatenate([[0], np.cumsum(batch.column(f).value_lengths().to_numpy(zero_copy_only=False))]).tolist() for f in ("langs", "edges", "groups")}
    names = list(zip(flat["langs"].to_pylist(), flat["sources"].to_pylist(), strict=True))
    edges, shared = flat["edges"].to_pylist(), flat["shared"].to_pylist()
    widths, groups, counts = (flat[f].to_numpy().astype(np.int64) for f in ("widths", "groups", "counts"))
    for i, prefix in enumerate(batch.column("prefix").to_pylist()):
        (a, b), (c, d), (e, f) = ((ends[x][i], ends[x][i + 1]) for x in ("langs", "edges", "groups"))
        paths, before = [], b""
        for n, edge in zip(shared[c:d], edges[c:d], strict=True):
            before = before[:n] + edge
            paths.append(before)
        yield prefix, (paths, names[a:b], np.repeat(np.arange(d - c), widths[c:d]), groups[e:f], counts[e:f])
