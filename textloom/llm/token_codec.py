"""Token ids in files: an adaptive context-mixing range coder over independent blocks.

A block holds up to ``BLOCK`` ids as a number of lanes, consecutive stretches that are coded in
step. For every id three predictions are mixed: order 0, the adaptive frequencies of all ids;
order 1, the id that last followed the previous one; order 2, the id that last followed the
previous two. The weights of the mixture adapt to how often each prediction came true at its
present confidence. The mixture is one exact integer distribution over all ids, which drives a
64-bit range coder with carries in each lane. Model and coder start afresh with every block, so that
any block can be decoded alone, and each block carries CRC-32 sums of its ids and of its bytes.

A file is one partition of a Parquet table whose rows are blocks in order; every block is
self-describing (``encode_block``). Ids are below 65,536.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .arrow import columns, rows
from .store import Scratch
from .textvec import U
from .wordbpe import WordBpe

#: Bytes of text tokenized at once; larger than elsewhere, as little else is held beside them.
_CHUNK = 1 << 20
#: Ids in a block, most lanes of a block, ids of a lane aimed at.
BLOCK, LANES, LANE = 1 << 20, 4096, 256
_MAGIC, _HEAD = b"TLB1", struct.Struct("<4sIIIIIII")
#: Shares are parts of ``total * _WEIGHT``, below 2 to the 28th; a lane's width stays at 2 to the 32nd or more.
_IDS, _SLOTS, _WEIGHT, _LEAST, _MOST = 1 << 16, 1 << 17, 256, 12, 1 << 20
_WORD, _ALL = U(1 << 32), U((1 << 64) - 1)
_UPDATE, _GAIN = 16, 16


class _Model:
    """What encoder and decoder know alike before each step."""

    def __init__(self, lanes: int):
        self.below = np.arange(_IDS + 1, dtype=np.int32)
        self.share = np.ones(_IDS, np.int32)
        # Of each context the id that followed last, times 4, and how sure that is (0: never seen, to 3).
        self.last1, self.last2 = np.zeros(_IDS, np.int32), np.zeros(_SLOTS, np.int32)
        self.seen, self.hit1, self.hit2 = (np.zeros(16, np.int64) for _ in range(3))
        self.before1 = self.before2 = np.zeros(lanes, np.int64)
        self.new: list[np.ndarray] = []
        self.step = 0
        self.holder: np.ndarray | None = None
        self._weigh()

    def _weigh(self) -> None:
        room, n, state = _WEIGHT - _LEAST, self.seen + 12, np.arange(16)
        two = np.where(state >> 2 > 0, room * (self.hit2 + 4) // n, 0)
        one = np.where(state & 3 > 0, np.minimum(room * (self.hit1 + 3) // n, room - two), 0)
        self.weight2, self.weight1, self.weight0 = (x.astype(np.int32) for x in (two, one, _WEIGHT - one - two))

    def predict(self) -> None:
        self.total = int(self.below[-1])
        self.slot = ((self.before2 * 40503 + self.before1 * 2654435761) >> 7) & (_SLOTS - 1)
        self.got2, self.got1 = self.last2[self.slot], self.last1[self.before1]
        self.a, self.b = self.got2 >> 2, self.got1 >> 2
        self.state = (self.got2 & 3) * 4 + (self.got1 & 3)
        scale = np.int32(self.total)
        self.w2, self.w1, self.w0 = self.weight2[self.state] * scale, self.weight1[self.state] * scale, self.weight0[self.state]

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' shares begin, and how large they are, of ``total * _WEIGHT``."""
        self.right2, self.right1 = self.a == x, self.b == x
        low = self.below[x] * self.w0 + self.w2 * (self.a < x) + self.w1 * (self.b < x)
        return low, self.share[x] * self.w0 + self.w2 * self.right2 + self.w1 * self.right1

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose shares hold these points."""
        low_a = self.below[self.a] * self.w0 + self.w1 * (self.b < self.a)
        low_b = self.below[self.b] * self.w0 + self.w2 * (self.a < self.b)
        same = self.a == self.b
        past_a = at >= low_a + self.share[self.a] * self.w0 + self.w2 + self.w1 * same
        past_b = at >= low_b + self.share[self.b] * self.w0 + self.w1 + self.w2 * same
        is_a, is_b = (at >= low_a) & ~past_a, (at >= low_b) & ~past_b
        x = np.where(is_a, self.a, self.b)
        rest = np.flatnonzero(~(is_a | is_b))
        point = at[rest] - self.w2[rest] * past_a[rest] - self.w1[rest] * past_b[rest]
        if self.holder is None:
            # The id whose share holds each point; every share is at least 1.
            first = np.zeros(self.total, np.uint16)
            first[self.below[1:-1]] = 1
            self.holder = np.cumsum(first, dtype=np.uint16)
        x[rest] = self.holder[point // self.w0[rest]]
        return x

    def update(self, x: np.ndarray) -> None:
        """x: the ids just coded, whose interval was the last asked for."""
        if self.step < 16 or self.step % 4 == 0:
            self.seen += np.bincount(self.state, minlength=16)
            self.hit2 += np.bincount(self.state[self.right2], minlength=16)
            self.hit1 += np.bincount(self.state[self.right1 & ~self.right2], minlength=16)
            if self.seen.max() > 1 << 16:
                self.seen, self.hit1, self.hit2 = self.seen >> 1, self.hit1 >> 1, self.hit2 >> 1
            self._weigh()
        fresh = x * 4 + 1
        for last, at, got, right in ((self.last2, self.slot, self.got2, self.right2), (self.last1, self.before1, self.got1, self.right1)):
            sure = got & 3
            last[at] = np.where(right, got + (sure < 3), np.where(sure > 1, got - 1, fresh))
        self.before2, self.before1 = self.before1, x.astype(np.int64)
        self.new.append(x)
        self.step += 1
        if self.step in (1, 2, 4, 8) or self.step % _UPDATE == 0:
            self.share += (_GAIN * np.bincount(np.concatenate(self.new), minlength=_IDS)).astype(np.int32)
            self.new, self.holder = [], None
            while int(self.share.sum()) > _MOST:
                self.share = (self.share + 1) >> 1
            np.cumsum(self.share, out=self.below[1:])

    def narrow(self, lanes: int) -> None:
        """Only the first lanes go on."""
        self.before1, self.before2 = self.before1[:lanes], self.before2[:lanes]


def _lanes(n: int) -> np.ndarray:
    """Sizes of the lanes, the longer ones first."""
    lanes = max(1, min(LANES, -(-n // LANE)))
    return n // lanes + (np.arange(lanes) < n % lanes)


def _grid(n: int) -> list[np.ndarray]:
    """For each step the places of its ids, one for each lane that goes on."""
    size = _lanes(n)
    start = np.cumsum(size) - size
    return [start[: int((size > step).sum())] + step for step in range(int(size[0]))]


def encode_ids(ids: np.ndarray) -> bytes:
    """The coded lanes: the number of 32-bit words of each, then the words."""
    ids = np.asarray(ids, np.int64)
    if not len(ids):
        return b""
    if ids.min() < 0 or ids.max() >= _IDS:
        raise ValueError("ids must be from 0 to 65535")
    ids = ids.astype(np.int32)
    grid = _grid(len(ids))
    model, lanes, room = _Model(len(grid[0])), len(grid[0]), len(grid) + 4
    low, width = np.zeros(lanes, U), np.full(lanes, _ALL)
    words = np.zeros(lanes * room, "<u4")
    begin_at = np.arange(lanes) * room
    at = begin_at.copy()

    def carry(lane: np.ndarray) -> None:
        place = at[lane] - 1
        while len(place):
            words[place] += np.uint32(1)
            place = place[words[place] == 0] - 1

    for places in grid:
        live = len(places)
        if live < len(low):
            finished = slice(live, len(low))
            _flush(low[finished], at[finished], words)
            low, width, at_live = low[:live], width[:live], at[:live]
            model.narrow(live)
        else:
            at_live = at[:live]
        model.predict()
        x = ids[places]
        begin, share = model.interval(x)
        unit = width // U(model.total * _WEIGHT)
        moved = low + begin.astype(U) * unit
        over = np.flatnonzero(moved < low)
        if len(over):
            carry(over)
        low, width = moved, share.astype(U) * unit
        out = np.flatnonzero(width < _WORD)
        place = at_live[out]
        words[place] = low[out] >> U(32)
        at[out] = place + 1
        low[out] <<= U(32)
        width[out] <<= U(32)
        model.update(x)
    _flush(low, at[: len(low)], words)
    used = at - begin_at
    return used.astype("<u4").tobytes() + words.reshape(lanes, room)[np.arange(room) < used[:, None]].tobytes()


def _flush(low: np.ndarray, at: np.ndarray, words: np.ndarray) -> None:
    """The shortest word that leaves each lane inside its last share."""
    point = low + (_WORD - U(1))
    place = at[point < low] - 1
    while len(place):
        words[place] += np.uint32(1)
        place = place[words[place] == 0] - 1
    words[at] = point >> U(32)
    at += 1


def decode_ids(data: bytes, n: int) -> np.ndarray:
    """The ids of ``encode_ids``, as uint32."""
    if not n:
        return np.zeros(0, np.uint32)
    grid = _grid(n)
    lanes = len(grid[0])
    used = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    # Behind its words each lane reads zeros.
    flat = np.zeros(int(used.sum()) + 3 * lanes, U)
    begin = np.cumsum(used + 3) - used - 3
    flat[textvec.ragged(begin, used)] = np.frombuffer(data, "<u4", offset=4 * lanes)
    model, out = _Model(lanes), np.zeros(n, np.uint32)
    code, width, at = (flat[begin] << U(32)) | flat[begin + 1], np.full(lanes, _ALL), begin + 2
    for places in grid:
        live = len(places)
        if live < len(code):
            code, width, at = code[:live], width[:live], at[:live]
            model.narrow(live)
        model.predict()
        most = model.total * _WEIGHT
        unit = width // U(most)
        x = model.find(np.minimum(code // unit, U(most - 1)).astype(np.int32))
        begin, share = model.interval(x)
        out[places] = x
        code = code - begin.astype(U) * unit
        width = share.astype(U) * unit
        more = np.flatnonzero(width < _WORD)
        place = at[more]
        code[more] = (code[more] << U(32)) | flat[place]
        at[more] = place + 1
        width[more] <<= U(32)
        model.update(x)
    return out


def encode_block(ids: np.ndarray, keys: list, sizes: list[int], first: int, begun: int) -> bytes:
    """A block of consecutive pieces of documents.

    keys: the document id of each piece; sizes: its ids in this block; first: the number in the
    file of the first piece's document; begun: ids of that document in earlier blocks.
    """
    key = np.array([0 if k is None else k for k in keys], "<i8")
    index = zlib.compress(np.array([k is None for k in keys], np.uint8).tobytes() + key.tobytes() + np.array(sizes, "<u4").tobytes(), 6)
    body = index + encode_ids(ids)
    head = _HEAD.pack(_MAGIC, len(ids), len(keys), len(index), zlib.crc32(np.asarray(ids, "<u4").tobytes()), first, begun, zlib.crc32(body))
    return head + body


def decode_block(data: bytes) -> tuple[np.ndarray, list, np.ndarray, int, int]:
    """ids, keys, sizes, first, begun of ``encode_block``; ValueError if a checksum does not hold."""
    magic, n, pieces, length, of_ids, first, begun, of_body = _HEAD.unpack_from(data)
    body = data[_HEAD.size :]
    if magic != _MAGIC or zlib.crc32(body) != of_body:
        raise ValueError("a damaged block")
    index = zlib.decompress(body[:length])
    null = np.frombuffer(index, np.uint8, pieces)
    key = np.frombuffer(index, "<i8", pieces, pieces)
    sizes = np.frombuffer(index, "<u4", pieces, 9 * pieces).astype(np.int64)
    ids = decode_ids(body[length:], n)
    if zlib.crc32(ids.astype("<u4").tobytes()) != of_ids:
        raise ValueError("a block that decodes to other ids")
    return ids, [None if x else int(k) for x, k in zip(null, key, strict=True)], sizes, first, begun


def crc32_join(left: int, right: int, length: int) -> int:
    """The CRC-32 of two byte strings in a row, from theirs and the length of the second."""
    if not length:
        return left

    def times(matrix: list[int], vector: int) -> int:
        total, i = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[i]
            vector, i = vector >> 1, i + 1
        return total

    square = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        square = [times(square, x) for x in square]
    while length:
        if length & 1:
            left = times(square, left)
        length >>= 1
        square = [times(square, x) for x in square] if length else square
    return left ^ right


_BLOCKS = "file long, block long, start long, n_tokens long, data binary"
_BLOCKS_ARROW = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
_PIECES = "file long, document long, begun long, start long, doc_id long, n_tokens long, ids_crc32 long"
_PIECES_ARROW = pa.schema([(n, pa.int64()) for n in ("file", "document", "begun", "start", "doc_id", "n_tokens", "ids_crc32")])


def write_ids(df: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, table: str = "blocks", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes blocks in ascending order of the id; returns the written table.

    One exchange by range of the id (equal ids by their text, repeated rows by their turn, so that many of
    them still lie in several ranges), then each partition is one file. Null texts are empty; a null id comes first.
    """

    def encode(batches):
        file, bpe = TaskContext.get().partitionId(), WordBpe.at(tokenizer)
        held: list[np.ndarray] = []
        keys: list = []
        sizes: list[int] = []
        n = start = block = first = begun = 0

        def row():
            nonlocal held, keys, sizes, n, start, block
            ids = np.concatenate(held)
            out = rows(_BLOCKS_ARROW, file=[file], block=[block], start=[start], n_tokens=[n], data=[encode_block(ids, keys, sizes, first, begun)])
            held, keys, sizes, start, block, n = [], [], [], start + n, block + 1, 0
            return out

        document = 0
        for part, docs, _ in textvec.chunks(batches, limit=_CHUNK):
            flat, at = bpe.ids(docs)
            for i, key in enumerate(part.column(0).to_pylist()):
                ids = np.append(flat[at[i] : at[i + 1]], np.uint32(end_id))
                done = 0
                while done < len(ids):
                    if not keys:
                        first, begun = document, done
                    piece = ids[done : done + BLOCK - n]
                    held.append(piece)
                    keys.append(key)
                    sizes.append(len(piece))
                    n, done = n + len(piece), done + len(piece)
                    if n == BLOCK:
                        yield row()
                document += 1
        if keys:
            yield row()

    texts = columns(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    own = ["doc_id", "tie", "turn"]
    ordered = texts.withColumn("tie", F.xxhash64("text")).withColumn("turn", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*own).sortWithinPartitions(*own)
    return scratch.keep(ordered.select("doc_id", "text").mapInArrow(encode, _BLOCKS), table)


def read_ids(blocks: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                ids, keys, sizes, first, begun = decode_block(row["data"])
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                k = len(keys)
                yield rows(_PIECES_ARROW, file=[row["file"]] * k, document=first + np.arange(k), begun=[begun] + [0] * (k - 1), start=row["start"] + ends - sizes, doc_id=keys, n_tokens=sizes, ids_crc32=crc)
        textvec.trim()

    @F.pandas_udf("long")
    def join(pieces):
        import pandas as pd

        out = []
        for each in pieces:
            if each is None:
                out.append(None)
                continue
            each = sorted(each, key=lambda x: x["begun"])
            crc = each[0]["crc"]
            for x in each[1:]:
                crc = crc32_join(crc, x["crc"], 4 * x["n"])
            out.append(crc)
        return pd.Series(out, dtype="Int64")

    pieces = blocks.select("file", "start", "data").mapInArrow(decode, _PIECES)
    documents = _by_document(pieces, join)
    # One row for each file: as many as partitions.
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return documents.join(files, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _by_document(pieces: DataFrame, join) -> DataFrame:
    each = pieces.groupBy("file", "document").agg(
        F.min("start").alias("start"),
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.collect_list(F.struct("begun", F.col("n_tokens").alias("n"), F.col("ids_crc32").alias("crc"))).alias("pieces"),
    )
    # Most documents lie in one block and need no joining.
    joined = join(F.when(F.size("pieces") > 1, F.col("pieces")))
    return each.withColumn("ids_crc32", F.coalesce(joined, F.col("pieces")[0]["crc"])).drop("pieces")
