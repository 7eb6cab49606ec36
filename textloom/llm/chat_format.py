"""Conversations formatted by a compiled template, and read back from what was written.

Turns meet by conversation in one exchange and are rendered in order, a turn at a time where the template
streams. A formatted conversation is one row, or several that end with a turn where it is longer than ``PIECE``
code points; spans under the generation marker are offsets in the row's own text. Reading back needs an
exchange only for conversations of several rows.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chat_template as ct
from .arrow import columns, rows

#: Code points after which a conversation goes on in another row.
PIECE = 1 << 20
#: The control strings of the format.
START, END = "<|im_start|>", "<|im_end|>"
#: Turns between control strings; the assistant's texts are under the loss mask, without the marks around them.
TEMPLATE = """
{%- for message in messages -%}
{{ '<|im_start|>' + (message.role | escape_line) + '\\n' }}
{%- if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}
{%- else %}{{ message.content | escape }}
{%- endif %}{{ '<|im_end|>\\n' }}
{%- endfor -%}
"""

_FORMATTED = "conv_id long, piece int, last boolean, n_turns int, text string, starts array<int>, ends array<int>"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _turns(batches):
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)


def format_conversations(df: DataFrame, template: str = TEMPLATE, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE, **values) -> DataFrame:
    """Rows of the formatted conversations: conv_id, piece, last, n_turns, text, starts, ends.

    Null roles and texts are empty; a null conversation is one. Turns are in order of their number, null first,
    then role and text; repeated rows are turns each. ``values`` are further names of the template. A template
    that asks for a conversation as a whole gets it in memory; one that streams never does. An empty table gives
    no rows. What the template raises fails the job, as does a template that is not of the language.
    """
    ct.Template(template)
    slim = columns(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    slim = slim.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        made, held, size = ct.Template(template), [], 0
        for conv, turns in groupby(_turns(batches), key=lambda x: x[0]):
            before = None
            for n, found in enumerate(made.pieces(({"role": r, "content": t} for _, r, t in turns), piece, **values)):
                if before:
                    held.append((conv, n - 1, False, *before))
                before = found
                size += len(found[0])
                if size > piece or len(held) > 1000:
                    yield from batch(held)
                    held, size = [], 0
            held.append((conv, n, True, *before))
        yield from batch(held)

    def batch(held):
        if held:
            conv, n, last, text, spans, turns = zip(*held, strict=True)
            parts = [pa.array(conv, pa.int64()), pa.array(n, pa.int32()), pa.array(last), pa.array(turns, pa.int32()), pa.array(text, pa.string())]
            parts += [pa.array([[x[i] for x in s] for s in spans], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(parts, names=["conv_id", "piece", "last", "n_turns", "text", "starts", "ends"])

    return ordered.mapInArrow(run, _FORMATTED)


def turns_of(text: str):
    """Roles and texts of a formatted piece."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = text.index("\n", at)
        end = text.index(END, line)
        yield ct.unescape_line(text[at + len(START) : line]), ct.unescape(text[line + 1 : end])
        at = end + len(END) + 1


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each formatted conversation: digests of its turns and of its text under the loss mask, unescaped."""

    def run(batches):
        own = ((b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()) for b in batches)
        pieces = (x for b in own for x in zip(*b, strict=True))
        found: list[tuple] = []
        for conv, parts in groupby(pieces, key=lambda x: x[0]):
            turns, loss, n, lost, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, starts, ends in parts:
                for role, said in turns_of(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, b in zip(starts, ends, strict=True):
                    masked = ct.unescape(text[a:b])
                    loss.update(masked.encode())
                    lost += len(masked)
                chars += len(text)
            found.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
            if len(found) == 1000:
                yield rows(_DIGEST, **dict(zip(_DIGEST.names, zip(*found, strict=True), strict=True)))
                found = []
        if found:
            yield rows(_DIGEST, **dict(zip(_DIGEST.names, zip(*found, strict=True), strict=True)))

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    alone = F.col("last") & (F.col("piece") == 0)
    single = formatted.where(alone).select("conv_id", "text", "starts", "ends").mapInArrow(run, kinds)
    several = formatted.where(~alone).repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "text", "starts", "ends").mapInArrow(run, kinds)
    return single.unionByName(several)
