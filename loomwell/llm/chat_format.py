"""Chat formatting: conversations through a compiled template into texts with a loss mask, and back.

Turns are brought together by conversation in one exchange, sorted within their
partitions, and rendered as a stream: of a conversation of any length a task holds
the messages of one part. Long conversations become several parts, cut between
messages; the parts of the others stand alone and are read back without another exchange.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, chat_template

#: Marks turns; roles and texts can't hold a mark, since no ``<|`` is left in them.
TEMPLATE = """{%- for message in messages -%}
<|im_start|>{{ message.role | escape_line }}
{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}<|im_end|>
{% endfor -%}
"""
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
PART = 1 << 18  # characters from which on a part ends with the next message
PARTS = "conv_id long, part int, at long, text string, starts array<long>, ends array<long>, last boolean"


def _records(batches, columns: list[str]):
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in columns])


def _batched(rows, names: list[str], kinds: list, held, size: int = 1 << 20, most: int = 2000):
    """Arrow batches of tuples, of not much more than ``size`` by ``held``."""
    some, n = [], 0
    for r in rows:
        some.append(r)
        n += held(r)
        if n >= size or len(some) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names)
            some, n = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names)


def parts(messages, template: chat_template.Template, size: int = PART):
    """(part, at, text, starts, ends, last) of one conversation."""
    sink, n, at, waiting = chat_template.Sink(), 0, 0, None
    for _ in template.stream(messages, sink):
        if sink.at - at >= size:
            if waiting is not None:
                yield (*waiting, False)
            text, spans = sink.take()
            waiting, at, n = (n, at, text, [s for s, _ in spans], [e for _, e in spans]), sink.at, n + 1
    text, spans = sink.take()
    if text or waiting is None:
        if waiting is not None:
            yield (*waiting, False)
        waiting = (n, at, text, [s for s, _ in spans], [e for _, e in spans])
    yield (*waiting, True)


def format_conversations(turns: DataFrame, template: str = TEMPLATE, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, at, text, starts, ends, last: the formatted text in parts, and where in it what is generated begins and ends.

    ``at`` and the spans count characters of the whole conversation. Rows of a
    conversation go by turn (null first), then by role and text; repeated rows are
    turns each. Null roles and texts are empty, rows with a null id are one
    conversation; an empty table gives no rows. A text of any length is one message, a
    conversation of any length a stream of parts, unless its template asks for all messages at
    once. Columns other than the four named take no part, whatever they are called.
    """
    chat_template.compile_template(template)  # what is wrong with it is said here, not in a task

    def run(batches):
        made = chat_template.compile_template(template)

        def rows():
            for conv, group in itertools.groupby(_records(batches, ["conv_id", "turn", "role", "text"]), key=lambda r: r[0]):
                for p in parts(({"turn": r[1], "role": r[2] or "", "text": r[3] or ""} for r in group), made):
                    yield (conv, *p)

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
        return _batched(rows(), ["conv_id", "part", "at", "text", "starts", "ends", "last"], kinds, lambda r: len(r[3]))

    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return _shared.map_batches(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), run, PARTS)


def turns_of(text: str):
    """(role, text) of the turns of a part, as they were before they were formatted."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        yield chat_template.unescape_line(m[1]), chat_template.unescape(m[2])
    if at != len(text):
        raise ValueError(f"no turn at character {at}: {text[at:at + 40]!r}")


def _digest(conv, group) -> tuple:
    turns, loss, n, length, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for _, at, text, starts, ends in group:
        for role, said in turns_of(text):
            turns.update(f"{role}\n{said}\n".encode())
            n += 1
        for s, e in zip(starts, ends):
            said = chat_template.unescape(text[s - at:e - at])
            loss.update(said.encode())
            length += len(said)
        chars += len(text)
    return conv, n, turns.hexdigest(), length, loss.hexdigest(), chars


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the parts alone.

    Only the parts of conversations that have several meet in an exchange, and are read there one after the other.
    """
    cols = ["conv_id", "at", "text", "starts", "ends"]

    def digests(batches, alone: bool):
        records = _records(batches, cols)
        groups = ((r[0], [r]) for r in records) if alone else itertools.groupby(records, key=lambda r: r[0])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return _batched((_digest(conv, group) for conv, group in groups), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], kinds, lambda r: 0)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    whole = (F.col("part") == 0) & F.col("last")
    alone = _shared.map_batches(formatted.filter(whole).select(*cols), lambda b: digests(b, True), schema)
    several = formatted.filter(~whole).select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return alone.union(_shared.map_batches(several, lambda b: digests(b, False), schema))
