"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context,
and its text as the only trainable part.  Turns after the last assistant turn, or
all turns of a conversation without one, are kept in an example without a trainable
part, so that the output holds every turn.

A turn is written as `<s>[INST]role[/INST]text</s>`.  Those four control strings are
broken up where they occur inside a role or text: a backslash goes in after their
first character, and backslashes that were there are doubled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._store import bounded_batches

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_NEEDS = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_ESCAPED = re.compile(r"\\(\\?)")
#: Characters of examples handed on at once.
BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    return _NEEDS.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends in it."""
    head = f"<s>[INST]{escape(role)}[/INST]"
    body = escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of an example."""
    turns = []
    for part in formatted.split("</s>")[:-1]:
        role, _, text = part.removeprefix("<s>[INST]").partition("[/INST]")
        turns.append((unescape(role), unescape(text)))
    return turns


_EXAMPLE = "example int, text string, loss_start long, loss_end long"


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end of every example; the mask in code points of `text`, empty if nothing is trainable.

    `turns` has conv_id, turn, role, text.  Turns go by number, then role, then text; a
    null turn comes first, a null role or text is empty.  Rows without a conversation
    form one of their own.  Examples of a conversation follow each other in one
    partition.  Turns are read as a stream, one conversation in memory at a time.
    """
    bounded_batches(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "example", "text", "loss_start", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        conv, open_conv, context, length, number, trailing = None, False, [], 0, 0, False

        def batch(id_type):
            columns = list(zip(*out, strict=True))
            return pa.record_batch([pa.array(columns[0], id_type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names)

        id_type = None
        for b in batches:
            id_type = b.schema.field("conv_id").type
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if not open_conv or c != conv:
                    if trailing:
                        out.append((conv, number, "".join(context), length, length))
                        held += length
                    conv, open_conv, context, length, number, trailing = c, True, [], 0, 0, False
                written, start, end = format_turn(role, text)
                context.append(written)
                trailing = role != "assistant"
                if not trailing:
                    context = ["".join(context)]
                    out.append((conv, number, context[0], length + start, length + end))
                    held += len(context[0])
                    number += 1
                length += len(written)
                if held > BATCH_CHARS:
                    yield batch(id_type)
                    out, held = [], 0
        if trailing:
            out.append((conv, number, "".join(context), length, length))
        if out:
            yield batch(id_type)

    return rows.mapInArrow(run, f"conv_id {kind}, {_EXAMPLE}")


def digest(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read back from `expand`'s rows as they come."""
    kind = dict(examples.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, loss, chars, size = None, None, None, 0, 0

        def row():
            turns = parse(last)
            return conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), chars, loss.hexdigest(), size

        def batch(rows, id_type):
            columns = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3], pa.int64()), pa.array(columns[4]), pa.array(columns[5], pa.int64())], names)

        id_type = None
        for b in batches:
            rows, id_type = [], b.schema.field("conv_id").type
            for c, text, start, end in zip(*(b.column(k).to_pylist() for k in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
                if last is None or c != conv:
                    if last is not None:
                        rows.append(row())
                    conv, loss, chars, size = c, hashlib.sha256(), 0, 0
                part = unescape(text[start:end])
                loss.update(part.encode())
                chars += len(part)
                size += len(text)
                last = text
            if rows:
                yield batch(rows, id_type)
        if last is not None:
            yield batch([row()], id_type)

    return examples.select(*examples.columns).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
