"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and its reply alone is trainable.
Turns after the last assistant turn (or a conversation without one) become one more example without a trainable part, so
that the output holds every turn and can be read back.

A turn is written as `<|turn|>role<|says|>text<|end|>`. Inside roles and texts a backslash is doubled, and one is put behind
the first character of every string that the template, or another common chat template, uses as control; reading
back takes them out again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = re.compile(r"\\|<(?=\||s>|/s>|<SYS>>|</SYS>>|/?SYS>>)|\[(?=/?INST\])", re.ASCII)
_PART = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.DOTALL)
#: Bytes of examples that are passed on together.
BATCH_BYTES = 8 << 20


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"(.)\\|(.)", lambda m: m.group(1) or m.group(2), text, flags=re.DOTALL) if "\\" in text else text


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text starts and ends."""
    head = f"{TURN}{escape(role)}{SAYS}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _PART.finditer(formatted)]


def expand(turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """(formatted, loss_start, loss_end) of each example of a conversation; without a trainable part both are the length."""
    context, pending = "", False
    for role, text in turns:
        piece, a, b = write_turn(role, text)
        at = len(context)
        context += piece
        pending = role != "assistant"
        if not pending:
            yield context, at + a, at + b
    if pending:
        yield context, len(context), len(context)


def _by_conversation(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, role, text) with the turns of each conversation together in one partition, in order."""
    rows = conversations.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, example, formatted, loss_start, loss_end): the examples of every conversation, numbered from 0.

    loss_start and loss_end are code points. Turns are ordered by turn (nulls first), then role and text; repeated rows are
    turns of their own; null roles and texts are empty; a null conversation id is a conversation like others; an
    empty table gives no examples. A worker holds one turn and the context so far, never the whole conversation's examples:
    those are passed on as they are made.
    """
    source = _by_conversation(conversations, conv, turn, role, text)
    kind = source.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def groups():
            """(conversation id, turns) with the rows of all batches as one stream."""
            for batch in batches:
                yield from zip(batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)

        from itertools import groupby

        def out():
            cols = list(zip(*held, strict=True))
            types = [source_type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv", "example", "formatted", "loss_start", "loss_end"])

        for key, rows in groupby(groups(), key=lambda r: r[0]):
            for k, (formatted, a, b) in enumerate(expand((r[1], r[2]) for r in rows)):
                held.append((key, k, formatted, a, b))
                size += len(formatted)
                if size > BATCH_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    source_type = to_arrow_type(source.schema["conv"].dataType)
    return source.mapInArrow(run, f"conv {kind}, example long, formatted string, loss_start long, loss_end long").withColumnRenamed("conv", conv)


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the examples of format_chats.

    The examples of a conversation must stand together and in order, as format_chats leaves them: no shuffle. The turns
    come from the last example, which holds them all; the trainable texts come from every example's mask.
    """
    source = examples.select(F.col(f"`{conv}`").alias("conv"), "formatted", "loss_start", "loss_end")
    kind = source.schema["conv"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    source_type = to_arrow_type(source.schema["conv"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(key, last: str, loss, chars: int, n_loss: int) -> tuple:
            turns = read_turns(last)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
            return key, len(turns), digest.hexdigest(), n_loss, loss.hexdigest(), chars

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [source_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        open_, key, last, loss, chars, n_loss, done = False, None, "", hashlib.sha256(), 0, 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                k, formatted, a, b = (batch.column(i)[row].as_py() for i in range(4))
                if open_ and k != key:
                    done.append(result(key, last, loss, chars, n_loss))
                    loss, chars, n_loss = hashlib.sha256(), 0, 0
                open_, key, last = True, k, formatted
                text = unescape(formatted[a:b])
                loss.update(text.encode("utf-8", "surrogatepass"))
                n_loss += len(text)
                chars += len(formatted)
            if done:
                yield batch_of(done)
                done = []
        if open_:
            yield batch_of([result(key, last, loss, chars, n_loss)])

    return source.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv)
