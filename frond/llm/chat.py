r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only the reply is under
the loss mask. A turn of a user, a system or any other role is written ``[INST]role[/ROLE]text[/INST]``, a reply
``<s>text</s>``. Where a text or role holds one of these control strings, a backslash is put after the string's first
character, and backslashes of the text are doubled; reading a formatted text back undoes both.

Every example is whole in its row, whatever its length, so contexts repeat all that came before and a conversation of n
turns takes space in n squared; that is what the expansion means. Turns after the last reply are written as a row of kind
"tail", which trains nothing, so that conversations can be read back whole. Reading back checks that each row begins with
all that the row before it held.

Spark sorts the turns by conversation; the formatter and the reader are streams over sorted rows that hold one example in
memory, so a conversation may have any share of all rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE, CLOSE, REPLY, END = "[INST]", "[/ROLE]", "[/INST]", "<s>", "</s>"
_CONTROL = r"(\[)(/?INST\]|/ROLE\])|(<)(/?s>)"
_TURN = re.compile(r"\[INST\](.*?)\[/ROLE\](.*?)\[/INST\]|<s>(.*?)</s>", re.DOTALL)
_ESCAPED = re.compile(r"\\(\\?)")
EXAMPLES = "conv_id long, example long, kind string, target_turn long, text string, loss_start long, loss_end long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, n_damaged long"
#: Rows and characters after which a batch is sent.
ROWS, CHARS = 256, 4_000_000


def escaped(text: Column) -> Column:
    """The text with its backslashes doubled and its control strings broken by a backslash; null is empty."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1$3\\$2$4")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= ROWS or chars >= CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_LONG, _TEXT = pa.int64(), pa.string()
_EXAMPLE_SCHEMA = pa.schema(
    [("conv_id", _LONG), ("example", _LONG), ("kind", _TEXT), ("target_turn", _LONG), ("text", _TEXT), ("loss_start", _LONG), ("loss_end", _LONG)]
)
_READ_SCHEMA = pa.schema(
    [("conv_id", _LONG), ("n_turns", _LONG), ("turns_sha256", _TEXT), ("loss_chars", _LONG), ("loss_sha256", _TEXT), ("formatted_chars", _LONG), ("n_examples", _LONG), ("n_damaged", _LONG)]
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns))


def _expand(turns: Iterator[tuple]) -> Iterator[tuple]:
    """Turns in order (conv_id, reply?, formatted) to examples."""
    none = object()
    current, context, number, turn, fresh = none, "", 0, 0, False
    for conv, reply, formatted in turns:
        if conv != current:
            if fresh:
                yield current, number, "tail", None, context, None, None
            current, context, number, turn, fresh = conv, "", 0, 0, False
        start = len(context) + len(REPLY)
        context += formatted
        fresh = not reply
        if reply:
            yield conv, number, "example", turn, context, start, len(context) - len(END)
            number += 1
        turn += 1
    if fresh:
        yield current, number, "tail", None, context, None, None


def examples(conversations: DataFrame) -> DataFrame:
    """The training rows of ``conversations`` (conv_id, turn, role, text), the rows of a conversation together and in order.

    Columns: conv_id, example (their order), kind, target_turn (place of the reply from 0), text (all turns before the reply,
    then the reply), loss_start and loss_end (code points of the reply's text in ``text``). Turns are ordered by turn, then role, then text, nulls first, so
    ties have one order; repeated rows are turns of their own. Null roles and texts are empty; rows with a null conv_id
    form one conversation. Only the role "assistant" is trained. An empty table gives an empty result, other columns are
    ignored.
    """
    reply = F.coalesce(F.col("role") == "assistant", F.lit(False))
    said = F.when(reply, F.concat(F.lit(REPLY), escaped(F.col("text")), F.lit(END))).otherwise(
        F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(ROLE), escaped(F.col("text")), F.lit(CLOSE))
    )
    turns = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.select("conv_id", reply.alias("reply"), said.alias("said")).mapInArrow(lambda b: _batches(_expand(_rows(b)), _EXAMPLE_SCHEMA), EXAMPLES)


class _Reader:
    """What is read back from one conversation's rows; the newest row is all that is kept of them."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.before = conv, hashlib.sha256(), hashlib.sha256(), ""
        self.n_turns = self.loss_chars = self.formatted = self.n_examples = self.n_damaged = 0

    def take(self, kind: str, text: str, start: int | None, end: int | None) -> None:
        self.formatted += len(text)
        at = len(self.before)
        self.n_damaged += not text.startswith(self.before)
        for m in _TURN.finditer(text, at):
            role, said, reply = m.groups()
            role, said = ("assistant", reply) if reply is not None else (unescaped(role), said)
            self.turns.update(f"{role}\n{unescaped(said)}\n".encode())
            self.n_turns += 1
            at = m.end()
        self.n_damaged += at < len(text)  # something that is no turn
        self.before = text
        if kind == "example":
            trained = unescaped(text[start:end])
            self.loss.update(trained.encode())
            self.loss_chars += len(trained)
            self.n_examples += 1

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.n_examples, self.n_damaged


def _read(rows: Iterator[tuple]) -> Iterator[tuple]:
    reader = None
    for conv, _, kind, _, text, start, end in rows:
        if reader is None or reader.conv != conv:
            if reader is not None:
                yield reader.row()
            reader = _Reader(conv)
        reader.take(kind, text, start, end)
    if reader is not None:
        yield reader.row()


def read_back(formatted: DataFrame, sorted_rows: bool = False) -> DataFrame:
    """Conversations as found in formatted rows alone: READ's columns, one row for each.

    turns_sha256 digests role, newline, text, newline of every turn; loss_sha256 all text under the loss masks, in order;
    n_damaged counts rows that don't begin with the row before them, or hold something that is no turn.
    sorted_rows says that the rows of a conversation come together and in order, as ``examples`` makes them; stored rows
    are sorted first.
    """
    rows = formatted.select(*_EXAMPLE_SCHEMA.names)
    if not sorted_rows:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return rows.mapInArrow(lambda b: _batches(_read(_rows(b)), _READ_SCHEMA), READ)
