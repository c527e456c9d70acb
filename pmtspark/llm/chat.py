"""Chat formatting: each assistant turn is an example whose context is all turns before it.

The formatted text of an example is the conversation's formatted text up to the end of its
target turn. ``examples`` spells every one out with its context, which grows with the square of a
conversation's length; so the examples are made from segments that are shuffled once, and
stream from the task that makes them to the one that reads them. ``render`` makes the texts of a
chosen few.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "<turn ", ">\n", "\n</turn>\n"
TRAINED = "assistant"
#: Characters of examples that a batch holds, beyond its last one.
BATCH_CHARS = 1 << 22
_HEADER = re.compile(r"<turn ((?:\\.|[^\\>])*)>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    r"""Backslash before ``\``, ``<`` and ``>``: no marker can begin inside."""
    for c in ("\\", "<", ">"):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head = _HEADER.match(segment)
    if head is None or not segment.endswith(CLOSE):
        raise ValueError(f"not a formatted turn: {segment[:60]!r}")
    return unescape(head[1]), unescape(segment[head.end() : len(segment) - len(CLOSE)])


def format_turns(turns: DataFrame) -> DataFrame:
    """A row per turn: conv_id, number (from 0), segment, start and end, trained, loss span.

    Positions count code points of the conversation's formatted text. Columns used:
    conv_id, turn, role, text. Null role and text are empty; null conversation ids are one
    conversation. Turns are ordered by turn (nulls first), role and text, so ties and
    repeated rows have a fixed order, and each stays a turn of its own. Rows of a
    conversation leave in order, in one task; that task holds one segment at a time.
    """
    order = [F.asc_nulls_first("turn"), "role", "text"]
    ordered = W.partitionBy("conv_id").orderBy(*order)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(AFTER_ROLE))
    made = rows.select(
        "*", head.alias("head"), F.concat("head", escape(F.col("text")), F.lit(CLOSE)).alias("segment")
    )
    placed = made.withColumns(
        {
            "number": F.row_number().over(ordered) - 1,
            "last": F.lead(F.lit(False), 1, True).over(ordered),
            "start": F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)),
        }
    )
    trained = F.col("role") == TRAINED
    end = F.col("start") + F.length("segment")
    return placed.select(
        "conv_id",
        "number",
        "segment",
        "start",
        end.alias("end"),
        trained.alias("trained"),
        (~trained & F.col("last")).alias("untrained_rest"),
        F.when(trained, F.col("start") + F.length("head")).alias("loss_start"),
        F.when(trained, end - len(CLOSE)).alias("loss_end"),
    )


def examples(segments: DataFrame) -> DataFrame:
    """A row per example: conv_id, target, text, loss_start, loss_end.

    ``target`` is the number of the example's last turn; ``text`` is the formatted text of all
    turns before it, the context, and of that turn. The loss span covers the text of an assistant
    turn. Turns after the last assistant turn are one more example, without a loss span,
    so that no turn is lost. Rows of a conversation must lie together in order, as
    ``format_turns`` leaves them; examples keep that order. A task holds one conversation's text.
    """
    names = ["conv_id", "target", "text", "loss_start", "loss_end"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, upto, out, chars = None, None, [], 0
        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int32(), pa.string(), pa.int64(), pa.int64()]

            def made(rows: list[tuple], types: list = types) -> pa.RecordBatch:
                columns = zip(*rows, strict=True)
                arrays = [pa.array(v, t) for v, t in zip(columns, types, strict=True)]
                return pa.RecordBatch.from_arrays(arrays, names)

            for row in batch.to_pylist():
                if upto is None or row["conv_id"] != conv:
                    conv, upto = row["conv_id"], ""
                if len(upto) != row["start"]:
                    raise ValueError(f"turn {row['number']} does not follow its context")
                upto += row["segment"]
                if row["trained"] or row["untrained_rest"]:
                    out.append((conv, row["number"], upto, row["loss_start"], row["loss_end"]))
                    chars += len(upto)
                if chars > BATCH_CHARS:
                    yield made(out)
                    out, chars = [], 0
            if out:
                yield made(out)
                out, chars = [], 0

    rows = segments.select(
        "conv_id", "number", "segment", "start", "trained", "untrained_rest", "loss_start", "loss_end"
    )
    kind = dict(segments.dtypes)["conv_id"]
    return rows.mapInArrow(spell, f"conv_id {kind}, target int, text string, loss_start long, loss_end long")


def render(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of ``wanted`` examples: conv_id, target, text, loss_start, loss_end.

    For the examples a training step reads; ``wanted`` needs no text, and any order will do.
    """
    own = segments.select(F.col("conv_id").alias("c"), "number", "segment")
    parts = wanted.join(
        own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("number") <= F.col("target"))
    )
    turns = F.array_sort(F.collect_list(F.struct("number", "segment")))
    return parts.groupBy("conv_id", "target", "loss_start", "loss_end").agg(
        F.array_join(F.transform(turns, lambda x: x["segment"]), "").alias("text")
    )


def digest_conversations(segments: DataFrame) -> DataFrame:
    """Read conversations back from the texts of their examples, a row per conversation.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars
    and loss_sha256 (text under the loss masks of all examples, without escapes), examples, and
    formatted_chars (characters of all examples' texts). An example's context must be the text
    of the example before it and turns without a loss span; its own turns are parsed.
    """

    def add(state: list, row: dict) -> None:
        text = row["text"]
        if not text.startswith(state[-1]):
            raise ValueError(f"the context of example {row['target']} differs from the one before")
        for piece in text[len(state[-1]) :].split(CLOSE)[:-1]:
            role, said = parse(piece + CLOSE)
            state[0] += 1
            state[1].update(f"{role}\n{said}\n".encode())
        if state[0] != row["target"] + 1:
            raise ValueError(f"example {row['target']} holds {state[0]} turns")
        if row["loss_start"] is not None:
            loss = unescape(text[row["loss_start"] : row["loss_end"]])
            state[2] += len(loss)
            state[3].update(loss.encode())
        state[4] += 1
        state[5] += len(text)
        state[-1] = text

    return _by_conversation(
        examples(segments),
        lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, ""],
        add,
        {
            "n_turns": "long",
            "turns_sha256": "string",
            "loss_chars": "long",
            "loss_sha256": "string",
            "examples": "long",
            "formatted_chars": "long",
        },
    )


def _by_conversation(
    rows: DataFrame,
    begin: Callable[[], list],
    add: Callable[[list, dict], None],
    columns: dict[str, str],
) -> DataFrame:
    """Fold the rows of each conversation, which lie together; hash states become hex digits.

    What a state holds beyond ``columns`` is not returned.
    """
    kinds = {"long": pa.int64(), "string": pa.string()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, conv, state, out = None, None, None, []

        def closed() -> tuple:
            kept = state[: len(columns)]
            return (conv, *(x if isinstance(x, int) else x.hexdigest() for x in kept))

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            types = [kind, *(kinds[k] for k in columns.values())]
            values = zip(*made, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, types, strict=True)], ["conv_id", *columns]
            )

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    if state:
                        out.append(closed())
                    conv, state = row["conv_id"], begin()
                add(state, row)
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if state:
            yield batch_of([*out, closed()])

    kind = dict(rows.dtypes)["conv_id"]
    shape = ", ".join(f"{c} {k}" for c, k in columns.items())
    return rows.mapInArrow(fold, f"conv_id {kind}, {shape}")
