"""Chat formatting: conversations rebuilt from their event log, then rendered with a loss mask.

A log has conv_id, turn, part, seq, kind, role and text. A conversation's messages are known by turn and part (a number or null, for
messages that share a turn) and follow each other in that order; seq orders events over the whole conversation. Kinds:

* ``message`` sets a message's role and text, ``edit`` its text,
* ``delta`` adds to the text, as a model streams it,
* ``regenerate`` drops the text for a new attempt, and with it every event of later messages that came before.

The log is parted by conversation and block of turns and sorted by message and seq; one pass folds each message in turn and holds that
message only. What a block needs to know of those before, the last regeneration, comes as one more row at its head. So a conversation
with a third of all events is dealt over many tasks, and no conversation is ever held. Only a digest of a whole conversation is by its
definition a single stream: ``digests`` takes it where the conversation lies in one block, and passes the messages of longer ones on.

A template marks turns. Control strings inside texts and roles are broken by a backslash after their first code point, and backslashes are
doubled; taking the first backslash of each pair away gives the text back, and no text can open or close a turn. Each message's
piece is formatted for itself, and a conversation is its pieces in order. The loss mask covers the escaped text of assistant messages.

Cases: a null conv_id is a conversation like any other; a null turn, part or seq comes first; null text is empty and a null role the
empty string, though a role is kept where a later event has none; repeated events count once; events of other kinds do nothing; a message
all of whose events were dropped is none; a text may be empty or of any length that a string can have, a conversation of any length; an empty
log gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("message", "edit", "delta", "regenerate")
#: Turns of a conversation that go to one task.
BLOCK = 4096
#: Code points or rows after which a task hands on what it has.
HAND_ON = 1 << 22, 4096

# Strings that chat models in common use read as marks. The first covers all marks of the form <|...|>.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")

EVENT = ("turn", "part", "seq", "kind", "role", "text")
MESSAGE = T.StructType().add("block", "long").add("whole", "boolean").add("turn", "long").add("part", "long").add("role", "string").add("text", "string")
DIGEST = T.StructType().add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")


@dataclass(frozen=True)
class Template:
    """A turn is ``start``, the role, a newline, the text and ``end``."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = CONTROLS
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if any(len(c) < 2 or "\\" in c or "\n" in c for c in self.controls):
            raise ValueError("a control string has two code points or more, and neither a backslash nor a newline")
        if "\\" in self.start + self.end or not all(any(m.startswith(c) for c in self.controls) for m in (self.start, self.end)):
            raise ValueError("a mark begins with a control string and has no backslash")
        for c in self.controls:
            if any(self.end.startswith(c[i:]) or c[i:].startswith(self.end) or self.start.endswith(c[:i]) for i in range(1, len(c))):
                raise ValueError(f"a mark and what stands beside it could make {c!r}")

    def escaped(self, text: Column) -> Column:
        """``text`` without any control string in it."""
        begins = f"(?=(?:{'|'.join(map(re.escape, self.controls))}))"
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"{begins}([\s\S])", r"$1\\")

    def read(self, piece: str) -> tuple[str, str]:
        """Role and text of a formatted piece."""
        if not piece.startswith(self.start) or piece.find(self.end) != len(piece) - len(self.end):
            raise ValueError(f"no formatted turn: {piece[:40]!r}")
        head = re.compile(r"(?:[^\\\n]|\\[\s\S])*").match(piece, len(self.start)).end()
        return unescaped(piece[len(self.start) : head]), unescaped(piece[head + 1 : -len(self.end)])


def unescaped(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text) if "\\" in text else text


def logged(turns: DataFrame, chunk: int = 400) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text), as a service would have written it: assistants stream deltas of
    ``chunk`` code points, every eighth answer is a second attempt, every eighth other message a draft that was edited. Rows
    that share a turn are messages of their own, unless they are equal. Turns are below 2^39 and texts below 2^24 chunks."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    event = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    deltas = lambda t: F.transform(F.regexp_extract_all(t, F.lit(rf"[\s\S]{{1,{chunk}}}"), F.lit(0)), lambda x: event("delta", x))
    again, start = F.pmod(F.crc32(F.concat_ws(":", "conv_id", "turn")), F.lit(8)) == 0, F.array(event("message", F.lit("")))
    answer = F.when(again, F.concat(start, deltas(F.reverse(text)), F.array(event("regenerate", F.lit(""))), deltas(text))).otherwise(F.concat(start, deltas(text)))
    other = F.when(again, F.array(event("message", F.reverse(text)), event("edit", text))).otherwise(F.array(event("message", text)))
    rows = turns.select("conv_id", "turn", F.xxhash64(role, text).alias("part"), role.alias("role"), F.posexplode(F.when(role == "assistant", answer).otherwise(other)).alias("i", "e"))
    return rows.select("conv_id", "turn", "part", (F.expr("shiftleft(coalesce(turn, -1), 24)") + F.col("i")).alias("seq"), "e.kind", "role", "e.text")


def messages(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, whole, turn, part, role, text: the final messages; each block's lie together in one partition, in order. ``whole``: the
    conversation has no other block."""
    rows = log.where(F.col("kind").isin(*KINDS)).select("conv_id", F.expr(f"turn div {block}").alias("block"), *EVENT)
    at = Window.partitionBy("conv_id").orderBy("block")
    tops = rows.groupBy("conv_id", "block").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("top"))
    heads = tops.select(
        "conv_id", "block", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("part"), F.max("top").over(at.rowsBetween(Window.unboundedPreceding, -1)).alias("seq"),
        F.lit("head").alias("kind"), F.when(F.count("*").over(Window.partitionBy("conv_id")) == 1, F.lit("whole")).alias("role"), F.lit("").alias("text"),
    )
    parted = heads.unionByName(rows).repartition("conv_id", "block")
    schema = T.StructType([rows.schema["conv_id"], *MESSAGE])
    return parted.sortWithinPartitions("conv_id", "block", F.col("kind") != "head", *EVENT).mapInArrow(lambda parts: _folded(parts, schema), schema)


class Batches:
    """Rows of ``schema`` on their way out of a task."""

    def __init__(self, schema: T.StructType) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.rows, self.size = to_arrow_schema(schema), [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= HAND_ON[0] or len(self.rows) >= HAND_ON[1]:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _later(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _folded(parts: Iterator[pa.RecordBatch], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    out = Batches(schema)
    place = whole = rewound = top = message = last = None  # the block, its head's flag, the last regeneration before this message and up to it
    role, pieces, alive = "", [], False

    def done() -> Iterator[pa.RecordBatch]:
        if alive:
            text = "".join(pieces)
            yield from out.add((*place, whole, *message, role, text), len(text))

    for row in _rows(parts):
        conv, block, turn, part, seq, kind, who, text = row
        if kind == "head":
            yield from done()
            place, whole, rewound, top, message, alive = (conv, block), who is not None, seq, seq, None, False
            continue
        if row == last:
            continue
        last = row
        if message != (turn, part):
            yield from done()
            message, rewound, role, pieces, alive = (turn, part), _later(rewound, top), "", [], False
        if rewound is not None and (seq is None or seq < rewound):
            continue
        alive, role = True, role if who is None else who
        if kind != "delta":
            pieces = []
        pieces.append(text or "")
        if kind == "regenerate":
            top = _later(top, seq)
    yield from done()
    yield from out.rest()


def rendered(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds formatted, loss_start and loss_end (code points of the piece, null outside the mask) in place of role and text; no shuffle."""
    role = F.replace(template.escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    parts = rows.withColumns({"role_": role, "text_": template.escaped(F.col("text")), "learn_": F.col("role").isin(*template.learned)})
    start = F.length("role_") + len(template.start) + 1
    return parts.select(
        "conv_id", "block", "whole", "turn", "part", F.concat(F.lit(template.start), "role_", F.lit("\n"), "text_", F.lit(template.end)).alias("formatted"),
        F.when(F.col("learn_"), start).cast("long").alias("loss_start"), F.when(F.col("learn_"), start + F.length("text_")).cast("long").alias("loss_end"),
    )


class Digest:
    """What is read back of one conversation's pieces."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.learned, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, template: Template, piece: str, start: int | None, end: int | None) -> None:
        self.turns.update("{}\n{}\n".format(*template.read(piece)).encode())
        self.n, self.chars = self.n + 1, self.chars + len(piece)
        if start is not None:
            text = unescaped(piece[start:end])
            self.loss.update(text.encode())
            self.learned += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


def digests(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from ``rendered`` pieces of ``messages``."""
    piece = ["conv_id", "block", "turn", "part", "formatted", "loss_start", "loss_end"]
    partial = T.StructType([*(pieces.schema[c] for c in piece), *DIGEST])
    blank = [None] * (len(piece) - 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces that are marked ``here``, and lie together, become their conversation's digest; other rows pass."""
        out, now, found = Batches(partial), None, None
        for here, *row in _rows(parts):
            if found and (not here or row[0] != now):
                yield from out.add((now, *blank, *found.row()), 200)
                found = None
            if here:
                now, found = row[0], found or Digest()
                found.add(template, *row[4:7])
            else:
                yield from out.add(tuple(row), len(row[4] or ""))
        if found:
            yield from out.add((now, *blank, *found.row()), 200)
        yield from out.rest()

    short = pieces.select(F.col("whole").alias("here"), *piece, *[F.lit(None).cast(f.dataType).alias(f.name) for f in DIGEST]).mapInArrow(run, partial)
    long = short.repartition("conv_id").sortWithinPartitions("conv_id", "block", "turn", "part")
    return long.select(F.isnull("n_turns").alias("here"), "*").mapInArrow(run, partial).select("conv_id", *DIGEST.names)
