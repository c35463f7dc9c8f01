"""Chat formatting by event sourcing.

A log holds events of conversations: ``conv_id``, ``seq``, ``message_id``, ``op``, ``role``, ``text``.

=============  ==========================================================
op             effect on the message named by (conv_id, message_id)
=============  ==========================================================
``message``    its text becomes the event's text
``delta``      the event's text is appended (a streamed token chunk)
``edit``       its text becomes the event's text
``regenerate`` what was there is discarded; the event's text starts anew
``delete``     the message is withdrawn (a later ``message`` restores it)
=============  ==========================================================

`fold_events` reconstructs the messages, `render` puts them in a template, one row per message,
and `read_back` parses the rendered text again.  Folding is keyed by message and rendering streams
over sorted rows, so that a conversation of any length needs the memory of one message.

Defined cases: null text is empty, a null role is empty, a null conv_id is a conversation of its
own, a null op counts as ``message``, unknown ops are ignored, ties of ``seq`` are ordered by role, text
and message id, extra columns are dropped, an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import records

RESETS = ("message", "edit", "regenerate", "delete")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of a control string of the common templates.
_REST = r"(?=\|[A-Za-z0-9_]*\|>|/?s>|</?SYS>>|/?INST\])"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _REST)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _REST)
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)

RENDERED = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("formatted", pa.string()), ("start", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_DDL = {pa.int64(): "long", pa.string(): "string"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def escape(text: str) -> str:
    """One backslash goes into each control string, after its first character and before any
    backslashes that stand there already; all other text stays as it is."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, position (the first seq), message_id, role, text."""
    op = F.coalesce("op", F.lit("message"))
    known = events.select("conv_id", "message_id", F.struct(F.col("seq").cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), op.alias("op")).alias("e")).filter(op.isin(*RESETS, "delta"))
    log = known.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list("e")).alias("log"))
    reset = F.array_max(F.transform("log", lambda e, i: F.when(e["op"].isin(*RESETS), i)))
    log = log.withColumn("at", F.coalesce(reset, F.lit(-1)))
    live = F.expr("slice(log, greatest(at, 0) + 1, size(log))")
    return log.filter("at < 0 or get(log, at).op <> 'delete' or at + 1 < size(log)").select(
        "conv_id",
        F.col("log")[0]["seq"].alias("position"),
        "message_id",
        F.coalesce(F.expr("get(filter(log, e -> e.role <> ''), 0).role"), F.lit("")).alias("role"),
        F.array_join(F.transform(F.filter(live, lambda e: e["op"] != "delete"), lambda e: e["text"]), "").alias("text"),
    )


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: object = ()
    turn = start = 0
    for batch in batches:
        out: list[list] = [[] for _ in RENDERED]
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if conv != now:
                now, turn, start = conv, 0, 0
            head = f"{OPEN}{escape_role(role)}\n"
            body = escape(text)
            mask = (start + len(head), start + len(head) + len(body)) if role == "assistant" else (None, None)
            formatted = f"{head}{body}{CLOSE}"
            for column, value in zip(out, (conv, turn, formatted, start, *mask), strict=True):
                column.append(value)
            turn, start = turn + 1, start + len(formatted)
        yield records(RENDERED, out)


def render(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn_no, formatted, start (of ``formatted`` in the
    conversation, in code points) and the loss mask (loss_start, loss_end), null but for
    assistant turns.  A conversation's text is its rows' ``formatted`` in order of turn_no; its rows
    are neighbours in one partition, in that order."""
    ordered = messages.repartition("conv_id").sortWithinPartitions("conv_id", "position", "role", "text", "message_id")
    return ordered.select("conv_id", "role", "text").mapInArrow(_render, ddl(RENDERED))


class _Reader:
    """Parses one conversation's rendered text, fed in order and in pieces of any size."""

    def __init__(self, conv: object) -> None:
        self.conv, self.rest, self.n, self.chars, self.loss_chars = conv, "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, mask: str | None) -> None:
        self.chars += len(piece)
        self.rest += piece
        end = 0
        for m in _TURN.finditer(self.rest):
            self.turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            self.n, end = self.n + 1, m.end()
        self.rest = self.rest[end:]
        if mask is not None:
            text = unescape(mask)
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv}: the rendered text doesn't end with a turn")
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader: _Reader | None = None
    for batch in batches:
        rows = []
        for conv, _, formatted, start, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if reader is None or reader.conv != conv:
                rows += [reader.row()] if reader else []
                reader = _Reader(conv)
            reader.feed(formatted, None if a is None else formatted[a - start : b - start])
        if rows:
            yield records(DIGEST, [list(c) for c in zip(*rows, strict=True)])
    if reader:
        yield records(DIGEST, [[x] for x in reader.row()])


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what a reader of `render`'s rows gets, one row per conversation."""
    return rendered.mapInArrow(_read, ddl(DIGEST))


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished rows as a log.  Equal rows stay apart: the copy's number is part of the message id."""
    same = conversations.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    copies = same.withColumn("copy", F.explode(F.expr("sequence(1, n)")))
    return copies.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("seq"),
        F.concat_ws("#", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.sha2(F.to_json(F.struct("role", "text")), 256), "copy").alias("message_id"),
        F.lit("message").alias("op"),
        "role",
        "text",
    )
