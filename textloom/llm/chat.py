r"""Chat formatting: a finite-state machine over roles, a declarative template, per-segment loss flags.

``format_chat`` turns rows (conv_id, turn, role, text) into segments, one row each, in order: their
texts joined are the formatted conversation, and ``loss`` says which of them a model is trained on.
Rows are dealt by conv_id, sorted within the partition by (turn, role, text), and streamed: the state
of a conversation is one FSM state, so a conversation of any length needs the memory of a batch.

Control strings of the template that occur in a role or a text are broken by a backslash after their
first character, and backslashes are doubled, so no text can end a turn or open another, and
``unescape`` restores every text exactly. ``read_chat`` parses formatted segments back into turns.

Defined results: null role and null text are empty; a null conv_id is a conversation of its own; a
role the machine has no move for marks the turn ``ok = false`` and the conversation goes on from that
role's own state, so every row is formatted; repeated rows are repeated turns; an empty table gives
no segments; extra columns are ignored. All rows without a conv_id are one sorted stream of one task: its memory is a
batch's, its time is theirs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table


@dataclass(frozen=True)
class Template:
    """What stands around a role and a text. ``loss_roles``: whose texts are trained on.

    ``moves``: state -> role -> next state; a conversation starts in "start" and may end in ``ends``.
    """

    begin: str = "<s>"
    role_open: str = "[INST]"
    role_close: str = "[/INST]"
    end: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    ends: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.role_open, self.role_close, self.end)


DEFAULT = Template()


class Escaper:
    def __init__(self, controls: tuple[str, ...]):
        if any("\\" in c or len(c) < 2 for c in controls):
            raise ValueError("a control string has two characters or more and no backslash")
        if any(c[:n] == c[-n:] for c in controls for n in range(1, len(c))):
            raise ValueError("no control string may start as it ends")
        alternatives = "|".join(map(re.escape, controls))
        self._find = re.compile(rf"\\|(?=(?:{alternatives})).", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._find.sub(lambda m: m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        """Drop each backslash and keep what follows it."""
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("ok", pa.bool_())])
_SEGMENTS_SQL = "conv_id long, seq long, turn long, kind string, text string, loss boolean, ok boolean"
_START = object()


def _segments(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    escape = Escaper(template.controls).escape
    conv, state, seq = _START, "start", 0
    for batch in batches:
        rows: list[tuple] = []
        for conv_id, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if conv is _START or conv_id != conv:
                conv, state, seq = conv_id, "start", 0
            role, text = role or "", text or ""
            ok = role in template.moves.get(state, {})
            state = template.moves[state][role] if ok else role
            head = (template.begin if seq == 0 else "") + template.role_open + escape(role) + template.role_close
            for kind, part, loss in (("head", head, False), ("text", escape(text), role in template.loss_roles), ("end", template.end, False)):
                rows.append((conv_id, seq, turn, kind, part, loss, ok))
                seq += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SEGMENTS, strict=True)], schema=SEGMENTS)


def format_chat(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Segments of every conversation; those of one follow each other in a partition, in order."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lambda batches: _segments(batches, template), _SEGMENTS_SQL)


def parse(pieces: Iterator[tuple[str, bool]], template: Template) -> Iterator[tuple[str, str, list[bool]]]:
    """Turns (role, text, loss flags of the text's segments) of one conversation's (text, loss) pieces."""
    text, flags = "", []
    close, end = template.role_close, template.end
    first = True
    for piece, loss in pieces:
        text += piece
        flags.append((len(piece), loss))
        # the end mark closes a turn; inside texts it is broken, so the first one is the turn's own
        while (at := text.find(end)) >= 0:
            turn, text = text[:at], text[at + len(end) :]
            opening = (template.begin if first else "") + template.role_open
            if not turn.startswith(opening) or (mid := turn.find(close, len(opening))) < 0:
                raise ValueError("not the template's output")
            first = False
            body = mid + len(close)
            position, losses = 0, []
            for length, flag in flags:
                if length and position < at and position + length > body:
                    losses.append(flag)
                position += length
            yield Escaper.unescape(turn[len(opening) : mid]), Escaper.unescape(turn[body:]), losses
            flags = [] if not text else [(len(text), loss)]
    if text:
        raise ValueError("the output ends inside a turn")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
_DIGESTS_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


class _Reader:
    """Digests of one conversation, fed a turn's segments at a time."""

    def __init__(self, conv_id, template: Template):
        self.conv_id, self.template, self.n, self.chars, self.loss_chars, self.ok, self.role = conv_id, template, 0, 0, 0, True, ""
        self.turns, self.loss, self.pieces = hashlib.sha256(), hashlib.sha256(), []

    def feed(self, text: str, loss: bool, ok: bool) -> None:
        self.chars += len(text)
        self.ok &= ok
        self.pieces.append((text, loss))
        if text.endswith(self.template.end):
            self.drain()

    def drain(self) -> None:
        t = self.template
        pieces, self.pieces = self.pieces, []
        if self.n and pieces:  # parse() wants the mark that opens a conversation
            pieces = [(t.begin, False), *pieces]
        for role, text, losses in parse(iter(pieces), t):
            self.n += 1
            self.role = role
            self.turns.update(f"{role}\n{text}\n".encode())
            if any(losses):
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        self.drain()
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.ok and self.role in self.template.ends


def _digests(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    reader = None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DIGESTS, strict=True)], schema=DIGESTS)

    for batch in batches:
        rows = []
        names = ("conv_id", "seq", "text", "loss", "ok")
        for conv_id, seq, text, loss, ok in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if seq == 0:
                if reader is not None:
                    rows.append(reader.row())
                reader = _Reader(conv_id, template)
            reader.feed(text, loss, ok)
        if rows:
            yield batch_of(rows)
    if reader is not None:
        yield batch_of([reader.row()])


def read_chat(segments: DataFrame, template: Template = DEFAULT, in_order: bool = False) -> DataFrame:
    """Per conversation, what its formatted text holds, parsed back from the segments of format_chat.

    Segments that were stored lie in any split: they are dealt and sorted by conversation. ``in_order`` says that they come
    straight from format_chat, in one plan, so that they need not move again.
    """
    rows = segments.select("conv_id", "seq", "text", "loss", "ok")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(lambda batches: _digests(batches, template), _DIGESTS_SQL)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")
    ).select("x.*")
    return read_chat(format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)), in_order=True)


QUERIES = {"op2_chat_format": op2_chat_format}
ORACLE_SQL: dict[str, str] = {}
