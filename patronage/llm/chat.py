"""Chat formatting: role turns to marked text segments with loss flags, and back.

A template is data: markers for each role, whether the role's text counts for the loss, and the transitions of a
finite-state machine over roles. ``format_chats`` runs the machine over the ordered turns of each conversation and emits
segments; ``read_back`` scans the formatted text alone and restores the turns.

Defined results: a null role or text is empty; rows of one conversation are ordered by turn (null first), then role, then
text, so ties and repeated rows have one order; rows with a null conv_id form one conversation; unknown roles and turns
out of order are formatted too, and the conversation is reported as not valid from that turn on. Other columns are ignored.
Rows are shuffled once by conversation and then streamed, so one task holds one turn at a time however long a conversation is.
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, start boolean, valid boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


@dataclass(frozen=True)
class ChatTemplate:
    """Markers by role as (before, after, counts for the loss); ``other`` marks roles that the template does not name."""

    turns: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("<s> ", " </s>", True),
    })
    other: tuple = ("[ROLE] ", " [/ROLE]", "[/TURN]")
    steps: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"}, "system": {"user": "user"},
        "user": {"assistant": "assistant"}, "assistant": {"user": "user"}, "broken": {},
    })

    def __post_init__(self):
        marks = self.controls()
        for a in marks:
            if a[0] == "\\" or any(a != b and b.startswith(a) for b in marks):
                raise ValueError(f"marker {a!r} starts another marker or is an escape")
            # the end of a text and the marker behind it must not form a marker together
            if any(a[k:] and b.startswith(a[k:]) for b in marks for k in range(1, len(a))):
                raise ValueError(f"the end of marker {a!r} starts another marker")

    def controls(self) -> list:
        return sorted({m.strip() for before, after, _ in self.turns.values() for m in (before, after)} | {m.strip() for m in self.other})

    def control_pattern(self) -> str:
        return "|".join(map(re.escape, self.controls()))

    def step(self, state: str, role: str) -> str:
        return self.steps[state].get(role, "broken")


def escape(text: str, controls: re.Pattern) -> str:
    """A backslash before each backslash and each control string; ``unescape`` takes it away again."""
    return controls.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _format(template: ChatTemplate):
    controls = re.compile(r"\\|" + template.control_pattern())

    def pieces(role: str, text: str):
        text = escape(text, controls)
        if role in template.turns:
            before, after, loss = template.turns[role]
            return (before, False), (text, loss), (after, False)
        a, b, c = template.other
        return (a + escape(role, controls) + b, False), (text, False), (c, False)

    def run(batches):
        conv, state, turn, first = None, "start", 0, True
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                begins = first or conv_id != conv
                if begins:
                    conv, state, turn, first = conv_id, "start", 0, False
                state = template.step(state, role or "")
                for k, (piece, loss) in enumerate(pieces(role or "", text or "")):
                    out.append((conv_id, turn, k, piece, loss, begins and k == 0, state != "broken"))
                turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)],
                                             names=["conv_id", "turn_no", "segment", "text", "loss", "start", "valid"])

    return run


def format_chats(chats: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Rows of (conv_id, turn, role, text) to segments, in the order of the formatted text within each partition.

    All segments of a conversation stand in one partition, one after another; ``start`` marks its first segment.
    """
    rows = chats.selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "cast(role as string) role", "cast(text as string) text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(template or ChatTemplate()), SEGMENTS)


class Scanner:
    """Reads turns from formatted text that arrives piece by piece."""

    def __init__(self, template: ChatTemplate):
        body = rf"((?:\\.|(?!{template.control_pattern()})[^\\])*)"
        named = [f"{re.escape(before)}{body}{re.escape(after)}" for before, after, _ in template.turns.values()]
        a, b, c = map(re.escape, template.other)
        self.names = list(template.turns)
        self.turn = re.compile("|".join([*named, f"{a}{body}{b}{body}{c}"]), re.S)
        self.rest = ""

    def feed(self, piece: str) -> list:
        """The turns that end in what has been read so far, as (role, text)."""
        self.rest += piece
        found, at = [], 0
        while m := self.turn.match(self.rest, at):
            k = next(i for i, g in enumerate(m.groups()) if g is not None)
            found.append((self.names[k] if k < len(self.names) else unescape(m[k + 1]), unescape(m[k + 1 if k < len(self.names) else k + 2])))
            at = m.end()
        self.rest = self.rest[at:]
        return found


def _read(template: ChatTemplate):
    class Sums:
        def __init__(self, conv_id):
            self.conv_id, self.turns, self.n, self.chars, self.loss_chars, self.valid = conv_id, hashlib.sha256(), 0, 0, 0, True
            self.loss, self.scan = hashlib.sha256(), Scanner(template)

        def add(self, piece, loss, valid, ends):
            self.chars += len(piece)
            self.valid &= valid
            if loss:
                plain = unescape(piece)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
            for role, text in self.scan.feed(piece) if ends else self.wait(piece):
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode())

        def wait(self, piece):
            self.scan.rest += piece
            return ()

        def row(self):
            if self.scan.rest:
                raise ValueError("formatted text that no turn matches")
            return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid

    def run(batches):
        now = None
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            done = []
            for conv_id, segment, text, loss, start, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "text", "loss", "start", "valid")), strict=True):
                if start:
                    if now:
                        done.append(now.row())
                    now = Sums(conv_id)
                now.add(text, loss, valid, segment == 2)
            if done:
                yield batch_of(done)
        if now:
            yield batch_of([now.row()])

    return run


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation with digests of the turns and of the loss text, read from the formatted text.

    ``segments`` must come straight from ``format_chats``: the rows stream in order, with no shuffle between.
    """
    return segments.mapInArrow(_read(template or ChatTemplate()), READ)
