"""Chat formatting with a template that is only ever called, never looked into.

Successive prefixes of a conversation are rendered; what a turn added to the output
is its span. Where the longer output does not begin with the shorter one, the
template has rewritten history, and the conversation is reported as such. Two
renders that differ in a one-character text show where a turn's text lies within
its span; the spans of assistant texts make the loss mask.

A conversation's rows arrive sorted and stream through. Every prefix is rendered from
the first turn on, so rewriting is seen however far back it reaches; a conversation's
turns are held together, and the time grows with the square of their number. Only a
template that declares ``additive = True`` (its output is that of the turns one by
one, joined) is rendered from at most ``WINDOW`` turns at a time, which gives the same
spans. The claim is held against the whole rendering whenever the turns have doubled,
and at the end, however long the output; a template that breaks it has rewritten
history. A conversation's turns are held for that. A :class:`Joined` template, as the
package's own is, claims nothing: it is made of the rendering of one turn and joins
those itself, so memory and the time for a turn do not grow with a conversation's
length.

The text under the loss mask is unescaped by the reader's own ``unescape``, if it has
one.

Null texts and roles count as empty. Rows of a conversation are ordered by turn,
then role, then text; repeated rows are turns of their own. Null conversation ids
form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
WINDOW = 8

_CONTROL = re.compile(r"\\|### |</turn>")
_ROLE_CONTROL = re.compile(r"\\|### |</turn>|:")
_ESCAPED = re.compile(r"\\(\\|### |</turn>|:)")
_HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_TAIL = " </turn>\n"


@lru_cache(64)
def escape(text: str) -> str:
    """A backslash before each control string and each backslash."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Joined:
    """A template made of the rendering of one turn; its output is that of the turns, joined."""

    additive = True

    def __init__(self, turn: Callable[[str, str], str]):
        self._turn = turn

    def __call__(self, turns: list[Turn]) -> str:
        return "".join([self._turn(role, text) for role, text in turns])


def _marked(role: str, text: str) -> str:
    return f"### {_ROLE_CONTROL.sub(lambda m: chr(92) + m[0], role)}: {escape(text)}{_TAIL}"


#: The template of this package: a header, the text, an end mark.
marked = Joined(_marked)


def read_back(segment: str) -> Turn:
    """Role and text from a turn's span of :func:`marked`."""
    head = _HEADER.match(segment)
    return unescape(head[1]), unescape(segment[head.end() : len(segment) - len(_TAIL)])


#: How a reader undoes the escapes of a text's span; one that has none takes the span as it is.
read_back.unescape = unescape


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[:mid]) else (low, mid - 1)
    return low


class Spans:
    """Renders a conversation turn by turn. ``add`` gives the turn's part of the output and the place of its text in it; ``size`` is the output's length so far."""

    def __init__(self, template: Template, window: int = WINDOW):
        self.template, self.window = template, window
        self.additive = getattr(template, "additive", False)
        self.turns: list[Turn] = []
        self.before = template([])
        self.size = len(self.before)
        self.rewrites = False
        # A mere claim of being additive is held against the whole rendering. A subclass may render otherwise, and claims too.
        self.all: list[Turn] | None = [] if self.additive and type(template) is not Joined else None
        self.parts = [self.before]

    def verify(self) -> None:
        """Whether the whole rendering is what the parts add up to."""
        if self.all is not None and not self.rewrites:
            self.rewrites = self.template(self.all) != "".join(self.parts)

    def _hold(self, role: str, text: str, part: str) -> None:
        if self.all is None:
            return
        self.all.append((role, text))
        self.parts.append(part)
        if len(self.all) > self.window and len(self.all) & len(self.all) - 1 == 0:
            self.verify()

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        if self.additive and len(self.turns) == self.window:
            self.turns = self.turns[self.window // 2 :]
            self.before = self.template(self.turns)
        turns = [*self.turns, (role, text)]
        after = self.template(turns)
        kept = len(self.before)
        if not after.startswith(self.before):
            self.rewrites = True
            kept = common_prefix(self.before, after)
        one, other = (self.template([*self.turns, (role, c)]) for c in "ab")
        start = common_prefix(one, other)
        tail = len(one) - start - 1
        self.size += len(after) - len(self.before)
        self.turns, self.before = turns, after
        self._hold(role, text, after[kept:])
        return after[kept:], start - kept, len(after) - tail - kept


def digests(df: DataFrame, template: Template = marked, reader: Callable[[str], Turn] = read_back, window: int = WINDOW) -> DataFrame:
    """For each conversation what can be read back from its formatted text: turns, the text under the loss mask, sizes."""
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # One task streams a conversation through; its rows are never held together.
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = df.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    undo = getattr(reader, "unescape", str)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = run
        done: list[list] = []
        n = loss = 0
        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if conv != key or key is run:
                    if key is not run:
                        spans.verify()
                        done.append([key, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), spans.size, spans.rewrites])
                    key, n, loss, spans = conv, 0, 0, Spans(template, window)
                    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                part, start, end = spans.add(role, text)
                role_read, text_read = reader(part)
                n += 1
                turns_sha.update(f"{role_read}\n{text_read}\n".encode())
                if role_read == "assistant":
                    masked = undo(part[start:end])
                    loss += len(masked)
                    loss_sha.update(masked.encode())
            if len(done) >= 10_000:
                yield _batch(done, b.schema.field(0).type, names, kinds)
                done = []
        if key is not run:
            spans.verify()
            done.append([key, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), spans.size, spans.rewrites])
            yield _batch(done, b.schema.field(0).type, names, kinds)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")


def _batch(done: list[list], key_kind, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), [key_kind, *kinds])], names)


def formatted(df: DataFrame, template: Template = marked, window: int = WINDOW) -> DataFrame:
    """For each turn its part of the formatted text, with the place of its text in that part and whether loss applies there."""
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, turn {df.schema['turn'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spans = run, None
        for b in batches:
            out = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if conv != key or key is run:
                    key, spans = conv, Spans(template, window)
                out.append((*spans.add(role, text), role == "assistant"))
            cols = [pa.array(c, k) for c, k in zip(zip(*out), [pa.string(), pa.int32(), pa.int32(), pa.bool_()])] if out else [pa.array([], k) for k in (pa.string(), pa.int32(), pa.int32(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["conv_id", "turn", "part", "text_start", "text_end", "loss"])

    return rows.mapInArrow(run, f"{kinds}, part string, text_start int, text_end int, loss boolean")
