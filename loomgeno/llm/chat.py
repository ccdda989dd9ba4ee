r"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to text. Successive prefixes of a conversation are rendered and
consecutive outputs compared: what a prefix adds to the one before is its last turn's span. If an output doesn't begin with
the one before it, the template rewrites history, and `rewrites` counts those turns. Within a span, the turn's content is
found as what differs from the rendering of the same turn with a marked text.

Prefixes are rendered whole, so a conversation takes time and a worker's memory as its template's renderings do: n turns
are rendered twice n times, and all are kept. A template declared context_free() puts out each turn by that turn alone,
which makes a whole prefix needless to see what a turn adds: beyond `whole` turns, one is rendered after the first turn and
the `context` turns before it. Renderings are then of bounded length, and rows stream through one sorted partition with bounded
memory, however many turns a conversation has. The registered query's template is declared so.

The template here puts <|im_start|>role, a newline, the text and <|im_end|> with a newline. Inside roles and texts, any <
that backslashes and then | follow gets one more backslash; in roles backslash and newline are escaped too. Both are undone
on reading.

Defined cases: null text is empty; null role is an empty role, not the assistant's; turns are ordered by turn, null first,
then role and text, repeated rows being turns of their own; a null conv_id is a conversation like others; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
_GUARD, _GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _GUARD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def context_free(template: Template) -> Template:
    """Declares that a template's output is its turns' own texts in order, each made from that turn alone, not from other
    turns, their number or its place."""
    template.context_free = True
    return template


@context_free
def chatml(turns: list[Turn]) -> str:
    """The template of the registered query."""
    return "".join([f"{START}{escape_role(r)}\n{escape(t)}{END}\n" for r, t in turns])


def parse(text: str) -> list[Turn]:
    """Turns of a chatml text."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = text.index("\n", at)
        end = text.index(END + "\n", line)
        out.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return out


@dataclass
class Span:
    """What a turn adds to the output, and where its content is within that (None: not found)."""

    added: str
    content: tuple[int, int] | None
    rewrites: bool


@dataclass
class Renderer:
    """Renders turn after turn through a black-box template; `whole` and `context` only hold for one declared context_free()."""

    template: Template
    whole: int = 64
    context: int = 2
    seen: list[Turn] = field(default_factory=list)
    before: str = ""

    def add(self, turn: Turn) -> Span:
        if len(self.seen) > self.whole and getattr(self.template, "context_free", False):
            # Beyond the whole prefixes: the first turn and the last few.
            self.seen = [self.seen[0], *self.seen[-self.context :]]
            self.before = self.template(self.seen)
        now = self.template([*self.seen, turn])
        same = now.startswith(self.before)
        at = len(self.before) if same else _common(self.before, now)
        added = now[at:]
        # The content is where the output changes if only this turn's text does.
        content = None
        mark = next(c for c in "\x00\x01\x02" if c not in (turn[1][:1], turn[1][-1:]))
        other = self.template([*self.seen, (turn[0], mark)])
        head = _common(now, other)
        tail = _common(now[head:][::-1], other[head:][::-1])
        if head >= at and other[head : len(other) - tail] == mark:
            content = (head - at, len(now) - tail - at)
        self.seen.append(turn)
        self.before = now
        return Span(added, content, not same)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def spans(turns: Iterable[Turn], template: Template = chatml, **options) -> Iterator[Span]:
    """Spans of one conversation."""
    r = Renderer(template, **options)
    for t in turns:
        yield r.add(t)


def formatted(rows: DataFrame, template: Template = chatml, trained: str = "assistant") -> DataFrame:
    """(conv_id, nth, formatted, loss_start, loss_end, rewrites) for every turn, in order: the text that the turn adds to its
    conversation's output, and the part of it under the loss mask, if its role is trained."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, r, n = (), None, 0
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if key != (conv,):
                    key, r, n = (conv,), Renderer(template), 0
                s = r.add((role, text))
                start, end = s.content if s.content and role == trained else (None, None)
                for col, x in zip(out, (conv, n, s.added, start, end, s.rewrites)):
                    col.append(x)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.bool_())], ["conv_id", "nth", "formatted", "loss_start", "loss_end", "rewrites"])

    return _ordered(rows).mapInArrow(run, f"conv_id {kind}, nth long, formatted string, loss_start long, loss_end long, rewrites boolean")


def _ordered(rows: DataFrame) -> DataFrame:
    """Turns in order within partitions; the external sort spills, so a long conversation needs no memory of its own."""
    turns = rows.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    return turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")


class _Digest:
    """What the report says of one conversation, read back from its formatted output, span after span."""

    def __init__(self):
        self.renderer, self.turns, self.loss = Renderer(chatml), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.rewrites = 0

    def add(self, role: str, text: str) -> None:
        s = self.renderer.add((role, text))
        for r, t in parse(s.added):
            self.turns.update(f"{r}\n{t}\n".encode())
            self.n += 1
        if role == "assistant" and s.content:
            under = unescape(s.added[slice(*s.content)])
            self.loss.update(under.encode())
            self.loss_chars += len(under)
        self.chars += len(s.added)
        self.rewrites += s.rewrites

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, d, kind, out = (), None, pa.int64(), []
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]

    def flush() -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*out), [kind, *types])]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names)

    for b in batches:
        kind = b.schema.field(0).type
        for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            if key != (conv,):
                if d:
                    out.append((key[0], *d.row()))
                key, d = (conv,), _Digest()
            d.add(role, text)
        if out:
            yield flush()
    if d:
        out.append((key[0], *d.row()))
        yield flush()


def report(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites) for every conversation."""
    return _ordered(rows).mapInArrow(_report, f"conv_id {dict(rows.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")
