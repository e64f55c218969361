"""Chat templates as black boxes: spans, loss masks and read-back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import groupby, tee
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import short_batches, utf8

# Markers of this template and strings that common chat
# templates use for control; none of them survives inside an escaped text.
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

#: Turns before a turn that are rendered with it; see :func:`turn_spans`.
WINDOW = 32

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")


class Turn(NamedTuple):
    role: str
    text: str


def escape(text: str) -> str:
    """Break every control string by a backslash after its first character;
    backslashes are doubled before, so :func:`unescape` undoes it exactly."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    while (broken := _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)) != text:
        text = broken
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[Turn]) -> str:
    """The template of the registered query."""
    return "".join(f"{ROLE}{escape(t.role)}{TEXT}{escape(t.text)}{END}" for t in turns)


def parse(span: str) -> Turn:
    """Read one rendered turn back; raises if its marks are not as written."""
    if not (span.startswith(ROLE) and span.endswith(END)):
        raise ValueError("a span is not one turn")
    role, mark, text = span[len(ROLE):-len(END)].partition(TEXT)
    if not mark:
        raise ValueError("a span has no text")
    return Turn(unescape(role), unescape(text))


class Rewrites(ValueError):
    """The template changed what it had rendered for earlier turns."""


def turn_spans(turns, template: Callable[[list[Turn]], str] = render, window: int | None = WINDOW):
    """What the template adds for each turn of an iterable, one string a turn.

    Nothing is known of the template but its output: it renders each prefix of
    the turns, and the output for ``k`` turns must begin with that for
    ``k - 1``; the rest is turn ``k``'s span (the first has all of its output).
    If it doesn't, the template rewrites history (it trims old turns, say) and
    :class:`Rewrites` is raised.

    Rendering every prefix takes quadratic time, so a prefix is cut to its last
    ``window`` turns first; this finds the same spans for templates that render a
    turn by itself or by at most ``window - 1`` turns before it.  Whether the
    template is one is seen from whole prefixes, which the joined spans must
    equal where the number of turns is ``window`` times a power of two and at the
    end (linear time in all).  If they don't, or the template fails on a cut
    prefix, every whole prefix is rendered.  Nothing is yielded before, so the
    turns are held; only :func:`render`, which renders a turn by itself, streams.
    ``window=None`` renders whole prefixes.
    """
    if window is None or template is render:
        yield from _prefix_spans(turns, template, window)
        return
    turns = list(turns)
    try:
        spans = list(_prefix_spans(turns, template, window))
        whole = _joins(spans, turns, template, window)
    except Exception:  # a template may refuse turns it is not used to begin with
        if len(turns) <= window:
            raise
        whole = False
    yield from spans if whole else _prefix_spans(turns, template, None)


def _prefix_spans(turns, template, window: int | None):
    held: list[Turn] = []
    before = ""
    for turn in turns:
        if window is not None and len(held) >= window:
            held = held[1:]
            before = template(held)
        held.append(turn)
        after = template(held)
        if not after.startswith(before):
            raise Rewrites(f"after {len(held)} turns")
        yield after[len(before):]
        before = after


def _joins(spans: list[str], turns: list[Turn], template, window: int) -> bool:
    """Whether the spans are those of whole prefixes, at doubling lengths and the end."""
    n = window
    while n < 2 * len(turns):
        if "".join(spans[:n]) != template(turns[:n]):
            return False
        n *= 2
    return True


class Digest:
    """Running digest of one conversation's formatted output."""

    def __init__(self, conv_id, plain: Callable[[str], str] = unescape):
        self.conv_id, self.plain = conv_id, plain
        self.n = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, span: str, turn: Turn, masked: list[tuple[int, int]]) -> None:
        role, text = turn
        self.n += 1
        self.formatted_chars += len(span)
        self.turns.update(utf8(f"{role}\n{text}\n"))
        for a, b in masked:
            learnt = self.plain(span[a:b])
            self.loss_chars += len(learnt)
            self.loss.update(utf8(learnt))

    def row(self):
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.formatted_chars)


def loss_spans(span: str, learn: str) -> list[tuple[int, int]]:
    """Offsets inside a turn's span that the loss covers: the text of a turn
    whose role is ``learn``, without its marks."""
    role, _, _ = span[len(ROLE):-len(END)].partition(TEXT)
    if unescape(role) != learn:
        return []
    return [(len(ROLE) + len(role) + len(TEXT), len(span) - len(END))]


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation side by side and in order in one partition.
    Ties of a turn number go by role and text, nulls first."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text"))


def _masks(template, loss, learn: str):
    """``(span, turn) -> offsets under the loss mask``."""
    loss = loss or (loss_spans if template is render else None)
    if loss is None:  # of a black box's span nothing is known but whose turn it is
        return lambda span, turn: [(0, len(span))] if turn.role == learn else []
    return lambda span, turn: loss(span, learn)


def format_turns(conversations: DataFrame, window: int | None = WINDOW, learn: str = "assistant",
                 template: Callable[[list[Turn]], str] = render, loss=None) -> DataFrame:
    """``(conv_id, position, span, loss_from, loss_to)``: the rendered span of
    each turn and the offsets in it under the loss mask (null: none); the
    formatted conversation is its spans joined by position.

    ``loss(span, learn)`` gives the offsets; without it they are those of the
    text for :func:`render` and the whole span for another ``template``.
    """
    masks = _masks(template, loss, learn)

    def emit(conv_id, spans):
        for k, (turn, span) in enumerate(spans):
            a, b = (masks(span, turn) or [(None, None)])[0]
            yield conv_id, k, span, a, b

    return _stream(conversations, emit, "conv_id long, position long, span string, loss_from long, loss_to long", window,
                   template)


def digests(conversations: DataFrame, window: int | None = WINDOW, learn: str = "assistant",
            template: Callable[[list[Turn]], str] = render, read: Callable[[str], Turn] | None = None,
            loss=None) -> DataFrame:
    """One row per conversation, read back from its formatted output:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Null texts and roles are empty ones; rows with a null ``conv_id`` are one
    conversation; repeated rows are turns of their own; an empty table gives no
    rows; other columns are not read.  A conversation streams through one task
    (SHA-256 runs in order) which holds ``window`` turns of it at a time; for a
    ``template`` other than :func:`render` it holds one conversation.  Such a
    template needs ``read``, which reads a span back; ``loss`` is as in
    :func:`format_turns`, and what it covers counts as it stands.
    """
    own = template is render
    if not (own or read):
        raise ValueError("digests of another template need read")
    read, plain, masks = read or parse, unescape if own else str, _masks(template, loss, learn)

    def emit(conv_id, spans):
        digest = Digest(conv_id, plain)
        for _, span in spans:
            turn = read(span)
            digest.add(span, turn, masks(span, turn))
        yield digest.row()

    return _stream(conversations, emit, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                        "loss_sha256 string, formatted_chars long", window, template)


def _frame(rows, columns) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns, dtype=object)  # ids may be null and large
    return frame.astype({c: "Int64" for c in ("conv_id", "loss_from", "loss_to") if c in frame})


def _stream(conversations: DataFrame, emit, schema: str, window: int | None, template=render) -> DataFrame:
    short_batches(conversations.sparkSession)
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        def rows():
            for pdf in batches:
                for conv_id, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                    yield conv_id, Turn(role, text)

        out = []
        for conv_id, group in groupby(rows(), key=lambda r: r[0]):
            turns, again = tee(t for _, t in group)
            # the span first: it takes the turn that goes with it
            spans = ((turn, span) for span, turn in zip(turn_spans(turns, template, window), again))
            for row in emit(None if conv_id is None else int(conv_id), spans):
                out.append(row)
                if len(out) == 1000:
                    yield _frame(out, columns)
                    out = []
        yield _frame(out, columns)

    return _sorted_turns(conversations).mapInPandas(run, schema)
