"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string.  Nothing is known
about it: a turn's span is found by rendering the turns before it and the turns
up to it, and comparing the two outputs.  If the longer does not start with the
shorter, the template rewrites history; the turn is marked and gets an empty
piece.  The loss mask is found in the same way, from a rendering in which the
turn's text is one private character: it covers what stands in its place.

A conversation streams through its task, sorted by turn, and the template sees
all turns up to the current one.  Only a template that its owner declares local
(``template.context = n``, as the default template does, or the ``context``
argument) sees the first turn and the last ``n - 2`` turns before the current
one once there are ``n``; its pieces must not depend on the turns between.

Defined results: null text or role is empty; null turns come first; equal turns
stand in the order of role and text; a null ``conv_id`` is one conversation; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = dict[str, str]
Template = Callable[[list[Turn]], str]
CONTEXT = 64

#: Control strings of the template; in texts and roles they are escaped.
OPEN, CLOSE, HEAD = "<|turn|>", "<|end|>", "<|text|>"
#: Every "<" or "[" that could start a control string, and the escape sign
#: itself, get the escape sign in front of a stand-in.
_ESCAPE = str.maketrans({"~": "~~", "<": "~l", "[": "~b", "/": "~s", "|": "~p"})
_UNESCAPE = {"~~": "~", "~l": "<", "~b": "[", "~s": "/", "~p": "|"}


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return re.sub("~.", lambda m: _UNESCAPE[m[0]], text, flags=re.S)


@lru_cache(maxsize=2 * CONTEXT)
def _marked_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{HEAD}{escape(text)}{CLOSE}\n"


def turn_template(turns: list[Turn]) -> str:
    """The default template: marked turns, escaped roles and texts.  A turn is
    in the renderings of ``CONTEXT`` successors, so it is escaped once and held
    as long as the context holds it."""
    return "".join(_marked_turn(t["role"], t["text"]) for t in turns)


#: Each turn is rendered alone.
turn_template.context = CONTEXT


class Renderer:
    """Renders the turns of one conversation after another's end."""

    def __init__(self, template: Template, context: int | None = None):
        self.template = template
        self.context = getattr(template, "context", None) if context is None else context
        self.turns: list[Turn] = []

    def push(self, turn: Turn) -> tuple[str, int, int, bool]:
        """``(piece, mask start, mask end, rewritten)`` of the next turn: the
        characters that it adds, and where its text stands in them."""
        before = self.turns
        if self.context is not None and len(before) >= self.context:
            before = [before[0], *before[len(before) - self.context + 2:]]
            self.turns = before
        old = self.template(before)
        new = self.template([*before, turn])
        rewritten = not new.startswith(old)
        piece = "" if rewritten else new[len(old):]
        start = end = 0
        if not rewritten:
            # a private character that the piece lacks, in place of the text
            mark = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in piece)
            probe = self.template([*before, {**turn, "text": mark}])[len(old):]
            start = probe.find(mark)
            end = len(piece) - (len(probe) - start - 1)
            if probe.count(mark) != 1 or end < start or piece[:start] + mark + piece[end:] != probe:
                rewritten, piece, start, end = True, "", 0, 0
        self.turns = [*before, turn]
        return piece, start, end, rewritten


def _render(template: Template, context: int | None, learn_from: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, renderer, at, n = object(), None, 0, 0
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now:
                    now, renderer, at, n = conv, Renderer(template, context), 0, 0
                turn = {"role": role or "", "text": text or ""}
                piece, a, z, rewritten = renderer.push(turn)
                loss = turn["role"] == learn_from and not rewritten
                row = (conv, n, at, piece, at + a if loss else None, at + z if loss else None, rewritten)
                for o, v in zip(out, row):
                    o.append(v)
                at, n = at + len(piece), n + 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)],
                                             names=["conv_id", "seq", "span_start", "piece", "loss_start", "loss_end",
                                                    "rewritten"])
    return run


_PIECE = "conv_id long, seq long, span_start long, piece string, loss_start long, loss_end long, rewritten boolean"


def chat_format(conversations: DataFrame, template: Template = turn_template, context: int | None = None,
                learn_from: str = "assistant") -> DataFrame:
    """One row per turn: ``conv_id, seq`` (from 0), ``span_start`` (place of the
    turn's ``piece`` in the conversation's output, the pieces in order),
    ``loss_start, loss_end`` (what the loss mask covers, null for none) and
    ``rewritten``."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return (rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
            .mapInArrow(_render(template, context, learn_from), _PIECE))


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(HEAD) + "(.*?)" + re.escape(CLOSE) + "\n", re.S)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    now, have = None, None
    out: list[list] = [[] for _ in names]

    def close() -> None:
        for o, v in zip(out, (now, have["n"], have["turns"].hexdigest(), have["loss_n"], have["loss"].hexdigest(),
                              have["chars"], have["rewritten"])):
            o.append(v)

    for b in batches:
        for conv, piece, span, a, z, rewritten in zip(*(b.column(c).to_pylist() for c in (
                "conv_id", "piece", "span_start", "loss_start", "loss_end", "rewritten"))):
            if have is None or conv != now:
                if have is not None:
                    close()
                now, have = conv, {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(),
                                   "chars": 0, "rewritten": False}
            have["rewritten"] |= rewritten
            have["chars"] += len(piece)
            for m in _TURN.finditer(piece):
                have["n"] += 1
                have["turns"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            if a is not None:
                text = unescape(piece[a - span:z - span])
                have["loss_n"] += len(text)
                have["loss"].update(text.encode())
        if len(out[0]) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=names)
            out = [[] for _ in names]
    if have is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation, parsed from the default template's output:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    rewritten``."""
    return (formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")
            .mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                        "loss_sha256 string, formatted_chars long, rewritten boolean"))
