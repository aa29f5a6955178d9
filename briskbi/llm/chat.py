"""Chat formatting in token-budgeted, turn-aligned windows.

A conversation's turns are laid end to end by the token counts of their formatted
turns, marks and escapes included (prefix sums).  A window takes the leading system turn, then repeats the newest turns before it
within ``history`` tokens, then new turns as long as the whole fits ``budget``.
Every turn is new in exactly one window; only assistant text that is new there
carries loss, a repeated target is masked.

The template marks a turn as ``<|turn|>role`` newline ``text<|end|>`` newline, and
``<|again|>`` in place of ``<|turn|>`` where it is repeated.  Texts and roles are escaped: a
backslash is doubled, and every control string (the template's own and those of
common chat templates) gets a backslash after its first character, so no control string
of a text survives as one; ``unescape`` is the exact inverse.

Turns are counted where they are read; one shuffle brings a conversation together
in order, and windows are built as its rows stream by.  Memory holds one window
and its history, however long the conversation.

Defined cases: null text and null role are empty; null conversation ids form one
conversation; null turns come first; equal turns (repeated rows) keep all their rows, by role
and text; a turn longer than the budget is a window of its own (after the system turn), never
cut, however long; further columns, also those named like a result column, are left out; an
empty table gives no windows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from briskbi.llm.shared import small_batches, steps
from briskbi.llm.tokens import coder

TURN, AGAIN, END = "<|turn|>", "<|again|>", "<|end|>"
#: Control strings of the template and of public chat templates.
CONTROL = (
    "<|turn|>", "<|again|>", "<|end|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<\|(turn|again)\|>((?:[^\n\\]|\\.)*)\n(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    """As a text, and on one line."""
    return escape(role).replace("\n", "\\n")


def form(role: str, text: str, mark: str = TURN) -> str:
    """A turn as it stands in a window."""
    return f"{mark}{escape_role(role)}\n{escape(text)}{END}\n"


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def parse(window: str) -> list[tuple[bool, str, str]]:
    """(new here, role, text) of each turn of a formatted window."""
    out, at = [], 0
    for m in _TURN.finditer(window):
        if m.start() != at:
            raise ValueError("not a formatted window")
        out.append((m[1] == "turn", unescape_role(m[2]), unescape(m[3])))
        at = m.end()
    if at != len(window):
        raise ValueError("not a formatted window")
    return out


def spread(window: str, loss: list) -> list[str]:
    """The unescaped texts under the loss mask."""
    return [unescape(window[s["start"] : s["end"]]) for s in loss]


class Windows:
    """The windows of one conversation, as its turns come in order."""

    def __init__(self, conv, budget: int, history: int, target: str):
        self.conv, self.budget, self.history, self.target = conv, budget, history, target
        self.system: tuple | None = None
        self.past: deque = deque()
        self.past_tokens = 0
        self.new: list[tuple] = []
        self.before = self.upto = 0  # prefix sums: at the window's first new turn, and after its last
        self.room = budget
        self.index = 0
        self.first = True

    def add(self, role: str, text: str, tokens: int, repeated: int) -> Iterator[tuple]:
        """The next turn, with its tokens as a new turn and as a repeated one."""
        turn = (role, text, repeated)
        if self.first and role == "system":
            self.system = turn
        self.first = False
        if self.new and self.upto + tokens - self.before > self.room:
            yield self.emit()
        if not self.new:
            self.before = self.upto
            self.room = self.budget - self.past_tokens - (self.system[2] if self.system and self.system is not turn else 0)
            while self.past and tokens > self.room:  # the new turn goes before old ones
                self.room += self.past.popleft()[2]
        self.new.append(turn)
        self.upto += tokens

    def emit(self) -> tuple:
        repeated = [self.system] if self.system and self.new[0] is not self.system else []
        repeated += self.past
        parts, loss, at = [], [], 0
        for again, (role, text, _) in [*((True, t) for t in repeated), *((False, t) for t in self.new)]:
            head, body = f"{AGAIN if again else TURN}{escape_role(role)}\n", escape(text)
            parts += [head, body, END, "\n"]
            if role == self.target and not again:
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            at += len(head) + len(body) + len(END) + 1
        n_new, tokens = len(self.new), self.upto - self.before + sum(t[2] for t in repeated)
        for t in self.new:
            if t is not self.system:
                self.past.append(t)
        self.past_tokens = sum(t[2] for t in self.past)
        while self.past and self.past_tokens > self.history:
            self.past_tokens -= self.past.popleft()[2]
        self.new = []
        self.index += 1
        return self.conv, self.index - 1, "".join(parts), loss, n_new, tokens


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_chats(turns: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 256, target: str = "assistant") -> DataFrame:
    """One row per window: conversation, window (0, 1, ...), formatted text, loss spans (characters), n_new, tokens.

    Rows come by conversation and window within their partition.  ``budget`` and ``history``
    hold for the formatted text: a window of several new turns has at most ``budget`` tokens.
    """
    small_batches(turns.sparkSession)
    kind = turns.schema[conv].dataType.simpleString()
    order = turns.schema[turn].dataType.simpleString()
    plain = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(tokenizer)
        for batch in steps(batches, "_text"):
            roles, texts = (batch.column(i).to_pylist() for i in (2, 3))
            _, first = encoder.encode(pa.array(map(form, roles, texts), pa.string()))
            tokens = first[1:] - first[:-1]
            # A repeated turn differs in its mark only.
            kinds = list(dict.fromkeys(roles))
            _, edge = encoder.encode(pa.array([f"{mark}{escape_role(r)}\n" for mark in (TURN, AGAIN) for r in kinds], pa.string()))
            heads = (edge[1:] - edge[:-1]).reshape(2, -1)
            more = dict(zip(kinds, (heads[1] - heads[0]).tolist(), strict=True))
            repeated = tokens + np.array([more[r] for r in roles])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64()), pa.array(repeated, pa.int64())], names=["_conv", "_turn", "_role", "_text", "_tokens", "_repeated"])

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, held, arrow = None, [], 0, None

        def batch_of(rows: list) -> pa.RecordBatch:
            c, i, f, s, n, t = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, arrow), pa.array(i, pa.int64()), pa.array(f, pa.string()), pa.array(s, _LOSS), pa.array(n, pa.int64()), pa.array(t, pa.int64())], names=[conv, "window", "formatted", "loss", "n_new", "tokens"])

        for batch in batches:
            arrow = batch.column(0).type
            for c, _, r, t, n, again in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or now.conv != c:
                    if now is not None and now.new:
                        out.append(now.emit())
                    now = Windows(c, budget, history, target)
                for made in now.add(r, t, n, again):
                    out.append(made)
                    held += len(made[2])
                if held > 1 << 20:
                    yield batch_of(out)
                    out, held = [], 0
        if now is not None and now.new:
            out.append(now.emit())
        if out:
            yield batch_of(out)

    counted = plain.mapInArrow(count, f"_conv {kind}, _turn {order}, _role string, _text string, _tokens long, _repeated long")
    dealt = counted.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    return dealt.mapInArrow(window, f"`{conv}` {kind}, window long, formatted string, loss array<struct<start:bigint,end:bigint>>, n_new long, tokens long")


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What ``format_chats`` wrote, read from its rows in the order they come in: one row per
    conversation with n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Windows of a conversation must follow each other in one partition, as they do
    right after ``format_chats``; anything else raises an error.
    """
    import hashlib

    kind = windows.schema[conv].dataType.simpleString()
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, expect, arrow = None, 0, None

        def batch_of(rows: list) -> pa.RecordBatch:
            c, n, t, k, s, f = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, arrow), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in t]), pa.array(k, pa.int64()), pa.array([x.hexdigest() for x in s]), pa.array(f, pa.int64())], names=names)

        for batch in batches:
            arrow, out = batch.column(0).type, []
            for c, index, formatted, loss in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if index == 0:
                    if now is not None:
                        out.append(now)
                    now, expect = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                if now is None or now[0] != c or index != expect:
                    raise ValueError("the windows of a conversation do not follow each other")
                expect += 1
                for new, role, text in parse(formatted):
                    if new:
                        now[1] += 1
                        now[2].update(f"{role}\n{text}\n".encode())
                for text in spread(formatted, loss):
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(formatted)
            if out:
                yield batch_of(out)
        if now is not None:
            yield batch_of([now])

    return windows.select(conv, "window", "formatted", "loss").mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
