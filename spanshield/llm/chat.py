"""Chat formatting in budgeted windows.

The running sum of turn tokens cuts a conversation into turn-aligned windows of at most ``budget``
tokens. Every window after the first opens with the conversation's system turn and with as many of
the turns before it as ``history`` tokens allow; those repeats carry no loss, so each assistant
text is a target exactly once.

Control strings of the template inside a text get one backslash more in front of them; marks of the
template never have one, so the escape is reversible and no text can open or close a turn.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n")}
OTHER = ("<s><<SYS>> ", " <</SYS>> ", " </s>\n")

_CONTROL = "|".join(re.escape(c) for c in CONTROL)
_ESCAPE = re.compile(rf"(\\*)({_CONTROL})")
_UNESCAPE = re.compile(rf"\\(\\*)({_CONTROL})")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

BUDGET = 512
HISTORY = 96
WINDOW_SCHEMA = ("conv_id long, window int, text string, repeated int, turns int, tokens long, "
                 "loss array<struct<start:int,end:int>>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn under the template, and where its text starts and ends."""
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    body = escape(text)
    return head + body + tail, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out, at = [], 0
    while at < len(text):
        if text.startswith(OTHER[0], at):
            at += len(OTHER[0])
            stop = text.index(OTHER[1], at)
            role, at, tail = unescape(text[at:stop]), stop + len(OTHER[1]), OTHER[2]
        else:
            role = next(r for r, (head, _) in MARKS.items() if text.startswith(head, at))
            at, tail = at + len(MARKS[role][0]), MARKS[role][1]
        stop = text.index(tail, at)
        out.append((role, unescape(text[at:stop])))
        at = stop + len(tail)
    return out


def turn_tokens(text: str) -> int:
    """Words of a turn's text and two marks."""
    return len(_WORD.findall(text)) + 2


class _Conversation:
    """One conversation as its turns stream by; holds the open window and the turns that the next
    window may repeat, never the whole conversation."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system, self.spoken, self.recent, self.fresh = None, None, [], []  # system turn before, and in, the window
        self.upto = self.base = self.fixed = self.window = 0

    def add(self, role: str, text: str):
        n = turn_tokens(text)
        self.upto += n  # the running sum; a window's share is a difference of two sums
        if self.fresh and self.fixed + self.upto - self.base > self.budget:
            yield self.close()
            self.base = self.upto - n
            # repeats give way where a turn needs the room
            self.fixed = (self.system[2] if self.system else 0) + sum(t[2] for t in self.recent)
            while self.recent and self.fixed + n > self.budget:
                self.fixed -= self.recent.pop(0)[2]
        self.fresh.append((role, text, n))
        if role == "system":
            self.spoken = self.fresh[-1]

    def close(self) -> tuple:
        repeats = ([self.system] if self.system else []) + self.recent
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate(repeats + self.fresh):
            turn, start, end = render(role, text)
            if role == "assistant" and i >= len(repeats):
                loss.append((at + start, at + end))
            parts.append(turn)
            at += len(turn)
        row = (self.conv_id, self.window, "".join(parts), len(repeats), len(self.fresh),
               sum(t[2] for t in repeats + self.fresh), loss)
        tail, room = [], self.history
        for t in reversed(self.recent + self.fresh):
            if t is self.spoken:  # it heads the next windows anyway
                continue
            room -= t[2]
            if room < 0:
                break
            tail.insert(0, t)
        self.system = self.spoken or self.system
        self.recent, self.fresh, self.spoken, self.window = tail, [], None, self.window + 1
        return row


def format_windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id",
                   turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conv_id, window, text, repeated (turns repeated at its start), turns (new
    ones), tokens, loss (character spans of the assistant texts that are targets).

    A turn longer than the budget has a window to itself, whole. Null text and null role are empty
    strings; roles other than system, user and assistant keep their name in the template. Turns are
    ordered by ``turn`` (null first), ties by role, then text; repeated rows are turns of their own.
    Rows with a null conv_id are one conversation. An empty table gives no rows.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        open_, names = None, [c.split(" ")[0] for c in WINDOW_SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"].astype("Int64"), batch["role"], batch["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if open_ is None or open_.conv_id != conv:
                    if open_:
                        out.append(open_.close())
                    open_ = _Conversation(conv, budget, history)
                out += open_.add(role, text)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if open_:
            yield pd.DataFrame([open_.close()], columns=names).astype({"conv_id": "Int64"})

    return rows.mapInPandas(run, WINDOW_SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows say, per conversation: n_turns, turns_sha256 (role, newline, text,
    newline of every turn), loss_chars, loss_sha256 (all text under the loss mask, unescaped),
    formatted_chars. Digests run along the sorted windows, so a conversation of any length needs
    the memory of one window."""
    rows = windows.select("conv_id", "window", "text", "repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now = None

        def done():
            conv, n, turns, chars, loss, size = now
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            out = []
            for conv, text, repeated, loss in zip(batch["conv_id"].astype("Int64"), batch["text"], batch["repeated"], batch["loss"]):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now[0] != conv:
                    if now:
                        out.append(done())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text)[repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"]:span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if now:
            yield pd.DataFrame([done()], columns=names).astype({"conv_id": "Int64"})

    return rows.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
