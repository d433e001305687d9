"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

A conversation's turns, in order, are cut into windows: prefix sums of turn tokens,
those that a byte-pair tokenizer gives for the turn as it is written, pick the longest run of new turns that fits the budget left beside the system turn
and the repeated history. Each window starts with the system turn, if the
conversation starts with one, then repeats up to ``history_turns`` earlier turns
within ``history_tokens``, then holds its new turns. Assistant text is under the
loss mask in the window where it is new; repeated turns are masked out. A turn is
never cut: one that is longer than the budget has a window with no history.

A turn is written as ``<s>[INST]role[/INST]text</s>``. Control strings inside roles
and texts get a backslash after their first character, and one that has some gets
one more, so reading back is exact.

Null text and role count as empty. Rows of a null conv_id form one conversation.
Rows of one conversation are ordered by turn (nulls first), then role and text, so
ties and repeated rows have a fixed order, and all are kept. Very long texts are one
turn each; extra columns are ignored, whatever their names; an empty table gives no rows.

Rows are shuffled once, partitioned by conversation and streamed in order; a task holds one window
and its history, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm.bpe import broadcast_model, cached_blocks
from brickyard.llm.token_count import LengthCache, no_table

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
OPEN, MIDDLE, BEFORE_TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)")
QUOTED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>)")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
WINDOWS = "conv_id long, window long, formatted string, n_repeated int, loss array<struct<start: int, end: int>>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return QUOTED.sub(r"\1\2\3", text)


def written(role: str, text: str) -> tuple[str, str]:
    """(what stands before a turn's text, its text), both as written."""
    return f"{OPEN}{MIDDLE}{escape(role)}{BEFORE_TEXT}", escape(text)


def tokens_of(turns: list[tuple[str, str]], cache: LengthCache) -> list[int]:
    """The tokens of each (role, text) as it is written."""
    texts = ["".join(written(role, text)) + CLOSE for role, text in turns]
    return [cache.count(blocks) for blocks in cached_blocks(cache.model, texts, cache.learn)]


class Windows:
    """The windows of one conversation, as its turns come."""

    def __init__(self, conv_id, budget: int, history_turns: int, history_tokens: int):
        self.conv_id, self.budget, self.history_turns, self.history_tokens = conv_id, budget, history_turns, history_tokens
        self.system: tuple[str, str, int] | None = None
        self.done: deque = deque(maxlen=max(1, history_turns))
        self.new: list[tuple[str, str, int]] = []
        self.sum = 0  # prefix sum of the tokens of the new turns
        self.count = 0
        self.first = True
        self.system_is_new = False

    def repeated(self) -> list[tuple[str, str, int]]:
        out, left = [], self.history_tokens
        for turn in reversed(list(self.done)[-self.history_turns :] if self.history_turns else []):
            if turn[2] > left:
                break
            out.append(turn)
            left -= turn[2]
        return out[::-1]

    def room(self) -> int:
        return self.budget - (self.system[2] if self.system else 0) - sum(t[2] for t in self.repeated())

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens)
        if self.first and role == "system":
            self.system, self.first, self.system_is_new = turn, False, True
            return
        self.first = False
        if self.new and self.sum + turn[2] > self.room():
            yield self.close()
        if not self.new and turn[2] > self.room():
            self.done.clear()
        self.new.append(turn)
        self.sum += turn[2]

    def close(self) -> tuple:
        repeated = self.repeated()
        head = ([self.system] if self.system else []) + repeated
        n_repeated = len(head) - self.system_is_new
        text, loss, at = [], [], 0
        for i, (role, body, _) in enumerate([*head, *self.new]):
            before, body = written(role, body)
            if i >= len(head) and role == "assistant" and body:
                loss.append({"start": at + len(before), "end": at + len(before) + len(body)})
            text += [before, body, CLOSE]
            at += len(before) + len(body) + len(CLOSE)
        row = (self.conv_id, self.count, "".join(text), n_repeated, loss)
        self.done.extend(self.new)
        self.new, self.sum, self.count, self.system_is_new = [], 0, self.count + 1, False
        return row

    def end(self) -> Iterator[tuple]:
        if self.new or self.system_is_new:
            yield self.close()


def format_windows(conversations: DataFrame, path: str, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss): windows in order, by partition.

    After the system turn, ``n_repeated`` counts the leading turns that an earlier
    window has already shown; ``loss`` holds code point spans of ``formatted``;
    ``path`` is the tokenizer file that tokens are counted with.
    """
    model = broadcast_model(conversations.sparkSession, path)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key, cache = None, object(), LengthCache(model.value, no_table())
        for pdf in batches:
            rows, sizes = [], tokens_of(list(zip(pdf["role"], pdf["text"], strict=True)), cache)
            for conv, role, text, size in zip(pdf["conv_id"], pdf["role"], pdf["text"], sizes, strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != key:
                    if now:
                        rows += now.end()
                    now, key = Windows(conv, budget, history_turns, history_tokens), conv
                rows += now.add(role, text, size)
            yield _frame(rows)
        if now:
            yield _frame(list(now.end()))

    return dealt.mapInPandas(run, WINDOWS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "window", "formatted", "n_repeated", "loss"])
    return out.astype({"conv_id": "Int64", "window": "int64", "formatted": object, "n_repeated": "int32", "loss": object})


def read_back(formatted: str, n_repeated: int) -> list[tuple[str, str]]:
    """The new (role, text) turns of a window."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)][n_repeated:]


def digests(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """One row per conversation, read back from its windows alone.

    ``in_order``: the windows come straight from :func:`format_windows`, which leaves each
    conversation whole and in order in one partition, so they need no second shuffle.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    dealt = windows if in_order else windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None

        def row() -> tuple:
            return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for pdf in batches:
            rows = []
            for conv, formatted, n_repeated, loss in zip(pdf["conv_id"], pdf["formatted"], pdf["n_repeated"], pdf["loss"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != key:
                    if state:
                        rows.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(formatted, n_repeated):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            yield _digest_frame(rows)
        if state:
            yield _digest_frame([row()])

    return dealt.mapInPandas(run, schema)


def _digest_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.astype({"conv_id": "Int64", "n_turns": "int64", "turns_sha256": object, "loss_chars": "int64", "loss_sha256": object, "formatted_chars": "int64"})
