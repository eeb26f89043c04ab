"""Answers that arrive in chunks: thinking left out, finished parts handed on at once. Chunks are rows (key, seq, chunk, last).

Each rule comes as a stream, whose state is what one unfinished answer needs, and as a query on a table of chunks. Chunks of
an answer have to come in order from one batch to the next; within a batch they are put in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import batch_answers

#: Milliseconds after which an answer without a last chunk is given up.
ABANDONED = 3_600_000
OPEN, CLOSE = "<think>", "</think>"
MARK = re.compile(r"^【(\d{1,9})】", re.MULTILINE)


def shown(text: str, inside: bool) -> tuple[str, bool, str]:
    """What of a text is outside of think blocks, whether it ends inside of one, and its end where that may begin a tag."""
    out = []
    while True:
        tag = CLOSE if inside else OPEN
        before, found, after = text.partition(tag)
        if not found:
            break
        out += [] if inside else [before]
        text, inside = after, not inside
    held = next((n for n in range(len(tag) - 1, 0, -1) if text.endswith(tag[:n])), 0)
    cut = len(text) - held
    return "".join(out) + ("" if inside else text[:cut]), inside, text[cut:]


def without_thinking(chunks: DataFrame) -> DataFrame:
    """A stream's (key, seq, text): what each chunk adds to the answer; what may be half a tag waits for the next chunk."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        inside, carry = state.get if state.exists else (False, "")
        rows, ended = [], False
        for seq, chunk, last in _in_order(parts):
            text, inside, carry = shown(carry + chunk, inside)
            if last:
                text, inside, carry = text + ("" if inside else carry), False, ""
            rows.append((key[0], seq, text))
            ended = bool(last)
        _kept(state, (inside, carry), ended)
        yield pd.DataFrame(rows, columns=["key", "seq", "text"])

    return chunks.groupBy("key").applyInPandasWithState(step, f"key {_key(chunks)}, seq long, text string", "inside boolean, carry string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def finished_parts(chunks: DataFrame) -> DataFrame:
    """A stream's (key, n, text): a part 【n】 of an answer as soon as the next one begins, each number once, no blank ones; the last part at the end."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buffer, told = state.get if state.exists else ("", "")
        done, ended = set(told.split()), False
        rows = []
        for _, chunk, last in _in_order(parts):
            buffer += chunk
            marks = list(MARK.finditer(buffer))
            ends = [m.start() for m in marks[1:]] + ([len(buffer)] if last else [])
            for mark, end in zip(marks, ends, strict=False):
                text = buffer[mark.end() : end].strip()
                if text and mark[1] not in done:
                    done.add(mark[1])
                    rows.append((key[0], int(mark[1]), text))
            # before a first mark only the line that may begin with it is kept
            buffer = "" if last else buffer[marks[-1].start() if marks else buffer.rfind("\n") + 1 :]
            ended = bool(last)
        _kept(state, (buffer, " ".join(sorted(done))), ended)
        yield pd.DataFrame(rows, columns=["key", "n", "text"])

    return chunks.groupBy("key").applyInPandasWithState(step, f"key {_key(chunks)}, n long, text string", "buffer string, done string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def whole_answers(chunks: DataFrame) -> DataFrame:
    """(key, text) of a table of chunks, without think blocks; one that is not closed goes to the answer's end."""
    listed = chunks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("c"))
    return listed.select("key", F.regexp_replace(F.array_join("c.chunk", ""), rf"(?s){OPEN}.*?(?:{CLOSE}|\z)", "").alias("text"))


def whole_parts(chunks: DataFrame) -> DataFrame:
    """(key, n, text) of a table of chunks."""
    return batch_answers(whole_answers(chunks), ["key"])


def _kept(state: GroupState, value: tuple, ended: bool) -> None:
    """State goes with the answer's last chunk, or when none has come for ``ABANDONED``."""
    if ended:
        if state.exists:
            state.remove()
    else:
        state.update(value)
        state.setTimeoutDuration(ABANDONED)


def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    rows = pd.concat(list(parts)).sort_values("seq")
    return zip(rows["seq"], rows["chunk"].fillna(""), rows["last"], strict=True)


def _key(chunks: DataFrame) -> str:
    return chunks.schema["key"].dataType.simpleString()
