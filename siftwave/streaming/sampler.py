"""Sampling of unbounded sequences: pieces of text arrive for each sequence, and windows are sampled as soon as they are complete.

What is stateful is only the cutting of pieces into the chunks that schemes sample in tables too: of a sequence, the letters that its next window and the
one before it need. Keys, least k-mers and positions come from the same plan as for tables, for any scheme.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.schemes import CHUNK, Scheme, sample_chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Cutter(StatefulProcessor):
    """Cuts the pieces of a sequence into chunks of windows. Its state is the letters from the one before the next window on, and how many letters there were."""

    def __init__(self, l: int, chunk: int, idle: int):
        self.l, self.chunk, self.idle = l, chunk, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("letters", "tail binary, seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tail, seen = self.state.get() if self.state.exists() else (b"", 0)
        parts, begin, first = [bytes(tail)], seen - len(tail), max(0, seen - self.l + 1)
        fresh = pd.concat(list(rows)).sort_values("at")
        for at, data in zip(fresh["at"], fresh["data"], strict=True):
            if at > seen:
                raise ValueError(f"sequence {key[0]}: letters {seen} to {at} are missing")
            if at + len(data) > seen:
                parts.append(bytes(data)[seen - at :])
                seen = at + len(data)
        text = b"".join(parts)
        end = seen - self.l + 1  # windows from first up to end are complete now
        out = []
        for start in range(first, end, self.chunk):
            count, lead = min(self.chunk, end - start), int(start > 0)
            at = start - lead - begin
            out.append((key[0], start, count, lead, text[at : at + lead + count + self.l - 1]))
        keep = max(0, max(end, 0) - 1)  # the letter before the next window
        self.state.update((text[max(0, keep - begin) :], seen))
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=["seq_id", "start", "count", "lead", "data"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["seq_id", "start", "count", "lead", "data"])

    def close(self) -> None:
        pass


def chunk_stream(pieces: DataFrame, w: int, k: int, chunk: int = CHUNK, idle_ms: int = 0) -> DataFrame:
    """The chunks of schemes.chunks() from a stream (seq_id, at, data) of pieces, at being the place of data's first letter.

    Pieces of one batch are put in order; one seen before, as after a restart of its source, is passed over, and a gap is an error. The state of a sequence is w + k - 1
    letters at most; idle_ms: after so long without a piece it is dropped (0: never), and the sequence would begin anew. The session's state store must be STORE's.
    """
    kind = pieces.schema["seq_id"].dataType.simpleString()
    return pieces.groupBy("seq_id").transformWithStateInPandas(
        Cutter(w + k - 1, chunk, idle_ms), f"seq_id {kind}, start long, count long, lead long, data binary", "Append", "ProcessingTime" if idle_ms else "None"
    )


def sample_stream(pieces: DataFrame, scheme: Scheme, w: int, k: int, sigma: int = 256, chunk: int = CHUNK, idle_ms: int = 0) -> DataFrame:
    """(seq_id, win, pos, prev) of any scheme, as schemes.sample() gives for whole sequences, from a stream of pieces, see chunk_stream()."""
    return sample_chunks(chunk_stream(pieces, w, k, chunk, idle_ms), scheme, w, k, sigma)
