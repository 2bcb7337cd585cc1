"""A live source: frames of ring buffers, each taken once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COLUMNS = ["source", "arrival", "buffer", "ts"]
OUTPUT = "source long, arrival long, buffer int, ts long"


def taken(rows: pd.DataFrame, buffer: int | None, ts: int | None) -> tuple[pd.DataFrame, int | None, int | None]:
    """The rows of one source that are new frames, and the buffer and time of the last one taken: a reader that finds the buffer or the time of the
    frame that it took last takes nothing."""
    keep = []
    for b, t in zip(rows["buffer"].tolist(), rows["ts"].tolist(), strict=True):
        new = b != buffer and t != ts
        if new:
            buffer, ts = b, t
        keep.append(new)
    return rows[keep], buffer, ts


def live_frames(polls: DataFrame) -> DataFrame:
    """The polls (source, arrival, buffer, ts) of a table that took a new frame, in the order of arrival. Sources are sorted within partitions
    and walked in one pass; what a task holds of a source is the last buffer and time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = buffer = ts = None
        for pdf in parts:
            for key, rows in pdf.groupby("source", sort=False):
                if key != source:
                    source, buffer, ts = key, None, None
                out, buffer, ts = taken(rows, buffer, ts)
                yield out

    return polls.select(*COLUMNS).repartition("source").sortWithinPartitions("source", "arrival").mapInPandas(run, OUTPUT)


class LiveReader(StatefulProcessor):
    """The last buffer and time of each source."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "buffer int, ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        buffer, ts = self.last.get() if self.last.exists() else (None, None)
        out, buffer, ts = taken(pd.concat(list(rows)).sort_values("arrival", kind="stable"), buffer, ts)
        self.last.update((buffer, ts))
        yield out[COLUMNS]

    def close(self) -> None:
        pass


def stream_live_frames(polls: DataFrame) -> DataFrame:
    """The same of a stream, in append mode; polls of a later micro-batch come after those before. Needs the RocksDB state store."""
    return polls.select(*COLUMNS).groupBy("source").transformWithStateInPandas(LiveReader(), OUTPUT, "Append", "None")
