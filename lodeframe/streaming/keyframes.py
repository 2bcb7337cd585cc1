"""Keyframe selection: one step function, used by a grouped job and by a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "seq long, frame_index int, is_keyframe boolean, keyframe int"
STATE = "keyframe int, failures int"


def step(keyframe: int | None, failures: int, row, least_disparity: float, least_scale: float, most_failures: int) -> tuple[int, int, bool]:
    """(keyframe, failures, whether this frame is one). The first frame is; so is a registered one
    that has moved enough, and one after more than `most_failures` failures since the last reset."""
    if keyframe is None:
        return row.frame_index, 0, True
    failures += not row.registered
    moved = row.registered and (row.disparity > least_disparity or row.scale_ratio > least_scale)
    if moved or failures > most_failures:
        return row.frame_index, 0, True
    return keyframe, failures, False


def _walk(rows: pd.DataFrame, keyframe, failures, options) -> tuple[pd.DataFrame, int | None, int]:
    rows = rows.sort_values(["frame_index"], kind="stable")
    out = []
    for row in rows.itertuples(index=False):
        keyframe, failures, new = step(keyframe, failures, row, *options)
        out.append((row.seq, row.frame_index, new, keyframe))
    return pd.DataFrame(out, columns=["seq", "frame_index", "is_keyframe", "keyframe"]), keyframe, failures


def select_keyframes(frames: DataFrame, least_disparity: float = 0.1, least_scale: float = 0.4, most_failures: int = 3) -> DataFrame:
    """Batch: a sequence is a group, its frames in the order of frame_index."""
    options = (least_disparity, least_scale, most_failures)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _walk(pdf, None, 0, options)[0]

    cols = ["seq", "frame_index", "registered", "disparity", "scale_ratio"]
    return frames.select(*cols).groupBy("seq").applyInPandas(run, OUTPUT)


def stream_keyframes(frames: DataFrame, least_disparity: float = 0.1, least_scale: float = 0.4, most_failures: int = 3) -> DataFrame:
    """Stream: the state of a sequence is its keyframe and its failures; each micro-batch is walked
    in order. Frames of a later batch must not precede those of an earlier one."""
    options = (least_disparity, least_scale, most_failures)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keyframe, failures = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts))
        out, keyframe, failures = _walk(rows, keyframe, failures, options)
        state.update((int(keyframe), int(failures)))
        yield out

    cols = ["seq", "frame_index", "registered", "disparity", "scale_ratio"]
    return frames.select(*cols).groupBy("seq").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
