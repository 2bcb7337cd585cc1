"""Keyframe registration as a stream: poses, the index and restarts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators.graph import kept
from lodeframe.plans import fixtures as fx
from lodeframe.streaming.places import FEATURES, PlaceIndex

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    """Two sequences of three frames; the second's last frame shows nothing that was seen."""
    f = fx.features(spark, SF).filter("frame_id < 3").withColumn("seq", F.lit(1).cast("bigint"))
    other = f.select(F.lit(2).cast("bigint").alias("seq"), (F.col("frame_id") + 10).alias("frame_id"), F.when(F.col("frame_id") == 2, F.col("kp_id") + 100_000).otherwise(F.col("kp_id")).alias("kp_id"), F.when(F.col("frame_id") == 2, F.transform("words", lambda w: F.xxhash64(w))).otherwise(F.col("words")).alias("words"), "x", "y", "z", "u", "v", "angle", "octave")
    return kept(f.select(other.columns).unionByName(other).select(*[c.split()[0] for c in FEATURES.split(", ")]))


def rows_of(index):
    key = lambda v: tuple(round(x, 9) for x in v) if isinstance(v, list) else v
    return sorted(tuple(map(key, r)) for r in index.keyframes().collect()), sorted((r.ref, r.new, r.n) for r in index.edges().collect())


def test_stream_over_a_restart_is_the_batch(spark, features, tmp_path):
    whole = PlaceIndex(spark, str(tmp_path / "whole"), fx.FEATURE_CAMERA)
    whole.apply(features)
    got = {r.frame_id: r for r in whole.keyframes().collect()}
    assert {f: (r.place, r.reference, r.registrations) for f, r in got.items()} == {0: (0, None, 0), 1: (1, 0, 1), 2: (2, 1, 1), 10: (0, None, 0), 11: (1, 10, 1), 12: (2, None, 0)}
    assert all(r.in_index for r in got.values())
    q, w = fx.TURN, (1 - sum(a * a for a in fx.TURN)) ** 0.5
    x, y, z = q
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    pose, t = np.eye(3), np.zeros(3)
    for frame in (1, 2):
        shift = np.array(fx.SHIFT) + [0.01 * ((frame - 1) % 5), 0, 0]
        pose, t = pose @ turn.T, t - pose @ turn.T @ shift
        assert np.allclose(np.reshape(got[frame].r, (3, 3)), pose, atol=1e-6) and np.allclose(got[frame].t, t, atol=1e-6)
    assert {(r.frame_id, r.map) for r in whole.poses().collect()} == {(0, 0), (1, 0), (2, 0), (10, 10), (11, 10), (12, 12)}

    for part in ("frame_id % 10 < 2", "frame_id % 10 = 2"):
        features.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        again = PlaceIndex(spark, str(tmp_path / "stream"), fx.FEATURE_CAMERA)  # all it knows is in the folder
        stream = spark.readStream.schema(features.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        again.follow(stream).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(again) == rows_of(whole)
    again.apply(features)  # nothing is new
    assert rows_of(again) == rows_of(whole) and again.last() == 2


def test_only_poorly_registered_keyframes_enter_the_index(spark, features, tmp_path, monkeypatch):
    """With one registration enough, the second keyframe takes its place but not its features; a step cut off before its commit leaves nothing."""
    index = PlaceIndex(spark, str(tmp_path / "places"), fx.FEATURE_CAMERA, enough=1)
    one = features.filter("seq = 1 and frame_id < 2")
    with monkeypatch.context() as m:
        m.setattr(PlaceIndex, "_put", lambda self, kind, rows, step, put=PlaceIndex._put: (_ for _ in ()).throw(OSError("lost")) if (kind, step) == ("keyframes", 1) else put(self, kind, rows, step))
        with pytest.raises(OSError):
            index.apply(one)
    assert [r.frame_id for r in index.keyframes().collect()] == [0] and index.edges().count() == 0
    PlaceIndex(spark, str(tmp_path / "places"), fx.FEATURE_CAMERA, enough=1).apply(one)
    assert [(r.frame_id, r.registrations, r.in_index) for r in index.keyframes().orderBy("place").collect()] == [(0, 0, True), (1, 1, False)]
    new = spark.createDataFrame([(1, 2, 2)], "seq long, frame_id int, place long")
    every = features.filter("seq = 1")
    found = index.closures(new, every, index.keyframes())
    assert found.filter("place = 1").count() == 0
