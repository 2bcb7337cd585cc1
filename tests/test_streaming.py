from __future__ import annotations

from lodeframe.plans import fixtures as fx
from lodeframe.streaming.keyframes import select_keyframes, stream_keyframes

SF = "/root/testdata/sf0.001"


def test_three_failures_then_a_fourth(spark):
    rows = [(1, i, i == 0, 0.0, 0.0) for i in range(7)]
    df = spark.createDataFrame(rows, "seq long, frame_index int, registered boolean, disparity double, scale_ratio double")
    got = {r.frame_index: r.is_keyframe for r in select_keyframes(df).collect()}
    assert [i for i in range(7) if got[i]] == [0, 4]


def test_stream_replay_equals_batch(spark, tmp_path):
    frames = fx.frames(spark, SF).select("seq", "frame_index", "registered", "disparity", "scale_ratio")
    for k in range(3):
        frames.filter(f"int(frame_index / 8) {'=' if k < 2 else '>='} {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_keyframes(source).writeStream.format("memory").queryName("kf").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("kf").collect())) == sorted(map(tuple, select_keyframes(frames).collect()))
