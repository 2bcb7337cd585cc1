"""Frames from files: a manifest joined with its blobs, and binary frame logs.

A log is a 32-bit count, then for each frame a 64-bit time, the sizes of depth and image (32 bits
each) and the two blobs, all little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_frames(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest (path_rgb, path_depth and own columns) with the blobs rgb and depth, and `readable`:
    whether both were found. files: path, content, as spark.read.format("binaryFile") gives them.
    Unreadable frames stay, for the caller to route. Two equi-joins on the path."""
    one = files.select(F.col("path").alias("path_rgb"), F.col("content").alias("rgb"))
    two = files.select(F.col("path").alias("path_depth"), F.col("content").alias("depth"))
    got = manifest.join(one, "path_rgb", "left").join(two, "path_depth", "left")
    return got.withColumn("readable", F.col("rgb").isNotNull() & F.col("depth").isNotNull())


def write_frame_log(frames: DataFrame, key: str) -> DataFrame:
    """(key, content): one log a key, its frames (ts, depth, image) in the order of frame_index. A log
    is one blob by its format, so a key's frames must fit in a blob."""
    size = lambda c: F.octet_length(c)

    def little(c, n: int):
        wide = F.lpad(F.hex(c.cast("bigint")), 16, "0")
        return F.concat(*[F.unhex(F.substring(wide, 15 - 2 * i, 2)) for i in range(n)])

    body = F.concat(little(F.col("ts"), 8), little(size("depth"), 4), little(size("image"), 4), F.col("depth"), F.col("image"))
    rows = frames.select(F.col(key).alias("key"), "frame_index", body.alias("b")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("frame_index", "b"))).alias("l"))
    whole = F.aggregate("l", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["b"]))
    return rows.select("key", F.concat(little(F.size("l"), 4), whole).alias("content"))


def read_frame_log(logs: DataFrame, width: int, height: int) -> DataFrame:
    """(key, frame_index, ts, depth, image, raw_depth, n_frames) of logs (key, content): a row a frame.

    raw_depth: the depth blob is width * height 16-bit numbers, and not compressed. A log that ends
    within a frame gives the frames before it; n_frames is the count in its head. Null logs give none.
    """
    key = logs.schema["key"].dataType.simpleString()
    names = ["key", "frame_index", "ts", "depth", "image", "raw_depth", "n_frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in zip(batch.column(0), batch.column(1), strict=True):
                blob = value.as_py()
                if not blob or len(blob) < 4:
                    continue
                (n,), at, rows = struct.unpack_from("<i", blob), 4, []
                for i in range(n):
                    if at + 16 > len(blob):
                        break
                    ts, d, m = struct.unpack_from("<qii", blob, at)
                    if at + 16 + d + m > len(blob):
                        break
                    rows.append((i, ts, blob[at + 16 : at + 16 + d], blob[at + 16 + d : at + 16 + d + m], d == width * height * 2))
                    at += 16 + d + m
                for a in range(0, len(rows), 256):
                    part = rows[a : a + 256]
                    cols = list(zip(*part, strict=True))
                    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * len(part), batch.column(0).type), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)], pa.array([n] * len(part), pa.int32())], names=names
                    )

    return logs.select("key", "content").mapInArrow(run, f"key {key}, frame_index int, ts long, depth binary, image binary, raw_depth boolean, n_frames int")


def swap_red_and_blue(image: bytes) -> bytes:
    """An image of 3-byte pixels with the outer channels exchanged."""
    out = bytearray(image)
    out[0::3], out[2::3] = image[2::3], image[0::3]
    return bytes(out)


def positions(frames: DataFrame, key: str) -> DataFrame:
    """Where a reader of each log can go from each frame: n_frames, has_more, back (the frame before,
    null at the first) and rewound (the first)."""
    n = frames.withColumn("n_frames", F.count("*").over(Window.partitionBy(key)))
    return n.select(key, "frame_index", "n_frames", (F.col("frame_index") + 1 < F.col("n_frames")).alias("has_more"), F.when(F.col("frame_index") > 0, F.col("frame_index") - 1).alias("back"), F.lit(0).alias("rewound"))


def drop_repeats(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """A live stream without the frames whose key and time were seen within `late`; its state is
    dropped behind the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, ts])
