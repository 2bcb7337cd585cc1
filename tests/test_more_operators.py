"""Operators that SQL cannot express, against plain loops and known answers."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.functions.geometry import Camera
from lodeframe.operators import stencils
from lodeframe.operators import voxels as vx
from lodeframe.sources import frames as src
from lodeframe.streaming import beliefs
from lodeframe.streaming.maps import VoxelMap

GRID = "gx int, gy int, gz int, sum_wd double, sum_w double, sum_r bigint, sum_g bigint, sum_b bigint, n_c bigint"


def test_pca_normals(spark):
    """A tilted plane: every normal is the plane's, turned to the camera; a lone point has none."""
    rows = [(0, u, v, u * 0.1, v * 0.1, 2 + u * 0.05) for u in range(6) for v in range(6)] + [(1, 0, 0, 0.0, 0.0, 1.0)]
    got = stencils.pca_normals(spark.createDataFrame(rows, "frame_id int, u int, v int, x double, y double, z double")).collect()
    assert len(got) == 36 and {r.frame_id for r in got} == {0}
    size = math.hypot(0.5, 1)
    for r in got:
        assert (r.nx, r.ny, r.nz) == pytest.approx((0.5 / size, 0, -1 / size), abs=1e-6)


def test_frame_log_round_trip(spark):
    rows = [(7, i, 100 + i, b"d" * 8, bytes([i % 256] * (i + 1))) for i in range(300)] + [(8, 0, -5, b"xyz", b"")]
    df = spark.createDataFrame(rows, "k long, frame_index int, ts long, depth binary, image binary")
    logs = src.write_frame_log(df, "k")
    blob = bytes(logs.filter("key = 8").first().content)
    assert blob == struct.pack("<iqii", 1, -5, 3, 0) + b"xyz"
    got = {(r.key, r.frame_index): r for r in src.read_frame_log(logs, 2, 2).collect()}
    assert len(got) == 301
    for k, i, ts, depth, image in rows:
        r = got[k, i]
        assert (r.ts, bytes(r.depth), bytes(r.image), r.raw_depth) == (ts, depth, image, len(depth) == 8)
    cut = spark.createDataFrame([(1, blob[:-1]), (2, None), (3, b""), (4, blob)], "key long, content binary")
    assert [r.key for r in src.read_frame_log(cut, 2, 2).collect()] == [4]
    assert src.swap_red_and_blue(b"rgbRGB") == b"bgrBGR"


def test_live_repeats_are_dropped(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "cam int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = src.drop_repeats(stream, "cam", "ts").writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(str, spark.table("live").collect())) == sorted(map(str, df.distinct().collect()))


def test_depth_moves_onto_a_plane(spark):
    """Depths 2 cm off a plane at 1.02 m come to lie on it; one too far off drops out."""
    voxel, rows = 0.05, []
    for gx in range(-4, 5):
        for gy in range(-4, 5):
            for gz in range(14, 28):
                rows.append((gx, gy, gz, 1.02 - (gz + 0.5) * voxel, 10.0))
    grid = spark.createDataFrame(rows, "gx int, gy int, gz int, sdf double, weight double")
    pts = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 0.01, 0.01, 1.0), (2, 1.04, 0.0, 0.0, 0.0, -0.02, 0.0, 1.0), (3, 1.3, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "id int, depth double, ox double, oy double, oz double, rx double, ry double, rz double")
    got = {r.id: r.depth for r in vx.refine_depth(pts, grid, ["id"], voxel).collect()}
    assert got == {1: pytest.approx(1.02), 2: pytest.approx(1.02)}


def test_fusion_options(spark):
    """Policies are replaceable, and carving halves what a frame sees through."""
    cam = Camera(8, 8, 8.0, 8.0, 3.5, 3.5, 1000.0, 10.0)
    pose = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "frame_id int, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    px = spark.createDataFrame([(0, u, v, 1.0, 10, 20, 30) for u in range(8) for v in range(8)], "frame_id int, u int, v int, depth double, r int, g int, b int")
    cells = spark.createDataFrame([(0, 0, 0, k) for k in range(17, 23)], "frame_id int, gx int, gy int, gz int")
    o = vx.FusionOptions(voxel=0.05, truncation=lambda z: F.lit(0.1), weigh=lambda t: F.lit(3.0))
    grid = vx.integrate(None, cells, px, pose, cam, o)
    got = {r.gz: r for r in grid.collect()}
    assert got and all(r.sum_w == 3.0 and r.sum_wd == pytest.approx(3 * (1 - (z + 0.5) * 0.05)) for z, r in got.items())
    old = spark.createDataFrame([(0, 0, 8, -5.0, 10.0, 0, 0, 0, 0), (0, 0, 25, -5.0, 10.0, 0, 0, 0, 0)], GRID)
    for carving, want in ((False, 10.0), (True, 5.0)):
        after = {r.gz: r.sum_w for r in vx.integrate(old, cells, px, pose, cam, vx.FusionOptions(voxel=0.05, carving=carving)).collect()}
        assert after[8] == want and after[25] == 10.0


def test_normal_blocks_by_finite_steps(spark):
    """The right-hand side is half the gradient of the squared error along each motion."""
    from lodeframe.operators.registration import normal_blocks

    rng = np.random.default_rng(1)
    p, q = rng.normal(size=(20, 3)), rng.normal(size=(20, 3))
    rows = [(0, 1, i, *map(float, (*p[i], *q[i]))) for i in range(20)]
    df = spark.createDataFrame(rows, "ref int, new int, id int, px double, py double, pz double, qx double, qy double, qz double")
    got = {(r.row, r.col, r.i, r.j): r.value for r in normal_blocks(df, F.lit(1.0)).collect()}

    def error(d, e):
        move = lambda x, m: x + m[:3] + np.cross(m[3:], x)
        return ((move(p, d) - move(q, e)) ** 2).sum()

    for i in range(6):
        h = np.zeros(6)
        h[i] = 1e-5
        z = np.zeros(6)
        assert got[0, 0, i, 6] == pytest.approx((error(h, z) - error(-h, z)) / 4e-5, abs=1e-5)
        assert got[1, 1, i, 6] == pytest.approx((error(z, h) - error(z, -h)) / 4e-5, abs=1e-5)
        for j in range(6):
            k = np.zeros(6)
            k[j] = 1e-5
            cross = (error(h, k) - error(h, -k) - error(-h, k) + error(-h, -k)) / (8 * 1e-10)
            assert got.get((0, 1, i, j), 0.0) == pytest.approx(cross, abs=1e-3)


def test_search_finds_images_beyond_a_full_bucket(spark):
    """Images past a bucket's capacity are found: the index that searches join with has no cap."""
    from lodeframe.operators import similarity as op

    rows = [(i, 0, [0, 0, 0, 0], 0, 7) for i in range(12)]
    keys = spark.createDataFrame(rows, "image_id long, feature_id long, words array<long>, table_id int, key long")
    assert op.build_buckets(keys, 5).count() == 5
    pairs = op.candidates(keys, op.build_buckets(keys, None), 1)
    assert {(r.q_image, r.image_id) for r in pairs.collect()} == {(a, b) for a in range(12) for b in range(a)}
