"""Depth refinement by four samples, thinning by quota, live sources, chunks in view, trilinear samples."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import geometry as g
from lodeframe.operators import images, registration, voxels
from lodeframe.sources import live

CAM = g.Camera(20, 20, 10.0, 10.0, 10.0, 10.0)


def test_refinement_takes_four_samples_or_the_nearest(spark):
    still = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 1.0, 0.05, 0.03, 0.0)], "frame_id int, to_frame int, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    point = lambda u, v, z: (0, u, v, (u - 10) / 10 * z, (v - 10) / 10 * z, z, 1)
    points = spark.createDataFrame([point(5, 5, 1.0), point(12, 12, 1.0), point(15, 5, 1.0), point(1, 1, 1.0), point(5, 15, 1.0)], "frame_id int, u int, v int, x double, y double, z double, w int")
    seen = {(5, 5): 1.0, (6, 5): 1.02, (5, 6): 1.04, (6, 6): 1.01, (12, 12): 1.03, (13, 12): 3.0, (12, 13): 1.0, (13, 13): 1.0, (15, 5): 2.0, (16, 5): 2.0, (15, 6): 2.0, (16, 6): 2.0}
    px = spark.createDataFrame([(1, u, v, d) for (u, v), d in seen.items()], "frame_id int, u int, v int, m double")
    got = {(r.u, r.v): (r.depth, r.new_weight) for r in images.refine_depth(points, still, px, "m", "w", CAM).collect()}
    four = 0.5 * 0.7 * 1.0 + 0.5 * 0.7 * 1.02 + 0.5 * 0.3 * 1.04 + 0.5 * 0.3 * 1.01
    assert got[5, 5] == pytest.approx(((1 + four) / 2, 2))  # bilinear
    assert got[12, 12][1] == 1  # the four disagree; the nearest is 3.0, too far
    assert got[15, 5] == (1.0, 1) and got[1, 1] == (1.0, 1) and got[5, 15] == (1.0, 1)  # too deep, at the border, nothing there
    near = px.withColumn("m", F.when((F.col("u") == 13) & (F.col("v") == 12), 1.04).when((F.col("u") == 12) & (F.col("v") == 13), 3.0).otherwise(F.col("m")))
    got = {(r.u, r.v): (r.depth, r.new_weight) for r in images.refine_depth(points, still, near, "m", "w", CAM).collect()}
    assert got[12, 12] == pytest.approx(((1 + 1.04) / 2, 2))  # the nearest pixel agrees


def brute_quad(rows, width, height, quota, depth):
    columns = max(1, round(width / height))
    best = lambda pts: max(pts, key=lambda p: (p[3], -p[0]))
    levels = []
    for d in range(depth + 1):
        cells = {}
        for p in rows:
            cells.setdefault((int(p[1] / (width / columns) * 2**d), int(p[2] / height * 2**d)), []).append(p)
        levels.append(cells)
    k = max((d for d in range(depth + 1) if len(levels[d]) <= quota), default=0)
    nodes, total = dict(levels[k]), len(levels[k])
    out = []
    spill = {c: [levels[k + 1][q] for q in levels[k + 1] if (q[0] // 2, q[1] // 2) == c] if k < depth else [] for c in nodes}
    stopped = False
    for c in sorted((c for c in nodes if len(spill[c]) > 1), key=lambda c: (-len(nodes[c]), c)):
        if not stopped and total + len(spill[c]) - 1 <= quota:
            total += len(spill[c]) - 1
            out += [best(q) for q in spill[c]]
            del nodes[c]
        else:
            stopped = True
    out += [best(p) for p in nodes.values()]
    return {p[0] for p in sorted(out, key=lambda p: (-p[3], p[0]))[:quota]}


@pytest.mark.parametrize("quota", [1, 3, 17, 60, 5000])
def test_thinning_keeps_the_strongest_of_a_quad_tree(spark, quota):
    import random

    rng = random.Random(quota)
    rows = [(i, rng.uniform(0, 100) if i % 3 else rng.uniform(0, 9), rng.uniform(0, 50), rng.randrange(20)) for i in range(400)] + [(1000 + i, 7.5, 7.5, 3) for i in range(5)]
    df = spark.createDataFrame([(1, 0, *r) for r in rows], "frame_id int, level int, kp_id int, x double, y double, response int")
    got = [r.kp_id for r in registration.quad_thin(df, 100.0, 50.0, [quota], depth=5).collect()]
    assert len(got) == len(set(got)) <= quota and set(got) == brute_quad(rows, 100.0, 50.0, quota, 5)
    assert registration.quad_thin(df.limit(0), 100.0, 50.0, [quota]).count() == 0


def test_quotas_fall_geometrically():
    out = registration.level_quotas(2000, 8)
    assert sum(out) == 2000 and all(abs(a / b - 1.2) < 0.01 for a, b in zip(out[:6], out[1:7], strict=True))
    assert registration.level_quotas(10, 1) == [10]


def test_live_stream_over_restarts_is_the_table_s(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [(s, a, rng.randrange(3), rng.randrange(6)) for s in range(4) for a in range(60)]
    df = spark.createDataFrame(rows, "source long, arrival long, buffer int, ts long")
    want, last = [], {}
    for s, a, b, t in rows:
        if s not in last or (b != last[s][0] and t != last[s][1]):
            want.append((s, a, b, t))
            last[s] = (b, t)
    assert sorted(map(tuple, live.live_frames(df.repartition(3)).collect())) == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for a, b in ((0, 7), (7, 8), (8, 60)):
            df.filter(f"arrival >= {a} and arrival < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            live.stream_live_frames(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.read.schema(live.OUTPUT).parquet(str(tmp_path / "out")).collect())) == want


def test_trilinear_samples_are_exact_for_a_plane(spark):
    cells = spark.createDataFrame([(i, j, k, 2.0 * i + 3 * j - k, float(i)) for i in range(4) for j in range(4) for k in range(4)], "gx int, gy int, gz int, a double, b double")
    points = spark.createDataFrame([(0, 0.15, 0.21, 0.17), (1, 0.05, 0.05, 0.05), (2, 0.01, 0.2, 0.2), (3, 5.0, 0.2, 0.2)], "id int, x double, y double, z double")
    got = {r.id: r for r in voxels.sample_trilinear(points, cells, "id", 0.1, ["a", "b"]).collect()}
    assert got[0].smooth and got[0].a == pytest.approx(2 * 1.0 + 3 * 1.6 - 1.2) and got[0].b == pytest.approx(1.0)
    assert got[1].smooth and got[1].a == pytest.approx(0.0)
    assert not got[2].smooth and got[2].a == 2 * 0 + 3 * 2 - 2 and not got[3].smooth and got[3].a is None


def test_chunks_seen_are_the_exhaustive_ones(spark):
    depth = [(0, u, v, 1.0 + 0.03 * u) for u in range(20) for v in range(20) if (u + v) % 7]
    pixels = spark.createDataFrame(depth, "frame_id int, u int, v int, depth double")
    poses = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.013, 0.021, 0.007)], "frame_id int, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    side, at = 0.3, {(u, v): d for _, u, v, d in depth}
    want = {}
    for x in range(-12, 13):
        for y in range(-12, 13):
            for z in range(-3, 14):
                hits = 0
                for o in [(k & 1, k >> 1 & 1, k >> 2) for k in range(8)] + [(0.5, 0.5, 0.5)]:
                    p = ((x + o[0]) * side - 0.013, (y + o[1]) * side - 0.021, (z + o[2]) * side - 0.007)
                    if 0 < p[2] < 3:
                        d = at.get((int((10 * p[0] / p[2] + 10) // 1), int((10 * p[1] / p[2] + 10) // 1)))
                        hits += d is not None and abs(d - p[2]) < 0.1 + 3**0.5 * side
                if hits > 2:
                    want[x, y, z] = hits
    got = {(r.cx, r.cy, r.cz): r.hits for r in images.chunks_seen(pixels, poses, side, CAM, lambda z: g.constant_truncation(0.1)).collect()}
    assert got == want and Counter(got.values())
