"""The pose graph: products and solutions against dense ones, a loop that closes, a spoilt newest frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodeframe.operators import posegraph
from lodeframe.operators.registration import pair_moments
from lodeframe.plans.graph import pose_graph

SF = "/root/testdata/sf0.001"


def gap(poses, true):
    want = {r.frame_id: r for r in true.collect()}
    return max(max(np.abs(np.array(r.t) - want[r.frame_id].t).max(), np.abs(np.array(r.r) - want[r.frame_id].r).max()) for r in poses.collect())


def test_conjugate_gradients_are_a_dense_solution(spark):
    rng = np.random.default_rng(0)
    blocks, rows, dense = [], [], {}
    for m, ids in ((0, [1, 2, 3]), (1, [7, 8])):
        a = rng.normal(size=(60, 6 * len(ids)))
        h, b = a.T @ a, rng.normal(size=6 * len(ids))
        x = np.linalg.solve(h, b)
        for i, n in enumerate(ids):
            dense[n] = x[6 * i : 6 * i + 6]
            rows.append((n, m, b[6 * i : 6 * i + 6].tolist(), np.linalg.inv(h[6 * i : 6 * i + 6, 6 * i : 6 * i + 6]).ravel().tolist()))
            blocks += [(n, k, h[6 * i : 6 * i + 6, 6 * j : 6 * j + 6].ravel().tolist()) for j, k in enumerate(ids)]
    got = posegraph.conjugate_gradients(spark.createDataFrame(blocks, "row int, col int, h array<double>"), spark.createDataFrame(rows, "id int, map int, b array<double>, m array<double>"), tolerance=1e-20)
    assert all(np.allclose(r.x, dense[r.id], atol=1e-8) for r in got.collect()) and got.count() == 5


def test_a_map_of_known_poses_closes(spark):
    drift, true, edges = pose_graph(spark, SF)
    assert posegraph.edge_errors(edges, true).agg(F.max("error")).first()[0] < 1e-6
    poses, left, maps = posegraph.optimise(drift, edges)
    row = maps.first()
    assert gap(poses, true) < 1e-5 < 1e-2 < gap(drift, true) and row.total_after < 1e-6 < row.total_before and not row.rolled_back
    assert left.count() == edges.count() and poses.count() == drift.count()


def test_a_spoilt_newest_frame_is_rolled_back(spark):
    _, true, edges = pose_graph(spark, SF)
    poses = true.filter("frame_id < 5")  # right already, but for the newest frame's false edge
    rng = np.random.default_rng(3)
    false = spark.createDataFrame([(0, 4, *map(float, rng.uniform(-1, 1, 3)), *map(float, rng.uniform(-1, 1, 3))) for _ in range(40)], "ref int, new int, px double, py double, pz double, qx double, qy double, qz double")
    every = edges.filter("new < 5 and new = ref + 1").unionByName(pair_moments(false, F.lit(10.0)).select(edges.columns))
    noisy = every.withColumn("sqq", F.transform("sqq", lambda v, k: v + F.when(k % 4 == 0, 1e-6).otherwise(0.0)))  # errors before are not 0
    out, left, maps = posegraph.optimise(poses, noisy, rounds=1)
    assert maps.first().rolled_back and gap(out, true) == 0
    assert sorted((r.ref, r.new) for r in left.select("ref", "new").collect()) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_small_maps_stand(spark):
    _, true, edges = pose_graph(spark, SF)
    drift, _, _ = pose_graph(spark, SF)
    two = drift.filter("frame_id < 2")
    poses, _, maps = posegraph.optimise(two, edges.filter("new < 2"))
    assert gap(poses, two) == 0 and not maps.first().rolled_back
    none, left, maps = posegraph.optimise(two, edges.filter("ref < 0"))
    assert none.count() == 2 and left.count() == 0 and maps.count() == 0
