"""What keeps queries going on larger tables: nothing that grows is broadcast, pixels lie by frame, rows that go are dropped early."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import geometry
from lodeframe.operators import images, meshing, registration, rigid, similarity, voxels
from lodeframe.operators.graph import kept
from lodeframe.plans import fixtures as fx
from lodeframe.plans import registration as registration_plan
from lodeframe.plans import similarity as similarity_plan
from lodeframe.plans.registry import QUERIES
from lodeframe.plans.space import CAM
from lodeframe.streaming import beliefs

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unfolded_trials_and_keys_are_not_broadcast(spark):
    m = kept(registration_plan.matches(spark, SF))
    assert "Broadcast" not in plan_of(rigid.trial_motions(m))
    f, pairs = kept(fx.features(spark, SF)), kept(fx.feature_pairs(spark, SF))
    met = plan_of(rigid.pair_matches(f, pairs, 50))
    assert "SortMergeJoin [ref" in met and not [line for line in met.splitlines() if "BroadcastHashJoin" in line and "table_id" in line]


def test_a_visit_step_costs_no_data_frame(spark):
    """A hundred thousand short steps in one task; a data frame each took a minute and more."""
    steps = spark.range(100_000).selectExpr("id DIV 50 AS seq", "CAST(id % 50 AS INT) AS step", "CAST(id % 50 AS INT) AS n", "CASE WHEN id % 50 > 3 THEN CAST(id % 50 - 3 AS INT) END AS idx", "CASE WHEN id % 50 > 3 THEN 0.5D END AS score")
    began = time.time()
    assert beliefs.visit_beliefs(steps.coalesce(1)).count() == 2000 * 46
    assert time.time() - began < 60


#: Queries in which an image, its cells or its samples were broadcast.
UNFOLDED = [
    "a12_fusion",
    "a13_colour_fusion",
    "a14_carving",
    "a15_chunk_statistics",
    "a17_frame_extent",
    "a20_mean_normal",
    "f3_keypoint_depth",
    "d1_dirty_chunks",
    "g16_deformation",
    "j10_chunks_seen",
    "d4_create_missing",
    "d5_collect_garbage",
    "g12_mesh_colour",
    "g13_cell_lookup",
    "g10_full_fusion",
    "g9_refusion",
    "g13_distance_lookup",
]


@pytest.mark.parametrize("name", UNFOLDED)
def test_pixels_and_cells_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan_of(QUERIES[name](spark, SF))


def test_a_frame_s_pixels_lie_in_one_task_of_many(spark):
    px = fx.dense(spark, "/root/testdata/sf0.1")
    tasks = px.select("frame_id", F.spark_partition_id().alias("task")).distinct().groupBy("frame_id").count()
    assert px.rdd.getNumPartitions() == 16 and tasks.filter("count > 1").count() == 0


def test_cells_of_grids_side_by_side_are_not_broadcast(spark):
    joins = [line for line in plan_of(QUERIES["g15_resampled_grid"](spark, SF)).splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("BuildRight" in line for line in joins)  # the motions are


@pytest.fixture(scope="module")
def small_surface(spark):
    cells = spark.range(1000).selectExpr("CAST(id % 10 AS INT) AS gx", "CAST(id DIV 10 % 10 AS INT) AS gy", "CAST(id DIV 100 AS INT) AS gz")
    return kept(cells.withColumns({"sdf": (4.5 - F.col("gz")) * 0.05, "weight": F.lit(9.0), "r": F.lit(1.0), "g": F.lit(2.0), "b": F.lit(3.0)}))


def test_meshes_merge_cells_with_gradients(spark, small_surface):
    mesh = meshing.extract_triangles(small_surface, voxels.gradients(small_surface, 0.05), 0.05, 1.0)
    assert not [line for line in plan_of(mesh).splitlines() if "BroadcastHashJoin [gx" in line] and mesh.count() > 0


def test_refined_depths_are_merged_step_by_step(spark, small_surface):
    rays = kept(spark.range(9).selectExpr("id", "0.22D AS depth", "0.1D + id * 0.03D AS ox", "0.25D AS oy", "0D AS oz", "0D AS rx", "0D AS ry", "1D AS rz"))
    got = voxels.refine_depth(rays, small_surface, ["id"], 0.05)
    assert "BroadcastHashJoin" not in plan_of(got) and [round(r.depth, 6) for r in got.collect()] == [0.25] * 9


def test_stencils_move_no_pixel_that_lies_by_frame(spark):
    px = fx.dense(spark, SF)
    points = images.unproject_pixels(px, CAM)
    for df in (images.pixel_normals(points), images.remove_edges(px, "depth_mm", 7), images.quads(px, "depth_mm")):
        plan = plan_of(df)
        assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and plan.count("Generate") == 2


def test_edges_see_across_absent_pixels(spark):
    px = spark.createDataFrame([(0, 5, 5, 10), (0, 6, 6, 10), (0, 7, 7, 30), (0, 5, 9, 10), (1, 6, 5, 99)], "frame_id int, u int, v int, d int")
    got = {(r.frame_id, r.u, r.v) for r in images.remove_edges(px, "d", 7).collect()}
    assert got == {(0, 5, 5), (0, 5, 9), (1, 6, 5)}


def test_pairs_are_shuffled_once_and_far_ones_not_grouped(spark):
    pairs = kept(spark.range(1000).selectExpr("id % 9 AS q_image", "id % 5 AS q_feature", "id AS image_id", "CAST(id % 90 AS INT) AS distance"))
    assert plan_of(similarity.image_scores(pairs, 100)).count("Exchange") == 1
    q = similarity_plan._queries_50(spark, SF)
    t = fx.descriptors(spark, SF).select(F.col("vec_id").alias("t_id"), "words")
    assert "HashAggregate(keys=[q_id" in plan_of(similarity.nearest_brute_force(q, t, 110)) and plan_of(similarity.nearest_brute_force(q, t, 110)).count("SortAggregate") == 2


def test_excluding_recent_and_salience_score_once(spark):
    for name in ("j6_exclude_recent", "w1_salience"):
        assert plan_of(QUERIES[name](spark, SF)).count("REPARTITION_BY_COL") == 1
    plan = plan_of(QUERIES["j6_exclude_recent"](spark, SF))
    assert plan.count("HashJoin") + plan.count("MergeJoin") == 1  # the candidates' only


def test_equal_means_go_to_the_first(spark):
    costs = [0.3, 0.2, 0.1, 0.0, 0.0, 0.1, 0.2, 0.3]  # 0.6 and 0.6000000000000001
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate(costs)], "seq int, idx int, cost double")
    assert sorted(r.idx for r in registration.moving_average_pick(df, 3).collect()) == [0, 1, 2]


def test_equally_salient_entries_go_by_index(spark):
    df = spark.createDataFrame([(0, 7, 2.0), (0, 3, 2.0 - 4e-16), (0, 9, 1.9)], "q_image int, idx int, salient double")
    assert [(r.idx, r.rank) for r in similarity.top_candidates(df).orderBy("rank").collect()] == [(3, 1), (7, 2), (9, 3)]


def test_a_ray_that_touches_an_edge_hits(spark):
    hit = geometry.ray_hits_box(geometry.Vec(*[F.lit(0.0)] * 3), geometry.Vec(F.lit(4403.5), F.lit(1.0), F.lit(1887.2142857142858)), geometry.Vec(F.lit(-500.0), F.lit(-500.0), F.lit(300.0)), geometry.Vec(*[F.lit(700.0)] * 3))
    assert spark.range(1).select(hit).first()[0]
