"""Golden cases and invariants of the spatial and similarity operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import geometry as g
from lodeframe.functions.hashing import hamming, neighbour_keys, substring_keys
from lodeframe.operators import similarity as sim
from lodeframe.operators import voxels as vox


def test_hamming_of_0_1_64_256_bits(spark):
    rows = [([0, 0, 0, 0], 0), ([1, 0, 0, 0], 1), ([-1, 0, 0, 0], 64), ([-1, -1, -1, -1], 256)]
    df = spark.createDataFrame(rows, "w array<bigint>, want int")
    zero = F.array(*[F.lit(0).cast("bigint")] * 4)
    assert df.filter(hamming(F.col("w"), zero) != F.col("want")).count() == 0


def test_keys_of_12_bits_cross_words(spark):
    df = spark.createDataFrame([([-(1 << 60), 0xFF, 0, 0],)], "w array<bigint>")
    keys = df.select(F.explode(substring_keys(F.col("w"), 7, 12)).alias("k")).select("k.*").collect()
    assert [r.key for r in keys] == [0, 0, 0, 0, 0, 0xFFF, 0]


def test_neighbour_keys_are_distinct(spark):
    keys = spark.range(1).select(neighbour_keys(F.lit(5).cast("bigint"), 8, 2).alias("k")).first().k
    assert len(keys) == len(set(keys)) == 1 + 8 + 28


@pytest.mark.parametrize(("scores", "want"), [
    ([2, 2, 2, 2, 2], 3.0), ([0, 0, 0, 0, 5], 1.0), ([1, 0, 9, 9, 9], 1.0), ([1, 2, 1, 2, 30, 1], None),
])
def test_salience(spark, scores, want):
    rows = [(0, i, float(s)) for i, s in enumerate(scores) if s]
    df = spark.createDataFrame(rows, "q_image long, idx long, score double")
    n = spark.createDataFrame([(0, len(scores))], "q_image long, n long")
    got = {r.idx: r.salient for r in sim.salience(df, n).collect()}
    if want is not None:
        assert set(got.values()) == {want}
    else:  # the last index below the mean is 5: the prefix is 1 2 1 2 30
        assert got[4] == pytest.approx((30 - 12.755391) / 7.2, rel=1e-5)


def test_pose_inverse_round_trip(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.9273618, 1.0, 2.0, 3.0)], "qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    same = g.compose(g.invert(g.pose_of()), g.pose_of())
    r = df.select(same.q.w.alias("w"), g.norm(same.t).alias("t")).first()
    assert r.w == pytest.approx(1, abs=1e-6) and r.t == pytest.approx(0, abs=1e-6)


def test_chunk_of_negative_zero_and_width(spark):
    df = spark.createDataFrame([(-0.001,), (0.0,), (0.4,)], "x double")
    assert [r[0] for r in df.select(g.cell(F.col("x"), 0.4)).collect()] == [-1, 0, 1]


def _obs(spark, *rows):
    return spark.createDataFrame([(0, 0, 0, wd, w, 10, 20, 30, 1) for wd, w in rows], "gx int, gy int, gz int, sum_wd double, sum_w double, sum_r long, sum_g long, sum_b long, n_c long")


def test_retraction_leaves_the_other_observation(spark):
    a, b = _obs(spark, (0.5, 2.0)), _obs(spark, (-0.25, 1.0))
    left = vox.fuse(vox.fuse(a, b), vox.negative(a)).first()
    assert (left.sum_wd, left.sum_w, left.n_c) == (-0.25, 1.0, 1)
    assert vox.fuse(vox.fuse(a, b), vox.negative(a), vox.negative(b)).count() == 0


@pytest.mark.parametrize(("signs", "mask"), [([1] * 8, 0), ([-1] * 8, 255), ([-1] + [1] * 7, 1)])
def test_cube_masks(spark, signs, mask):
    rows = [(k & 1, k >> 1 & 1, k >> 2, float(s)) for k, s in enumerate(signs)]
    df = spark.createDataFrame(rows, "gx int, gy int, gz int, sdf double")
    got = vox.corner_cells(df).select(vox.cube_mask(F.col("sdf")).alias("m")).collect()
    assert [r.m for r in got] == [mask]


def test_carving_halves_and_drops(spark):
    v = _obs(spark, (-4.0, 4.0))
    assert vox.carve(v, v).first().sum_w == 2.0
    assert vox.carve(_obs(spark, (-1.0, 1.0)), v).count() == 0
