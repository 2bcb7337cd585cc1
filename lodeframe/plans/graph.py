"""Graph jobs over edges between frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import graph as op
from lodeframe.operators.registration import pair_moments
from lodeframe.plans import fixtures as fx
from lodeframe.plans.registry import query

EDGES = """edges AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 5 WHERE a.s_suppkey % 25 < 20)"""


@query("g8_map_components", "WITH RECURSIVE " + EDGES + """, both_ AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
r AS (SELECT s_suppkey AS id, s_suppkey AS seen FROM supplier UNION SELECT r.id, e.b FROM r JOIN both_ e ON e.a = r.seen)
SELECT id, min(seen) AS origin FROM r GROUP BY id""")
def g8(spark, d):
    """Chains of every fifth frame, 25 frames a map."""
    n = fx.frame_ids(spark, d).select(F.col("frame_id").alias("id"))
    edges = n.filter("id % 25 < 20").select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"))
    return op.map_components(n, edges.join(n.withColumnRenamed("id", "b"), "b", "left_semi"))


def pose_graph(spark, d):
    """(poses, true poses, moments): maps of 25 frames, edges to the next frame and to the fifth after it; poses drift with the place in the map."""
    turn = lambda half: F.array(*[c.cast("double") for c in (1 - 2 * F.sin(half) * F.sin(half), -F.sin(2 * half), F.lit(0), F.sin(2 * half), 1 - 2 * F.sin(half) * F.sin(half), F.lit(0), F.lit(0), F.lit(0), F.lit(1))])
    frames = fx.poses(spark, d).select(F.col("frame_id").cast("int").alias("frame_id"), F.expr("CAST(frame_id DIV 25 AS INT)").alias("map"), "tx", "ty", "tz")
    place = F.col("frame_id") % 25
    true = frames.select("frame_id", "map", turn(0.01 * F.col("frame_id")).alias("r"), F.array("tx", "ty", "tz").alias("t"))
    off = lambda k: 0.004 * place * (1 + (F.col("frame_id") * k) % 3)
    drift = frames.select("frame_id", "map", turn(0.01 * F.col("frame_id") + 0.001 * place).alias("r"), F.array(F.col("tx") + off(1), F.col("ty") - off(2), F.col("tz") + off(5)).alias("t"))
    ids = frames.select(F.col("frame_id").alias("ref"), "map")
    edges = ids.withColumn("new", F.explode(F.array(F.col("ref") + 1, F.col("ref") + 5))).join(ids.select(F.col("ref").alias("new"), F.col("map").alias("__m")), "new").filter("map = __m")
    points = edges.select("ref", "new", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    h = lambda n, m: (F.col("ref") * 31 + F.col("k") * n) % m
    points = points.join(true.select(F.col("frame_id").alias("ref"), F.col("r").alias("ra"), F.col("t").alias("ta")), "ref").join(true.select(F.col("frame_id").alias("new"), F.col("r").alias("rb"), F.col("t").alias("tb")), "new")
    world = [F.get("ta", F.lit(0)) + h(17, 23) / 10.0 - 1, F.get("ta", F.lit(1)) + h(29, 19) / 10.0 - 1, F.get("ta", F.lit(2)) + 1 + h(41, 29) / 10.0]
    back = lambda r, t: [sum((F.get(r, F.lit(3 * k + i)) * (world[k] - F.get(t, F.lit(k))) for k in (1, 2)), F.get(r, F.lit(i)) * (world[0] - F.get(t, F.lit(0)))) for i in range(3)]
    points = points.select("ref", "new", *[c.alias("p" + n) for c, n in zip(back("ra", "ta"), "xyz", strict=True)], *[c.alias("q" + n) for c, n in zip(back("rb", "tb"), "xyz", strict=True)])
    return drift, true, pair_moments(points, F.lit(1.0))


@query("g7_pose_graph")
def g7(spark, d):
    """Iterative: tested against the known poses, a dense solution and a spoilt newest edge."""
    from lodeframe.operators.posegraph import optimise

    drift, _, edges = pose_graph(spark, d)
    poses, _, maps = optimise(drift, edges)
    at = lambda c, i, n: F.round(F.get(c, F.lit(i)), 6).alias(n)
    return poses.join(maps, "map").select("frame_id", "map", at("r", 1, "r01"), *[at("t", i, n) for i, n in enumerate(("tx", "ty", "tz"))], F.round("total_before", 6).alias("before"), F.round("total_after", 6).alias("after"), "rolled_back")
