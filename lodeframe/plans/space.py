"""Projections, predicates and scalar functions of space."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeframe.functions import color
from lodeframe.functions import geometry as g
from lodeframe.functions.hashing import cell_hash
from lodeframe.operators import images
from lodeframe.plans import fixtures as fx
from lodeframe.plans.fixtures import duck
from lodeframe.plans.registry import query

CAM = g.Camera(fx.WIDTH, fx.HEIGHT, fx.FX, fx.FY, fx.CX, fx.CY, fx.SCALE, fx.FAR)
#: A depth pixel's camera-space point, in SQL.
PTS = """pts AS MATERIALIZED (SELECT (frame_id * 100 + u) * 100 + v AS pk, frame_id, u, v, depth_mm, r, g, b, (u - 31.5) / 60.0::DOUBLE * (depth_mm / 1000.0::DOUBLE) AS x, (v - 23.5) / 60.0::DOUBLE * (depth_mm / 1000.0::DOUBLE) AS y,
  depth_mm / 1000.0::DOUBLE AS z FROM fx_dense WHERE depth_mm IS NOT NULL)"""
#: The same points in the world (yaw by q = (0, 0, qz, qw)).
WORLD = """world AS (SELECT p.*, (1 - 2 * qz * qz) * x - 2 * qz * qw * y + tx AS wx, 2 * qz * qw * x + (1 - 2 * qz * qz) * y + ty AS wy, z + tz AS wz
  FROM pts p JOIN fx_pose USING (frame_id))"""


def r6(**cols):
    return [F.round(c, 6).alias(k) if hasattr(c, "alias") else c for k, c in cols.items()]


def points(spark, d):
    """Camera-space points of the valid pixels."""
    return images.unproject_pixels(fx.dense(spark, d), CAM)


def world(spark, d):
    return images.to_world(points(spark, d), fx.poses(spark, d))


@query("p1_unproject", duck("fx_dense") + ",\n" + PTS + "\nSELECT frame_id, u, v, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts")
def p1(spark, d):
    return points(spark, d).select("frame_id", "u", "v", *r6(x=F.col("x"), y=F.col("y"), z=F.col("z")))


@query("p2_project", duck("fx_dense") + ",\n" + PTS + """
SELECT frame_id, u, v, round(60.0 * (x + 0.1) / (z + 0.2) + 31.5, 6) AS pu, round(60.0 * (y - 0.1) / (z + 0.2) + 23.5, 6) AS pv FROM pts""")
def p2(spark, d):
    p = g.project(g.Vec(F.col("x") + 0.1, F.col("y") - 0.1, F.col("z") + 0.2), CAM)
    return points(spark, d).select("frame_id", "u", "v", *r6(pu=p.x, pv=p.y))


@query("p3_apply_pose", duck("fx_dense", "fx_pose") + ",\n" + PTS + ",\n" + WORLD + "\nSELECT frame_id, u, v, round(wx, 6) AS x, round(wy, 6) AS y, round(wz, 6) AS z FROM world")
def p3(spark, d):
    return world(spark, d).select("frame_id", "u", "v", *r6(x=F.col("wx"), y=F.col("wy"), z=F.col("wz")))


@query("p4_relative_pose", duck("fx_pose") + """
SELECT a.frame_id, round(a.qw * b.qz - a.qz * b.qw, 6) + 0.0 AS qz, round(a.qw * b.qw + a.qz * b.qz, 6) AS qw,
  round((1 - 2 * a.qz * a.qz) * (b.tx - a.tx) + 2 * a.qz * a.qw * (b.ty - a.ty), 6) + 0.0 AS tx,
  round(-2 * a.qz * a.qw * (b.tx - a.tx) + (1 - 2 * a.qz * a.qz) * (b.ty - a.ty), 6) + 0.0 AS ty, round(b.tz - a.tz, 6) AS tz
FROM fx_pose a JOIN fx_pose b ON b.frame_id = a.frame_id + 1""")
def p4(spark, d):
    a = fx.poses(spark, d)
    b = a.select((F.col("frame_id") - 1).alias("frame_id"), *[F.col(c).alias("b_" + c) for c in ("qx", "qy", "qz", "qw", "tx", "ty", "tz")])
    rel = g.compose(g.invert(g.pose_of()), g.pose_of("b_"))
    z = lambda c: F.round(c, 6) + 0.0
    return a.join(b, "frame_id").select("frame_id", z(rel.q.z).alias("qz"), z(rel.q.w).alias("qw"), z(rel.t.x).alias("tx"), z(rel.t.y).alias("ty"), z(rel.t.z).alias("tz"))


@query("p5_exp_update", duck("fx_pose") + """, a AS (SELECT *, -0.001 * frame_id AS s, 0.001 * frame_id * sqrt(11.0) AS th FROM fx_pose),
b AS (SELECT *, CASE WHEN th = 0 THEN 0.5 ELSE (1 - cos(th)) / (th * th) END AS ca, CASE WHEN th = 0 THEN 0 ELSE (th - sin(th)) / (th * th * th) END AS cb, CASE WHEN th = 0 THEN 0.5 ELSE sin(th / 2) / th END AS h, s * s AS ss FROM a),
t AS (SELECT *, s * h AS ex, -s * h AS ey, 3 * s * h AS ez, cos(th / 2) AS ew,
  s + ca * -5 * ss + cb * ss * s * -15 AS dx, 2 * s + ca * 4 * ss + cb * ss * s * -18 AS dy, -s + ca * 3 * ss + cb * ss * s * -1 AS dz FROM b)
SELECT frame_id, round(ex * qw + ey * qz, 6) AS qx, round(ey * qw - ex * qz, 6) AS qy, round(ez * qw + ew * qz, 6) AS qz, round(ew * qw - ez * qz, 6) AS qw,
  round((1 - 2 * (ey * ey + ez * ez)) * tx + 2 * (ex * ez + ew * ey) * tz + dx, 6) AS tx, round(2 * (ex * ey + ew * ez) * tx + 2 * (ey * ez - ew * ex) * tz + dy, 6) AS ty, round(2 * (ex * ez - ew * ey) * tx + (1 - 2 * (ex * ex + ey * ey)) * tz + dz, 6) AS tz FROM t""")
def p5(spark, d):
    """Moves every pose by a small step; applying the inverse step gives the pose back (tests)."""
    step = F.col("frame_id") * 0.001
    new = g.exp_update(g.pose_of(), g.Vec(step, step * 2, -step), g.Vec(step, -step, step * 3))
    return fx.poses(spark, d).select("frame_id", *r6(qx=new.q.x, qy=new.q.y, qz=new.q.z, qw=new.q.w, tx=new.t.x, ty=new.t.y, tz=new.t.z))


@query("p6_pose_cost", duck("fx_pose") + """, t AS (SELECT a.frame_id, 2 * atan2(a.qw * b.qz - a.qz * b.qw, a.qw * b.qw + a.qz * b.qz) AS yaw,
  pow(b.tx_prev - a.tx, 2) + pow(b.tz - a.tz, 2) AS tt FROM fx_pose a JOIN fx_pose b ON b.frame_id = a.frame_id + 1)
SELECT frame_id, round(9 * pow(least(abs(yaw - pi()), abs(yaw + pi()), abs(yaw)), 2) + tt, 6) AS cost FROM t""")
def p6(spark, d):
    a = fx.poses(spark, d)
    b = a.withColumn("tx", F.col("tx_prev")).select((F.col("frame_id") - 1).alias("frame_id"), *[F.col(c).alias("b_" + c) for c in ("qx", "qy", "qz", "qw", "tx", "ty", "tz")])
    return a.join(b, "frame_id").select("frame_id", *r6(cost=g.pose_cost(g.pose_of(), g.pose_of("b_"))))


@query("p7_truncation", duck("fx_dense") + ",\n" + PTS + "\nSELECT frame_id, u, v, round(abs(0.0019 * z * z + 0.00152 * z + 0.001504) * 8.0, 9) AS trunc FROM pts")
def p7(spark, d):
    return points(spark, d).select("frame_id", "u", "v", F.round(g.quadratic_truncation(F.col("z")), 9).alias("trunc"))


@query("p8_weight", duck("fx_dense") + ",\n" + PTS + "\nSELECT frame_id, u, v, round(1.0 / (2 * abs(0.0019 * z * z + 0.00152 * z + 0.001504) * 8.0), 6) AS w FROM pts")
def p8(spark, d):
    return points(spark, d).select("frame_id", "u", "v", *r6(w=g.observation_weight(g.quadratic_truncation(F.col("z")))))


_MM = """mm AS (SELECT o_orderkey AS id, CAST(o_orderkey * 37 % 4001 - 2000 AS INT) AS x, CAST(o_orderkey * 53 % 4001 - 2000 AS INT) AS y, CAST(o_custkey * 31 % 4001 - 2000 AS INT) AS z FROM orders)"""


def _mm(spark, d):
    """Integer-millimetre points on both sides of 0."""
    return fx.table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "CAST(o_orderkey * 37 % 4001 - 2000 AS INT) AS x", "CAST(o_orderkey * 53 % 4001 - 2000 AS INT) AS y", "CAST(o_custkey * 31 % 4001 - 2000 AS INT) AS z"
    )


@query("p9_chunk_id", "WITH " + _MM + """
SELECT id, CAST(floor(x / 400.0) AS INT) AS cx, CAST(floor(y / 400.0) AS INT) AS cy, CAST(floor(z / 400.0) AS INT) AS cz FROM mm""")
def p9(spark, d):
    return _mm(spark, d).select("id", *g.chunk_of(g.vec("x", "y", "z"), 50.0, 8))


_VOX = """vox AS (SELECT id, CAST(floor(x / 50.0) AS INT) AS gx, CAST(floor(y / 50.0) AS INT) AS gy, CAST(floor(z / 50.0) AS INT) AS gz FROM mm)"""


@query("p10_voxel_ids", "WITH " + _MM + ",\n" + _VOX + """
SELECT id, gx, gy, gz, CAST((((gz % 8 + 8) % 8) * 8 + (gy % 8 + 8) % 8) * 8 + (gx % 8 + 8) % 8 AS INT) AS vid FROM vox""")
def p10(spark, d):
    v = _mm(spark, d).select("id", *[g.cell(F.col(c), 50.0).alias("g" + c) for c in "xyz"])
    return v.withColumn("vid", g.voxel_of(g.vec("gx", "gy", "gz"), 8).cast("int"))


@query("p11_centroids", """
SELECT frame_id AS cx, vid, round((frame_id * 8 + vid % 8 + 0.5) * 0.05, 6) AS x, round((-region_id * 8 + (vid // 8) % 8 + 0.5) * 0.05, 6) AS y, round((vid // 64 + 0.5) * 0.05, 6) AS z
FROM (SELECT s_suppkey AS frame_id, s_nationkey % 5 AS region_id FROM supplier) CROSS JOIN (SELECT unnest(range(0, 512)) AS vid)""")
def p11(spark, d):
    n = fx.frame_ids(spark, d).withColumn("vid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(511).cast("bigint"))))
    c = g.centroid(F.col("frame_id"), -F.col("region_id"), F.lit(0), F.col("vid"), fx.VOXEL, fx.CHUNK)
    return n.select(F.col("frame_id").alias("cx"), "vid", *r6(x=c.x, y=c.y, z=c.z))


@query("p12_box_corners", """
SELECT frame_id AS cx, k, round((frame_id + (k & 1)) * 0.4, 6) AS x, round((region_id + ((k >> 1) & 1)) * 0.4, 6) AS y, round((k >> 2) * 0.4, 6) AS z
FROM (SELECT s_suppkey AS frame_id, s_nationkey % 5 AS region_id FROM supplier) CROSS JOIN (SELECT unnest(range(0, 8))::INT AS k)""")
def p12(spark, d):
    lo = g.Vec(F.col("frame_id") * 0.4, F.col("region_id") * 0.4, F.lit(0.0))
    hi = g.Vec((F.col("frame_id") + 1) * 0.4, (F.col("region_id") + 1) * 0.4, F.lit(0.4))
    n = fx.frame_ids(spark, d).select(F.col("frame_id").alias("cx"), F.posexplode(g.corners(lo, hi)).alias("k", "p"))
    return n.select("cx", "k", *r6(x=F.col("p.x"), y=F.col("p.y"), z=F.col("p.z")))


@query("p13_cell_hash", "WITH " + _MM + ",\n" + _VOX + "\nSELECT id, xor(xor(gx::BIGINT * 73856093, gy::BIGINT * 19349663), gz::BIGINT * 83492791) AS h FROM vox")
def p13(spark, d):
    v = _mm(spark, d).select("id", *[g.cell(F.col(c), 50.0).alias("g" + c) for c in "xyz"])
    return v.select("id", cell_hash(F.col("gx"), F.col("gy"), F.col("gz")).alias("h"))


@query("p14_fixed_point", """
SELECT c_custkey AS id, CAST(floor(greatest(-1000.0, least(1000.0, c_acctbal)) * (32767.0 / 1000.0) + 0.5) AS INT) AS s, CAST(floor(greatest(0.0, least(1000.0, c_acctbal)) * 65.535 + 0.5) AS INT) AS u,
  round(floor(greatest(-1000.0, least(1000.0, c_acctbal)) * (32767.0 / 1000.0) + 0.5) * (1000.0 / 32767.0), 6) AS back FROM customer""")
def p14(spark, d):
    x = F.col("c_acctbal")
    return fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), g.fixed_encode(x).alias("s"), g.fixed_encode(x, signed=False).alias("u"), *r6(back=g.fixed_decode(g.fixed_encode(x)))
    )


@query("p15_bilinear_depth", duck("fx_dense") + """, h AS (SELECT *, lead(depth_mm) OVER (PARTITION BY frame_id, v ORDER BY u) AS right_mm FROM fx_dense),
q AS (SELECT *, lead(depth_mm) OVER w AS below_mm, lead(right_mm) OVER w AS corner_mm FROM h WINDOW w AS (PARTITION BY frame_id, u ORDER BY v))
SELECT frame_id, u, v, round((depth_mm * 0.75 + right_mm * 0.25) * 0.5 + (below_mm * 0.75 + corner_mm * 0.25) * 0.5, 6) AS depth
FROM q WHERE depth_mm + right_mm + below_mm + corner_mm IS NOT NULL""")
def p15(spark, d):
    q = images.quads(fx.dense(spark, d), "depth_mm")
    value = g.bilinear(F.col("d00"), F.col("d10"), F.col("d01"), F.col("d11"), F.lit(0.25), F.lit(0.5))
    return q.select("frame_id", "u", "v", *r6(depth=value))


_NORMALS = """nb AS (SELECT *, lag(u) OVER h AS u0, lag(x) OVER h AS ax, lag(y) OVER h AS ay, lag(z) OVER h AS az, lead(u) OVER h AS u1, lead(x) OVER h AS bx, lead(y) OVER h AS by_, lead(z) OVER h AS bz,
  lag(v) OVER k AS v0, lag(x) OVER k AS cx, lag(y) OVER k AS cy, lag(z) OVER k AS cz, lead(v) OVER k AS v1, lead(x) OVER k AS ex, lead(y) OVER k AS ey, lead(z) OVER k AS ez
  FROM pts WINDOW h AS (PARTITION BY frame_id, v ORDER BY u), k AS (PARTITION BY frame_id, u ORDER BY v)),
nrm AS (SELECT frame_id, u, v, x, y, z, (by_ - ay) * (ez - cz) - (bz - az) * (ey - cy) AS nx, (bz - az) * (ex - cx) - (bx - ax) * (ez - cz) AS ny, (bx - ax) * (ey - cy) - (by_ - ay) * (ex - cx) AS nz
  FROM nb WHERE u0 = u - 1 AND u1 = u + 1 AND v0 = v - 1 AND v1 = v + 1
  AND sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2) + pow(bz - az, 2)) < 0.3 AND sqrt(pow(ex - cx, 2) + pow(ey - cy, 2) + pow(ez - cz, 2)) < 0.3),
nn AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM nrm WHERE nx * nx + ny * ny + nz * nz > 1e-18)"""


@query("w4_pixel_normals", duck("fx_dense") + ",\n" + PTS + ",\n" + _NORMALS + "\nSELECT frame_id, u, v, round(nx / len, 6) + 0.0 AS nx, round(ny / len, 6) + 0.0 AS ny, round(nz / len, 6) + 0.0 AS nz FROM nn")
def w4(spark, d):
    return images.pixel_normals(points(spark, d)).select("frame_id", "u", "v", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


_COS = "abs((x * nx + y * ny + z * nz) / (sqrt(x * x + y * y + z * z) * len))"


@query("p21_view_cosine", duck("fx_dense") + ",\n" + PTS + ",\n" + _NORMALS + f"\nSELECT frame_id, u, v, round({_COS}, 6) AS cosine FROM nn")
def p21(spark, d):
    n = images.pixel_normals(points(spark, d))
    return n.select("frame_id", "u", "v", *r6(cosine=g.view_cosine(g.vec("x", "y", "z"), g.vec("nx", "ny", "nz"))))


@query("f4_grazing_angles", duck("fx_dense") + ",\n" + PTS + ",\n" + _NORMALS + f"\nSELECT frame_id, u, v, CASE WHEN {_COS} < 0.97 THEN 0.0 ELSE round(z, 6) END AS depth FROM nn")
def f4(spark, d):
    n = images.reject_grazing(images.pixel_normals(points(spark, d)), 0.97)
    return n.select("frame_id", "u", "v", *r6(depth=F.col("z")))


@query("f5_colour_trust", duck("fx_dense") + ",\n" + PTS + ",\n" + _NORMALS + f"\nSELECT frame_id, u, v, CAST({_COS} >= 0.97 AS INT) AS color_ok FROM nn")
def f5(spark, d):
    n = images.pixel_normals(points(spark, d))
    return n.select("frame_id", "u", "v", (g.view_cosine(g.vec("x", "y", "z"), g.vec("nx", "ny", "nz")) >= 0.97).cast("int").alias("color_ok"))


@query("p22_huber", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(1.0, 5.0 / l_quantity), 9) AS w FROM lineitem")
def p22(spark, d):
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(g.huber(F.col("l_quantity"), 5.0), 9).alias("w"))


@query("p23_skew_and_jacobian", "WITH " + _MM + """
SELECT id, 0 - z + 2 * y AS skew_sum, CAST(x * y - (x * z + y * x + z * y) AS DOUBLE) AS product_11, y - x AS jac_sum FROM (SELECT id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z FROM mm)""")
def p23(spark, d):
    v = _mm(spark, d).select("id", *[F.col(c).cast("bigint").alias(c) for c in "xyz"])
    p = g.vec("x", "y", "z")
    s, m, j = g.skew(p), g.skew_product(p, g.vec("z", "x", "y")), g.point_jacobian(p)
    return v.select("id", (F.get(s, F.lit(1)) + 2 * F.get(s, F.lit(2))).cast("bigint").alias("skew_sum"), (F.get(m, F.lit(4))).cast("double").alias("product_11"),
                    (F.get(j, F.lit(15)) + F.get(j, F.lit(16))).cast("bigint").alias("jac_sum"))


@query("p24_pack_rgb", duck("fx_dense") + "\nSELECT frame_id, u, v, CAST((r << 16) + (g << 8) + b AS INT) AS rgb, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM fx_dense")
def p24(spark, d):
    packed = fx.dense(spark, d).select("frame_id", "u", "v", color.pack(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))
    return packed.select("*", *[c.alias(n) for c, n in zip(color.unpack(F.col("rgb")), "rgb", strict=True)])


@query("p25_heat_colours", """
WITH t AS (SELECT p_partkey, (p_size - 1) / 49.0::DOUBLE AS t FROM part)
SELECT p_partkey, round(CASE WHEN t >= 0.5 AND t < 0.75 THEN 4 * (t - 0.5) ELSE 0.0 END, 6) AS r,
  round(CASE WHEN t < 0.25 THEN 4 * t WHEN t >= 0.75 THEN 1 + 4 * (0.75 - t) ELSE 0.0 END, 6) AS g, round(CASE WHEN t >= 0.25 AND t < 0.5 THEN 1 + 4 * (0.25 - t) ELSE 0.0 END, 6) AS b FROM t""")
def p25(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", *[F.round(c, 6).alias(n) for c, n in zip(color.heat(F.col("p_size"), 1.0, 50.0), "rgb", strict=True)])


@query("p26_channels", duck("fx_dense") + """
SELECT frame_id, u, v, CASE WHEN u % 4 >= 2 THEN r ELSE b END AS pr, CASE WHEN u % 4 >= 2 THEN g ELSE b END AS pg, b AS pb, CASE u % 4 WHEN 3 THEN 7 WHEN 1 THEN g ELSE 255 END AS pa FROM fx_dense""")
def p26(spark, d):
    px = fx.dense(spark, d).withColumn("pixel", F.array("b", "g", "r", F.lit(7))).withColumn("n", F.col("u") % 4 + 1)
    return px.select("frame_id", "u", "v", *[c.alias(n) for c, n in zip(color.channels(F.col("pixel"), F.col("n")), ("pr", "pg", "pb", "pa"), strict=True)])


@query("p28_edge_crossing", "WITH " + _MM + "\nSELECT id, round(x + (x / (x - y + 0.0::DOUBLE)) * (z - x), 6) AS p FROM mm WHERE (x < 0) <> (y < 0)")
def p28(spark, d):
    m = _mm(spark, d).filter("(x < 0) <> (y < 0)")
    return m.select("id", F.round(F.col("x") + F.col("x") / (F.col("x") - F.col("y")) * (F.col("z") - F.col("x")), 6).alias("p"))


@query("p30_metric_depth", duck("fx_dense") + "\nSELECT frame_id, u, v, CASE WHEN depth_mm / 1000.0 >= 0.3 AND depth_mm / 1000.0 <= 1.3 THEN round(depth_mm / 1000.0, 6) END AS z, CASE WHEN depth_mm / 1000.0 >= 0.3 AND depth_mm / 1000.0 <= 1.3 THEN round((depth_mm / 1000.0 - 0.3) / 1.0, 6) END AS n FROM fx_dense")
def p30(spark, d):
    z = images.metric_depth(F.col("depth_mm"), 1000.0, 0.3, 1.3)
    return fx.dense(spark, d).select("frame_id", "u", "v", *r6(z=z, n=(z - 0.3) / (1.3 - 0.3)))


@query("f1_depth_gate", duck("fx_dense") + "\nSELECT frame_id, u, v, CASE WHEN depth_mm / 1000.0 <= 1.2 THEN round(depth_mm / 1000.0, 6) END AS z FROM fx_dense")
def f1(spark, d):
    return fx.dense(spark, d).select("frame_id", "u", "v", *r6(z=images.metric_depth(F.col("depth_mm"), 1000.0, 0.0, 1.2)))


@query("f2_in_image", duck("fx_dense") + ",\n" + PTS + """, q AS (SELECT frame_id, u, v, 60.0 * (x + 0.4) / z + 31.5 AS pu, 60.0 * y / z + 23.5 AS pv FROM pts)
SELECT frame_id, u, v, CAST(pu >= 1 AND pu < 63 AND pv >= 1 AND pv < 47 AS INT) AS inside FROM q""")
def f2(spark, d):
    p = g.project(g.Vec(F.col("x") + 0.4, F.col("y"), F.col("z")), CAM)
    return points(spark, d).select("frame_id", "u", "v", images.in_image(p.x, p.y, CAM).cast("int").alias("inside"))


_KP = """kp AS (SELECT vec_id % 25 AS frame_id, vec_id AS kp_id, (vec_id * 13 % 640) / 10.0::DOUBLE AS x, (vec_id * 7 % 480) / 10.0::DOUBLE AS y FROM embeddings)"""


@query("f3_keypoint_depth", duck("fx_dense") + ",\n" + _KP + """
SELECT k.frame_id, k.kp_id, round((k.x - 31.5) / 60.0 * depth_mm / 1000.0, 6) AS px, round((k.y - 23.5) / 60.0 * depth_mm / 1000.0, 6) AS py, round(depth_mm / 1000.0, 6) AS pz
FROM kp k JOIN fx_dense d ON d.frame_id = k.frame_id AND d.u = CAST(floor(k.x) AS INT) AND d.v = CAST(floor(k.y) AS INT)
WHERE k.x >= 1 AND k.x < 63 AND k.y >= 1 AND k.y < 47 AND depth_mm > 0 AND depth_mm < 10000""")
def f3(spark, d):
    kp = fx.table(spark, d, "embeddings").selectExpr("CAST(vec_id % 25 AS INT) AS frame_id", "vec_id AS kp_id", "(vec_id * 13 % 640) / 10.0D AS x", "(vec_id * 7 % 480) / 10.0D AS y")
    return images.keypoint_depth(kp, fx.dense(spark, d), CAM).select("frame_id", "kp_id", *r6(px=F.col("px"), py=F.col("py"), pz=F.col("pz")))


@query("f6_boxes", "WITH " + _MM + """
SELECT id, CAST(x BETWEEN -500 AND 700 AND y BETWEEN -500 AND 700 AND z BETWEEN -500 AND 700 AS INT) AS inside,
  CAST(x - 100 <= 700 AND x + 100 >= -500 AND y - 100 <= 700 AND y + 100 >= -500 AND z - 100 <= 700 AND z + 100 >= -500 AS INT) AS overlaps,
  round((x - 100 + y + 300) / 2.0, 6) AS centre_x, round((y + 300 - (x - 100)) / 2.0, 6) AS half_x FROM mm""")
def f6(spark, d):
    p = g.vec("x", "y", "z")
    box = g.Box(g.Vec(F.lit(-500), F.lit(-500), F.lit(-500)), g.Vec(F.lit(700), F.lit(700), F.lit(700)))
    own = g.Box(g.add(p, g.Vec(F.lit(-100), F.lit(-100), F.lit(-100))), g.add(p, g.Vec(F.lit(100), F.lit(100), F.lit(100))))
    odd = g.Box(g.Vec(F.col("x") - 100, F.lit(0), F.lit(0)), g.Vec(F.col("y") + 300, F.lit(1), F.lit(1)))
    return _mm(spark, d).select("id", box.contains(p).cast("int").alias("inside"), box.intersects(own).cast("int").alias("overlaps"), *r6(centre_x=odd.centre().x, half_x=odd.half_extent().x))


@query("f7_plane_side", "WITH " + _MM + """, s AS (SELECT id, 0.6 * x + 0.8 * z - 100 AS dist, 0.6 * 100 + 0.8 * 100 AS reach FROM mm)
SELECT id, round(dist, 6) AS dist, CASE WHEN dist > 0 THEN 'inside' WHEN dist < 0 THEN 'outside' ELSE 'on' END AS side, CASE WHEN dist - reach > 0 THEN 'inside' WHEN dist + reach < 0 THEN 'outside' ELSE 'intersects' END AS box FROM s""")
def f7(spark, d):
    p = g.vec("x", "y", "z")
    dist = g.plane_distance(p, (0.6, 0.0, 0.8), -100.0)
    m = _mm(spark, d).withColumn("dist", F.round(dist, 6))
    box = g.corners(g.sub(p, g.Vec(*[F.lit(100)] * 3)), g.add(p, g.Vec(*[F.lit(100)] * 3)))
    far = F.transform(box, lambda c: F.round(g.plane_distance(g.Vec(c["x"], c["y"], c["z"]), (0.6, 0.0, 0.8), -100.0), 6))
    return m.select("id", "dist", F.when(F.col("dist") > 0, "inside").when(F.col("dist") < 0, "outside").otherwise("on").alias("side"),
                    F.when(F.array_min(far) > 0, "inside").when(F.array_max(far) < 0, "outside").otherwise("intersects").alias("box"))


@query("f8_frustum", duck("fx_dense") + ",\n" + PTS + """, m AS (SELECT frame_id, u, v, x * 1.5 + 0.0013 AS x, y * 1.5 + 0.0017 AS y, z FROM pts)
SELECT frame_id, u, v, CAST(z >= 0.5 AND z <= 1.3003 AND 60.0 * x >= -31.5 * z AND 60.0 * x <= 32.5 * z AND 60.0 * y >= -23.5 * z AND 60.0 * y <= 24.5 * z AS INT) AS inside FROM m""")
def f8(spark, d):
    """The points are moved a little, so that none lies on a plane."""
    x, y = F.col("x") * 1.5 + 0.0013, F.col("y") * 1.5 + 0.0017
    p = points(spark, d).select("frame_id", "u", "v", x.alias("x"), y.alias("y"), "z")
    return p.select("frame_id", "u", "v", g.in_frustum(g.vec("x", "y", "z"), CAM, 0.5, 1.3003).cast("int").alias("inside"))


@query("f9_ray_box", "WITH " + _MM + """, t AS (SELECT id, (-500 - 0) / (x + 0.5::DOUBLE) AS a0, 700 / (x + 0.5::DOUBLE) AS a1, -500 / (y + 0.5::DOUBLE) AS b0, 700 / (y + 0.5::DOUBLE) AS b1, (300 - 0) / (z + 0.5::DOUBLE) AS c0, 700 / (z + 0.5::DOUBLE) AS c1 FROM mm)
SELECT id, CAST(least(greatest(a0, a1), greatest(b0, b1), greatest(c0, c1)) >= greatest(0.0, least(a0, a1), least(b0, b1), least(c0, c1)) AS INT) AS hit FROM t""")
def f9(spark, d):
    o = g.Vec(*[F.lit(0.0)] * 3)
    ray = g.Vec(*(F.col(c) + 0.5 for c in "xyz"))
    hit = g.ray_hits_box(o, ray, g.Vec(F.lit(-500.0), F.lit(-500.0), F.lit(300.0)), g.Vec(*[F.lit(700.0)] * 3))
    return _mm(spark, d).select("id", hit.cast("int").alias("hit"))


@query("f11_retention", """
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey FROM n WHERE (i * 6) // n <> ((i - 1) * 6) // n OR i = 0""")
def f11(spark, d):
    return images.keep_evenly(fx.table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 6).select("o_custkey", "o_orderkey")


@query("f13_systematic_sample", "SELECT event_id, user_id FROM events WHERE event_id % 500 = 0")
def f13(spark, d):
    return fx.table(spark, d, "events").filter(F.pmod("event_id", F.lit(500)) == 0).select("event_id", "user_id")


@query("f12_depth_edges", duck("fx_dense") + """, r AS (SELECT *, min(depth_mm) OVER h AS lo3, max(depth_mm) OVER h AS hi3 FROM fx_dense WINDOW h AS (PARTITION BY frame_id, v ORDER BY u ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
n AS (SELECT *, min(lo3) OVER k AS lo, max(hi3) OVER k AS hi FROM r WINDOW k AS (PARTITION BY frame_id, u ORDER BY v ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT frame_id, u, v, depth_mm FROM n WHERE depth_mm IS NOT NULL AND hi - depth_mm <= 7 AND depth_mm - lo <= 7""")
def f12(spark, d):
    return images.remove_edges(fx.dense(spark, d).filter("depth_mm is not null"), "depth_mm", 7).select("frame_id", "u", "v", "depth_mm")


@query("a10_disparity", duck("fx_dense") + ",\n" + PTS + """, q AS (SELECT frame_id, sqrt(pow(60.0 * (x + 0.01 * (frame_id + 1)) / z + 31.5 - u, 2) + pow(60.0 * y / z + 23.5 - v, 2)) AS px FROM pts)
SELECT frame_id, round(sum(px) / (count(*) + 1) / 60.0, 9) AS disparity FROM q GROUP BY frame_id""")
def a10(spark, d):
    p = g.project(g.Vec(F.col("x") + 0.01 * (F.col("frame_id") + 1), F.col("y"), F.col("z")), CAM)
    px = F.sqrt((p.x - F.col("u")) * (p.x - F.col("u")) + (p.y - F.col("v")) * (p.y - F.col("v")))
    return points(spark, d).groupBy("frame_id").agg(F.round(F.sum(px) / (F.count("*") + 1) / 60.0, 9).alias("disparity"))


@query("a16_image_stats", duck("fx_dense") + "\nSELECT frame_id, min(depth_mm) AS lo, max(depth_mm) AS hi, round(sum(depth_mm) / count(*), 6) AS mean FROM fx_dense GROUP BY frame_id")
def a16(spark, d):
    return fx.dense(spark, d).groupBy("frame_id").agg(F.min("depth_mm").alias("lo"), F.max("depth_mm").alias("hi"), F.round(F.sum("depth_mm") / F.count("*"), 6).alias("mean"))


@query("a17_frame_extent", duck("fx_dense", "fx_pose") + ",\n" + PTS + ",\n" + WORLD + """
SELECT frame_id, round(min(wx), 6) AS min_x, round(max(wx), 6) AS max_x, round(min(wy), 6) AS min_y, round(max(wy), 6) AS max_y, round(min(wz), 6) AS min_z, round(max(wz), 6) AS max_z FROM world GROUP BY frame_id""")
def a17(spark, d):
    return world(spark, d).groupBy("frame_id").agg(*[F.round(f("w" + c), 6).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


@query("a18_memory", "SELECT lang, count(*) AS n_rows, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def a18(spark, d):
    return fx.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("text")).alias("bytes"))


@query("j17_fill_holes", duck("fx_dense", "fx_px") + """
SELECT coalesce(a.frame_id, b.frame_id) AS frame_id, coalesce(a.u, b.u) AS u, coalesce(a.v, b.v) AS v, CAST(coalesce(a.depth_mm, b.depth_mm) AS INT) AS depth_mm
FROM fx_px a FULL JOIN fx_dense b ON a.frame_id = b.frame_id AND a.u = b.u AND a.v = b.v""")
def j17(spark, d):
    return images.fill_holes(fx.px(spark, d), fx.dense(spark, d), ["depth_mm"]).select("frame_id", "u", "v", F.col("depth_mm").cast("int").alias("depth_mm"))


@query("j10_chunks_in_frustum", duck("fx_dense") + """, box AS (SELECT frame_id, CAST(floor(min(x) / 0.4) AS INT) AS x0, CAST(floor(max(x) / 0.4) AS INT) AS x1, CAST(floor(min(y) / 0.4) AS INT) AS y0, CAST(floor(max(y) / 0.4) AS INT) AS y1, CAST(floor(min(z) / 0.4) AS INT) AS z0, CAST(floor(max(z) / 0.4) AS INT) AS z1 FROM (
  SELECT frame_id, (u - 31.5) / 60.0 * depth_mm / 1000.0 AS x, (v - 23.5) / 60.0 * depth_mm / 1000.0 AS y, depth_mm / 1000.0 AS z FROM fx_dense WHERE depth_mm IS NOT NULL) GROUP BY frame_id),
c AS (SELECT frame_id, cx, cy, cz, (cx + 0.5) * 0.4 AS x, (cy + 0.5) * 0.4 AS y, (cz + 0.5) * 0.4 AS z FROM box, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS cx), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS cy), LATERAL (SELECT unnest(range(z0, z1 + 1)) AS cz))
SELECT frame_id, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, CAST(cz AS INT) AS cz FROM c WHERE z >= 0.5 AND z <= 2.0 AND 60.0 * x >= -31.5 * z AND 60.0 * x <= 32.5 * z AND 60.0 * y >= -23.5 * z AND 60.0 * y <= 24.5 * z""")
def j10(spark, d):
    box = points(spark, d).groupBy("frame_id").agg(*[f(c).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    return images.cells_in_frustum(box, 0.4, CAM, 0.5, 2.0).select("frame_id", "cx", "cy", "cz")


@query("j11_ray_cells", "WITH " + _MM + """, seg AS (SELECT id, x / 500.0::DOUBLE + 0.013 AS ax, y / 500.0::DOUBLE + 0.027 AS ay, z / 500.0::DOUBLE + 0.041 AS az, y / 500.0::DOUBLE + 0.0191 AS bx, z / 500.0::DOUBLE + 0.0333 AS by_, x / 500.0::DOUBLE + 0.0077 AS bz FROM mm),
cuts AS (SELECT id, 0.0::DOUBLE AS t FROM seg UNION SELECT id, 1.0::DOUBLE FROM seg
  UNION SELECT id, (k - ax) / (bx - ax) FROM (SELECT *, unnest(range(CAST(floor(least(ax, bx)) AS INT) + 1, CAST(floor(greatest(ax, bx)) AS INT) + 1)) AS k FROM seg)
  UNION SELECT id, (k - ay) / (by_ - ay) FROM (SELECT *, unnest(range(CAST(floor(least(ay, by_)) AS INT) + 1, CAST(floor(greatest(ay, by_)) AS INT) + 1)) AS k FROM seg)
  UNION SELECT id, (k - az) / (bz - az) FROM (SELECT *, unnest(range(CAST(floor(least(az, bz)) AS INT) + 1, CAST(floor(greatest(az, bz)) AS INT) + 1)) AS k FROM seg)),
mid AS (SELECT id, t, (t + lead(t) OVER (PARTITION BY id ORDER BY t)) / 2 AS m FROM cuts)
SELECT DISTINCT s.id, CAST(floor(ax + m * (bx - ax)) AS INT) AS gx, CAST(floor(ay + m * (by_ - ay)) AS INT) AS gy, CAST(floor(az + m * (bz - az)) AS INT) AS gz FROM mid JOIN seg s USING (id) WHERE m IS NOT NULL""")
def j11(spark, d):
    s = _mm(spark, d).select(
        "id", *[(F.col(c) / 500.0 + o).alias("a" + n) for c, o, n in (("x", 0.013, "x"), ("y", 0.027, "y"), ("z", 0.041, "z"))],
        *[(F.col(c) / 500.0 + o).alias("b" + n) for c, o, n in (("y", 0.0191, "x"), ("z", 0.0333, "y"), ("x", 0.0077, "z"))],
    )
    return images.ray_cells(s, "id")


@query("s8_depth_to_colour", duck("fx_dense") + ",\n" + PTS + """, a AS (SELECT frame_id, u, v, CAST(60.0 * (x + 0.05) / z + 31.5 AS DOUBLE) AS pu, 60.0 * y / z + 23.5 AS pv FROM pts),
t AS (SELECT frame_id, u, v, CAST(trunc(round(pu, 9)) AS INT) AS cu, CAST(trunc(round(pv, 9)) AS INT) AS cv FROM a)
SELECT t.frame_id, t.u, t.v, CAST(coalesce(d.r, 0) AS INT) AS r, CAST(coalesce(d.g, 0) AS INT) AS g, CAST(coalesce(d.b, 0) AS INT) AS b FROM t LEFT JOIN (SELECT (frame_id * 100 + u) * 100 + v AS pk, r, g, b FROM fx_dense) d ON d.pk = CASE WHEN cu BETWEEN 0 AND 63 AND cv BETWEEN 0 AND 47 THEN (t.frame_id * 100 + cu) * 100 + cv END""")
def s8(spark, d):
    p = points(spark, d).select("frame_id", "u", "v", (F.col("x") + 0.05).alias("x"), "y", "z")
    return images.colour_at(p, fx.dense(spark, d), CAM).select("frame_id", "u", "v", *[F.col(c).cast("int").alias(c) for c in "rgb"])


@query("s11_point_cloud", duck("fx_dense", "fx_pose") + ",\n" + PTS + ",\n" + WORLD + "\nSELECT round(wx, 6) AS x, round(wy, 6) AS y, round(wz, 6) AS z, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM world")
def s11(spark, d):
    return world(spark, d).select(*r6(x=F.col("wx"), y=F.col("wy"), z=F.col("wz")), *[F.col(c).cast("int").alias(c) for c in "rgb"])


#: Frame n seen from frame n + 1, a step to the right.
_INTO = """prj AS (SELECT p.frame_id, p.u, p.v, z, frame_id + 1 AS to_frame, z + 0.01 AS pz, CAST(floor(round(60.0 * (x - 0.05) / (z + 0.01) + 31.5 + 0.5, 9)) AS INT) AS pu, CAST(floor(round(60.0 * y / (z + 0.01) + 23.5 + 0.5, 9)) AS INT) AS pv FROM pts p)"""


def _into(spark, d):
    step = fx.frame_ids(spark, d).selectExpr(
        "frame_id", "frame_id + 1 AS to_frame", "0.0D AS qx", "0.0D AS qy", "0.0D AS qz", "1.0D AS qw", "-0.05D AS tx", "0.0D AS ty", "0.01D AS tz"
    )
    return images.project_into(points(spark, d), step, CAM)


def _metres(spark, d):
    return fx.dense(spark, d).select("frame_id", "u", "v", (F.col("depth_mm") / 1000.0).alias("m"))


@query("j7_depth_agreement", duck("fx_dense") + ",\n" + PTS + ",\n" + _INTO + """
SELECT q.frame_id, q.u, q.v, CASE WHEN abs(d.depth_mm / 1000.0::DOUBLE - pz) > 0.05 * pz THEN 0.0 ELSE round(z, 6) END AS depth FROM prj q LEFT JOIN fx_dense d ON d.frame_id = q.to_frame AND d.u = q.pu AND d.v = q.pv""")
def j7(spark, d):
    return images.agree_in_depth(_into(spark, d), _metres(spark, d), "m").select("frame_id", "u", "v", F.round("depth", 6).alias("depth"))


@query("j8_nearest_refinement", duck("fx_dense") + ",\n" + PTS + ",\n" + _INTO + """
SELECT q.frame_id, q.u, q.v, round(CASE WHEN abs(d.depth_mm / 1000.0::DOUBLE - pz) <= 0.05 * pz THEN (z * 2 + d.depth_mm / 1000.0::DOUBLE - pz + z) / 3 ELSE z END, 6) AS depth,
  2 + CASE WHEN abs(d.depth_mm / 1000.0::DOUBLE - pz) <= 0.05 * pz THEN 1 ELSE 0 END AS weight FROM prj q LEFT JOIN fx_dense d ON d.frame_id = q.to_frame AND d.u = q.pu AND d.v = q.pv""")
def j8_nearest(spark, d):
    got = images.fuse_depth(_into(spark, d).withColumn("w", F.lit(2)), _metres(spark, d), "m", "w")
    return got.select("frame_id", "u", "v", F.round("depth", 6).alias("depth"), F.col("new_weight").alias("weight"))


_QUAD = """mv AS (SELECT p.*, cos(0.002) * x - sin(0.002) * y - 0.05 AS mx, sin(0.002) * x + cos(0.002) * y AS my, z + 0.01 AS mz FROM pts p),
uv AS (SELECT *, round(60.0 * mx / mz + 31.5, 9) AS pu, round(60.0 * my / mz + 23.5, 9) AS pv FROM mv),
qd AS (SELECT q.*, q.pu - floor(q.pu) AS fu, q.pv - floor(q.pv) AS fv, coalesce(a.depth_mm, 0) / 1000.0::DOUBLE AS q0, coalesce(b.depth_mm, 0) / 1000.0::DOUBLE AS q1, coalesce(c.depth_mm, 0) / 1000.0::DOUBLE AS q2, coalesce(e.depth_mm, 0) / 1000.0::DOUBLE AS q3
  FROM uv q LEFT JOIN fx_dense a ON a.frame_id = q.frame_id + 1 AND a.u = CAST(floor(pu) AS INT) AND a.v = CAST(floor(pv) AS INT) LEFT JOIN fx_dense b ON b.frame_id = q.frame_id + 1 AND b.u = CAST(floor(pu) AS INT) + 1 AND b.v = CAST(floor(pv) AS INT)
  LEFT JOIN fx_dense c ON c.frame_id = q.frame_id + 1 AND c.u = CAST(floor(pu) AS INT) AND c.v = CAST(floor(pv) AS INT) + 1 LEFT JOIN fx_dense e ON e.frame_id = q.frame_id + 1 AND e.u = CAST(floor(pu) AS INT) + 1 AND e.v = CAST(floor(pv) AS INT) + 1),
ob AS (SELECT *, pu > 2 AND pu < 62 AND pv > 2 AND pv < 46 AS inside, CASE WHEN abs(q0 - q1) < 0.1 AND abs(q0 - q2) < 0.1 AND abs(q0 - q3) < 0.1 THEN (1 - fu) * (1 - fv) * q0 + fu * (1 - fv) * q1 + (1 - fu) * fv * q2 + fu * fv * q3
  WHEN fu >= 0.5 THEN CASE WHEN fv >= 0.5 THEN q3 ELSE q1 END ELSE CASE WHEN fv >= 0.5 THEN q2 ELSE q0 END END AS d FROM qd)"""


@query("j8_depth_refinement", duck("fx_dense") + ",\n" + PTS + ",\n" + _QUAD + """
SELECT frame_id, u, v, round(CASE WHEN inside AND abs(d - mz) < 0.05 * mz THEN (z * 2 + d - 0.01) / 3 ELSE z END, 6) AS depth, 2 + CASE WHEN inside AND abs(d - mz) < 0.05 * mz THEN 1 ELSE 0 END AS weight FROM ob""")
def j8(spark, d):
    """Four samples of the next frame, or the nearest where they disagree; the fixture's holes give both branches."""
    step = fx.frame_ids(spark, d).selectExpr("frame_id", "frame_id + 1 AS to_frame", "0.0D AS qx", "0.0D AS qy", "sin(0.001D) AS qz", "cos(0.001D) AS qw", "-0.05D AS tx", "0.0D AS ty", "0.01D AS tz")
    got = images.refine_depth(points(spark, d).withColumn("w", F.lit(2)), step, _metres(spark, d), "m", "w", CAM)
    return got.select("frame_id", "u", "v", F.round("depth", 6).alias("depth"), F.col("new_weight").alias("weight"))

