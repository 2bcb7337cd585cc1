"""Surfels over the dense fixture images."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.functions import color
from lodeframe.operators import images
from lodeframe.operators import surfels as op
from lodeframe.plans import fixtures as fx
from lodeframe.plans.fixtures import duck
from lodeframe.plans.registry import query
from lodeframe.plans.space import _NORMALS, PTS, points

_RADIUS = "least(2 * (z / 60.0 * sqrt(2.0)), z / 60.0 * sqrt(2.0) / abs(nz / len))"
_CONF = "exp(-((u - 31.5) * (u - 31.5) + (v - 23.5) * (v - 23.5)) / 1600.0 / 0.72)"


def _surfels(spark, d):
    n = images.pixel_normals(points(spark, d))
    return n.withColumns({"radius": op.radius(F.col("z"), F.col("nz"), fx.FX), "conf": op.confidence(F.col("u"), F.col("v"), fx.CX, fx.CY, 40.0)})


@query("p29_radius_confidence", duck("fx_dense") + ",\n" + PTS + ",\n" + _NORMALS + f"\nSELECT frame_id, u, v, round({_RADIUS}, 6) AS radius, round({_CONF}, 6) AS conf FROM nn")
def p29(spark, d):
    return _surfels(spark, d).select("frame_id", "u", "v", F.round("radius", 6).alias("radius"), F.round("conf", 6).alias("conf"))


@query("p31_image_to_surfels", duck("fx_dense") + ",\n" + PTS + ",\n" + _NORMALS + f""", s AS (SELECT frame_id, u, v, {_RADIUS} AS radius, z FROM nn)
SELECT d.frame_id, d.u, d.v, CAST((d.r << 16) + (d.g << 8) + d.b AS INT) AS rgb, CAST(s.z IS NOT NULL AS INT) AS valid, round(s.z, 6) AS z, round(s.radius, 6) AS radius FROM fx_dense d LEFT JOIN s USING (frame_id, u, v)""")
def p31(spark, d):
    s = _surfels(spark, d).select("frame_id", "u", "v", "z", "radius")
    px = fx.dense(spark, d).select("frame_id", "u", "v", color.pack(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))
    return px.join(s.hint("merge"), ["frame_id", "u", "v"], "left").select("frame_id", "u", "v", "rgb", F.col("z").isNotNull().cast("int").alias("valid"), F.round("z", 6).alias("z"), F.round("radius", 6).alias("radius"))


_A21 = """a AS (SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS x, p_retailprice / 1000 AS y, 1 + p_size / 100.0::DOUBLE AS z, 0.1 + p_size % 5 / 50.0::DOUBLE AS radius, 1.0 + p_size % 3 AS conf FROM part),
b AS (SELECT l_partkey AS id, l_quantity / 10 AS x, l_tax AS y, 1 + l_discount AS z, 0.1 + l_linenumber / 40.0::DOUBLE AS radius, 1.0::DOUBLE AS conf FROM lineitem),
e AS (SELECT *, conf AS w FROM a UNION ALL SELECT b.*, CASE WHEN b.radius < 1.5 * a.radius THEN b.conf ELSE 0 END FROM b JOIN a USING (id))"""


@query("a21_surfel_merge", "WITH " + _A21 + "\nSELECT id, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * radius) / sum(w), 6) AS radius, round(sum(conf), 6) AS conf FROM e GROUP BY id")
def a21(spark, d):
    a = fx.table(spark, d, "part").selectExpr("p_partkey AS id", "p_size / 10.0D AS x", "p_retailprice / 1000 AS y", "1 + p_size / 100.0D AS z", "0.1D + p_size % 5 / 50.0D AS radius", "1.0D + p_size % 3 AS conf")
    b = fx.table(spark, d, "lineitem").selectExpr("l_partkey AS id", "l_quantity / 10 AS x", "l_tax AS y", "1 + l_discount AS z", "0.1D + l_linenumber / 40.0D AS radius", "1.0D AS conf")
    return op.merge(a, b).select("id", *[F.round(c, 6).alias(c) for c in ("x", "radius", "conf")])


_MODEL = """mdl AS (SELECT frame_id + 1 AS frame_id, (frame_id * 100 + u) * 100 + v AS id, x - 0.05 AS x, y, z - 0.01 AS z, nx / len AS nx, ny / len AS ny, nz / len AS nz FROM nn),
mp AS (SELECT *, CAST(floor(round(60.0 * x / z + 31.5 + 0.5, 9)) AS INT) AS u, CAST(floor(round(60.0 * y / z + 23.5 + 0.5, 9)) AS INT) AS v FROM mdl),
vis AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, u, v ORDER BY round(z, 9), id) AS rn FROM mp) WHERE rn = 1)"""


def _model(spark, d):
    """The surfels of each frame, as the next frame sees them."""
    n = images.pixel_normals(points(spark, d))
    m = n.select((F.col("frame_id") + 1).alias("frame_id"), ((F.col("frame_id") * 100 + F.col("u")) * 100 + F.col("v")).alias("id"), (F.col("x") - 0.05).alias("x"), "y", F.round(F.col("z") - 0.01, 9).alias("z"), "nx", "ny", "nz")
    at = lambda p, f, c: F.floor(F.round(f * F.col(p) / F.col("z") + c + 0.5, 9)).cast("int")
    return op.visible(m.withColumns({"u": at("x", fx.FX, fx.CX), "v": at("y", fx.FY, fx.CY)}))


@query("g16_visible_surfels", duck("fx_dense") + ",\n" + PTS + ",\n" + _NORMALS + ",\n" + _MODEL + "\nSELECT frame_id, u, v, id FROM vis")
def g16(spark, d):
    return _model(spark, d).select("frame_id", "u", "v", "id")


@query("g16_pruned_surfels", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (60 - l_linenumber * 6 > 20 AND l_discount <= 0.05) AND l_suppkey % 12 <= 8 AND l_quantity % 7 <= 4""")
def g16_prune(spark, d):
    s = fx.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_linenumber * 6 AS t_last", "l_discount AS conf", "l_suppkey % 12 AS n_copies", "l_quantity % 7 AS n_free")
    return op.prune(s, F.lit(60), 0.05).select("l_orderkey", "l_linenumber", "l_partkey")


@query("j13_surfel_association", duck("fx_dense") + ",\n" + PTS + ",\n" + _NORMALS + ",\n" + _MODEL + """, asks AS (SELECT frame_id, u, v, z, nx / len AS nx, ny / len AS ny, nz / len AS nz, (u - 31.5) / 60.0::DOUBLE AS rx, (v - 23.5) / 60.0::DOUBLE AS ry, u + i AS mu, v + j AS mv FROM nn, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
met AS (SELECT a.frame_id, a.u, a.v, m.id, sqrt(rx * rx + ry * ry + 1) AS l, m.z - a.z AS dz, m.nz AS mnz, a.nx * m.nx + a.ny * m.ny + a.nz * m.nz AS c, sqrt(pow(ry * m.z - m.y, 2) + pow(m.x - rx * m.z, 2) + pow(rx * m.y - ry * m.x, 2)) AS d
  FROM asks a JOIN vis m ON (m.frame_id * 100 + m.u) * 100 + m.v = (a.frame_id * 100 + a.mu) * 100 + a.mv AND m.frame_id = a.frame_id AND m.u = a.mu AND m.v = a.mv),
best AS (SELECT *, row_number() OVER (PARTITION BY frame_id, u, v ORDER BY round(d / l, 9), id) AS rn FROM met WHERE abs(dz) * l < 0.05 AND (abs(mnz) < 0.75 OR acos(least(greatest(c, -1.0), 1.0)) < 0.5))
SELECT nn.frame_id, nn.u, nn.v, b.id AS match FROM nn LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON b.frame_id = nn.frame_id AND b.u = nn.u AND b.v = nn.v""")
def j13(spark, d):
    n = images.pixel_normals(points(spark, d))
    return op.associate(n, _model(spark, d), fx.CX, fx.CY, fx.FX, fx.FY)


@query("g16_deformation", """
WITH n AS (SELECT o_orderkey AS t, o_totalprice / 100000 AS x, o_custkey % 17 / 10.0::DOUBLE AS y, 0.5::DOUBLE AS z, (o_custkey % 3)::DOUBLE AS mx FROM orders),
p AS (SELECT event_id AS id, event_id AS t, value / 100 AS x, user_id % 13 / 10.0::DOUBLE AS y, 0.25::DOUBLE AS z FROM events),
k AS (SELECT p.*, unnest(range(t - 10, t + 11)) AS nt FROM p),
d AS (SELECT k.id, n.t, mx, round(sqrt(pow(k.x - n.x, 2) + pow(k.y - n.y, 2) + pow(k.z - n.z, 2)), 9) AS d FROM k JOIN n ON n.t = k.nt),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, t) AS r FROM d), m AS (SELECT id, max(d) AS far FROM r WHERE r <= 5 GROUP BY id)
SELECT id, round(coalesce(sum(pow(1 - d / far, 2) * mx) / nullif(sum(pow(1 - d / far, 2)), 0), 0), 5) AS dx FROM r JOIN m USING (id) WHERE r <= 4 GROUP BY id""")
def g16_deform(spark, d):
    """Nodes are the orders and points the events, both with their ids as times."""
    nodes = fx.table(spark, d, "orders").selectExpr("o_orderkey AS t", "o_totalprice / 100000 AS x", "o_custkey % 17 / 10.0D AS y", "0.5D AS z", "CAST(o_custkey % 3 AS DOUBLE) AS mx", "0D AS my", "0D AS mz")
    p = fx.table(spark, d, "events").selectExpr("event_id AS id", "event_id AS t", "value / 100 AS x", "user_id % 13 / 10.0D AS y", "0.25D AS z")
    return op.deform(p, nodes).select("id", F.round("dx", 5).alias("dx"))
