"""Voxel fusion over the dense fixture images, with poses that only move."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.functions import geometry as g
from lodeframe.operators import images
from lodeframe.operators import voxels as op
from lodeframe.plans import fixtures as fx
from lodeframe.plans.fixtures import duck
from lodeframe.plans.registry import query
from lodeframe.plans.space import CAM, PTS

#: Band of the samples, and a shift of all poses; neither a multiple of a voxel, so that no sample
#: lies on a cell's face.
BEFORE, BEHIND = 0.1513, 0.05
SHIFT = (0.00273, 0.00317, 0.00171)
_STEPS = int((BEFORE + BEHIND) / (fx.VOXEL / 2)) + 1


def _sql(tx: str = "tx") -> str:
    """Views cells -> obs -> vox for poses at `tx`."""
    return f"""samples AS (SELECT p.frame_id, x * (1 + (k * 0.025 - 0.1513) / z) + ({tx} + 0.00273) AS x, y * (1 + (k * 0.025 - 0.1513) / z) + 0.00317 AS y, z * (1 + (k * 0.025 - 0.1513) / z) + (tz + 0.00171) AS z
  FROM pts p JOIN fx_pose USING (frame_id) CROSS JOIN (SELECT unnest(range(0, {_STEPS + 1})) AS k)),
cells AS (SELECT DISTINCT frame_id, CAST(floor(x / 0.05) AS INT) AS gx, CAST(floor(y / 0.05) AS INT) AS gy, CAST(floor(z / 0.05) AS INT) AS gz FROM samples),
cam AS (SELECT c.*, (gx + 0.5) * 0.05 - ({tx} + 0.00273) AS x, (gy + 0.5) * 0.05 - 0.00317 AS y, (gz + 0.5) * 0.05 - (tz + 0.00171) AS z, floor(gz / 8.0) * 0.4 - (tz + 0.00171) AS o FROM cells c JOIN fx_pose USING (frame_id)),
pix AS (SELECT *, CAST(floor(60.0 * x / z + 31.5 + 0.5) AS INT) AS u, CAST(floor(60.0 * y / z + 23.5 + 0.5) AS INT) AS v, abs(0.0019 * o * o + 0.00152 * o + 0.001504) * 8.0 AS t FROM cam WHERE z > 0.1 AND z < 10.0),
obs AS (SELECT p.frame_id, gx, gy, gz, d.depth_mm / 1000.0::DOUBLE - p.z AS d, t, 1.0 / (2 * t) AS w, d.r, d.g, d.b FROM pix p JOIN fx_dense d ON d.frame_id = p.frame_id AND d.u = p.u AND d.v = p.v
  WHERE d.depth_mm IS NOT NULL AND d.depth_mm / 1000.0::DOUBLE - p.z > -0.03 AND d.depth_mm / 1000.0::DOUBLE - p.z < t + sqrt(3.0) * 0.05),
vox AS (SELECT gx, gy, gz, sum(w * d) AS sum_wd, sum(w) AS sum_w, {", ".join(f"CAST(sum(CASE WHEN abs(d) < sqrt(3.0) * 0.05 + 0.01 THEN {c} ELSE 0 END) AS BIGINT) AS sum_{c}" for c in "rgb")},
  CAST(sum(CASE WHEN abs(d) < sqrt(3.0) * 0.05 + 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS n_c, count(*) AS n FROM obs GROUP BY gx, gy, gz),
sdf AS (SELECT gx, gy, gz, sum_wd / sum_w AS sdf, sum_w AS weight, sum_r, sum_g, sum_b, n_c FROM vox WHERE sum_w > 0.5)"""


def _head(tx: str = "tx") -> str:
    return duck("fx_dense", "fx_pose") + ",\n" + PTS + ",\n" + _sql(tx)


def _poses(spark, d, tx="tx"):
    return fx.poses(spark, d).select("frame_id", "qx", "qy", F.lit(0.0).alias("qz"), F.lit(1.0).alias("qw"), (F.col(tx) + SHIFT[0]).alias("tx"), (F.col("ty") + SHIFT[1]).alias("ty"), (F.col("tz") + SHIFT[2]).alias("tz"))


def _pixels(spark, d):
    return fx.dense(spark, d).withColumn("depth", F.col("depth_mm") / 1000.0)


def _cells(spark, d, tx="tx"):
    points = images.unproject_pixels(fx.dense(spark, d), CAM).select("frame_id", "x", "y", "z")
    return op.band_cells(points, _poses(spark, d, tx), fx.VOXEL, BEFORE, BEHIND)


def observations(spark, d, tx="tx"):
    return op.observe(_cells(spark, d, tx), _pixels(spark, d).select("frame_id", "u", "v", "depth", "r", "g", "b"), _poses(spark, d, tx), CAM, fx.VOXEL, fx.CHUNK)


def voxels(spark, d):
    return op.fuse(observations(spark, d))


@query("j9_band_cells", _head() + "\nSELECT frame_id, gx, gy, gz FROM cells")
def j9(spark, d):
    return _cells(spark, d).select("frame_id", "gx", "gy", "gz")


@query("a12_fusion", _head() + "\nSELECT gx, gy, gz, round(sum_wd, 6) + 0.0 AS sum_wd, round(sum_w, 6) AS sum_w FROM vox")
def a12(spark, d):
    return voxels(spark, d).select("gx", "gy", "gz", (F.round("sum_wd", 6) + 0.0).alias("sum_wd"), F.round("sum_w", 6).alias("sum_w"))


@query("a13_colour_fusion", _head() + "\nSELECT gx, gy, gz, sum_r, sum_g, sum_b, n_c FROM vox")
def a13(spark, d):
    return voxels(spark, d).select("gx", "gy", "gz", "sum_r", "sum_g", "sum_b", "n_c")


@query("a14_carving", _head() + """, c AS (SELECT *, sum_wd < 0 AND (gx + gy + gz) % 2 = 0 AS hit FROM vox)
SELECT gx, gy, gz, round(CASE WHEN hit THEN sum_w / 2 ELSE sum_w END, 6) AS sum_w FROM c WHERE NOT (hit AND sum_w < 2)""")
def a14(spark, d):
    v = voxels(spark, d)
    return op.carve(v, v.filter("(gx + gy + gz) % 2 = 0")).select("gx", "gy", "gz", F.round("sum_w", 6).alias("sum_w"))


@query("a15_chunk_statistics", _head() + """, c AS (SELECT format('{},{},{}', CAST(floor(gx / 8.0) AS INT), CAST(floor(gy / 8.0) AS INT), CAST(floor(gz / 8.0) AS INT)) AS chunk, * FROM vox)
SELECT chunk, CAST(sum(CASE WHEN sum_w > 0.5 AND sum_wd < 0 THEN 1 ELSE 0 END) AS BIGINT) AS inside, CAST(sum(CASE WHEN sum_w > 0.5 AND sum_wd >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS outside,
  CAST(sum(CASE WHEN sum_w > 0.5 THEN 0 ELSE 1 END) AS BIGINT) AS unknown, round(sum(sum_w), 4) AS weight,
  round(min(floor(gx / 8.0)) * 0.4, 6) AS x0, round(min(floor(gy / 8.0)) * 0.4, 6) AS y0, round(min(floor(gz / 8.0)) * 0.4, 6) AS z0, round((max(floor(gx / 8.0)) + 1) * 0.4, 6) AS x1, round((max(floor(gy / 8.0)) + 1) * 0.4, 6) AS y1, round((max(floor(gz / 8.0)) + 1) * 0.4, 6) AS z1,
  round(count(DISTINCT chunk) * 512 * 8 / 1e6, 6) AS megabytes, round((max(floor(gx / 8.0)) - min(floor(gx / 8.0)) + 1) * (max(floor(gy / 8.0)) - min(floor(gy / 8.0)) + 1) * (max(floor(gz / 8.0)) - min(floor(gz / 8.0)) + 1) * 512 * 8 / 1e6, 6) AS most_megabytes FROM c GROUP BY ROLLUP (chunk)""")
def a15(spark, d):
    """With the bounds in metres, and the memory of dense chunks of 8 bytes a cell: of those there are, and of all within the bounds."""
    got = op.chunk_statistics(voxels(spark, d), fx.CHUNK, fx.VOXEL).withColumn("weight", F.round("weight", 4))
    return got.withColumns({c: F.round(c, 6) for c in ("x0", "y0", "z0", "x1", "y1", "z1", "megabytes", "most_megabytes")})


_CHUNKS = """ch AS (SELECT DISTINCT frame_id, CAST(floor(gx / 8.0) AS INT) AS cx, CAST(floor(gy / 8.0) AS INT) AS cy, CAST(floor(gz / 8.0) AS INT) AS cz FROM cells)"""


def _chunks(spark, d):
    return _cells(spark, d).select("frame_id", *[F.floor(F.col(g) / fx.CHUNK).cast("int").alias(c) for g, c in (("gx", "cx"), ("gy", "cy"), ("gz", "cz"))]).distinct()


@query("d1_dirty_chunks", _head() + ",\n" + _CHUNKS + """
SELECT DISTINCT cx + a AS cx, cy + b AS cy, cz + c AS cz FROM ch, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) n(a, b, c)""")
def d1(spark, d):
    return op.dirty_chunks(_chunks(spark, d).select("cx", "cy", "cz").distinct())


@query("d4_create_missing", _head() + ",\n" + _CHUNKS + """
SELECT DISTINCT cx, cy, cz, CAST(NULL AS BIGINT) AS age FROM ch WHERE frame_id % 5 = 4 AND (cx, cy, cz) NOT IN (SELECT (cx, cy, cz) FROM ch WHERE frame_id % 5 < 4)
UNION ALL SELECT cx, cy, cz, min(frame_id) FROM ch WHERE frame_id % 5 < 4 GROUP BY cx, cy, cz""")
def d4(spark, d):
    c = _chunks(spark, d)
    have = c.filter("frame_id % 5 < 4").groupBy("cx", "cy", "cz").agg(F.min("frame_id").alias("age"))
    return op.create_missing(have, c.filter("frame_id % 5 = 4"), ["cx", "cy", "cz"])


@query("d5_collect_garbage", _head() + ",\n" + _CHUNKS + """
SELECT cx, cy, cz, min(frame_id) AS age FROM ch GROUP BY cx, cy, cz HAVING min(frame_id) % 2 = 0 OR max(CAST(frame_id % 5 = 4 AS INT)) = 1""")
def d5(spark, d):
    c = _chunks(spark, d)
    have = c.groupBy("cx", "cy", "cz").agg(F.min("frame_id").alias("age")).withColumn("is_new", F.col("age") % 2 == 1)
    return op.collect_garbage(have, c.filter("frame_id % 5 = 4"), ["cx", "cy", "cz"]).drop("is_new")


@query("d6_map_reset", _head() + "\nSELECT gx, gy, gz, n FROM vox WHERE false")
def d6(spark, d):
    return voxels(spark, d).select("gx", "gy", "gz", F.col("n_c").alias("n")).filter(F.lit(False))


@query("g9_refusion", _head() + "\nSELECT gx, gy, gz, round(sum_wd, 5) + 0.0 AS sum_wd, round(sum_w, 5) AS sum_w FROM vox WHERE sum_w > 1e-9")
def g9(spark, d):
    """Fused at the earlier poses, retracted there and fused at the current ones."""
    old = observations(spark, d, "tx_prev")
    grid = op.fuse(op.fuse(old), op.negative(old), observations(spark, d))
    return grid.select("gx", "gy", "gz", (F.round("sum_wd", 5) + 0.0).alias("sum_wd"), F.round("sum_w", 5).alias("sum_w"))


@query("g10_full_fusion", _head("tx_prev") + "\nSELECT gx, gy, gz, round(sum_wd, 6) + 0.0 AS sum_wd, round(sum_w, 6) AS sum_w FROM vox")
def g10(spark, d):
    v = op.fuse(observations(spark, d, "tx_prev"))
    return v.select("gx", "gy", "gz", (F.round("sum_wd", 6) + 0.0).alias("sum_wd"), F.round("sum_w", 6).alias("sum_w"))


@query("s13_voxel_dump", _head() + "\nSELECT round((gx + 0.5) * 0.05, 6) AS x, round((gy + 0.5) * 0.05, 6) AS y, round((gz + 0.5) * 0.05, 6) AS z, round((sdf + 0.2) * 30, 5) + 0.0 AS nx, round(weight, 6) AS ny, round(sdf * 100, 5) + 0.0 AS nz, 1 AS intensity, " + ", ".join(f"round(CASE WHEN n_c > 0 THEN sum_{c} / n_c ELSE 255.0 END, 6) AS {c}" for c in "rgb") + " FROM sdf")
def s13(spark, d):
    """Cell centres; distance and weight lie in the normal's slots."""
    s = op.surface(voxels(spark, d))
    at = [F.round((F.col(c) + 0.5) * fx.VOXEL, 6).alias(n) for c, n in (("gx", "x"), ("gy", "y"), ("gz", "z"))]
    slots = [(F.round((F.col("sdf") + 0.2) * 30, 5) + 0.0).alias("nx"), F.round("weight", 6).alias("ny"), (F.round(F.col("sdf") * 100, 5) + 0.0).alias("nz")]
    return s.select(*at, *slots, F.lit(1).alias("intensity"), *[F.round(c, 6).alias(c) for c in "rgb"])


_CUBES = """cubes AS (SELECT gx - (k & 1) AS gx, gy - ((k >> 1) & 1) AS gy, gz - (k >> 2) AS gz, sum(CASE WHEN sdf < 0 THEN 1 << k ELSE 0 END) AS mask, count(*) AS n
  FROM sdf CROSS JOIN (SELECT unnest(range(0, 8))::INT AS k) GROUP BY 1, 2, 3)"""


@query("p27_cube_mask", _head() + ",\n" + _CUBES + "\nSELECT gx, gy, gz, CAST(mask AS INT) AS mask FROM cubes WHERE n = 8")
def p27(spark, d):
    c = op.corner_cells(op.surface(voxels(spark, d)))
    return c.select("gx", "gy", "gz", op.cube_mask(F.col("sdf")).alias("mask"))


@query("j12_cube_corners", _head() + ",\n" + _CUBES + "\nSELECT gx, gy, gz, CAST(n AS BIGINT) AS n FROM cubes WHERE n = 8")
def j12(spark, d):
    return op.corner_cells(op.surface(voxels(spark, d))).select("gx", "gy", "gz", F.size("sdf").cast("bigint").alias("n"))


@query("w7_gradients", _head() + """, s1 AS (SELECT *, (gx * 1000::BIGINT + gy) * 1000 + gz AS k FROM sdf WHERE sdf < 1)
SELECT s.gx, s.gy, s.gz, round((a.sdf - b.sdf) / 2, 6) + 0.0 AS dx, round((c.sdf - e.sdf) / 2, 6) + 0.0 AS dy, round((f.sdf - g.sdf) / 2, 6) + 0.0 AS dz FROM s1 s JOIN s1 a ON a.k = s.k + 1000000 JOIN s1 b ON b.k = s.k - 1000000
JOIN s1 c ON c.k = s.k + 1000 JOIN s1 e ON e.k = s.k - 1000 JOIN s1 f ON f.k = s.k + 1 JOIN s1 g ON g.k = s.k - 1""")
def w7(spark, d):
    return op.gradients(op.surface(voxels(spark, d)), fx.VOXEL).select("gx", "gy", "gz", *[(F.round(c, 6) + 0.0).alias(c) for c in ("dx", "dy", "dz")])


@query("a20_mean_normal", _head() + """, s1 AS (SELECT *, (gx * 1000::BIGINT + gy) * 1000 + gz AS k FROM sdf WHERE sdf < 1), n AS (
SELECT s.gx, s.gy, s.gz, (a.sdf - b.sdf) / 2 AS dx, (c.sdf - e.sdf) / 2 AS dy, (f.sdf - g.sdf) / 2 AS dz FROM s1 s JOIN s1 a ON a.k = s.k + 1000000 JOIN s1 b ON b.k = s.k - 1000000 JOIN s1 c ON c.k = s.k + 1000 JOIN s1 e ON e.k = s.k - 1000 JOIN s1 f ON f.k = s.k + 1 JOIN s1 g ON g.k = s.k - 1)
SELECT CAST(floor(gx / 8.0) AS INT) AS cx, CAST(floor(gy / 8.0) AS INT) AS cy, CAST(floor(gz / 8.0) AS INT) AS cz, count(*) AS n, round(avg(dx), 6) + 0.0 AS dx, round(avg(dy), 6) + 0.0 AS dy, round(avg(dz), 6) + 0.0 AS dz FROM n GROUP BY 1, 2, 3""")
def a20(spark, d):
    n = op.gradients(op.surface(voxels(spark, d)), fx.VOXEL)
    at = [F.floor(F.col(g) / fx.CHUNK).cast("int").alias(c) for g, c in (("gx", "cx"), ("gy", "cy"), ("gz", "cz"))]
    return n.groupBy(*at).agg(F.count("*").alias("n"), *[(F.round(F.avg(c), 6) + 0.0).alias(c) for c in ("dx", "dy", "dz")])


@query("g13_distance_lookup", _head() + """, p AS (SELECT frame_id * 10000 + u * 100 + v AS id, x + (tx + 0.00273) AS x, y + 0.00317 AS y, z + (tz + 0.00171) AS z FROM pts JOIN fx_pose USING (frame_id)),
q AS (SELECT *, CAST(floor(x / 0.05 - 0.5) AS INT) AS bx, CAST(floor(y / 0.05 - 0.5) AS INT) AS by_, CAST(floor(z / 0.05 - 0.5) AS INT) AS bz FROM p),
r AS (SELECT id, bx + (k & 1) AS gx, by_ + ((k >> 1) & 1) AS gy, bz + (k >> 2) AS gz, (CASE WHEN k & 1 = 1 THEN x / 0.05 - 0.5 - bx ELSE 1 - (x / 0.05 - 0.5 - bx) END) * (CASE WHEN (k >> 1) & 1 = 1 THEN y / 0.05 - 0.5 - by_ ELSE 1 - (y / 0.05 - 0.5 - by_) END)
  * (CASE WHEN k >> 2 = 1 THEN z / 0.05 - 0.5 - bz ELSE 1 - (z / 0.05 - 0.5 - bz) END) AS w FROM q CROSS JOIN (SELECT unnest(range(0, 8))::INT AS k))
SELECT id, round(sum(w * sdf), 6) + 0.0 AS distance FROM r JOIN sdf USING (gx, gy, gz) GROUP BY id HAVING count(*) = 8""")
def g13(spark, d):
    p = images.to_world(images.unproject_pixels(fx.dense(spark, d), CAM), _poses(spark, d))
    p = p.select((F.col("frame_id") * 10000 + F.col("u") * 100 + F.col("v")).alias("id"), F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
    return op.sample_distance(p, op.surface(voxels(spark, d)), "id", fx.VOXEL).withColumn("distance", F.round("distance", 6) + 0.0)


@query("g15_resampled_grid", _head() + """, src AS (SELECT *, (CAST(floor(gx / 8.0) AS INT) % 3 + 3) % 3 + 1 AS anchor FROM sdf),
m AS (SELECT frame_id AS anchor, 1 - 2 * qz * qz AS c, 2 * qz * qw AS s, tx, tz FROM fx_pose),
t AS (SELECT DISTINCT anchor, CAST(floor((c * x - s * y + tx) / 0.05) AS INT) AS gx, CAST(floor((s * x + c * y) / 0.05) AS INT) AS gy, CAST(floor((z + tz) / 0.05) AS INT) AS gz
  FROM (SELECT anchor, (gx + 0.5::DOUBLE) * 0.05 AS x, (gy + 0.5::DOUBLE) * 0.05 AS y, (gz + 0.5::DOUBLE) * 0.05 AS z FROM src) JOIN m USING (anchor)),
p AS (SELECT anchor, gx AS ox, gy AS oy, gz AS oz, c * ((gx + 0.5::DOUBLE) * 0.05 - tx) + s * ((gy + 0.5::DOUBLE) * 0.05) AS x, c * ((gy + 0.5::DOUBLE) * 0.05) - s * ((gx + 0.5::DOUBLE) * 0.05 - tx) AS y, (gz + 0.5::DOUBLE) * 0.05 - tz AS z FROM t JOIN m USING (anchor)),
q AS (SELECT *, x / 0.05 - 0.5 AS fx, y / 0.05 - 0.5 AS fy, z / 0.05 - 0.5 AS fz FROM p),
r AS (SELECT anchor, ox, oy, oz, CAST(floor(fx) AS INT) + (k & 1) AS gx, CAST(floor(fy) AS INT) + ((k >> 1) & 1) AS gy, CAST(floor(fz) AS INT) + (k >> 2) AS gz,
  (CASE WHEN k & 1 = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE WHEN (k >> 1) & 1 = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN k >> 2 = 1 THEN fz - floor(fz) ELSE 1 - (fz - floor(fz)) END) AS w
  FROM q CROSS JOIN (SELECT unnest(range(0, 8))::INT AS k))
SELECT CAST(anchor AS BIGINT) AS anchor, ox AS gx, oy AS gy, oz AS gz, round(sum(w * sdf), 6) + 0.0 AS sdf FROM r JOIN src USING (anchor, gx, gy, gz) GROUP BY anchor, ox, oy, oz HAVING count(*) = 8""")
def g15(spark, d):
    """Columns of chunks belong to three anchors in turn, which move by the first poses."""
    s = op.surface(voxels(spark, d)).withColumn("anchor", F.pmod(F.floor(F.col("gx") / fx.CHUNK), F.lit(3)) + 1)
    moved = op.resample(s, fx.poses(spark, d).withColumnRenamed("frame_id", "anchor").drop("tx_prev"), fx.VOXEL)
    return moved.withColumns({"anchor": F.col("anchor").cast("bigint"), "sdf": F.round("sdf", 6) + 0.0})


@query("g12_mesh_colour", duck("fx_dense", "fx_pose") + ",\n" + PTS + ",\n" + _sql() + """, p AS (SELECT frame_id * 10000 + u * 100 + v AS id, x + (tx + 0.00273) AS x, y + 0.00317 AS y, z + (tz + 0.00171) AS z FROM pts JOIN fx_pose USING (frame_id))
SELECT id, round(v.sum_r / v.n_c, 6) AS r FROM p JOIN vox v ON v.gx = CAST(floor(x / 0.05) AS INT) AND v.gy = CAST(floor(y / 0.05) AS INT) AND v.gz = CAST(floor(z / 0.05) AS INT) WHERE v.n_c > 0 AND v.sum_w > 0.5""")
def g12(spark, d):
    p = images.to_world(images.unproject_pixels(fx.dense(spark, d), CAM), _poses(spark, d))
    at = [F.floor(F.col(w) / fx.VOXEL).cast("int").alias(c) for w, c in (("wx", "gx"), ("wy", "gy"), ("wz", "gz"))]
    p = p.select((F.col("frame_id") * 10000 + F.col("u") * 100 + F.col("v")).alias("id"), *at)
    return p.join(op.surface(voxels(spark, d).filter("n_c > 0")).hint("merge"), ["gx", "gy", "gz"]).select("id", F.round("r", 6).alias("r"))


@query("g13_cell_lookup", _head() + """, p AS (SELECT frame_id * 10000 + u * 100 + v AS id, CAST(floor((x + (tx + 0.00273)) / 0.05) AS INT) AS gx, CAST(floor((y + 0.00317) / 0.05) AS INT) AS gy, CAST(floor((z + (tz + 0.00171)) / 0.05) AS INT) AS gz FROM pts JOIN fx_pose USING (frame_id))
SELECT id, round(sdf, 6) + 0.0 AS sdf, coalesce(round(weight, 6), 0) AS weight, sdf IS NOT NULL AS observed FROM p LEFT JOIN sdf USING (gx, gy, gz)""")
def g13_cell(spark, d):
    """Distance and weight of the cell that holds a point; weight 0 where nothing was observed."""
    p = images.to_world(images.unproject_pixels(fx.dense(spark, d), CAM), _poses(spark, d))
    p = p.select((F.col("frame_id") * 10000 + F.col("u") * 100 + F.col("v")).alias("id"), F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
    got = op.look_up(p, op.surface(voxels(spark, d)), fx.VOXEL, ["sdf", "weight"])
    return got.select("id", (F.round("sdf", 6) + 0.0).alias("sdf"), F.coalesce(F.round("weight", 6), F.lit(0.0)).alias("weight"), F.col("sdf").isNotNull().alias("observed"))


@query("j10_chunks_seen", duck("fx_dense", "fx_pose") + ",\n" + PTS + """, wp AS (SELECT frame_id, floor((x + tx + 0.00273) / 0.4) AS cx, floor((y + 0.00317) / 0.4) AS cy, floor((z + tz + 0.00171) / 0.4) AS cz FROM pts JOIN fx_pose USING (frame_id)),
box AS (SELECT frame_id, CAST(min(cx) AS INT) - 4 AS x0, CAST(max(cx) AS INT) + 5 AS x1, CAST(min(cy) AS INT) - 4 AS y0, CAST(max(cy) AS INT) + 5 AS y1, CAST(min(cz) AS INT) - 4 AS z0, CAST(max(cz) AS INT) + 5 AS z1 FROM wp GROUP BY frame_id),
c AS (SELECT frame_id, cx, cy, cz, i FROM box, LATERAL (SELECT unnest(range(x0, x1)) AS cx), LATERAL (SELECT unnest(range(y0, y1)) AS cy), LATERAL (SELECT unnest(range(z0, z1)) AS cz), (SELECT unnest(range(0, 9)) AS i)),
p AS (SELECT c.*, (cx + CASE WHEN i = 8 THEN 0.5 ELSE i & 1 END) * 0.4 - (tx + 0.00273) AS x, (cy + CASE WHEN i = 8 THEN 0.5 ELSE (i >> 1) & 1 END) * 0.4 - 0.00317 AS y, (cz + CASE WHEN i = 8 THEN 0.5 ELSE i >> 2 END) * 0.4 - (tz + 0.00171) AS z FROM c JOIN fx_pose USING (frame_id)),
h AS (SELECT p.frame_id, cx, cy, cz FROM p JOIN fx_dense d ON d.frame_id = p.frame_id AND d.u = CAST(floor(round(60.0 * x / z + 31.5, 9)) AS INT) AND d.v = CAST(floor(round(60.0 * y / z + 23.5, 9)) AS INT)
  WHERE z > 0 AND z < 3 AND d.depth_mm IS NOT NULL AND abs(d.depth_mm / 1000.0::DOUBLE - z) < abs(0.0019 * pow(d.depth_mm / 1000.0::DOUBLE, 2) + 0.00152 * (d.depth_mm / 1000.0::DOUBLE) + 0.001504) * 8.0 + sqrt(3.0) * 0.4)
SELECT frame_id, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, CAST(cz AS INT) AS cz, count(*) AS hits FROM h GROUP BY ALL HAVING count(*) > 2""")
def j10_seen(spark, d):
    """Nine samples a chunk; the SQL tries all chunks of a box around."""
    return images.chunks_seen(_pixels(spark, d).select("frame_id", "u", "v", "depth"), _poses(spark, d), fx.VOXEL * fx.CHUNK, CAM, g.quadratic_truncation)


def chunk_references(spark, d):
    """The frame that sees each chunk best, by its mean normal."""
    n = op.gradients(op.surface(voxels(spark, d)), fx.VOXEL)
    at = [F.floor(F.col(c) / fx.CHUNK).cast("int").alias(k) for c, k in (("gx", "cx"), ("gy", "cy"), ("gz", "cz"))]
    mean = n.groupBy(*at).agg(*[F.avg("d" + c).alias("n" + c) for c in "xyz"])
    return op.chunk_reference(mean, _chunks(spark, d), _poses(spark, d), fx.VOXEL, fx.CHUNK)


@query("j15_chunk_reference", _head() + ",\n" + _CHUNKS + """, s1 AS (SELECT *, (gx * 1000::BIGINT + gy) * 1000 + gz AS k FROM sdf WHERE sdf < 1),
told AS (SELECT s.k + o AS k, i, sdf FROM s1 s, (VALUES (-1000000, 0), (1000000, 1), (-1000, 2), (1000, 3), (-1, 4), (1, 5), (0, 6)) t(o, i)),
grad AS (SELECT k, (max(sdf) FILTER (i = 0) - max(sdf) FILTER (i = 1)) / 2 AS dx, (max(sdf) FILTER (i = 2) - max(sdf) FILTER (i = 3)) / 2 AS dy, (max(sdf) FILTER (i = 4) - max(sdf) FILTER (i = 5)) / 2 AS dz FROM told GROUP BY k HAVING count(*) = 7),
nrm AS (SELECT CAST(floor(gx / 8.0) AS INT) AS cx, CAST(floor(gy / 8.0) AS INT) AS cy, CAST(floor(gz / 8.0) AS INT) AS cz, avg(dx) AS nx, avg(dy) AS ny, avg(dz) AS nz FROM s1 JOIN grad USING (k) WHERE sqrt(dx * dx + dy * dy + dz * dz) <= 5.0 GROUP BY 1, 2, 3),
q AS (SELECT n.*, frame_id, cx * 0.4 - (tx + 0.00273) AS x, cy * 0.4 - 0.00317 AS y, cz * 0.4 - (tz + 0.00171) AS z FROM ch JOIN nrm n USING (cx, cy, cz) JOIN fx_pose USING (frame_id)),
b AS (SELECT *, round((nx * x + ny * y + nz * z) / sqrt(x * x + y * y + z * z), 9) AS quality FROM q WHERE z > 0)
SELECT cx, cy, cz, frame_id, round(quality, 6) + 0.0 AS quality FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY quality, frame_id DESC) AS rn FROM b) WHERE rn = 1""")
def j15(spark, d):
    return chunk_references(spark, d).withColumn("quality", F.round("quality", 6) + 0.0)


@query("g14_refined_depth")
def g14(spark, d):
    """Steps that depend on the ones before: tested on a plane."""
    pose = _poses(spark, d).select("frame_id", F.col("tx").alias("ox"), F.col("ty").alias("oy"), F.col("tz").alias("oz"))
    p = images.unproject_pixels(fx.dense(spark, d), CAM).join(pose.hint("shuffle_hash"), "frame_id")
    p = p.select("frame_id", "u", "v", F.col("z").alias("depth"), "ox", "oy", "oz", (F.col("x") / F.col("z")).alias("rx"), (F.col("y") / F.col("z")).alias("ry"), F.lit(1.0).alias("rz"))
    from lodeframe.operators.graph import kept

    return op.refine_depth(p, kept(op.surface(voxels(spark, d))), ["frame_id", "u", "v"], fx.VOXEL).withColumn("depth", F.round("depth", 6))
