"""Meshes of the fused fixture grid."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodeframe.functions import color
from lodeframe.operators import meshing
from lodeframe.operators.graph import kept, shared_root
from lodeframe.operators import voxels as op
from lodeframe.plans import fixtures as fx
from lodeframe.plans.registry import query
from lodeframe.plans.voxels import _CHUNKS, _CUBES, _head, chunk_references, observations, voxels
from lodeframe.sinks import mesh_lines, number_vertices
from lodeframe.streaming.maps import VoxelMap

#: The fixture's frames are few, so a corner needs less weight than by default.
LEAST = 1.0
_CASES = ", ".join(f"({m},{t},{k},{a},{b})" for m, t, k, a, b in meshing.case_table())
_MESH = _head() + ",\n" + _CUBES + f""", s1 AS MATERIALIZED (SELECT gx, gy, gz, sdf, weight, {", ".join(f"CASE WHEN n_c > 0 THEN sum_{c} / n_c ELSE 255.0 END AS {c}" for c in "rgb")}, (gx * 1000::BIGINT + gy) * 1000 + gz AS k FROM sdf),
told AS (SELECT s.k + o AS k, i, sdf FROM s1 s, (VALUES (-1000000, 0), (1000000, 1), (-1000, 2), (1000, 3), (-1, 4), (1, 5), (0, 6)) t(o, i) WHERE sdf < 1),
grad AS (SELECT k, (max(sdf) FILTER (i = 0) - max(sdf) FILTER (i = 1)) / 2 AS dx, (max(sdf) FILTER (i = 2) - max(sdf) FILTER (i = 3)) / 2 AS dy, (max(sdf) FILTER (i = 4) - max(sdf) FILTER (i = 5)) / 2 AS dz FROM told GROUP BY k HAVING count(*) = 7),
cases(mask, tri, corner, a, b) AS (VALUES {_CASES}),
ends AS (SELECT gx, gy, gz, tri, corner, gx + (a & 1) AS ax, gy + ((a >> 1) & 1) AS ay, gz + (a >> 2) AS az, gx + (b & 1) AS bx, gy + ((b >> 1) & 1) AS by_, gz + (b >> 2) AS bz FROM cubes c JOIN cases t ON t.mask = c.mask WHERE c.n = 8),
vert AS (SELECT e.*, p.sdf AS sp, q.sdf AS sq, p.sdf / (p.sdf - q.sdf) AS t, CASE WHEN abs(p.sdf) <= abs(q.sdf) THEN p.k ELSE q.k END AS nk FROM ends e
  JOIN s1 p ON p.k = (ax * 1000::BIGINT + ay) * 1000 + az JOIN s1 q ON q.k = (bx * 1000::BIGINT + by_) * 1000 + bz),
full_ AS (SELECT v.*, n.r, n.g, n.b, n.weight, g.dx, g.dy, g.dz, sqrt(g.dx * g.dx + g.dy * g.dy + g.dz * g.dz) AS len, count(*) FILTER (g.dx IS NOT NULL AND n.weight > {LEAST} AND sqrt(g.dx * g.dx + g.dy * g.dy + g.dz * g.dz) <= 5.0) OVER (PARTITION BY v.gx, v.gy, v.gz, v.tri) AS good
  FROM vert v JOIN s1 n ON n.k = v.nk LEFT JOIN grad g ON g.k = v.nk),
mesh AS (SELECT gx, gy, gz, tri, corner, (ax + 0.5 + t * (bx - ax)) * 0.05 AS x, (ay + 0.5 + t * (by_ - ay)) * 0.05 AS y, (az + 0.5 + t * (bz - az)) * 0.05 AS z, dx / len AS nx, dy / len AS ny, dz / len AS nz, r, g, b FROM full_ WHERE good = 3)"""


def _triangles(spark, d):
    """The surface is written once, as cells and gradients both read it."""
    s = kept(op.surface(voxels(spark, d)))
    return meshing.extract_triangles(s, op.gradients(s, fx.VOXEL), fx.VOXEL, LEAST)


def _r6(*names):
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


_SQL6 = lambda *names: ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


@query("g11_marching_cubes", _MESH + f"\nSELECT gx, gy, gz, CAST(tri AS INT) AS tri, CAST(corner AS INT) AS corner, {_SQL6('x', 'y', 'z', 'nx', 'ny', 'nz', 'r', 'g', 'b')} FROM mesh")
def g11(spark, d):
    return _triangles(spark, d).select("gx", "gy", "gz", "tri", "corner", *_r6("x", "y", "z", "nx", "ny", "nz", "r", "g", "b"))


_COLOURS = _MESH + """, v3 AS MATERIALIZED (SELECT (gx * 1000::BIGINT + gy) * 1000 + gz AS k, sum(CASE WHEN c THEN r ELSE 0 END) / sum(c::INT) AS r, sum(CASE WHEN c THEN g ELSE 0 END) / sum(c::INT) AS g, sum(CASE WHEN c THEN b ELSE 0 END) / sum(c::INT) AS b
  FROM (SELECT *, abs(d) < sqrt(3.0) * 0.05 + 0.01 AS c FROM obs) GROUP BY gx, gy, gz HAVING sum(c::INT) > 0 AND sum(w) > 0.5),
pt AS MATERIALIZED (SELECT gx, gy, gz, tri, corner, CAST(floor(round(x / 0.05 - 0.5, 9)) AS INT) AS bx, CAST(floor(round(y / 0.05 - 0.5, 9)) AS INT) AS by_, CAST(floor(round(z / 0.05 - 0.5, 9)) AS INT) AS bz, x, y, z FROM mesh),
ask AS (SELECT *, x / 0.05 - 0.5 - bx AS fx, y / 0.05 - 0.5 - by_ AS fy, z / 0.05 - 0.5 - bz AS fz, i & 1 AS ox, (i >> 1) & 1 AS oy, i >> 2 AS oz FROM pt, (SELECT unnest(range(0, 8)) AS i)),
got AS (SELECT a.*, CASE WHEN ox = 1 THEN fx ELSE 1 - fx END * CASE WHEN oy = 1 THEN fy ELSE 1 - fy END * CASE WHEN oz = 1 THEN fz ELSE 1 - fz END AS wt, (fx >= 0.5) = (ox = 1) AND (fy >= 0.5) = (oy = 1) AND (fz >= 0.5) = (oz = 1) AS own, c.r, c.g, c.b
  FROM ask a LEFT JOIN v3 c ON c.k = ((bx + ox) * 1000::BIGINT + by_ + oy) * 1000 + bz + oz)"""


@query("g12_vertex_colours", _COLOURS + """
SELECT gx, gy, gz, CAST(tri AS INT) AS tri, CAST(corner AS INT) AS corner, count(r) = 8 AS smooth, """ + ", ".join(f"round(CASE WHEN count({c}) = 8 THEN sum(wt * {c}) ELSE max({c}) FILTER (own) END, 6) AS {c}" for c in "rgb") + " FROM got GROUP BY gx, gy, gz, tri, corner")
def g12_vertices(spark, d):
    """All three channels at the vertices of the mesh, trilinear or of the vertex's cell."""
    v = kept(voxels(spark, d))
    s = op.surface(v)
    at = ["gx", "gy", "gz", "tri", "corner"]
    mesh = kept(meshing.extract_triangles(s, op.gradients(s, fx.VOXEL), fx.VOXEL, LEAST).select(F.struct(*at).alias("id"), "x", "y", "z"))
    got = op.sample_trilinear(mesh, op.surface(v.filter("n_c > 0")), "id", fx.VOXEL, ["r", "g", "b"])
    return got.select("id.*", "smooth", *[F.round(c, 6).alias(c) for c in "rgb"])


def _replayed(spark, d):
    """The map after a stream of three files of observations, each read by a stream that starts where the one before ended."""
    root = f"{shared_root(spark)}/lodeframe-map-{uuid.uuid4().hex}"
    seen = kept(observations(spark, d))
    for k in range(3):
        seen.filter(f"frame_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        here = VoxelMap(spark, f"{root}/map", fx.CHUNK, fx.VOXEL, LEAST)
        here.follow(stream).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return here


@query("r5_map_grid", _head() + "\nSELECT gx, gy, gz, round(sum_wd, 5) + 0.0 AS sum_wd, round(sum_w, 5) AS sum_w, sum_r, sum_g, sum_b, n_c FROM vox WHERE abs(sum_w) > 1e-9")
def r5_grid(spark, d):
    return _replayed(spark, d).grid().select("gx", "gy", "gz", (F.round("sum_wd", 5) + 0.0).alias("sum_wd"), F.round("sum_w", 5).alias("sum_w"), "sum_r", "sum_g", "sum_b", "n_c")


@query("r5_map_mesh", _MESH + f"\nSELECT gx, gy, gz, CAST(tri AS INT) AS tri, CAST(corner AS INT) AS corner, {_SQL6('x', 'y', 'z', 'nx', 'ny', 'nz', 'r', 'g', 'b')} FROM mesh")
def r5_mesh(spark, d):
    """Only chunks that a file's observations tell are meshed anew."""
    return _replayed(spark, d).mesh().select("gx", "gy", "gz", "tri", "corner", *_r6("x", "y", "z", "nx", "ny", "nz", "r", "g", "b"))


_ORDER = "CAST(floor(gx / 8.0) AS INT), CAST(floor(gy / 8.0) AS INT), CAST(floor(gz / 8.0) AS INT), gx, gy, gz, tri, corner"


def _numbered(spark, d):
    chunks = {c: F.floor(F.col(g) / fx.CHUNK).cast("int") for g, c in (("gx", "cx"), ("gy", "cy"), ("gz", "cz"))}
    return number_vertices(_triangles(spark, d).withColumns(chunks), ["cx", "cy", "cz"], ["gx", "gy", "gz", "tri", "corner"])


@query("s12_mesh_sink", _MESH + f""", v AS (SELECT row_number() OVER (ORDER BY {_ORDER}) - 1 AS n, * FROM mesh)
SELECT CAST(0 AS INT) AS part, CAST(n AS BIGINT) AS n, value FROM (SELECT unnest(range(0, 12)) AS n, unnest(['ply', 'format ascii 1.0', format('element vertex {{}}', (SELECT count(*) FROM v)), 'property float x', 'property float y', 'property float z', 'property uchar red', 'property uchar green', 'property uchar blue',
  format('element face {{}}', (SELECT count(*) // 3 FROM v)), 'property list uchar int vertex_index', 'end_header']) AS value)
UNION ALL SELECT CAST(1 AS INT), n, format('{{:.6f}} {{:.6f}} {{:.6f}} {{}} {{}} {{}}', round(x, 3) + 0.0, round(y, 3) + 0.0, round(z, 3) + 0.0, CAST(trunc(round(r, 6)) AS INT), CAST(trunc(round(g, 6)) AS INT), CAST(trunc(round(b, 6)) AS INT)) FROM v
UNION ALL SELECT CAST(2 AS INT), n // 3, format('3 {{}} {{}} {{}}', n, n + 1, n + 2) FROM v WHERE n % 3 = 0""")
def s12(spark, d):
    """Positions are rounded to a millimetre, as the SQL does."""
    v = _numbered(spark, d)
    return mesh_lines(v.withColumns({c: F.round(c, 3) + 0.0 for c in "xyz"} | {c: F.round(c, 6) for c in "rgb"}))


@query("s14_flat_vertices", _MESH + ",\n" + _CHUNKS + f""", v AS (SELECT row_number() OVER (ORDER BY {_ORDER}) - 1 AS n, * FROM mesh),
nrm AS (SELECT CAST(floor(gx / 8.0) AS INT) AS cx, CAST(floor(gy / 8.0) AS INT) AS cy, CAST(floor(gz / 8.0) AS INT) AS cz, avg(dx) AS nx, avg(dy) AS ny, avg(dz) AS nz FROM s1 JOIN grad USING (k) WHERE sqrt(dx * dx + dy * dy + dz * dz) <= 5.0 GROUP BY 1, 2, 3),
q AS (SELECT n.*, frame_id, cx * 0.4 - (tx + 0.00273) AS x, cy * 0.4 - 0.00317 AS y, cz * 0.4 - (tz + 0.00171) AS z FROM ch JOIN nrm n USING (cx, cy, cz) JOIN fx_pose USING (frame_id)),
b AS (SELECT *, round((nx * x + ny * y + nz * z) / sqrt(x * x + y * y + z * z), 9) AS quality FROM q WHERE z > 0),
best AS (SELECT cx, cy, cz, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY quality, frame_id DESC) AS rn FROM b) WHERE rn = 1)
SELECT CAST(n AS BIGINT) AS vertex, {_SQL6('v.x', 'v.y', 'v.z').replace('AS v.', 'AS ')}, 1.0::DOUBLE AS w, CAST((CAST(trunc(round(r, 6)) AS INT) << 16) + (CAST(trunc(round(g, 6)) AS INT) << 8) + CAST(trunc(round(b, 6)) AS INT) AS DOUBLE) AS rgb, 0.0::DOUBLE AS spare, CAST(tri AS DOUBLE) AS part,
  coalesce(CAST(frame_id AS DOUBLE), -1.0) AS anchor, {_SQL6('v.nx', 'v.ny', 'v.nz').replace('AS v.', 'AS ')}, 0.05::DOUBLE AS radius
FROM v LEFT JOIN best ON best.cx = CAST(floor(gx / 8.0) AS INT) AND best.cy = CAST(floor(gy / 8.0) AS INT) AND best.cz = CAST(floor(gz / 8.0) AS INT)""")
def s14(spark, d):
    """Twelve numbers a vertex: position, w, packed colour, a spare one, triangle, anchor, normal and radius. The anchor
    is the reference frame of the vertex's chunk, -1 where it has none."""
    v = _numbered(spark, d).join(chunk_references(spark, d).select("cx", "cy", "cz", F.col("frame_id").cast("double").alias("__f")), ["cx", "cy", "cz"], "left")
    rgb = color.pack(*[F.round(c, 6).cast("int") for c in "rgb"]).cast("double")
    return v.select("vertex", *_r6("x", "y", "z"), F.lit(1.0).alias("w"), rgb.alias("rgb"), F.lit(0.0).alias("spare"), F.col("tri").cast("double").alias("part"), F.coalesce("__f", F.lit(-1.0)).alias("anchor"), *_r6("nx", "ny", "nz"), F.lit(fx.VOXEL).alias("radius"))


@query("d2_mesh_union", _MESH + "\nSELECT CAST(floor(gx / 8.0) AS INT) AS cx, CAST(floor(gy / 8.0) AS INT) AS cy, CAST(floor(gz / 8.0) AS INT) AS cz, count(*) AS n FROM mesh GROUP BY ALL")
def d2(spark, d):
    """The meshes of border and inner cells, made apart and put together, by chunk."""
    mesh = _triangles(spark, d)
    border = (F.pmod("gx", F.lit(fx.CHUNK)) == fx.CHUNK - 1) | (F.pmod("gy", F.lit(fx.CHUNK)) == fx.CHUNK - 1) | (F.pmod("gz", F.lit(fx.CHUNK)) == fx.CHUNK - 1)
    both = mesh.filter(border).unionByName(mesh.filter(~border))
    return both.groupBy(*[F.floor(F.col(g) / fx.CHUNK).cast("int").alias(c) for g, c in (("gx", "cx"), ("gy", "cy"), ("gz", "cz"))]).agg(F.count("*").alias("n"))
