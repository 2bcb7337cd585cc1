"""Triangles from the voxel grid: the case table is derived from a rule, the rest is joins."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.geometry import Vec, edge_crossing
from lodeframe.operators.voxels import CELL, cube_mask

#: Corners of each face of a cube, counter-clockwise seen from outside; corner k lies at offset
#: (k & 1, k >> 1 & 1, k >> 2).
FACES = ((0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6))


def triangles_of(mask: int) -> list[tuple[tuple[int, int], ...]]:
    """The triangles of a cube whose corners in `mask` lie inside, as triples of edges (corner, corner).

    On each face every run of inside corners is cut off by one segment, from the edge by which the
    walk around the face leaves the run to the one by which it entered. An edge is left on one of
    its two faces and entered on the other, so segments join to loops; each loop becomes a fan.
    Faces alone decide, so neighbouring cubes agree.
    """
    inside = [bool(mask >> k & 1) for k in range(8)]
    step: dict[tuple[int, int], tuple[int, int]] = {}
    for face in FACES:
        crossings = [(a, b) for a, b in zip(face, face[1:] + face[:1], strict=True) if inside[a] != inside[b]]
        for i, (a, b) in enumerate(crossings):
            if inside[a]:  # leaves a run, whose entry is the crossing before
                c, d = crossings[i - 1]
                step[min(a, b), max(a, b)] = (min(c, d), max(c, d))
    out = []
    while step:
        loop = [min(step)]
        while (after := step.pop(loop[-1])) != loop[0]:
            loop.append(after)
        out += [(loop[0], loop[i + 1], loop[i]) for i in range(1, len(loop) - 1)]  # counter-clockwise from outside
    return out


def case_table() -> list[tuple[int, int, int, int, int]]:
    """(mask, triangle, corner of it, first and second cube corner of the edge) of all 256 masks."""
    rows = []
    for mask, (t, tri) in itertools.chain.from_iterable(((m, x) for x in enumerate(triangles_of(m))) for m in range(256)):
        rows += [(mask, t, k, a, b) for k, (a, b) in enumerate(tri)]
    return rows


def extract_triangles(surface_rows: DataFrame, normals: DataFrame, voxel: float, least_weight: float = 50.0) -> DataFrame:
    """Triangle corners (cell, tri, corner, x, y, z, nx, ny, nz, r, g, b) of cubes with all eight
    corners observed.

    A vertex takes the normal, weight and colour of the nearer end of its edge (the first if both
    are as near). A triangle stays if all three normals are known and weights above `least_weight`.
    surface_rows: cell, sdf, weight, r, g, b; normals: cell, dx, dy, dz. Two groupings on cells and
    one join against the case table, which has a fixed size.
    """
    spark = surface_rows.sparkSession
    info = surface_rows.join(normals.hint("merge"), CELL, "left")
    k = info.select(*CELL, F.struct("sdf", "weight", "r", "g", "b", "dx", "dy", "dz").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    off = (F.col("k").bitwiseAND(1), F.shiftright("k", 1).bitwiseAND(1), F.shiftright("k", 2))
    cubes = k.select(*[(F.col(c) - o).alias(c) for c, o in zip(CELL, off, strict=True)], "k", "c")
    cubes = cubes.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("__c")).filter(F.size("__c") == 8)
    cubes = cubes.select(*CELL, F.col("__c.c").alias("c")).withColumn("mask", cube_mask(F.col("c.sdf")))
    table = spark.createDataFrame(case_table(), "mask int, tri int, corner int, a int, b int")
    at = cubes.join(F.broadcast(table), "mask").select(*CELL, "tri", "corner", "a", "b", F.get("c", F.col("a")).alias("p"), F.get("c", F.col("b")).alias("q"))

    def place(end: str) -> Vec:
        o = (F.col(end).bitwiseAND(1), F.shiftright(end, 1).bitwiseAND(1), F.shiftright(end, 2))
        return Vec(*((F.col(c) + i + 0.5) * voxel for c, i in zip(CELL, o, strict=True)))

    v = edge_crossing(place("a"), place("b"), F.col("p.sdf"), F.col("q.sdf"))
    near = F.when(F.abs("p.sdf") <= F.abs("q.sdf"), F.col("p")).otherwise(F.col("q"))
    out = at.select(*CELL, "tri", "corner", v.x.alias("x"), v.y.alias("y"), v.z.alias("z"), near.alias("n"))
    whole = out.groupBy(*CELL, "tri").agg(
        F.min(F.col("n.dx").isNotNull() & (F.col("n.weight") > least_weight)).alias("ok"), F.collect_list(F.struct("corner", "x", "y", "z", "n")).alias("v")
    )
    flat = whole.filter("ok").select(*CELL, "tri", F.explode("v").alias("v")).select(*CELL, "tri", "v.*")
    size = F.sqrt(F.col("n.dx") * F.col("n.dx") + F.col("n.dy") * F.col("n.dy") + F.col("n.dz") * F.col("n.dz"))
    unit = [F.try_divide(F.col(f"n.d{c}"), size).alias(f"n{c}") for c in "xyz"]
    return flat.select(*CELL, "tri", "corner", "x", "y", "z", *unit, "n.r", "n.g", "n.b")
