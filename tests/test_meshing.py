"""The case table, and a mesh of an analytic sphere."""

from __future__ import annotations

import math

from lodeframe.operators import meshing
from lodeframe.operators.voxels import gradients


def test_case_table_closes_every_mask():
    """Each crossed edge of a cube is in its triangles, and inner triangle sides cancel out."""
    assert meshing.triangles_of(0) == meshing.triangles_of(255) == [] and len(meshing.triangles_of(1)) == 1
    for mask in range(256):
        crossed = {(a, b) for a in range(8) for b in range(a, 8) if (a ^ b) in (1, 2, 4) and (mask >> a & 1) != (mask >> b & 1)}
        tris = meshing.triangles_of(mask)
        assert {e for t in tris for e in t} == crossed
        sides = [(t[i], t[(i + 1) % 3]) for t in tris for i in range(3)]
        assert len(sides) == len(set(sides))


def test_sphere(spark):
    n, radius, voxel = 14, 0.31, 0.1
    rows = []
    for i in range(-n // 2, n // 2):
        for j in range(-n // 2, n // 2):
            for k in range(-n // 2, n // 2):
                d = math.dist([(c + 0.5) * voxel for c in (i, j, k)], (0, 0, 0)) - radius
                rows.append((i, j, k, d, 100.0, 255.0, 255.0, 255.0))
    grid = spark.createDataFrame(rows, "gx int, gy int, gz int, sdf double, weight double, r double, g double, b double")
    got = meshing.extract_triangles(grid, gradients(grid, voxel), voxel).collect()
    tris = {}
    for r in got:
        tris.setdefault((r.gx, r.gy, r.gz, r.tri), {})[r.corner] = r
        assert abs(math.sqrt(r.x**2 + r.y**2 + r.z**2) - radius) < 0.02
        assert (r.x * r.nx + r.y * r.ny + r.z * r.nz) / radius > 0.9
    sides, area = {}, 0.0
    for t in tris.values():
        p = [tuple(round(getattr(t[k], c), 9) for c in "xyz") for k in range(3)]
        u, v = [b - a for a, b in zip(p[0], p[1], strict=True)], [b - a for a, b in zip(p[0], p[2], strict=True)]
        cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        assert sum(c * x for c, x in zip(cross, p[0], strict=True)) >= -1e-12  # seen from outside, counter-clockwise
        area += math.sqrt(sum(c * c for c in cross)) / 2
        for k in range(3):
            sides[p[k], p[(k + 1) % 3]] = sides.get((p[k], p[(k + 1) % 3]), 0) + 1
    assert all(sides.get((b, a), 0) == n for (a, b), n in sides.items())  # a closed surface
    assert abs(area - 4 * math.pi * radius**2) < 0.05 * area
