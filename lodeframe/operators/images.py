"""Operators on depth images held as long tables (frame_id, u, v, depth, ...).

Spark takes an unfolded image for the size of the row that it was made of, and would broadcast it: pixels are merged with pixels,
and what has a row a frame is hashed within the frame's task, where pixels that lie by frame stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodeframe.functions import geometry as g
from lodeframe.functions.geometry import Camera, Vec, vec


def metric_depth(raw: Column, scale: float, near: float, far: float) -> Column:
    """Metres within [near, far], else null."""
    z = raw / F.lit(scale)
    return F.when((z >= near) & (z <= far), z)


def unproject_pixels(px: DataFrame, cam: Camera, depth: str = "depth_mm") -> DataFrame:
    """Adds camera-space x, y, z to the pixels that have a depth."""
    p = g.unproject(F.col("u"), F.col("v"), F.col(depth) / F.lit(cam.scale), cam)
    return px.filter(F.col(depth).isNotNull()).withColumns({"x": p.x, "y": p.y, "z": p.z})


def to_world(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Adds wx, wy, wz by each frame's pose."""
    w = g.apply_pose(g.pose_of(), vec("x", "y", "z"))
    extra = ["qx", "qy", "qz", "qw", "tx", "ty", "tz"]
    return points.join(poses.select("frame_id", *extra).hint("shuffle_hash"), "frame_id").withColumns({"wx": w.x, "wy": w.y, "wz": w.z}).drop(*extra)


def in_image(u: Column, v: Column, cam: Camera) -> Column:
    """Within the image, one pixel off its edge."""
    return (u >= 1) & (u < cam.width - 1) & (v >= 1) & (v < cam.height - 1)


def keypoint_depth(keypoints: DataFrame, px: DataFrame, cam: Camera, depth: str = "depth_mm") -> DataFrame:
    """Keypoints (frame_id, kp_id, x, y) in the image with a depth in (0, far), and their point."""
    at = keypoints.filter(in_image(F.col("x"), F.col("y"), cam)).withColumns({"u": F.floor("x").cast("int"), "v": F.floor("y").cast("int")})
    hit = at.join(px.select("frame_id", "u", "v", depth).hint("merge"), ["frame_id", "u", "v"])
    hit = hit.filter((F.col(depth) > 0) & (F.col(depth) < cam.far * cam.scale))
    p = g.unproject(F.col("x"), F.col("y"), F.col(depth) / F.lit(cam.scale), cam)
    return hit.withColumns({"px": p.x, "py": p.y, "pz": p.z})


#: Pixels are numbered column by column, with room for so many rows.
ROWS = 1 << 21


def _around(first: tuple[int, int], last: tuple[int, int] | None = None) -> WindowSpec:
    """The pixels of a frame whose numbers lie from that of the one `first` (du, dv) away to that of the one `last` away (only that one by default).
    All such windows have one order, so they are one pass over pixels that are sorted once, and pixels that lie by frame are not moved."""
    at = [du * ROWS + dv for du, dv in (first, last or first)]
    return Window.partitionBy("frame_id").orderBy(F.col("u").cast("bigint") * ROWS + F.col("v")).rangeBetween(*at)


def pixel_normals(points: DataFrame, limit: float = 0.3) -> DataFrame:
    """Adds the unit normal (nx, ny, nz) from the four neighbours' central differences; pixels that
    lack a neighbour, span `limit` metres or have no normal are left out. One pass of windows, no join."""
    xyz = ["x", "y", "z"]
    points = points.withColumns({name: F.first(F.struct(*xyz)).over(_around(at)) for name, at in (("__l", (-1, 0)), ("__r", (1, 0)), ("__t", (0, -1)), ("__b", (0, 1)))})
    get = lambda n: Vec(*(F.col(f"{n}.{c}") for c in xyz))
    across, down = g.sub(get("__r"), get("__l")), g.sub(get("__b"), get("__t"))
    n = g.cross(across, down)
    kept = points.filter((g.norm(across) < limit) & (g.norm(down) < limit)).withColumns({"__x": n.x, "__y": n.y, "__z": n.z})
    raw = vec("__x", "__y", "__z")
    kept = kept.withColumn("__n", g.norm(raw)).filter(g.dot(raw, raw) > 1e-18)
    return kept.withColumns({"nx": F.col("__x") / F.col("__n"), "ny": F.col("__y") / F.col("__n"), "nz": F.col("__z") / F.col("__n")}).drop(
        "__l", "__r", "__t", "__b", "__x", "__y", "__z", "__n"
    )


def reject_grazing(normals: DataFrame, least: float = 0.1) -> DataFrame:
    """Depth and normal 0 where the ray meets the surface at |cosine| < least."""
    bad = g.view_cosine(vec("x", "y", "z"), vec("nx", "ny", "nz")) < least
    return normals.withColumn("__bad", bad).withColumns({c: F.when(F.col("__bad"), 0.0).otherwise(F.col(c)) for c in ("z", "nx", "ny", "nz")}).drop("__bad")


def quads(px: DataFrame, depth: str) -> DataFrame:
    """Pixels whose right, lower and lower right neighbours all have a depth: d00, d10, d01, d11."""
    has = px.filter(F.col(depth).isNotNull()).select("frame_id", "u", "v", F.col(depth).alias("d00"))
    return has.withColumns({name: F.first("d00").over(_around(at)) for name, at in (("d10", (1, 0)), ("d01", (0, 1)), ("d11", (1, 1)))}).dropna(subset=["d10", "d01", "d11"])


def remove_edges(px: DataFrame, depth: str, limit: float) -> DataFrame:
    """Drops pixels that differ by more than `limit` from one of their eight neighbours.

    The neighbours are three windows of three pixels, one a column.
    """
    columns = [_around((du, -1), (du, 1)) for du in (-1, 0, 1)]
    lo, hi = ([f(depth).over(w) for w in columns] for f in (F.min, F.max))
    seen = px.select("frame_id", "u", "v", depth).withColumns({f"__{n}{k}": c for n, side in (("lo", lo), ("hi", hi)) for k, c in enumerate(side)})
    lo, hi = F.least(*[f"__lo{k}" for k in range(3)]), F.greatest(*[f"__hi{k}" for k in range(3)])
    return seen.filter(F.col(depth).isNotNull() & (hi - F.col(depth) <= limit) & (F.col(depth) - lo <= limit)).select("frame_id", "u", "v", depth)


def colour_at(points: DataFrame, colours: DataFrame, cam: Camera) -> DataFrame:
    """The colour of the pixel that each point projects to (cut off to whole pixels); black where
    there is none."""
    p = g.project(vec("x", "y", "z"), cam)
    whole = lambda c: F.round(c, 9).cast("int")
    at = points.withColumns({"__u": whole(p.x), "__v": whole(p.y)})
    side = colours.select(F.col("frame_id").alias("__f"), F.col("u").alias("__cu"), F.col("v").alias("__cv"), "r", "g", "b")
    hit = at.drop("r", "g", "b").join(side.hint("merge"), (F.col("frame_id") == F.col("__f")) & (F.col("__u") == F.col("__cu")) & (F.col("__v") == F.col("__cv")), "left")
    return hit.withColumns({c: F.coalesce(c, F.lit(0)) for c in "rgb"}).drop("__f", "__cu", "__cv", "__u", "__v")


def fill_holes(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Full outer join on the pixel; the first image's values where it has them."""
    key = ["frame_id", "u", "v"]
    both = first.select(*key, *columns).join(second.select(*key, *[F.col(c).alias("__" + c) for c in columns]), key, "full")
    return both.select(*key, *[F.coalesce(c, "__" + c).alias(c) for c in columns])


def keep_evenly(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """k evenly spaced rows of each group (all of a smaller one), the first always among them."""
    w = Window.partitionBy(group)
    n = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    step = lambda i: F.floor(i * k / F.col("__n"))
    return n.filter((F.col("__i") == 0) | (step(F.col("__i")) != step(F.col("__i") - 1))).drop("__i", "__n")


def cells_in_frustum(box: DataFrame, size: float, cam: Camera, near: float, far: float) -> DataFrame:
    """Cells of each box (lo_x .. hi_z) whose centre lies in the view frustum: cx, cy, cz."""
    for c in "xyz":
        box = box.withColumn("c" + c, F.explode(F.sequence(g.cell(F.col("lo_" + c), size), g.cell(F.col("hi_" + c), size))))
    centre = Vec(*((F.col("c" + c) + 0.5) * size for c in "xyz"))
    return box.filter(g.in_frustum(centre, cam, near, far))


def ray_cells(segments: DataFrame, key: str) -> DataFrame:
    """The unit cells (gx, gy, gz) that each segment (ax, ay, az) - (bx, by, bz) passes through.

    The places where it crosses grid planes are sorted as parameters in [0, 1]; between two of them
    it lies in the cell of the middle. All within the row: no shuffle but the last distinct.
    """
    def cuts(c: str) -> Column:
        a, b = F.col("a" + c), F.col("b" + c)
        lo, hi = F.floor(F.least(a, b)) + 1, F.floor(F.greatest(a, b))
        planes = F.when(hi >= lo, F.sequence(lo, F.greatest(hi, lo))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(planes, lambda k: F.try_divide(k - a, b - a))

    ends = F.array(F.lit(0.0), F.lit(1.0))
    t = F.array_sort(F.array_distinct(F.concat(ends, *[cuts(c) for c in "xyz"])))
    s = segments.withColumn("__t", t).withColumn("__m", F.explode(F.expr("transform(sequence(1, size(__t) - 1), i -> (__t[i - 1] + __t[i]) / 2)")))
    at = [F.floor(F.col("a" + c) + F.col("__m") * (F.col("b" + c) - F.col("a" + c))).cast("int").alias("g" + c) for c in "xyz"]
    return s.select(key, *at).distinct()


def project_into(points: DataFrame, relative: DataFrame, cam: Camera) -> DataFrame:
    """Points (frame_id, u, v, x, y, z) moved by `relative` (frame_id, to_frame, pose) and the
    nearest pixel (pu, pv) and depth pz that they get in the frame `to_frame`."""
    p = g.apply_pose(g.pose_of(), vec("x", "y", "z"))
    m = points.join(relative.hint("shuffle_hash"), "frame_id").withColumns({"__x": p.x, "__y": p.y, "pz": p.z}).filter("pz > 0")
    uv = g.project(vec("__x", "__y", "pz"), cam)
    return m.withColumns({"pu": F.floor(F.round(uv.x + 0.5, 9)).cast("int"), "pv": F.floor(F.round(uv.y + 0.5, 9)).cast("int")})


def agree_in_depth(projected: DataFrame, px: DataFrame, depth: str, tolerance: float = 0.05) -> DataFrame:
    """Depth of each projected pixel where the other frame's depth there is within `tolerance` of
    it, 0 where it differs, unchanged where the other frame has none. One equi-join on the pixel."""
    side = px.select(F.col("frame_id").alias("__f"), F.col("u").alias("__u"), F.col("v").alias("__v"), F.col(depth).alias("other"))
    hit = projected.join(side.hint("merge"), (F.col("to_frame") == F.col("__f")) & (F.col("pu") == F.col("__u")) & (F.col("pv") == F.col("__v")), "left")
    far = F.abs(F.col("other") - F.col("pz")) > tolerance * F.col("pz")
    return hit.withColumn("depth", F.when(F.col("other").isNotNull() & far, 0.0).otherwise(F.col("z"))).drop("__f", "__u", "__v")


def fuse_depth(projected: DataFrame, px: DataFrame, depth: str, weight: str, tolerance: float = 0.05) -> DataFrame:
    """Running weighted mean of a keyframe's depth with the new frame's depth at the projected
    pixel: (z * weight + other) / (weight + 1) where they agree, and the weight grows by one."""
    side = px.select(F.col("frame_id").alias("__f"), F.col("u").alias("__u"), F.col("v").alias("__v"), F.col(depth).alias("other"))
    hit = projected.join(side.hint("merge"), (F.col("to_frame") == F.col("__f")) & (F.col("pu") == F.col("__u")) & (F.col("pv") == F.col("__v")), "left")
    near = F.coalesce(F.abs(F.col("other") - F.col("pz")) <= tolerance * F.col("pz"), F.lit(False))
    mean = (F.col("z") * F.col(weight) + F.col("other") - F.col("pz") + F.col("z")) / (F.col(weight) + 1)
    return hit.withColumns({"depth": F.when(near, mean).otherwise(F.col("z")), "new_weight": F.col(weight) + F.when(near, 1).otherwise(0)}).drop("__f", "__u", "__v")


def depths_around(px: DataFrame, depth: str) -> DataFrame:
    """(frame_id, u, v, q): the depths of each pixel, its right, its lower and its lower right neighbour, 0 where there is none. Each pixel
    tells the four that it is part of: one grouping, no join."""
    told = px.select("frame_id", F.col("u"), F.col("v"), F.col(depth).alias("__d"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("__k"))
    told = told.select("frame_id", (F.col("u") - F.col("__k").bitwiseAND(1)).alias("u"), (F.col("v") - F.shiftright("__k", 1)).alias("v"), "__k", "__d")
    pick = lambda k: F.coalesce(F.max(F.when(F.col("__k") == k, F.col("__d"))), F.lit(0.0))
    return told.groupBy("frame_id", "u", "v").agg(F.array(*[pick(k) for k in range(4)]).alias("q"))


def refine_depth(points: DataFrame, relative: DataFrame, px: DataFrame, depth: str, weight: str, cam: Camera, tolerance: float = 0.05, step: float = 0.1, border: int = 2, near: float = 0.01, far: float = 10.0) -> DataFrame:
    """A keyframe's depths refined by a new frame's: points (frame_id, u, v, x, y, z, weight) with depth and new_weight.

    A point is moved by `relative` (frame_id, to_frame, pose) and projected; where it falls more than `border` pixels inside the image the new frame's
    depth is taken there: bilinear among the four pixels around if none differs from the upper left by `step` or more, else the nearest pixel's (0 where
    there is none). If it is within `tolerance` of the point's depth, the point moves to it along the new frame's ray, goes back, and its
    depth enters the running mean, whose weight grows by one. Points beyond [near, far] or outside the image stay as they are. One equi-join on (frame, pixel).
    """
    pose = g.pose_of()
    p = g.apply_pose(pose, vec("x", "y", "z"))
    m = points.join(relative.hint("shuffle_hash"), "frame_id", "left").withColumns({"__x": p.x, "__y": p.y, "__z": p.z})
    uv = g.project(vec("__x", "__y", "__z"), cam)
    at = lambda c: F.round(c, 9)
    m = m.withColumns({"__u": at(uv.x), "__v": at(uv.y)})
    inside = (F.col("__z") > 0) & F.col("z").between(near, far) & (F.col("__u") > border) & (F.col("__u") < cam.width - border) & (F.col("__v") > border) & (F.col("__v") < cam.height - border)
    m = m.withColumns({"__i": F.when(inside, F.floor("__u")).cast("int"), "__j": F.when(inside, F.floor("__v")).cast("int")})
    side = depths_around(px, depth).select(F.col("frame_id").alias("to_frame"), F.col("u").alias("__i"), F.col("v").alias("__j"), "q")
    hit = m.join(side.hint("merge"), ["to_frame", "__i", "__j"], "left")
    q = [F.get("q", F.lit(k)) for k in range(4)]
    fu, fv = F.col("__u") - F.col("__i"), F.col("__v") - F.col("__j")
    smooth = (F.abs(q[0] - q[1]) < step) & (F.abs(q[0] - q[2]) < step) & (F.abs(q[0] - q[3]) < step)
    bilinear = (1 - fu) * (1 - fv) * q[0] + fu * (1 - fv) * q[1] + (1 - fu) * fv * q[2] + fu * fv * q[3]
    nearest = F.get("q", F.when(fu >= 0.5, 1).otherwise(0) + F.when(fv >= 0.5, 2).otherwise(0))
    hit = hit.withColumn("__d", F.when(smooth, bilinear).otherwise(nearest))
    near_enough = F.coalesce(F.abs(F.col("__d") - F.col("__z")) < tolerance * F.col("__z"), F.lit(False))
    s = F.col("__d") / F.col("__z")
    back = g.apply_pose(g.invert(pose), Vec(F.col("__x") * s, F.col("__y") * s, F.col("__z") * s)).z
    mean = (F.col("z") * F.col(weight) + back) / (F.col(weight) + 1)
    return hit.withColumns({"depth": F.when(near_enough, mean).otherwise(F.col("z")), "new_weight": F.col(weight) + F.when(near_enough, 1).otherwise(0)}).drop("q", "__x", "__y", "__z", "__u", "__v", "__i", "__j", "__d")


def chunks_seen(pixels: DataFrame, poses: DataFrame, side: float, cam: Camera, truncation: Callable[[Column], Column], far: float = 3.0, least: int = 3) -> DataFrame:
    """(frame_id, cx, cy, cz, hits): chunks of `side` metres of which `least` or more of nine samples, the corners and the middle, lie on
    the image and within the truncation distance plus the chunk's diagonal of the depth at their pixel, no farther than `far`.

    Coarse first: chunks around those that hold a pixel's point, as far as a sample can lie from its pixel's surface; each chunk
    once a frame. Then their nine samples meet pixels by an equi-join. pixels: frame_id, u, v, depth (metres), within the image.
    """
    seen = pixels.filter("depth is not null")
    pose = g.pose_of()
    point = g.apply_pose(pose, g.unproject(F.col("u"), F.col("v"), F.col("depth"), cam))
    held = seen.join(poses.hint("shuffle_hash"), "frame_id").select("frame_id", *[F.floor(c / side).cast("int").alias(n) for c, n in zip(point, ("cx", "cy", "cz"), strict=True)], truncation(F.col("depth")).alias("__t"))
    reach = F.ceil((F.max("__t") + 3**0.5 * side) / side).cast("int") + 1
    held = held.groupBy("frame_id", "cx", "cy", "cz").agg(reach.alias("__r"))
    for c in ("cx", "cy", "cz"):
        held = held.withColumn(c, F.explode(F.sequence(F.col(c) - F.col("__r"), F.col(c) + F.col("__r"))))
    coarse = held.select("frame_id", "cx", "cy", "cz").distinct()
    spots = F.array(*[F.struct(*[F.lit(float(k >> i & 1)).alias(n) for i, n in enumerate("xyz")]) for k in range(8)], F.struct(*[F.lit(0.5).alias(n) for n in "xyz"]))
    at = coarse.join(poses.hint("shuffle_hash"), "frame_id").withColumn("__o", F.explode(spots))
    p = g.apply_pose(g.invert(pose), Vec(*((F.col(c) + F.col("__o")[n]) * side for c, n in zip(("cx", "cy", "cz"), "xyz", strict=True))))
    at = at.select("frame_id", "cx", "cy", "cz", p.x.alias("__x"), p.y.alias("__y"), p.z.alias("__z")).filter((F.col("__z") > 0) & (F.col("__z") < far))
    uv = g.project(vec("__x", "__y", "__z"), cam)
    at = at.select("frame_id", "cx", "cy", "cz", "__z", F.floor(F.round(uv.x, 9)).cast("int").alias("u"), F.floor(F.round(uv.y, 9)).cast("int").alias("v"))
    hit = at.join(seen.select("frame_id", "u", "v", "depth").hint("merge"), ["frame_id", "u", "v"]).filter(F.abs(F.col("depth") - F.col("__z")) < truncation(F.col("depth")) + 3**0.5 * side)
    return hit.groupBy("frame_id", "cx", "cy", "cz").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)
