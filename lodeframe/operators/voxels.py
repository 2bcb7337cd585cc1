"""Voxel-grid fusion: cells are rows (gx, gy, gz) with sums, so that fusing is adding and
retracting is adding the negative.

Cells and samples are unfolded from pixels, which Spark's estimates don't see: joins on them are merged, never broadcast; poses are
hashed within their frames' tasks (see images)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import geometry as g
from lodeframe.functions.geometry import Camera, Vec, vec

CELL = ["gx", "gy", "gz"]
SUMS = ["sum_wd", "sum_w", "sum_r", "sum_g", "sum_b", "n_c"]
#: Below this weight a cell counts as unobserved.
LEAST_WEIGHT = 0.5


def band_cells(points: DataFrame, poses: DataFrame, voxel: float, before: float, behind: float) -> DataFrame:
    """(frame_id, gx, gy, gz): the cells along each pixel's ray from `before` metres in front of
    its depth to `behind` metres after it, sampled at half a voxel; each once a frame.

    Driven by pixels, so no candidate volume is scanned. points: camera-space frame_id, x, y, z.
    """
    steps = int((before + behind) / (voxel / 2)) + 1
    k = points.select("frame_id", "x", "y", "z").join(poses.hint("shuffle_hash"), "frame_id").withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    f = 1 + (F.col("__k") * (voxel / 2) - before) / F.col("z")
    k = k.withColumns({c: F.col(c) * f for c in "xyz"})
    w = g.apply_pose(g.pose_of(), vec("x", "y", "z"))
    cells = [g.cell(c, voxel).alias(n) for c, n in zip(w, CELL, strict=True)]
    return k.select("frame_id", *cells).distinct()


def observe(cells: DataFrame, pixels: DataFrame, poses: DataFrame, cam: Camera, voxel: float, chunk: int, truncation: Callable[[Column], Column] = g.quadratic_truncation, weigh: Callable[[Column], Column] = g.observation_weight, near: float = 0.1, back: float = 0.03) -> DataFrame:
    """(frame_id, cell, sums): each candidate cell reads the one pixel that its centre projects to.

    An observation counts within (-back, truncation + sqrt(3) voxel) of the surface; truncation and
    weight are taken at the camera depth of the chunk's origin. Colour counts near the surface.
    pixels: frame_id, u, v, depth (metres), r, g, b. `truncation` and `weigh` can be replaced.
    """
    pose = g.invert(g.pose_of())
    centre = Vec(*((F.col(c) + 0.5) * voxel for c in CELL))
    origin = Vec(*(F.floor(F.col(c) / chunk) * (chunk * voxel) for c in CELL))
    at = cells.join(poses.hint("shuffle_hash"), "frame_id")
    p = g.apply_pose(pose, centre)
    at = at.withColumns({"__x": p.x, "__y": p.y, "__z": p.z, "__o": g.apply_pose(pose, origin).z}).filter((F.col("__z") > near) & (F.col("__z") < cam.far))
    uv = g.project(vec("__x", "__y", "__z"), cam)
    at = at.withColumns({"u": F.floor(uv.x + 0.5).cast("int"), "v": F.floor(uv.y + 0.5).cast("int")})
    hit = at.join(pixels.filter("depth is not null").hint("merge"), ["frame_id", "u", "v"])
    trunc = truncation(F.col("__o"))
    d = F.col("depth") - F.col("__z")
    hit = hit.withColumns({"__d": d, "__t": trunc}).filter((F.col("__d") > -back) & (F.col("__d") < F.col("__t") + 3**0.5 * voxel))
    w = weigh(F.col("__t"))
    close = F.abs("__d") < 3**0.5 * voxel + 0.01
    colour = [F.when(close, F.col(c).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("sum_" + c) for c in "rgb"]
    return hit.select("frame_id", *CELL, (w * F.col("__d")).alias("sum_wd"), w.alias("sum_w"), *colour, close.cast("bigint").alias("n_c"))


def fuse(*parts: DataFrame) -> DataFrame:
    """Sums observations or grids by cell; cells without weight left vanish."""
    every = parts[0].select(*CELL, *SUMS)
    for p in parts[1:]:
        every = every.unionByName(p.select(*CELL, *SUMS))
    return every.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in SUMS]).filter(F.abs("sum_w") > 1e-9)


def negative(part: DataFrame) -> DataFrame:
    """What retracts `part` when it is fused."""
    return part.withColumns({c: -F.col(c) for c in SUMS})


def surface(voxels: DataFrame) -> DataFrame:
    """sdf and colour of observed cells; colour is white where none was seen. The mean of
    exact sums needs no sharing down of large counts."""
    mean = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_c")), F.lit(255.0))
    return voxels.filter(F.col("sum_w") > LEAST_WEIGHT).select(*CELL, (F.col("sum_wd") / F.col("sum_w")).alias("sdf"), F.col("sum_w").alias("weight"), *[mean("sum_" + c).alias(c) for c in "rgb"])


@dataclass(frozen=True)
class FusionOptions:
    """What a user sets of fusion. truncation and weigh: the policies, column functions. near, back:
    the nearest camera depth, and how far behind the surface counts. carving: whether stale cells in
    front of the surface lose weight, beyond carving_distance metres. least_weight: below it a cell
    counts as unobserved. voxel, chunk: cell size in metres and cells along a chunk's side."""

    voxel: float = 0.005
    chunk: int = 8
    truncation: Callable[[Column], Column] = g.quadratic_truncation
    weigh: Callable[[Column], Column] = g.observation_weight
    near: float = 0.1
    back: float = 0.03
    carving: bool = False
    carving_distance: float = 0.05
    least_weight: float = LEAST_WEIGHT


def integrate(grid: DataFrame | None, cells: DataFrame, pixels: DataFrame, poses: DataFrame, cam: Camera, options: FusionOptions) -> DataFrame:
    """The grid with the candidate cells' observations fused in, carved first if the options ask for it."""
    o = options
    seen = observe(cells, pixels, poses, cam, o.voxel, o.chunk, o.truncation, o.weigh, o.near, o.back)
    if grid is None:
        return fuse(seen)
    if o.carving:
        grid = carve(grid, free_cells(grid, pixels, poses, cam, o))
    return fuse(grid, seen)


def free_cells(grid: DataFrame, pixels: DataFrame, poses: DataFrame, cam: Camera, options: FusionOptions) -> DataFrame:
    """Cells of the grid that a frame sees more than carving_distance in front of its surface. The
    frames' poses are few and each cell projects into each; pixels are met by an equi-join."""
    at = grid.select(*CELL).join(F.broadcast(poses))
    p = g.apply_pose(g.invert(g.pose_of()), Vec(*((F.col(c) + 0.5) * options.voxel for c in CELL)))
    at = at.withColumns({"__x": p.x, "__y": p.y, "__z": p.z}).filter(F.col("__z") > options.near)
    uv = g.project(vec("__x", "__y", "__z"), cam)
    at = at.withColumns({"u": F.floor(uv.x + 0.5).cast("int"), "v": F.floor(uv.y + 0.5).cast("int")})
    return at.join(pixels.hint("merge"), ["frame_id", "u", "v"]).filter(F.col("depth") - F.col("__z") > options.carving_distance).select(*CELL).distinct()


def carve(voxels: DataFrame, free: DataFrame) -> DataFrame:
    """Halves the weight of negative cells that were seen to be free; drops those below 2."""
    seen = free.select(*CELL).distinct().withColumn("__free", F.lit(True))
    v = voxels.join(seen.hint("merge"), CELL, "left")
    hit = F.coalesce("__free", F.lit(False)) & (F.col("sum_wd") < 0)
    v = v.filter(~(hit & (F.col("sum_w") < 2)))
    half = {c: F.when(hit, F.col(c) / 2).otherwise(F.col(c)) for c in ("sum_wd", "sum_w")}
    return v.withColumns(half).drop("__free")


def chunk_statistics(voxels: DataFrame, chunk: int, voxel: float, cell_bytes: int = 8) -> DataFrame:
    """Per chunk and in total (null chunk): cells inside, outside and unknown, their weight, the bounds in metres (x0 to z1, whole chunks),
    and the megabytes of dense chunks: megabytes of those that there are, most_megabytes of all within the bounds."""
    c = voxels.select(*[F.floor(F.col(x) / chunk).cast("int").alias(n) for x, n in zip(CELL, ("cx", "cy", "cz"), strict=True)], "sum_wd", "sum_w")
    c = c.withColumn("chunk", F.format_string("%d,%d,%d", "cx", "cy", "cz"))
    known = F.col("sum_w") > LEAST_WEIGHT
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).alias("n")
    each = c.groupBy("chunk", "cx", "cy", "cz").agg(n(known & (F.col("sum_wd") < 0)).alias("inside"), n(known & (F.col("sum_wd") >= 0)).alias("outside"), n(~known).alias("unknown"), F.sum("sum_w").alias("weight"))
    size, dense = chunk * voxel, chunk**3 * cell_bytes / 1e6
    low, high = {a: F.min(f"c{a}") for a in "xyz"}, {a: F.max(f"c{a}") + 1 for a in "xyz"}
    span = (high["x"] - low["x"]) * (high["y"] - low["y"]) * (high["z"] - low["z"])
    return each.rollup("chunk").agg(
        *[F.sum(k).alias(k) for k in ("inside", "outside", "unknown", "weight")], *[(low[a] * size).alias(f"{a}0") for a in "xyz"], *[(high[a] * size).alias(f"{a}1") for a in "xyz"],
        (F.count("*") * dense).alias("megabytes"), (span * dense).alias("most_megabytes"),
    )


def dirty_chunks(updated: DataFrame) -> DataFrame:
    """Updated chunks (cx, cy, cz) and their six face neighbours, as a set."""
    steps = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    moved = F.explode(F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(("cx", "cy", "cz"), s, strict=True)]) for s in steps]))
    return updated.select(moved.alias("c")).select("c.*").distinct()


def create_missing(have: DataFrame, want: DataFrame, key: list[str]) -> DataFrame:
    """`have` with the wanted keys that it lacks, their other columns null."""
    new = want.select(*key).distinct().join(have.hint("merge"), key, "left_anti")
    return have.unionByName(new, allowMissingColumns=True)


def collect_garbage(have: DataFrame, updated: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `have` that are not new, or were updated (column `is_new`)."""
    return have.filter("not is_new").unionByName(have.filter("is_new").join(updated.select(*key).distinct().hint("merge"), key, "left_semi"))


def corner_cells(surface_rows: DataFrame) -> DataFrame:
    """Cubes whose eight corner cells are all observed: (gx, gy, gz, sdf: array of 8, corner k at
    offset (k & 1, k >> 1 & 1, k >> 2)). Each cell goes to the eight cubes that it is a corner of;
    one grouping brings a cube together, across chunk borders too."""
    k = surface_rows.select(*CELL, "sdf", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    off = (F.col("k").bitwiseAND(1), F.shiftright("k", 1).bitwiseAND(1), F.shiftright("k", 2))
    cube = [(F.col(c) - o).alias(c) for c, o in zip(CELL, off, strict=True)]
    got = k.select(*cube, "k", "sdf").groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("k", "sdf"))).alias("__c"))
    return got.filter(F.size("__c") == 8).select(*CELL, F.col("__c.sdf").alias("sdf"))


def cube_mask(sdf: Column) -> Column:
    """Bit k is set where corner k lies inside (sdf < 0)."""
    return sum((F.when(F.get(sdf, F.lit(k)) < 0, 1 << k).otherwise(0) for k in range(8)), F.lit(0))


def gradients(surface_rows: DataFrame, voxel: float, steep: float = 100.0) -> DataFrame:
    """Adds nothing but (gx, gy, gz, dx, dy, dz): central differences over the six neighbours,
    where all are observed with sdf < 1 and the norm is at most `steep` voxels."""
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    told = F.explode(F.array(*[F.struct(*[(F.col(c) - d).alias(c) for c, d in zip(CELL, s, strict=True)], F.lit(i).alias("k")) for i, s in enumerate(steps)]))
    k = surface_rows.filter("sdf < 1").select(told.alias("t"), "sdf").select("t.*", "sdf")
    own = surface_rows.filter("sdf < 1").select(*CELL, F.lit(6).alias("k"), "sdf")
    pick = lambda i: F.max(F.when(F.col("k") == i, F.col("sdf")))
    got = k.unionByName(own).groupBy(*CELL).agg(*[pick(i).alias(f"s{i}") for i in range(7)]).dropna()
    d = got.select(*CELL, *[((F.col(f"s{2 * i}") - F.col(f"s{2 * i + 1}")) / 2).alias(n) for i, n in enumerate(("dx", "dy", "dz"))])
    return d.filter(F.sqrt(sum((F.col(n) * F.col(n) for n in ("dy", "dz")), F.col("dx") * F.col("dx"))) <= steep * voxel)


def look_up(points: DataFrame, cells: DataFrame, voxel: float, values: list[str]) -> DataFrame:
    """points (x, y, z and own columns) with the values of the cell that holds each; null where there is no such cell."""
    at = points.withColumns({n: g.cell(F.col(c), voxel) for n, c in zip(CELL, "xyz", strict=True)})
    return at.join(cells.select(*CELL, *values).hint("merge"), CELL, "left").drop(*CELL)


def sample_trilinear(points: DataFrame, cells: DataFrame, key: str, voxel: float, values: list[str]) -> DataFrame:
    """(key, smooth, values): each value at points (key, x, y, z), trilinear among the eight cell centres around where all are there (then smooth is true),
    else that of the cell which holds the point; null where that lacks it too. cells: cell and values, none null. Points ask eight cells by an equi-join, and the answers are summed."""
    base = {f"__b{c}": F.floor(F.round(F.col(c) / voxel - 0.5, 9)).cast("int") for c in "xyz"}
    p = points.withColumns(base).withColumns({f"__f{c}": F.col(c) / voxel - 0.5 - F.col(f"__b{c}") for c in "xyz"}).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    off = (F.col("k").bitwiseAND(1), F.shiftright("k", 1).bitwiseAND(1), F.shiftright("k", 2))
    w, own = F.lit(1.0), F.lit(True)
    for c, o in zip("xyz", off, strict=True):
        high = F.col(f"__f{c}") >= 0.5
        w = w * F.when(o == 1, F.col(f"__f{c}")).otherwise(1 - F.col(f"__f{c}"))
        own = own & (high == (o == 1))  # the nearest centre is the middle of the cell that holds the point
    at = p.select(key, w.alias("__w"), own.alias("__own"), *[(F.col(f"__b{c}") + o).alias(n) for c, o, n in zip("xyz", off, CELL, strict=True)])
    hit = at.join(cells.select(*CELL, *values).hint("merge"), CELL, "left")
    all_there = F.count(values[0]) == 8
    return hit.groupBy(key).agg(all_there.alias("smooth"), *[F.when(all_there, F.sum(F.col("__w") * F.col(v))).otherwise(F.max(F.when(F.col("__own"), F.col(v)))).alias(v) for v in values])


def sample_distance(points: DataFrame, surface_rows: DataFrame, key: str, voxel: float, within: tuple[str, ...] = ()) -> DataFrame:
    """Trilinear sdf at points (key, x, y, z) whose eight surrounding cell centres are observed. Where
    grids lie side by side, `within` names the columns of both that tell them apart."""
    base = {f"__b{c}": F.floor(F.col(c) / voxel - 0.5).cast("int") for c in "xyz"}
    p = points.withColumns(base).withColumns({f"__f{c}": F.col(c) / voxel - 0.5 - F.col(f"__b{c}") for c in "xyz"})
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    off = (F.col("k").bitwiseAND(1), F.shiftright("k", 1).bitwiseAND(1), F.shiftright("k", 2))
    w = F.lit(1.0)
    for c, o in zip("xyz", off, strict=True):
        w = w * F.when(o == 1, F.col(f"__f{c}")).otherwise(1 - F.col(f"__f{c}"))
    at = p.select(key, *within, w.alias("w"), *[(F.col(f"__b{c}") + o).alias(n) for c, o, n in zip("xyz", off, CELL, strict=True)])
    # both sides grow with the cells: merge, whatever the estimate of their sizes
    hit = at.join(surface_rows.select(*within, *CELL, "sdf").hint("merge"), [*within, *CELL])
    return hit.groupBy(key).agg(F.sum(F.col("w") * F.col("sdf")).alias("distance"), F.count("*").alias("__n")).filter("__n = 8").drop("__n")


def resample(surface_rows: DataFrame, motions: DataFrame, voxel: float) -> DataFrame:
    """(anchor, gx, gy, gz, sdf): each anchor's grid after its rigid motion.

    surface_rows have an anchor, motions a pose (qx to tz) for each. The cells that moved centres
    fall into take the distance that the old grid has where their own centres came from; a cell
    drops out unless all eight old cells around that place are observed, and so do grids without a
    motion. Nothing is scanned but the observed cells.
    """
    centre = Vec(*((F.col(c) + 0.5) * voxel for c in CELL))
    # one motion an anchor, however many cells it has: the motions are broadcast, never the cells
    motions = F.broadcast(motions)
    grid = surface_rows.join(motions, "anchor")
    to = g.apply_pose(g.pose_of(), centre)
    cells = grid.select("anchor", *[F.floor(c / voxel).cast("int").alias(n) for c, n in zip((to.x, to.y, to.z), CELL, strict=True)]).distinct()
    back = g.apply_pose(g.invert(g.pose_of()), centre)
    places = cells.join(motions, "anchor").select("anchor", F.struct("anchor", *CELL).alias("cell"), back.x.alias("x"), back.y.alias("y"), back.z.alias("z"))
    return sample_distance(places, surface_rows, "cell", voxel, ("anchor",)).select("cell.*", F.col("distance").alias("sdf"))


def chunk_reference(normals: DataFrame, views: DataFrame, poses: DataFrame, voxel: float, chunk: int) -> DataFrame:
    """(cx, cy, cz, frame_id, quality): of the frames that see a chunk (views: frame_id, cx, cy, cz) the
    one that looks at its surface most frontally, of equals the latest.

    quality is the product of the chunk's mean normal (nx, ny, nz) and the unit viewing ray to its
    origin, at the frame's pose; the smallest faces the frame most. A chunk without normal has none.
    """
    at = views.join(normals.hint("merge"), ["cx", "cy", "cz"]).join(poses.hint("shuffle_hash"), "frame_id")
    p = g.apply_pose(g.invert(g.pose_of()), Vec(*(F.col(c) * (chunk * voxel) for c in ("cx", "cy", "cz"))))
    at = at.withColumns({"__x": p.x, "__y": p.y, "__z": p.z}).filter(F.col("__z") > 0)
    q = g.dot(vec("nx", "ny", "nz"), vec("__x", "__y", "__z")) / g.norm(vec("__x", "__y", "__z"))
    best = F.min(F.struct(F.round(q, 9).alias("q"), (-F.col("frame_id")).alias("f"))).alias("b")
    return at.groupBy("cx", "cy", "cz").agg(best).select("cx", "cy", "cz", (-F.col("b.f")).alias("frame_id"), F.col("b.q").alias("quality"))


def refine_depth(points: DataFrame, surface_rows: DataFrame, key: list[str], voxel: float, steps: int = 6, residual: float = 0.005, most: float = 0.1) -> DataFrame:
    """(key, depth): depths moved onto the surface of the grid, by adding the distance there to the
    depth `steps` times. A pixel drops out where the grid is unknown, where the last distance is over
    `residual`, or where it has moved over `most` metres. points: key, depth, and for the pixel's ray
    origin (ox, oy, oz) and direction a metre of depth (rx, ry, rz), in the world. Each step is one
    look-up join; keys are hashed to one column for it."""
    now = points.withColumns({"__id": F.struct(*key), "__first": F.col("depth")})
    for _ in range(steps):
        at = now.select("__id", *[(F.col("o" + c) + F.col("r" + c) * F.col("depth")).alias(c) for c in "xyz"])
        now = now.join(sample_distance(at, surface_rows, "__id", voxel).hint("merge"), "__id")
        now = now.withColumn("depth", F.col("depth") + F.col("distance")).withColumnRenamed("distance", "__last").select(*points.columns, "__id", "__first", "__last")
        last = now
        now = now.drop("__last")
    good = (F.abs("__last") <= residual) & (F.abs(F.col("depth") - F.col("__first")) <= most)
    return last.filter(good).select(*key, "depth")
