"""Surfels: radius, confidence and confidence-weighted merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def radius(z: Column, nz: Column, focal: float) -> Column:
    """sqrt(2) z / focal, over |nz| but at most twice that."""
    flat = z / F.lit(focal) * F.lit(2**0.5)
    return F.least(2 * flat, F.coalesce(F.try_divide(flat, F.abs(nz)), 2 * flat))


def confidence(u: Column, v: Column, cx: float, cy: float, reach: float, weight: float = 1.0) -> Column:
    """exp(-d^2 / 0.72) of the pixel's distance from the centre, over `reach`, times weight."""
    d2 = ((u - cx) * (u - cx) + (v - cy) * (v - cy)) / F.lit(reach * reach)
    return F.exp(-d2 / F.lit(0.72)) * F.lit(weight)


def merge(surfels: DataFrame, updates: DataFrame, widest: float = 1.5) -> DataFrame:
    """Confidence-weighted mean of a surfel (id, x, y, z, radius, conf) and its updates; an update
    whose radius is `widest` times the surfel's or more adds its confidence only."""
    base = surfels.select("id", F.col("radius").alias("__r"))
    near = updates.join(base, "id").withColumn("__w", F.when(F.col("radius") < widest * F.col("__r"), F.col("conf")).otherwise(0.0))
    cols = ["x", "y", "z", "radius"]
    every = surfels.select("id", *cols, "conf", F.col("conf").alias("__w")).unionByName(near.select("id", *cols, "conf", "__w"))
    return every.groupBy("id").agg(*[(F.sum(F.col("__w") * F.col(c)) / F.sum("__w")).alias(c) for c in cols], F.sum("conf").alias("conf"))


def visible(surfels: DataFrame) -> DataFrame:
    """The nearest surfel (smallest z) of each pixel (frame_id, u, v), of equals the smallest id."""
    rest = [c for c in surfels.columns if c not in ("frame_id", "u", "v")]
    first = F.min(F.struct("z", "id", *[c for c in rest if c not in ("z", "id")])).alias("s")
    return surfels.groupBy("frame_id", "u", "v").agg(first).select("frame_id", "u", "v", *[F.col(f"s.{c}").alias(c) for c in rest])


def associate(points: DataFrame, model: DataFrame, cx: float, cy: float, fx: float, fy: float, window: int = 1, gap: float = 0.05, angle: float = 0.5) -> DataFrame:
    """(frame_id, u, v, match): for each new point (x, y, z, nx, ny, nz) the model surfel it belongs to,
    or null for a new one.

    Candidates are the visible surfels (id and the same columns) within `window` pixels whose depth
    along the ray is less than `gap` away and whose normal is within `angle` or seen edge-on; the one
    nearest to the point's ray wins. Points are told to their window, then met by an equi-join.
    """
    steps = F.explode(F.sequence(F.lit(-window), F.lit(window)))
    asks = points.select("frame_id", "u", "v", "z", "nx", "ny", "nz").withColumn("__i", steps).withColumn("__j", steps)
    asks = asks.withColumns({"__u": F.col("u") + F.col("__i"), "__v": F.col("v") + F.col("__j")})
    m = model.select(F.col("frame_id"), F.col("u").alias("__u"), F.col("v").alias("__v"), "id", *[F.col(c).alias("m" + c) for c in ("x", "y", "z", "nx", "ny", "nz")])
    both = asks.join(m.hint("merge"), ["frame_id", "__u", "__v"])
    rx, ry = (F.col("u") - cx) / fx, (F.col("v") - cy) / fy
    length = F.sqrt(rx * rx + ry * ry + 1)
    a, b, c = ry * F.col("mz") - F.col("my"), F.col("mx") - rx * F.col("mz"), rx * F.col("my") - ry * F.col("mx")
    far = F.sqrt(a * a + b * b + c * c) / length
    cosine = F.col("nx") * F.col("mnx") + F.col("ny") * F.col("mny") + F.col("nz") * F.col("mnz")
    close = (F.abs(F.col("mz") - F.col("z")) * length < gap) & ((F.abs("mnz") < 0.75) | (F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) < angle))
    best = both.filter(close).groupBy("frame_id", "u", "v").agg(F.min(F.struct(F.round(far, 9).alias("d"), "id")).alias("b"))
    return points.select("frame_id", "u", "v").join(best.hint("merge"), ["frame_id", "u", "v"], "left").select("frame_id", "u", "v", F.col("b.id").alias("match"))


def prune(surfels: DataFrame, now, least_conf: float, age: int = 20, copies: int = 8, violations: int = 4) -> DataFrame:
    """Surfels that stay: not unstable for over `age` steps (conf at most least_conf), with at most
    `copies` duplicates and `violations` of free space (columns t_last, conf, n_copies, n_free)."""
    stale = (now - F.col("t_last") > age) & (F.col("conf") <= least_conf)
    return surfels.filter(~stale & (F.col("n_copies") <= copies) & (F.col("n_free") <= violations))


def deform(points: DataFrame, nodes: DataFrame, k: int = 4, pool: int = 20) -> DataFrame:
    """(id, dx, dy, dz): each point (id, t, x, y, z) moved by the mean of its k nearest nodes among the
    `pool` nearest in time, with weights (1 - d / d_max)^2, d_max being the distance of the next one.
    nodes: t, x, y, z, mx, my, mz, one a time step, so the pool is a range of steps. Points are unfolded to `pool` steps: merged, never broadcast."""
    half = pool // 2
    asks = points.withColumn("__t", F.explode(F.sequence(F.col("t") - half, F.col("t") + half)))
    both = asks.join(nodes.select(F.col("t").alias("__t"), *[F.col(c).alias("n" + c) for c in "xyz"], "mx", "my", "mz").hint("merge"), "__t")
    d = F.sqrt(sum(((F.col(c) - F.col("n" + c)) * (F.col(c) - F.col("n" + c)) for c in "yz"), (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx"))))
    near = both.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round(d, 9).alias("d"), F.col("__t").alias("t"), "mx", "my", "mz"))), 1, k + 1).alias("n"))
    far = F.element_at("n", -1)["d"]
    some = F.slice("n", 1, k)
    w = lambda x: F.pow(1 - F.coalesce(F.try_divide(x["d"], far), F.lit(0.0)), 2)
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + w(x))

    def mean(c: str):
        return F.coalesce(F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + w(x) * x["m" + c]), total), F.lit(0.0)).alias("d" + c)

    moved = [mean(c) for c in "xyz"]
    return near.select("id", *moved)
