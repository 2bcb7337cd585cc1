"""Pose-graph optimisation: Gauss-Newton steps on the edges' moments, each solved by conjugate gradients on DataFrames.

Poses are rows (frame_id, map, r, t), r row-major, from camera to world; edges are the moments of matched camera-space points (see
pair_moments). All maps are solved at the same time, each with its own step sizes; a frame's share of the system are the rows of its 6 x 6 blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.operators.graph import kept
from lodeframe.operators.registration import blocks_of_moments
from lodeframe.operators.rigid import EDGE, by_rows, exponential, motion_error

MOMENTS = ["sum_w", "sp", "sq", "spp", "sqq", "spq"]


def _at(name: str, k: int) -> Column:
    return F.get(name, F.lit(k))


def _dot(a: str, b: str) -> Column:
    return sum((_at(a, k) * _at(b, k) for k in range(1, 6)), _at(a, 0) * _at(b, 0))


def _product(matrix: str, vector: str) -> list[Column]:
    return [sum((_at(matrix, 6 * i + k) * _at(vector, k) for k in range(1, 6)), _at(matrix, 6 * i) * _at(vector, 0)) for i in range(6)]


def _step(a: str, factor: Column, b: str) -> Column:
    return F.array(*[_at(a, k) + factor * _at(b, k) for k in range(6)])


def with_poses(edges: DataFrame, poses: DataFrame) -> DataFrame:
    """Edges within one map, with map and the poses of both ends (ra, ta of ref; rb, tb of new). Two joins on the frame."""
    end = lambda name, a: poses.select(F.col("frame_id").alias(name), F.col("map").alias(f"__{a}"), F.col("r").alias(f"r{a}"), F.col("t").alias(f"t{a}"))
    return edges.join(end("ref", "a"), "ref").join(end("new", "b"), "new").filter("__a = __b").withColumnRenamed("__a", "map").drop("__b")


def edge_errors(edges: DataFrame, poses: DataFrame) -> DataFrame:
    """(ref, new, map, sum_w, error) of edges at the given poses."""
    e = with_poses(edges, poses)
    turn = F.array(*[sum((_at("rb", 3 * k + i) * _at("ra", 3 * k + j) for k in (1, 2)), _at("rb", i) * _at("ra", j)) for i in range(3) for j in range(3)])
    gap = [_at("ta", k) - _at("tb", k) for k in range(3)]
    move = F.array(*[sum((_at("rb", 3 * k + i) * gap[k] for k in (1, 2)), _at("rb", i) * gap[0]) for i in range(3)])
    e = e.select(*EDGE, "map", *MOMENTS, turn.alias("r"), move.alias("t"))
    return e.select(*EDGE, "map", "sum_w", motion_error(e).alias("error"))


def world_moments(edges: DataFrame, poses: DataFrame) -> DataFrame:
    """The moments of the edges' points in world space."""
    kind = "ref int, new int, sum_w double, sp array<double>, sq array<double>, spp array<double>, sqq array<double>, spq array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            get = lambda c, *shape: np.stack(pdf[c].to_numpy()).reshape(-1, *shape)  # noqa: B023, E731
            w = pdf["sum_w"].to_numpy()[:, None]
            ra, rb, ta, tb = get("ra", 3, 3), get("rb", 3, 3), get("ta", 3), get("tb", 3)
            turned_p, turned_q = (np.einsum("bij,bj->bi", r, get(c, 3)) for r, c in ((ra, "sp"), (rb, "sq")))
            outer = lambda a, b: np.einsum("bi,bj->bij", a, b)

            def second(r, name, s, u, a, b, t, v):
                """R (sum p q^T) S^T and what the shifts t and v add."""
                return np.einsum("bij,bjk,blk->bil", r, get(name, 3, 3), s) + outer(u, b) + outer(a, v) + w[:, :, None] * outer(t, b)  # noqa: B023

            spp = second(ra, "spp", ra, turned_p, ta, ta, ta, turned_p)
            sqq = second(rb, "sqq", rb, turned_q, tb, tb, tb, turned_q)
            spq = second(ra, "spq", rb, turned_p, ta, tb, ta, turned_q)
            out = pdf[[*EDGE, "sum_w"]].copy()
            out["sp"], out["sq"] = list(turned_p + w * ta), list(turned_q + w * tb)
            out["spp"], out["sqq"], out["spq"] = (list(x.reshape(-1, 9)) for x in (spp, sqq, spq))
            yield out

    return with_poses(edges, poses).select(*EDGE, *MOMENTS, "ra", "ta", "rb", "tb").mapInPandas(run, kind)


def _system(edges: DataFrame, poses: DataFrame, free: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, rows): the normal equations of the free frames (frame_id, map). blocks: row, col, h (36); rows: id, map, b (6) and the inverse
    of its own block, m (36). Both are written."""
    every = blocks_of_moments(world_moments(edges, poses))
    own = free.select(F.col("frame_id").alias("row"), "map")
    cell = lambda i, j: F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("value")).otherwise(0.0))
    packed = every.join(own, "row").groupBy("row", "col", "map").agg(F.array(*[cell(i, j) for i in range(6) for j in range(6)]).alias("h"), F.array(*[cell(i, 6) for i in range(6)]).alias("b"))
    packed = kept(packed)
    blocks = kept(packed.join(free.select(F.col("frame_id").alias("col")), "col", "left_semi").select("row", "col", "h"))

    def invert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                out = pdf[["id", "map", "b"]].copy()
                out["m"] = list(np.linalg.pinv(np.stack(pdf["h"].to_numpy()).reshape(-1, 6, 6), hermitian=True).reshape(-1, 36))
                yield out

    rows = packed.filter("row = col").select(F.col("row").alias("id"), "map", "b", "h").mapInPandas(invert, "id int, map int, b array<double>, m array<double>")
    return blocks, kept(rows)


def conjugate_gradients(blocks: DataFrame, rows: DataFrame, tolerance: float = 1e-6, most: int = 400) -> DataFrame:
    """(id, map, x): the solution of each map's system, preconditioned by the inverses of its diagonal blocks.

    A round is one job: a join and a grouping for the product, one grouping by map for both of the round's inner products, and
    the vectors' updates; its result is written, so that a round costs the same however many came before. A map whose residual
    is below `tolerance` of its first (squared, in the preconditioner's measure) stands still; the rounds end when all do.
    """
    zero = F.array(*[F.lit(0.0)] * 6)
    state = rows.select("id", "map", "m", zero.alias("x"), F.col("b").alias("r"), zero.alias("p"), zero.alias("s"), F.lit(0.0).alias("gamma"), F.lit(1.0).alias("alpha"), F.lit(-1.0).alias("first"))
    state = kept(state.withColumn("u", F.array(*_product("m", "r"))))
    for k in range(most):
        ask = blocks.join(state.select(F.col("id").alias("col"), "u"), "col")
        w = ask.select("row", F.array(*_product("h", "u")).alias("v")).groupBy("row").agg(F.array(*[F.sum(_at("v", k)) for k in range(6)]).alias("w"))
        now = state.join(w.withColumnRenamed("row", "id"), "id")
        sums = now.groupBy("map").agg(F.sum(_dot("r", "u")).alias("__g"), F.sum(_dot("w", "u")).alias("__d"))
        now = now.join(sums, "map")
        first = F.when(F.col("first") < 0, F.col("__g")).otherwise(F.col("first"))
        beta = F.when(F.col("gamma") > 0, F.col("__g") / F.col("gamma")).otherwise(0.0)
        alpha = F.when(F.col("gamma") > 0, F.try_divide(F.col("__g"), F.col("__d") - beta * F.col("__g") / F.col("alpha"))).otherwise(F.try_divide(F.col("__g"), F.col("__d")))
        still = (F.col("__g") <= tolerance * first) | (F.col("__d") <= 0)
        now = now.withColumns({"__b": beta, "__a": F.coalesce(alpha, F.lit(0.0)), "first": first, "still": still})
        now = now.withColumns({"p": _step("u", F.col("__b"), "p"), "s": _step("w", F.col("__b"), "s")})
        go = F.when(F.col("still"), 0.0).otherwise(F.col("__a"))
        now = now.withColumns({"x": _step("x", go, "p"), "r": _step("r", -go, "s")}).withColumn("u", F.array(*_product("m", "r")))
        state = kept(now.select("id", "map", "m", "x", "r", "p", "s", F.col("__g").alias("gamma"), F.col("__a").alias("alpha"), "first", "u", "still"))
        if k % 2 and state.filter("not still").isEmpty():
            return state.select("id", "map", "x")
        state = state.drop("still")
    raise RuntimeError(f"residuals are not below {tolerance} after {most} rounds")


def optimise(poses: DataFrame, edges: DataFrame, rounds: int = 3, worse: float = 0.05, least_frames: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(poses, edges, maps) after up to `rounds` Gauss-Newton steps over all maps of `least_frames` frames or more.

    A map's first frame stands; the others move by the inverse of exp(d) before their pose. If without the newest frame's edges the weighted mean
    error of a map has grown by more than the share `worse`, the newest frame has spoilt it: the map's poses are what they
    were, and of the newest frame's edges only those to the nearest frames (in the order of frames) stay. poses: frame_id, map, r, t; edges: the
    given ones that stay; maps: map, before, after (errors without the newest frame's edges, null if there are no others), total_before,
    total_after, rolled_back. Frames without edges, and edges between maps, change nothing. Each step's poses are written.
    """
    edges = kept(edges.select(*EDGE, *MOMENTS))
    rank = Window.partitionBy("map").orderBy("frame_id")
    known = kept(poses.select("frame_id", "map", "r", "t").withColumns({"place": F.row_number().over(rank), "frames": F.count("*").over(Window.partitionBy("map"))}))
    linked = edges.select(F.explode(F.array(*EDGE)).alias("frame_id")).distinct()
    free = kept(known.filter((F.col("place") > 1) & (F.col("frames") >= least_frames)).join(linked, "frame_id", "left_semi").select("frame_id", "map"))
    start = now = known.select("frame_id", "map", "r", "t")
    if not free.isEmpty():
        for _ in range(rounds):
            step = conjugate_gradients(*_system(edges, now, free))
            moving = now.join(step.select(F.col("id").alias("frame_id"), "x"), "frame_id", "left")

            def move(r, t, x):
                turn, shift = exponential(-x)
                return turn @ r.reshape(-1, 3, 3), np.einsum("bij,bj->bi", turn, t) + shift

            now = kept(by_rows(moving.withColumn("x", F.coalesce("x", F.array(*[F.lit(0.0)] * 6))), ["frame_id", "map"], ["r", "t", "x"], move))
    places = known.select("frame_id", "place")
    met = with_poses(edges, start).select(*EDGE, "map").join(places.select(F.col("frame_id").alias("ref"), F.col("place").alias("__p")), "ref").join(places.select(F.col("frame_id").alias("new"), F.col("place").alias("__q")), "new")
    met = met.withColumn("__far", F.abs(F.col("__p") - F.col("__q")))
    newest = met.groupBy("map").agg(F.max(F.greatest(*EDGE)).alias("newest"))
    met = met.join(newest, "map").withColumn("late", (F.col("ref") == F.col("newest")) | (F.col("new") == F.col("newest")))
    near = met.filter("late").groupBy("map").agg(F.min("__far").alias("__near"))
    marked = kept(met.join(near, "map", "left").select(*EDGE, "map", "late", (F.col("late") & (F.col("__far") > F.col("__near"))).alias("far")))
    both = edge_errors(edges, start).withColumnRenamed("error", "e0").join(edge_errors(edges, now).select(*EDGE, F.col("error").alias("e1")), EDGE).join(marked.select(*EDGE, "late"), EDGE)
    mean = lambda e, only: F.try_divide(F.sum(F.when(only, F.col(e) * F.col("sum_w"))), F.sum(F.when(only, F.col("sum_w"))))
    maps = both.groupBy("map").agg(mean("e0", ~F.col("late")).alias("before"), mean("e1", ~F.col("late")).alias("after"), mean("e0", F.lit(True)).alias("total_before"), mean("e1", F.lit(True)).alias("total_after"))
    spoilt = F.coalesce(F.try_divide(F.col("after") - F.col("before"), F.col("before")) > worse, F.lit(False))
    maps = kept(maps.withColumn("rolled_back", spoilt))
    back = maps.filter("rolled_back").select("map")
    poses = kept(now.join(back, "map", "left_anti").unionByName(start.join(back, "map", "left_semi")))
    gone = marked.filter("far").join(back, "map", "left_semi").select(*EDGE)
    return poses, edges.join(gone, EDGE, "left_anti"), maps
