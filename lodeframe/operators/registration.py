"""Frame-pair moments, errors, robust selection and components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.operators.graph import kept


def pair_moments(matches: DataFrame, weight, keys: Sequence[str] = ("ref", "new")) -> DataFrame:
    """Per edge (ref, new), or by other keys, the weighted second moments of matched points p (px, py, pz) and q:
    sum_w, sp, sq (3), spp, sqq, spq (9, row-major). One partial and one final sum."""
    m = matches.withColumn("w", weight)
    p, q = [F.col("p" + c) for c in "xyz"], [F.col("q" + c) for c in "xyz"]
    w = F.col("w")
    outer = lambda a, b: F.array(*[F.sum(w * x * y) for x in a for y in b])
    return m.groupBy(*keys).agg(
        F.sum(w).alias("sum_w"), F.array(*[F.sum(w * x) for x in p]).alias("sp"), F.array(*[F.sum(w * x) for x in q]).alias("sq"),
        outer(p, p).alias("spp"), outer(q, q).alias("sqq"), outer(p, q).alias("spq"),
    )


def errors_per_frame(edges: DataFrame) -> DataFrame:
    """Weighted mean error, weight and degree of each frame over its edges; 1e8 below weight 1."""
    ends = edges.select(F.explode(F.array("ref", "new")).alias("frame_id"), "error", "sum_w")
    agg = ends.groupBy("frame_id").agg((F.sum(F.col("error") * F.col("sum_w")) / F.sum("sum_w")).alias("e"), F.sum("sum_w").alias("weight"), F.count("*").alias("degree"))
    return agg.select("frame_id", F.when(F.col("weight") < 1, 1e8).otherwise(F.col("e")).alias("error"), "weight", "degree")


def top_bins(bins: DataFrame, least: float = 0.1, k: int = 3) -> DataFrame:
    """Per key the k fullest bins (key, bin, n) that hold over `least` of the fullest; ties by bin."""
    w = Window.partitionBy("key").orderBy(F.desc("n"), "bin")
    r = bins.withColumns({"rank": F.row_number().over(w), "__m": F.max("n").over(Window.partitionBy("key"))})
    return r.filter((F.col("rank") <= k) & (F.col("n") >= least * F.col("__m"))).drop("__m")


def rotation_consistent(matches: DataFrame, bins: int = 18) -> DataFrame:
    """Keeps matches (key, angle in degrees) whose bin is the fullest, a circular neighbour of it,
    or the second or third fullest."""
    width = 360.0 / bins
    m = matches.withColumn("bin", F.pmod(F.floor(F.pmod("angle", F.lit(360.0)) / width), F.lit(bins)))
    top = top_bins(m.groupBy("key", "bin").agg(F.count("*").alias("n")))
    first = top.filter("rank = 1").select("key", F.explode(F.array(*[F.pmod(F.col("bin") + o, F.lit(bins)) for o in (-1, 0, 1)])).alias("bin"))
    return m.join(first.union(top.select("key", "bin")).distinct(), ["key", "bin"], "left_semi")


def thin(points: DataFrame, cell: float, per_cell: int = 1) -> DataFrame:
    """The strongest `per_cell` points (x, y, response, kp_id) of each frame's grid cell."""
    w = Window.partitionBy("frame_id", F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)).orderBy(F.desc("response"), "kp_id")
    return points.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_cell).drop("__r")


def level_quotas(total: int, levels: int, scale: float = 1.2) -> list[int]:
    """How many of `total` points each level of an image pyramid may keep: a falling geometric progression, the last level the rest."""
    first = total * (1 - 1 / scale) / (1 - scale**-levels)
    out = [round(first * scale**-k) for k in range(levels - 1)]
    return [*out, max(total - sum(out), 0)]


def quad_thin(points: DataFrame, width: float, height: float, quotas: list[int], depth: int = 8) -> DataFrame:
    """Points (frame_id, level, kp_id, x, y, response) spread over their image: the strongest of each cell of a quad tree that has as many
    cells as the level's quota allows.

    The image is cut into about square columns, and these into quarters again and again. A level takes the deepest depth at which no more cells hold
    points than its quota; of these cells those with most points (then by place) are quartered once more, as long as the cells stay within the
    quota. Ties of response go to the smaller id. Where even the first columns are more than the quota, the strongest of them stay. A
    point is a row a depth until cells are counted; windows are over a level's cells of one depth, which its quota bounds.
    """
    columns = max(1, round(width / height))
    at = ["frame_id", "level"]
    wide = points.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    place = lambda c, size: F.floor(F.col(c) / size * F.call_function("shiftleft", F.lit(1), F.col("depth"))).cast("int")
    wide = wide.withColumns({"cx": place("x", width / columns), "cy": place("y", height)})
    best = F.max(F.struct("response", (-F.col("kp_id")).alias("i")))
    cells = kept(wide.groupBy(*at, "depth", "cx", "cy").agg(F.count("*").alias("n"), best.alias("best")))
    quota = F.get(F.array(*[F.lit(q) for q in quotas]), F.col("level"))
    fits = cells.groupBy(*at, "depth").agg(F.count("*").alias("cells")).withColumn("quota", quota)
    chosen = fits.groupBy(*at, "quota").agg(F.coalesce(F.max(F.when(F.col("cells") <= F.col("quota"), F.struct("depth", "cells"))), F.min(F.when(F.col("depth") == 0, F.struct("depth", "cells")))).alias("c")).select(*at, "quota", "c.*")
    own = cells.join(chosen, [*at, "depth"])
    children = cells.select(*at, (F.col("depth") - 1).alias("depth"), F.shiftright("cx", 1).alias("cx"), F.shiftright("cy", 1).alias("cy"), F.col("best").alias("child"))
    met = own.join(children, [*at, "depth", "cx", "cy"], "left").groupBy(*at, "quota", "cells", "cx", "cy", "n", "best").agg(F.collect_list("child").alias("quarters"))
    more = F.greatest(F.size("quarters") - 1, F.lit(0))
    order = Window.partitionBy(*at).orderBy((more == 0), F.desc("n"), "cx", "cy").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("sum", F.sum(more).over(order)).withColumn("open", (more > 0) & (F.col("cells") + F.col("sum") <= F.col("quota")))
    out = met.select(*at, "quota", F.explode(F.when(F.col("open"), F.col("quarters")).otherwise(F.array("best"))).alias("b"))
    rank = F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("b.response"), F.desc("b.i")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= F.col("quota")).select(*at, (-F.col("b.i")).alias("kp_id"))


def moving_average_pick(costs: DataFrame, length: int, least: float = 1e-4) -> DataFrame:
    """Per seq the rows of the full window of `length` rows with the largest mean cost (the first
    of equals), if the mean is above `least`. costs: seq, idx, cost."""
    w = Window.partitionBy("seq").orderBy("idx")
    run = w.rowsBetween(0, length - 1)
    m = costs.withColumns({"m": F.avg("cost").over(run), "n": F.count("*").over(run)}).filter(F.col("n") == length)
    # means that are equal but for the order of their sums are equal
    best = m.groupBy("seq").agg(F.max(F.struct(F.round("m", 12).alias("r"), (-F.col("idx")).alias("i"), "m")).alias("b")).filter(F.col("b.m") > least)
    best = best.select("seq", (-F.col("b.i")).alias("__from"))
    return costs.join(best, "seq").filter((F.col("idx") >= F.col("__from")) & (F.col("idx") < F.col("__from") + length)).drop("__from")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, ts: str) -> DataFrame:
    """As-of: each left row (key, ts, id) with the right row (key, ts, id) nearest in time, the
    earlier of equals. One union and two windows; no join on a range."""
    rows = left.select(key, ts, F.col("id").alias("l"), F.lit(None).cast("bigint").alias("r")).unionByName(right.select(key, ts, F.lit(None).cast("bigint").alias("l"), F.col("id").alias("r")))
    mark = F.when(F.col("r").isNotNull(), F.struct(ts, "r"))
    before = Window.partitionBy(key).orderBy(F.col(ts), F.col("r").isNull(), "r", "l").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(F.col(ts), F.col("r").isNotNull(), "r", "l").rowsBetween(0, Window.unboundedFollowing)
    m = rows.withColumns({"__b": F.last(mark, True).over(before), "__a": F.first(mark, True).over(after)}).filter("l is not null")
    us = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    closer = F.col("__b").isNull() | (us(F.col("__a")[ts]) - us(ts) < us(ts) - us(F.col("__b")[ts]))
    pick = F.when(F.col("__a").isNotNull() & closer, F.col("__a")).otherwise(F.col("__b"))
    return m.withColumn("__p", pick).select(key, F.col("l").alias("id"), F.col("__p.r").alias("match"), ((us(F.col("__p")[ts]) - us(ts))).alias("gap_us"))


def map_dynamics(costs: DataFrame, rounds: tuple[int, ...] = (5, 2, 2), more: tuple[int, ...] = (1, 1, 1), least_rows: int = 5) -> DataFrame:
    """Per seq the rows whose pose has moved most: windows of the lengths `rounds` are picked one after
    another, each from what the ones before left; a seq with fewer than `least_rows` picked takes
    single rows too. costs: seq, idx, cost. Every round is a window over what is left; its few picks are
    written out, so plans stay short."""
    left, picked = costs, None
    for k, length in enumerate(rounds + more):
        pool = left
        if k >= len(rounds):
            full = picked.filter(F.col("__round") < len(rounds)).groupBy("seq").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least_rows)
            pool = left.join(full.select("seq"), "seq", "left_anti")
        # what is left closes ranks, so windows run over gaps
        dense = pool.withColumn("__idx", F.row_number().over(Window.partitionBy("seq").orderBy("idx")))
        got = moving_average_pick(dense.select("seq", F.col("__idx").alias("idx"), "cost", F.col("idx").alias("__old")), length)
        got = kept(got.select("seq", F.col("__old").alias("idx"), "cost", F.lit(k).alias("__round")))
        picked = got if picked is None else picked.unionByName(got)
        left = left.join(got.select("seq", "idx"), ["seq", "idx"], "left_anti")
    return picked.select("seq", "idx", "cost", F.col("__round").alias("round"))


def plane_moments(matches: DataFrame) -> DataFrame:
    """Per edge (ref, new) the sums of a point-to-plane alignment: nn (n n^T, 9), pn and qn (p and q
    times n n^T, 27 each, point component first), pq_nn (the sum of (n . p)(n . q)), pp and qq (squared
    lengths). matches: px.., qx.., nx... All terms add up, so partial sums do."""
    p, q, n = ([F.col(a + c) for c in "xyz"] for a in "pqn")
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    return matches.groupBy("ref", "new").agg(
        F.array(*[F.sum(a * b) for a in n for b in n]).alias("nn"),
        F.array(*[F.sum(x * a * b) for x in p for a in n for b in n]).alias("pn"),
        F.array(*[F.sum(x * a * b) for x in q for a in n for b in n]).alias("qn"),
        F.sum(dot(n, p) * dot(n, q)).alias("pq_nn"), F.sum(dot(p, p)).alias("pp"), F.sum(dot(q, q)).alias("qq"),
    )


def preserve_distance(matches: DataFrame, partners: int = 8, tolerance: float = 0.015, rounds: int = 1, prime: int = 7919) -> DataFrame:
    """Matches (ref, new, id, p, q) for which any of `partners` other matches of their edge keeps its
    distance: the two distances differ by less than `tolerance` of the depth.

    Partners are chosen by arithmetic on a match's number within its edge: number * prime + partner
    * 31 + 17, modulo the edge's matches. One join on (edge, number); a match is one row at each
    partner, so no group is held whole. `rounds` repeats the filter on what is left; what a round leaves
    is written, as the next one reads it three times.
    """
    edge = Window.partitionBy("ref", "new")
    for k in range(rounds):
        if k:
            matches = kept(matches)
        m = matches.withColumns({"__k": F.row_number().over(edge.orderBy("id")) - 1, "__n": F.count("*").over(edge)})
        pick = F.pmod(F.col("__k") * prime + F.col("__c") * 31 + 17, F.col("__n"))
        asks = m.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(partners - 1)))).withColumn("__k", pick)
        other = m.select("ref", "new", "__k", *[F.col(a + c).alias(f"__{a}{c}") for a in "pq" for c in "xyz"])
        met = asks.join(other.hint("merge"), ["ref", "new", "__k"])
        span = lambda a: F.sqrt(sum(((F.col(a + c) - F.col(f"__{a}{c}")) * (F.col(a + c) - F.col(f"__{a}{c}")) for c in "yz"), (F.col(a + "x") - F.col(f"__{a}x")) * (F.col(a + "x") - F.col(f"__{a}x"))))
        good = met.filter(F.abs(span("p") - span("q")) / F.col("pz") < tolerance).select("ref", "new", "id").distinct()
        matches = matches.join(good.hint("merge"), ["ref", "new", "id"], "left_semi")
    return matches


#: The entries (frame, row, column) of a point's Jacobian by its frame's translation and rotation:
#: unit rows and the skew matrix of the world point, as (kind, sign): kind 0 is 1, 1 to 3 are x, y, z.
_JACOBIAN = {(0, 0): (0, 1), (1, 1): (0, 1), (2, 2): (0, 1), (0, 4): (3, 1), (0, 5): (2, -1), (1, 3): (3, -1), (1, 5): (1, 1), (2, 3): (2, 1), (2, 4): (1, -1)}


def normal_blocks(matches: DataFrame, weight) -> DataFrame:
    """(row, col, i, j, value): the normal equations of all edges as 6 x 6 blocks by frames, and with
    j = 6 the right-hand side (col = row). Frames move as p -> exp(d) p, d = (translation, rotation).

    matches: ref, new, and world points px.. of ref and qx.. of new. First one sum of second moments
    by edge, then an edge's blocks as rows; nothing but sums is shuffled.
    """
    return blocks_of_moments(pair_moments(matches, weight))


def blocks_of_moments(m: DataFrame) -> DataFrame:
    """normal_blocks, of the edges' moments."""
    one = {0: F.col("sum_w")}
    first = {"p": one | {k: F.get("sp", F.lit(k - 1)) for k in (1, 2, 3)}, "q": one | {k: F.get("sq", F.lit(k - 1)) for k in (1, 2, 3)}}

    def moment(a: str, k: int, b: str, n: int):
        """The weighted sum of component k of a times component n of b; component 0 is 1."""
        if k == 0:
            return first[b][n]
        if n == 0:
            return first[a][k]
        if a == b:
            return F.get("spp" if a == "p" else "sqq", F.lit(3 * (k - 1) + n - 1))
        return F.get("spq", F.lit(3 * (k - 1) + n - 1) if a == "p" else F.lit(3 * (n - 1) + k - 1))

    out = []
    for a, row, sa in (("p", "ref", 1), ("q", "new", -1)):
        for b, col, sb in (("p", "ref", 1), ("q", "new", -1)):
            for i in range(6):
                for j in range(6):
                    terms = [moment(a, _JACOBIAN[r, i][0], b, _JACOBIAN[r, j][0]) * (_JACOBIAN[r, i][1] * _JACOBIAN[r, j][1] * sa * sb) for r in range(3) if (r, i) in _JACOBIAN and (r, j) in _JACOBIAN]
                    if terms:
                        out.append((row, col, i, j, sum(terms[1:], terms[0])))
        for i in range(6):
            terms = []
            for r in range(3):
                if (r, i) in _JACOBIAN:
                    k, s = _JACOBIAN[r, i]
                    terms += [moment(a, k, "p", r + 1) * (s * sa), moment(a, k, "q", r + 1) * (-s * sa)]
            out.append((row, row, i, 6, sum(terms[1:], terms[0])))
    rows = F.explode(F.array(*[F.struct(F.col(r).alias("row"), F.col(c).alias("col"), F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("value")) for r, c, i, j, v in out]))
    return m.select(rows.alias("b")).select("b.*").groupBy("row", "col", "i", "j").agg(F.sum("value").alias("value"))
