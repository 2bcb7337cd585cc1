"""Frame-pair moments and errors over `part`, joined to edges between frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.functions import geometry as g
from lodeframe.operators import registration as op
from lodeframe.operators import rigid
from lodeframe.operators.graph import kept
from lodeframe.plans import fixtures as fx
from lodeframe.plans.registry import query

#: Matched points of edges n -> n + 1 and n -> n + 5, in metres off whole millimetres.
MATCHES = """m AS (SELECT p_partkey % 25 AS ref, (p_partkey % 25 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 5 END) % 25 AS new, p_partkey AS id,
  (p_partkey * 37 % 2000) / 1000.0::DOUBLE AS px, (p_partkey * 53 % 2000) / 1000.0::DOUBLE AS py, 1 + (p_partkey * 71 % 3000) / 1000.0::DOUBLE AS pz FROM part),
mm AS (SELECT *, px + 0.01 + (id % 7) / 1000.0::DOUBLE AS qx, py - 0.02 AS qy, pz + (id % 5) / 1000.0::DOUBLE AS qz, 1 / (pz * pz) AS w FROM m)"""


def matches(spark, d):
    m = fx.table(spark, d, "part").selectExpr(
        "CAST(p_partkey % 25 AS INT) AS ref", "CAST((p_partkey % 25 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 5 END) % 25 AS INT) AS new", "p_partkey AS id",
        "(p_partkey * 37 % 2000) / 1000.0D AS px", "(p_partkey * 53 % 2000) / 1000.0D AS py", "1 + (p_partkey * 71 % 3000) / 1000.0D AS pz",
    )
    return m.withColumns({"qx": F.col("px") + 0.01 + (F.col("id") % 7) / 1000.0, "qy": F.col("py") - 0.02, "qz": F.col("pz") + (F.col("id") % 5) / 1000.0})


def moments(spark, d):
    return op.pair_moments(matches(spark, d), 1 / (F.col("pz") * F.col("pz")))


@query("a5_pair_moments", "WITH " + MATCHES + """
SELECT CAST(ref AS INT) AS ref, CAST(new AS INT) AS new, round(sum(w), 6) AS sum_w, round(sum(w * px), 6) AS spx, round(sum(w * qz), 6) AS sqz, round(sum(w * px * py), 6) AS spp1, round(sum(w * py * qz), 6) AS spq5 FROM mm GROUP BY ref, new""")
def a5(spark, d):
    get = lambda c, i, n: F.round(F.get(c, F.lit(i)), 6).alias(n)
    return moments(spark, d).select("ref", "new", F.round("sum_w", 6).alias("sum_w"), get("sp", 0, "spx"), get("sq", 2, "sqz"), get("spp", 1, "spp1"), get("spq", 5, "spq5"))


@query("a6_huber_moments", "WITH " + MATCHES + """, h AS (SELECT *, w * least(1.0, 0.001 * pz / sqrt(pow(px - qx, 2) + pow(py - qy, 2) + pow(pz - qz, 2))) * abs(new - ref) AS hw FROM mm)
SELECT CAST(ref AS INT) AS ref, CAST(new AS INT) AS new, round(sum(hw), 6) AS sum_w, round(sum(hw * px), 6) AS spx FROM h GROUP BY ref, new""")
def a6(spark, d):
    gap = sum(((F.col("p" + c) - F.col("q" + c)) * (F.col("p" + c) - F.col("q" + c)) for c in "yz"), (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")))
    w = 1 / (F.col("pz") * F.col("pz")) * F.least(F.lit(1.0), 0.001 * F.col("pz") / F.sqrt(gap)) * F.abs(F.col("new") - F.col("ref"))
    m = op.pair_moments(matches(spark, d), w)
    return m.select("ref", "new", F.round("sum_w", 6).alias("sum_w"), F.round(F.get("sp", F.lit(0)), 6).alias("spx"))


#: A motion of p for each edge: a turn about z and a shift.
_MOVED = """mv AS (SELECT *, cos(0.001 * (ref % 7)) * px - sin(0.001 * (ref % 7)) * py + 0.005 AS mx, sin(0.001 * (ref % 7)) * px + cos(0.001 * (ref % 7)) * py - 0.01 AS my, pz AS mz FROM mm)"""
_ERR = _MOVED + """, e AS (SELECT ref, new, sum(w) AS sum_w, sqrt(sum(w * (pow(mx - qx, 2) + pow(my - qy, 2) + pow(mz - qz, 2)))) / sum(w) AS error FROM mv GROUP BY ref, new)"""


def _motions(edges):
    c, s, zero, one = F.cos(0.001 * (F.col("ref") % 7)), F.sin(0.001 * (F.col("ref") % 7)), F.lit(0.0), F.lit(1.0)
    return edges.withColumns({"r": F.array(c, -s, zero, s, c, zero, zero, zero, one), "t": F.array(F.lit(0.005), F.lit(-0.01), zero)})


def _errors(spark, d):
    """From moments alone."""
    m = _motions(moments(spark, d))
    return m.withColumn("error", rigid.motion_error(m))


@query("a8_edge_errors", "WITH " + MATCHES + ",\n" + _ERR + "\nSELECT CAST(ref AS INT) AS ref, CAST(new AS INT) AS new, round(error, 6) AS error FROM e")
def a8(spark, d):
    return _errors(spark, d).select("ref", "new", F.round("error", 6).alias("error"))


@query("a8_frame_errors", "WITH " + MATCHES + ",\n" + _ERR + """, x AS (SELECT ref AS frame_id, error, sum_w FROM e UNION ALL SELECT new, error, sum_w FROM e)
SELECT CAST(frame_id AS INT) AS frame_id, round(CASE WHEN sum(sum_w) < 1 THEN 1e8 ELSE sum(error * sum_w) / sum(sum_w) END, 6) AS error, count(*) AS degree FROM x GROUP BY frame_id""")
def a8f(spark, d):
    return op.errors_per_frame(_errors(spark, d)).select("frame_id", F.round("error", 6).alias("error"), "degree")


_GAPS = _MOVED + """, gp AS (SELECT *, sqrt(pow(mx - qx, 2) + pow(my - qy, 2) + pow(mz - qz, 2)) / pz AS gap FROM mv)"""


@query("a9_point_errors", "WITH " + MATCHES + ",\n" + _GAPS + "\nSELECT CAST(ref AS INT) AS ref, CAST(new AS INT) AS new, round(sqrt(sum(gap * gap)) / count(*), 9) AS error FROM gp GROUP BY ref, new")
def a9(spark, d):
    m = matches(spark, d)
    return rigid.point_errors(m, _motions(m.select("ref", "new").distinct())).withColumn("error", F.round("error", 9))


@query("a9_huber_errors", "WITH " + MATCHES + ",\n" + _GAPS + "\nSELECT CAST(ref AS INT) AS ref, CAST(new AS INT) AS new, round(sqrt(sum(gap * gap * CASE WHEN gap > 0.008 THEN 0.008 / gap ELSE 1 END)) / count(*), 9) AS error FROM gp GROUP BY ref, new")
def a9_huber(spark, d):
    m = matches(spark, d)
    return rigid.point_errors(m, _motions(m.select("ref", "new").distinct()), huber=0.008).withColumn("error", F.round("error", 9))


@query("a11_scale_change", "WITH " + MATCHES + """
SELECT CAST(ref AS INT) AS ref, CAST(new AS INT) AS new, round(greatest(sum(CASE WHEN id % 8 > id % 5 THEN 1 ELSE 0 END), sum(CASE WHEN id % 8 < id % 5 THEN 1 ELSE 0 END)) / (count(*) + 1), 9) AS scale FROM mm GROUP BY ref, new""")
def a11(spark, d):
    up, down = (F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("id") % 8 > F.col("id") % 5, F.col("id") % 8 < F.col("id") % 5))
    return matches(spark, d).groupBy("ref", "new").agg(F.round(F.greatest(up, down) / (F.count("*") + 1), 9).alias("scale"))


@query("t2_best_reference", "WITH " + MATCHES + ",\n" + _ERR + "\nSELECT CAST(new AS INT) AS new, CAST(ref AS INT) AS ref FROM (SELECT *, row_number() OVER (PARTITION BY new ORDER BY round(error, 9), ref) AS rn FROM e) WHERE rn = 1")
def t2(spark, d):
    best = _errors(spark, d).groupBy("new").agg(F.min(F.struct(F.round("error", 9).alias("e"), "ref")).alias("b"))
    return best.select("new", F.col("b.ref").alias("ref"))


_BINS = """b AS (SELECT ref AS key, id, CAST(floor((id * 47 % 360) / 20.0) AS BIGINT) AS bin FROM mm), c AS (SELECT key, bin, count(*) AS n FROM b GROUP BY key, bin),
t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, bin) AS rank, max(n) OVER (PARTITION BY key) AS m FROM c), top AS (SELECT * FROM t WHERE rank <= 3 AND n >= 0.1 * m)"""


def _angles(spark, d):
    return matches(spark, d).select(F.col("ref").alias("key"), "id", (F.col("id") * 47 % 360).cast("double").alias("angle"))


@query("t3_top_bins", "WITH " + MATCHES + ",\n" + _BINS + "\nSELECT CAST(key AS INT) AS key, bin, n, CAST(rank AS INT) AS rank FROM top")
def t3(spark, d):
    b = _angles(spark, d).withColumn("bin", F.floor(F.col("angle") / 20.0)).groupBy("key", "bin").agg(F.count("*").alias("n"))
    return op.top_bins(b)


@query("t4_rotation_filter", "WITH " + MATCHES + ",\n" + _BINS + """, keep AS (SELECT key, bin FROM top UNION SELECT key, (bin + o + 18) % 18 FROM top, (SELECT unnest([-1, 1]) AS o) WHERE rank = 1)
SELECT CAST(b.key AS INT) AS key, b.id FROM b SEMI JOIN keep k ON b.key = k.key AND b.bin = k.bin""")
def t4(spark, d):
    return op.rotation_consistent(_angles(spark, d)).select("key", "id")


@query("t5_spatial_thinning", """
WITH k AS (SELECT vec_id % 25 AS frame_id, vec_id AS kp_id, (vec_id * 13 % 640) / 10.0::DOUBLE AS x, (vec_id * 7 % 480) / 10.0::DOUBLE AS y, vec_id * 31 % 97 AS response FROM embeddings)
SELECT frame_id, kp_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, floor(x / 16.0), floor(y / 16.0) ORDER BY response DESC, kp_id) AS rn FROM k) WHERE rn = 1""")
def t5(spark, d):
    k = fx.table(spark, d, "embeddings").selectExpr("vec_id % 25 AS frame_id", "vec_id AS kp_id", "(vec_id * 13 % 640) / 10.0D AS x", "(vec_id * 7 % 480) / 10.0D AS y", "vec_id * 31 % 97 AS response")
    return op.thin(k, 16.0).select("frame_id", "kp_id")


#: 120 points a frame over four levels; depths 0 to 6.
_QUOTAS = op.level_quotas(120, 4)


@query("t5_quad_tree_thinning", f"""
WITH k AS (SELECT l_suppkey AS frame_id, l_linenumber % 4 AS level, l_orderkey * 8 + l_linenumber AS kp_id, (l_partkey * 131 + l_linenumber * 17) % 640 + 0.25::DOUBLE AS x, (l_orderkey * 37 + l_partkey) % 480 + 0.25::DOUBLE AS y, (l_orderkey * 31 + l_partkey) % 97 AS response FROM lineitem),
c AS MATERIALIZED (SELECT frame_id, level, depth, CAST(floor(x / 640.0 * (1 << depth)) AS INT) AS cx, CAST(floor(y / 480.0 * (1 << depth)) AS INT) AS cy, count(*) AS n, max((response, -kp_id)) AS best FROM k, (SELECT unnest(range(0, 7))::INT AS depth) GROUP BY ALL),
f AS (SELECT frame_id, level, depth, count(*) AS cells, {_QUOTAS}[level + 1] AS quota FROM c GROUP BY ALL),
ch AS (SELECT frame_id, level, quota, coalesce(max(depth) FILTER (cells <= quota), 0) AS depth FROM f GROUP BY ALL),
o AS (SELECT c.*, quota, count(*) OVER (PARTITION BY c.frame_id, c.level) AS cells, (SELECT count(*) FROM c q WHERE q.frame_id = c.frame_id AND q.level = c.level AND q.depth = c.depth + 1 AND q.cx // 2 = c.cx AND q.cy // 2 = c.cy) AS quarters FROM c JOIN ch USING (frame_id, level, depth)),
s AS (SELECT *, sum(greatest(quarters - 1, 0)) OVER (PARTITION BY frame_id, level ORDER BY (quarters < 2)::INT, n DESC, cx, cy ROWS UNBOUNDED PRECEDING) AS more FROM o),
b AS (SELECT frame_id, level, quota, best FROM s WHERE NOT (quarters > 1 AND cells + more <= quota)
  UNION ALL SELECT s.frame_id, s.level, quota, q.best FROM s JOIN c q ON q.frame_id = s.frame_id AND q.level = s.level AND q.depth = s.depth + 1 AND q.cx // 2 = s.cx AND q.cy // 2 = s.cy WHERE quarters > 1 AND cells + more <= quota)
SELECT frame_id, CAST(level AS INT) AS level, -best[2] AS kp_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, level ORDER BY best DESC) AS rank FROM b) WHERE rank <= quota""")
def t5_quad(spark, d):
    k = fx.table(spark, d, "lineitem").selectExpr("l_suppkey AS frame_id", "CAST(l_linenumber % 4 AS INT) AS level", "l_orderkey * 8 + l_linenumber AS kp_id", "(l_partkey * 131 + l_linenumber * 17) % 640 + 0.25D AS x", "(l_orderkey * 37 + l_partkey) % 480 + 0.25D AS y", "(l_orderkey * 31 + l_partkey) % 97 AS response")
    return op.quad_thin(k, 640.0, 480.0, _QUOTAS, depth=6)


@query("t6_first_match", "WITH " + MATCHES + "\nSELECT CAST(ref AS INT) AS ref, id % 10 AS q, min(id) AS id FROM mm GROUP BY ref, id % 10")
def t6(spark, d):
    return matches(spark, d).groupBy("ref", (F.col("id") % 10).alias("q")).agg(F.min("id").alias("id"))


@query("d3_append_correspondences", "WITH " + MATCHES + "\nSELECT CAST(ref AS INT) AS ref, id FROM mm WHERE id % 2 = 0 UNION ALL SELECT CAST(ref AS INT), id FROM mm WHERE id % 2 = 1")
def d3(spark, d):
    m = matches(spark, d).select("ref", "id")
    return m.filter("id % 2 = 0").unionByName(m.filter("id % 2 = 1"))


_TRIALS = """tr AS (SELECT unnest(range(0, 12)) AS trial), hit AS (SELECT ref, new, trial,
  sqrt(pow(cos(0.0005 * trial) * px - sin(0.0005 * trial) * py + 0.008 + 0.001 * trial - qx, 2) + pow(sin(0.0005 * trial) * px + cos(0.0005 * trial) * py - 0.02 - qy, 2) + pow(pz + 0.0002 * trial - qz, 2)) / pz AS gap FROM mm, tr)"""


@query("g2_inlier_counts", "WITH " + MATCHES + ",\n" + _TRIALS + "\nSELECT CAST(ref AS INT) AS ref, CAST(new AS INT) AS new, CAST(trial AS INT) AS trial, count(*) AS inliers FROM hit WHERE gap < 0.002 GROUP BY ref, new, trial")
def g2_counts(spark, d):
    """The scoring of trials, by given ones; in chunks of 16 matches."""
    m = matches(spark, d)
    k = F.col("trial")
    c, s, zero, one = F.cos(0.0005 * k), F.sin(0.0005 * k), F.lit(0.0), F.lit(1.0)
    trials = m.select("ref", "new").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(11))))
    trials = trials.withColumns({"r": F.array(c, -s, zero, s, c, zero, zero, zero, one), "t": F.array(0.008 + 0.001 * k, F.lit(-0.02), 0.0002 * k)})
    return rigid.inlier_counts(m, trials, 0.002, chunk=16)


@query("g2_best_trials")
def g2(spark, d):
    """Seeded sampling and small decompositions: tested against a known motion."""
    m = kept(matches(spark, d))
    return rigid.best_trials(m, kept(rigid.trial_motions(m)), 0.02)


_HUBER = """h AS (SELECT *, sqrt(pow(mx - qx, 2) + pow(my - qy, 2) + pow(mz - qz, 2)) / pz AS gap FROM mv), x AS (SELECT *, CASE WHEN gap > 0.005 THEN 0.005 / gap ELSE 1 END / pz AS hw FROM h)"""


@query("g3_step_sums", "WITH " + MATCHES + ",\n" + _MOVED + ",\n" + _HUBER + """
SELECT CAST(ref AS INT) AS ref, CAST(new AS INT) AS new, round(sum(hw), 6) AS w, round(sum(hw * my), 6) AS wy, round(sum(hw * mx * mz), 6) AS wxz, round(sum(hw * (mx - qx)), 6) AS ex,
  round(sum(hw * (my * (mz - qz) - mz * (my - qy))), 6) AS tx, round(sum(hw * (mz * (mx - qx) - mx * (mz - qz))), 6) AS ty, round(sum(hw * (mx * (my - qy) - my * (mx - qx))), 6) AS tz FROM x GROUP BY ref, new""")
def g3_sums(spark, d):
    """What one Gauss-Newton step is solved from, at given motions."""
    m = matches(spark, d)
    got = rigid.step_sums(m, _motions(m.select("ref", "new").distinct()), 0.005)
    at = lambda c, i, n: F.round(F.get(c, F.lit(i)), 6).alias(n)
    return got.select("ref", "new", F.round("w", 6).alias("w"), at("wx", 1, "wy"), at("wxx", 2, "wxz"), at("we", 0, "ex"), at("wm", 0, "tx"), at("wm", 1, "ty"), at("wm", 2, "tz"))


@query("g3_refined_motions")
def g3(spark, d):
    """Six steps from given motions: tested against a known motion and against the least sum."""
    m = kept(matches(spark, d))
    return rigid.refine(m, _motions(m.select("ref", "new").distinct()))


@query("g4_robust_alignment")
def g4(spark, d):
    """Trials, refinement, selection and the error by moments: tested against a known motion. Inliers come with their weights."""
    m = matches(spark, d)
    q = g.project(g.vec("qx", "qy", "qz"), fx.FEATURE_CAMERA)
    m = kept(m.withColumns({"q": F.col("id"), "qu": q.x, "qv": q.y}))
    motions, inliers = rigid.align(m.select("ref", "new").distinct(), m, m, fx.FEATURE_CAMERA)
    return inliers.select("ref", "new", "id", "weight").join(motions, ["ref", "new"], "right")


@query("g5_pair_registration")
def g5(spark, d):
    """Two searches and two robust motions a frame pair: tested against the frames' known motions, and with pairs that only look alike."""
    return rigid.register_pairs(kept(fx.features(spark, d)), kept(fx.feature_pairs(spark, d)), fx.FEATURE_CAMERA)[0]


_J = "[[1, 0, 0, 0, {0}z, -{0}y], [0, 1, 0, -{0}z, 0, {0}x], [0, 0, 1, {0}y, -{0}x, 0]]"


@query("g6_normal_blocks", "WITH " + MATCHES + f""", j AS (SELECT ref, new, w, {_J.format('p')} AS jp, {_J.format('q')} AS jq, [px - qx, py - qy, pz - qz] AS e FROM mm),
x AS (SELECT ref AS row, ref AS col, w, jp AS a, jp AS b, 1 AS s FROM j UNION ALL SELECT new, new, w, jq, jq, 1 FROM j UNION ALL SELECT ref, new, w, jp, jq, -1 FROM j UNION ALL SELECT new, ref, w, jq, jp, -1 FROM j),
h AS (SELECT row, col, i, j, s * w * (a[1][i + 1] * b[1][j + 1] + a[2][i + 1] * b[2][j + 1] + a[3][i + 1] * b[3][j + 1]) AS value FROM x, (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(range(0, 6)) AS j)
  UNION ALL SELECT ref, ref, i, 6, w * (jp[1][i + 1] * e[1] + jp[2][i + 1] * e[2] + jp[3][i + 1] * e[3]) FROM j, (SELECT unnest(range(0, 6)) AS i)
  UNION ALL SELECT new, new, i, 6, -w * (jq[1][i + 1] * e[1] + jq[2][i + 1] * e[2] + jq[3][i + 1] * e[3]) FROM j, (SELECT unnest(range(0, 6)) AS i))
SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(value), 4) + 0.0 AS value FROM h GROUP BY ALL HAVING round(sum(value), 4) <> 0""")
def g6(spark, d):
    blocks = op.normal_blocks(matches(spark, d), 1 / (F.col("pz") * F.col("pz")))
    return blocks.withColumn("value", F.round("value", 4) + 0.0).filter("value <> 0")


@query("g1_distance_filter", "WITH " + MATCHES + """, n AS (SELECT *, row_number() OVER (PARTITION BY ref, new ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY ref, new) AS n FROM mm),
a AS (SELECT *, (k * 7919 + c * 31 + 17) % n AS o FROM n, (SELECT unnest(range(0, 8)) AS c))
SELECT DISTINCT CAST(a.ref AS INT) AS ref, CAST(a.new AS INT) AS new, a.id FROM a JOIN n b ON b.ref = a.ref AND b.new = a.new AND b.k = a.o
WHERE abs(sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2)) - sqrt(pow(a.qx - b.qx, 2) + pow(a.qy - b.qy, 2) + pow(a.qz - b.qz, 2))) / a.pz < 0.00015037""")
def g1(spark, d):
    """The tolerance is narrow because the fixture's points hardly move against each other."""
    return op.preserve_distance(matches(spark, d), tolerance=0.00015037).select("ref", "new", "id")


@query("a7_plane_moments", "WITH " + MATCHES + """, n AS (SELECT *, (id % 3) / 7.0::DOUBLE AS nx, (id % 5) / 7.0::DOUBLE AS ny, 0.5::DOUBLE AS nz FROM mm)
SELECT CAST(ref AS INT) AS ref, CAST(new AS INT) AS new, round(sum(nx * ny), 6) AS nn1, round(sum(px * ny * nz), 6) AS pn5, round(sum(qz * nx * nx), 6) AS qn18, round(sum((nx * px + ny * py + nz * pz) * (nx * qx + ny * qy + nz * qz)), 5) AS pq_nn,
  round(sum(px * px + py * py + pz * pz), 8) AS pp, round(sum(qx * qx + qy * qy + qz * qz), 8) AS qq FROM n GROUP BY ref, new""")
def a7(spark, d):
    m = matches(spark, d).withColumns({"nx": (F.col("id") % 3) / 7.0, "ny": (F.col("id") % 5) / 7.0, "nz": F.lit(0.5)})
    get = lambda c, i: F.round(F.get(c, F.lit(i)), 6).alias(f"{c}{i}")
    return op.plane_moments(m).select("ref", "new", get("nn", 1), get("pn", 5), get("qn", 18), F.round("pq_nn", 5).alias("pq_nn"), *[F.round(c, 8).alias(c) for c in ("pp", "qq")])


@query("f10_outlier_rejection", "WITH " + MATCHES + """
SELECT CAST(ref AS INT) AS ref, id FROM mm WHERE sqrt(pow(px + 0.012 - qx, 2) + pow(py - 0.02 - qy, 2) + pow(pz - qz, 2)) / pz < 0.002
  AND sqrt(pow(60 * (px + 0.012) / pz - 60 * qx / qz, 2) + pow(60 * (py - 0.02) / pz - 60 * qy / qz, 2)) < 6""")
def f10(spark, d):
    moved = g.Vec(F.col("px") + 0.012, F.col("py") - 0.02, F.col("pz"))
    q = g.vec("qx", "qy", "qz")
    uv = lambda p: (60.0 * p.x / p.z, 60.0 * p.y / p.z)
    (a, b), (c, e) = uv(moved), uv(q)
    keep = (g.norm(g.sub(moved, q)) / F.col("pz") < 0.002) & (F.sqrt((a - c) * (a - c) + (b - e) * (b - e)) < 6)
    return matches(spark, d).filter(keep).select("ref", "id")
