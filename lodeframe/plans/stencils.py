"""Windowed depth filters over the fixture images."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import stencils as op
from lodeframe.plans import fixtures as fx
from lodeframe.plans.fixtures import duck
from lodeframe.plans.registry import query
from lodeframe.plans.space import points


@query("w6_bilateral_filter", duck("fx_dense") + """, p AS MATERIALIZED (SELECT frame_id, (frame_id * 100 + u) * 100 + v AS pk, u, v, depth_mm / 1000.0::DOUBLE AS d FROM fx_dense WHERE depth_mm IS NOT NULL),
s AS (SELECT i, j, (i * i + j * j) / 40.5::DOUBLE AS s FROM (SELECT unnest(range(-4, 5)) AS i), (SELECT unnest(range(-4, 5)) AS j)),
t AS (SELECT (frame_id * 100 + u + i) * 100 + v + j AS pk, d AS o, s FROM p, s WHERE u + i BETWEEN 0 AND 63 AND v + j BETWEEN 0 AND 47),
w AS (SELECT p.frame_id, p.u, p.v, t.o, exp(-t.s - pow(t.o - p.d, 2) / 0.0018::DOUBLE) AS w FROM t JOIN p ON p.pk = t.pk)
SELECT frame_id, u, v, round(sum(w * o) / sum(w), 6) AS depth FROM w GROUP BY frame_id, u, v""")
def w6(spark, d):
    px = fx.dense(spark, d).withColumn("metres", F.col("depth_mm") / 1000.0)
    return op.bilateral(px, "metres").withColumn("depth", F.round("depth", 6))


@query("w5_pca_normals")
def w5(spark, d):
    """Eigenvectors: tested against a plain decomposition."""
    return op.pca_normals(points(spark, d))
