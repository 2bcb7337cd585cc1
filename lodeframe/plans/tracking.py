"""Selections and states along a sequence of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import registration as op
from lodeframe.plans import fixtures as fx
from lodeframe.plans.fixtures import duck
from lodeframe.plans.registry import query


def _dynamics_sql() -> str:
    """The rounds of W3 as a chain of views: left k -> windows -> picked k -> left k + 1."""
    out = ["l0 AS (SELECT seq, frame_index AS idx, round(disparity, 9) AS cost FROM fx_frames)"]
    for k, n in enumerate((5, 2, 2, 1, 1, 1)):
        few = "" if k < 3 else " WHERE seq NOT IN (SELECT seq FROM (SELECT seq FROM p0 UNION ALL SELECT seq FROM p1 UNION ALL SELECT seq FROM p2) GROUP BY seq HAVING count(*) >= 5)"
        out.append(f"d{k} AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY idx) AS k FROM l{k}{few})")
        out.append(f"m{k} AS (SELECT *, avg(cost) OVER w AS m, count(*) OVER w AS n FROM d{k} WINDOW w AS (PARTITION BY seq ORDER BY k ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING))")
        out.append(f"b{k} AS (SELECT seq, k FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(m, 12) DESC, k) AS r FROM m{k} WHERE n = {n}) WHERE r = 1 AND m > 1e-4)")
        out.append(f"p{k} AS MATERIALIZED (SELECT d.seq, d.idx, {k} AS round FROM d{k} d JOIN b{k} b ON b.seq = d.seq AND d.k BETWEEN b.k AND b.k + {n - 1})")
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT * FROM l{k} WHERE (seq, idx) NOT IN (SELECT (seq, idx) FROM p{k}))")
    return ",\n".join(out)


@query("w3_map_dynamics", duck("fx_frames") + ",\n" + _dynamics_sql() + "\n" + " UNION ALL ".join(f"SELECT seq, idx AS frame_index, CAST(round AS INT) AS round FROM p{k}" for k in range(6)))
def w3(spark, d):
    c = fx.frames(spark, d).select("seq", F.col("frame_index").alias("idx"), F.round("disparity", 9).alias("cost"))
    return op.map_dynamics(c).select("seq", F.col("idx").alias("frame_index"), "round")
