"""Calibration scan, view and keyframe exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.functions import geometry as g
from lodeframe.plans import fixtures as fx
from lodeframe.plans.fixtures import duck
from lodeframe.plans.registry import query
from lodeframe.sinks import trajectory_lines
from lodeframe.sources.text import parse_numbers

CALIBRATION = ["width", "height", "fx", "fy", "cx", "cy", "d0", "d1", "d2", "d3", "d4", "depth_scale", "max_depth"]


@query("s3_calibration", "SELECT s_suppkey, 640.0::DOUBLE AS width, s_suppkey + 500.0::DOUBLE AS fx, 1000.0::DOUBLE AS depth_scale FROM supplier WHERE s_suppkey % 4 <> 0")
def s3(spark, d):
    line = F.concat(F.format_string("640 480 %d 520 319.5 239.5 0 0 0 0 0 1000", F.col("s_suppkey") + 500), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(" 8"))
    rows, _ = parse_numbers(fx.table(spark, d, "supplier").select("s_suppkey", line.alias("value")), CALIBRATION)
    return rows.select("s_suppkey", "width", "fx", "depth_scale")


@query("s10_keyframe_lines", duck("fx_pose") + """
SELECT format('{:.8f} {:.8f} {:.8f} {:.8f} {:.8f} {:.8f} {:.8f} {:.8f} {}', frame_id::DOUBLE, tx, ty, tz, qx, qy, round(qz, 7), round(qw, 7), CAST(frame_id % 5 = 0 AS INT)) AS value FROM fx_pose""")
def s10(spark, d):
    p = fx.poses(spark, d).withColumns({"ts": F.col("frame_id").cast("double"), "qz": F.round("qz", 7), "qw": F.round("qw", 7)})
    return trajectory_lines(p.withColumn("is_keyframe", (F.col("frame_id") % 5 == 0).cast("int")), keyframes=True)


@query("s15_camera_views", duck("fx_pose") + """
SELECT frame_id, round(-qz, 6) + 0.0 AS qz, round(qw, 6) AS qw, round(-((1 - 2 * qz * qz) * tx + 2 * qz * qw * ty), 6) + 0.0 AS tx, round(-(-2 * qz * qw * tx + (1 - 2 * qz * qz) * ty), 6) + 0.0 AS ty, round(-tz, 6) + 0.0 AS tz, 0.9375::DOUBLE AS fx, 1.25::DOUBLE AS fy FROM fx_pose""")
def s15(spark, d):
    i = g.invert(g.pose_of())
    z = lambda c: F.round(c, 6) + 0.0
    return fx.poses(spark, d).select("frame_id", z(i.q.z).alias("qz"), F.round(i.q.w, 6).alias("qw"), z(i.t.x).alias("tx"), z(i.t.y).alias("ty"), z(i.t.z).alias("tz"), F.lit(60.0 / 64).alias("fx"), F.lit(60.0 / 48).alias("fy"))


@query("j14_member_poses", duck("fx_pose") + """
SELECT m.frame_id, k.frame_id AS keyframe, round((1 - 2 * k.qz * k.qz) * m.tx - 2 * k.qz * k.qw * m.ty + k.tx, 6) + 0.0 AS tx, round(2 * k.qz * k.qw * m.tx + (1 - 2 * k.qz * k.qz) * m.ty + k.ty, 6) + 0.0 AS ty, round(m.tz + k.tz, 6) AS tz
FROM fx_pose m JOIN fx_pose k ON k.frame_id = m.frame_id - m.frame_id % 5""")
def j14(spark, d):
    p = fx.poses(spark, d)
    names = ("qx", "qy", "qz", "qw", "tx", "ty", "tz")
    k = p.select(F.col("frame_id").alias("keyframe"), *[F.col(c).alias("k_" + c) for c in names])
    both = p.join(k, F.col("keyframe") == F.col("frame_id") - F.col("frame_id") % 5)
    w = g.compose(g.pose_of("k_"), g.pose_of())
    return both.select("frame_id", "keyframe", (F.round(w.t.x, 6) + 0.0).alias("tx"), (F.round(w.t.y, 6) + 0.0).alias("ty"), F.round(w.t.z, 6).alias("tz"))
