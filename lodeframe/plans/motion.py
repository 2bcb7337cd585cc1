"""Sequences of frames: keyframe drift, smoothing and alignment in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeframe.operators import registration as op
from lodeframe.plans import fixtures as fx
from lodeframe.plans.fixtures import duck
from lodeframe.plans.registry import query


@query("w2_moving_average_pick", duck("fx_frames") + """, m AS (SELECT *, avg(disparity) OVER w AS m, count(*) OVER w AS n FROM fx_frames WINDOW w AS (PARTITION BY seq ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
b AS (SELECT seq, frame_index AS f FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(m, 12) DESC, frame_index) AS rn FROM m WHERE n = 5) WHERE rn = 1 AND m > 1e-4)
SELECT x.seq, x.frame_index FROM fx_frames x JOIN b ON b.seq = x.seq AND x.frame_index BETWEEN f AND f + 4""")
def w2(spark, d):
    c = fx.frames(spark, d).select("seq", F.col("frame_index").alias("idx"), F.col("disparity").alias("cost"))
    return op.moving_average_pick(c, 5).select("seq", F.col("idx").alias("frame_index"))


@query("w8_neighbourhood_max", duck("fx_frames") + "\nSELECT seq, frame_index, max(disparity) OVER (PARTITION BY seq ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS belief FROM fx_frames")
def w8(spark, d):
    w = Window.partitionBy("seq").orderBy("frame_index").rowsBetween(-2, 2)
    return fx.frames(spark, d).select("seq", "frame_index", F.max("disparity").over(w).alias("belief"))


@query("s6_fast_forward", duck("fx_frames") + "\nSELECT seq, frame_index, event_id FROM fx_frames WHERE frame_index >= 20")
def s6(spark, d):
    return fx.frames(spark, d).filter("frame_index >= 20").select("seq", "frame_index", "event_id")


@query("j16_nearest_in_time", """
WITH v AS (SELECT user_id, ts, event_id AS id FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, event_id AS id FROM events WHERE event_type = 'click'),
x AS (SELECT v.user_id, v.id, c.id AS match, epoch_us(c.ts) - epoch_us(v.ts) AS gap_us, row_number() OVER (PARTITION BY v.user_id, v.id ORDER BY abs(epoch_us(c.ts) - epoch_us(v.ts)), c.ts, c.id) AS rn FROM v JOIN c ON c.user_id = v.user_id)
SELECT v.user_id, v.id, x.match, x.gap_us FROM v LEFT JOIN x ON x.user_id = v.user_id AND x.id = v.id AND rn = 1""")
def j16(spark, d):
    e = fx.table(spark, d, "events").withColumn("id", F.col("event_id"))
    return op.nearest_in_time(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), "user_id", "ts")


_MANIFEST = """t AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN format('{} rgb/{}.png x', event_id, event_id) WHEN event_id % 2 = 0 THEN format('{} rgb/{}.png {} depth/{}.png', event_id, event_id, event_id + 2, event_id)
  ELSE format('{} depth/{}.png {} rgb/{}.png', event_id, event_id, event_id + 2, event_id) END AS value FROM events), k AS (SELECT event_id, string_split_regex(trim(value), '\\s+') AS a FROM t)"""


@query("s1_manifest", "WITH " + _MANIFEST + """
SELECT event_id, (CAST(a[1] AS DOUBLE) + CAST(a[3] AS DOUBLE)) / 2 AS ts, CASE WHEN a[2] LIKE 'd%' THEN a[4] ELSE a[2] END AS color_path, CASE WHEN a[2] LIKE 'd%' THEN a[2] ELSE a[4] END AS depth_path FROM k WHERE len(a) = 4""")
def s1(spark, d):
    from lodeframe.sources.text import parse_manifest

    line = F.when(F.col("event_id") % 11 == 0, F.format_string("%d rgb/%d.png x", "event_id", "event_id")).when(
        F.col("event_id") % 2 == 0, F.format_string("%d rgb/%d.png %d depth/%d.png", "event_id", "event_id", F.col("event_id") + 2, "event_id")
    ).otherwise(F.format_string("%d depth/%d.png %d rgb/%d.png", "event_id", "event_id", F.col("event_id") + 2, "event_id"))
    return parse_manifest(fx.table(spark, d, "events").select("event_id", line.alias("value")))


@query("s2_ground_truth", "SELECT event_id, CAST(event_id AS DOUBLE) AS ts, round(value, 6) AS tx FROM events WHERE event_id % 13 <> 0")
def s2(spark, d):
    from lodeframe.sources.text import parse_numbers

    e = fx.table(spark, d, "events")
    line = F.format_string("%d %f 0 0 0 0 0 %s", "event_id", "value", F.when(F.col("event_id") % 13 == 0, "bad").otherwise("1"))
    good, _ = parse_numbers(e.select("event_id", line.alias("value")), ["ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw"])
    return good.select("event_id", "ts", F.round("tx", 6).alias("tx"))


@query("s9_trajectory_lines", duck("fx_pose") + """
SELECT format('{:.8f} {:.8f} {:.8f} {:.8f} {:.8f} {:.8f} {:.8f} {:.8f}', frame_id::DOUBLE, tx, ty, tz, qx, qy, round(qz, 7), round(qw, 7)) AS value FROM fx_pose WHERE frame_id % 3 <> 0""")
def s9(spark, d):
    from lodeframe.sinks import trajectory_lines

    p = fx.poses(spark, d).filter("frame_id % 3 <> 0").withColumns({"ts": F.col("frame_id").cast("double"), "qz": F.round("qz", 7), "qw": F.round("qw", 7)})
    return trajectory_lines(p)
