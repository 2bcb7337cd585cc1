"""Stateful operators, as grouped jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators.graph import kept
from lodeframe.plans import fixtures as fx
from lodeframe.plans.fixtures import duck
from lodeframe.plans.registry import query
from lodeframe.sources.frames import read_frame_log, read_frames, write_frame_log
from lodeframe.sources.live import live_frames
from lodeframe.streaming.beliefs import visit_beliefs
from lodeframe.streaming.keyframes import select_keyframes


@query("r1_keyframes", duck("fx_frames").replace("WITH fx_frames AS", "WITH RECURSIVE fx_frames AS MATERIALIZED", 1) + """,
k AS (SELECT seq, frame_index, 0 AS failures, true AS is_keyframe, frame_index AS keyframe FROM fx_frames WHERE frame_index = 0
  UNION ALL SELECT f.seq, f.frame_index, CASE WHEN new_ THEN 0 ELSE fail END, new_, CASE WHEN new_ THEN f.frame_index ELSE keyframe END FROM (
    SELECT f.seq, f.frame_index, k.keyframe, k.failures + CASE WHEN f.registered THEN 0 ELSE 1 END AS fail,
      (f.registered AND (f.disparity > 0.15 OR f.scale_ratio > 0.44)) OR k.failures + CASE WHEN f.registered THEN 0 ELSE 1 END > 3 AS new_
    FROM k JOIN fx_frames f ON f.seq = k.seq AND f.frame_index = k.frame_index + 1) f)
SELECT seq, frame_index, is_keyframe, CAST(keyframe AS INT) AS keyframe FROM k""")
def r1(spark, d):
    return select_keyframes(fx.frames(spark, d), least_disparity=0.15, least_scale=0.44)


def visit_scores(spark, d):
    """Similarities of a user's steps with the user's earlier steps of the same or the next band of disparity; n is a step's number of
    places. Steps meet by (user, band), so pairs that are far apart are not made."""
    steps = fx.frames(spark, d).selectExpr("seq", "frame_index AS step", "disparity", "CAST(floor(disparity * 25) AS INT) AS band")
    asks = steps.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    past = steps.select("seq", "band", F.col("step").alias("idx"), F.col("disparity").alias("other"))
    near = asks.join(past, ["seq", "band"]).filter("idx < step")
    scored = near.select("seq", "step", F.col("step").alias("n"), "idx", F.exp(-F.abs(F.col("disparity") - F.col("other")) * 20).alias("score"))
    none = steps.select("seq", "step", F.col("step").alias("n"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("score"))
    return scored.unionByName(none)


@query("r3_visit_beliefs")
def r3(spark, d):
    """State that depends on its own past: tested against a plain loop, and as a stream."""
    return visit_beliefs(visit_scores(spark, d))


def _logs(spark, d):
    """Frame logs written from the events of each user, depth and image as their bytes."""
    rows = fx.frames(spark, d).selectExpr("seq", "frame_index", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS ts", "encode(concat('d', event_id, repeat('.', 8 * 4 * 2 - 1 - length(event_id))), 'UTF-8') AS depth", "encode(concat('i', event_id), 'UTF-8') AS image")
    return write_frame_log(rows, "seq")


@query("s5_frame_log", duck("fx_frames") + """
SELECT seq, frame_index, epoch_us(ts) AS ts, CAST(64 AS INT) AS depth_size, true AS raw_depth, concat('i', event_id) AS image, count(*) OVER (PARTITION BY seq) AS n_frames FROM fx_frames""")
def s5(spark, d):
    got = read_frame_log(kept(_logs(spark, d)), width=8, height=4)
    return got.select(F.col("key").alias("seq"), "frame_index", "ts", F.octet_length("depth").alias("depth_size"), "raw_depth", F.decode("image", "UTF-8").alias("image"), F.col("n_frames").cast("bigint").alias("n_frames"))


@query("s4_frame_load", """
SELECT doc_id, 'rgb/' || doc_id AS path_rgb, octet_length(encode(coalesce(text, ''))) AS n_rgb, CASE WHEN doc_id % 9 <> 0 THEN octet_length(encode(coalesce(lang, ''))) END AS n_depth, doc_id % 9 <> 0 AS readable FROM documents""")
def s4(spark, d):
    """The files are rows (path, content), as spark.read.format("binaryFile") gives them; a ninth lacks its depth."""
    docs = fx.table(spark, d, "documents")
    manifest = docs.select("doc_id", F.format_string("rgb/%d", "doc_id").alias("path_rgb"), F.format_string("depth/%d", "doc_id").alias("path_depth"))
    blob = lambda c: F.encode(F.coalesce(c, F.lit("")), "UTF-8").alias("content")
    files = docs.select(F.format_string("rgb/%d", "doc_id").alias("path"), blob(F.col("text"))).unionByName(docs.filter("doc_id % 9 <> 0").select(F.format_string("depth/%d", "doc_id").alias("path"), blob(F.col("lang"))))
    got = read_frames(manifest, files)
    return got.select("doc_id", "path_rgb", F.octet_length("rgb").cast("bigint").alias("n_rgb"), F.octet_length("depth").cast("bigint").alias("n_depth"), "readable")


_SEEK = duck("fx_frames") + ", n AS (SELECT *, count(*) OVER (PARTITION BY seq) AS n_frames FROM fx_frames)"


@query("s6_log_positions", _SEEK + """
SELECT seq, CAST(frame_index AS INT) AS frame_index, n_frames, frame_index + 1 < n_frames AS has_more, CASE WHEN frame_index > 0 THEN frame_index - 1 END AS back, 0 AS rewound FROM n""")
def s6_positions(spark, d):
    from lodeframe.sources.frames import positions

    return positions(fx.frames(spark, d).select("seq", "frame_index"), "seq")


_POLLS = """polls AS MATERIALIZED (SELECT user_id AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS arrival, CAST(event_id % 4 AS INT) AS buffer, CAST(floor(value / 60) AS BIGINT) AS ts FROM events)"""


@query("s7_live_frames", "WITH RECURSIVE " + _POLLS + """, r AS (SELECT source, arrival, buffer, ts, true AS new_, buffer AS b, ts AS t FROM polls WHERE arrival = 0
  UNION ALL SELECT p.source, p.arrival, p.buffer, p.ts, p.buffer <> r.b AND p.ts <> r.t, CASE WHEN p.buffer <> r.b AND p.ts <> r.t THEN p.buffer ELSE r.b END, CASE WHEN p.buffer <> r.b AND p.ts <> r.t THEN p.ts ELSE r.t END
  FROM r JOIN polls p ON p.source = r.source AND p.arrival = r.arrival + 1)
SELECT source, arrival, buffer, ts FROM r WHERE new_""")
def s7(spark, d):
    """Polls of a ring of four buffers, for each user's events."""
    polls = fx.frames(spark, d).join(fx.table(spark, d, "events").select("event_id", "value"), "event_id")
    return live_frames(polls.selectExpr("seq AS source", "CAST(frame_index AS BIGINT) AS arrival", "CAST(event_id % 4 AS INT) AS buffer", "CAST(floor(value / 60) AS BIGINT) AS ts"))
