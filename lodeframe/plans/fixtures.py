"""Views over the driver's tables that stand in for sensor data, once for each engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import geometry as g
from lodeframe.functions.hashing import descriptor

#: The fixture camera.
WIDTH, HEIGHT, FX, FY, CX, CY, SCALE, FAR = 64, 48, 60.0, 60.0, 31.5, 23.5, 1000.0, 10.0
VOXEL, CHUNK = 0.05, 8
PAIRS = [(k % 64, (k % 64 + 1 + (k // 64) * 17) % 64) for k in range(256)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "user_id AS seq",
        "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_index",
        "ts", "event_id", "value / 500 AS disparity", "(event_id % 10) / 20.0D AS scale_ratio", "event_type <> 'error' AS registered",
    )


def frame_ids(spark: SparkSession, d: str) -> DataFrame:
    """A frame for each supplier, so that images, poses and edges grow with the scale factor."""
    return table(spark, d, "supplier").selectExpr("s_suppkey AS frame_id", "s_nationkey % 5 AS region_id")


#: Frames that a task unfolds to pixels.
TASK_FRAMES = 64


def _grid(df: DataFrame) -> DataFrame:
    """Frames as pixels. They are dealt out by frame_id before they are unfolded, so that images are made by many tasks, a frame's pixels lie
    in one of them, and what works by frame moves no pixel."""
    df = df.repartition(-(-df.count() // TASK_FRAMES) or 1, "frame_id")
    return df.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(47))))


def dense(spark: SparkSession, d: str) -> DataFrame:
    n = _grid(frame_ids(spark, d).select("frame_id"))
    return n.selectExpr(
        "frame_id", "u", "v",
        "CASE WHEN (u * v + frame_id) % 23 = 0 THEN NULL ELSE 1000 + 5 * u + 3 * v + (frame_id * 17) % 50 END AS depth_mm",
        "(u * 4) % 256 AS r", "(v * 5) % 256 AS g", "(u + v) % 256 AS b",
    )


def px(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .selectExpr(
            "CAST(l_orderkey % 40 AS INT) AS frame_id", "CAST((l_partkey * 7 + l_linenumber) % 64 AS INT) AS u",
            "CAST((l_suppkey * 3 + l_linenumber) % 48 AS INT) AS v", "CAST(500 + (l_orderkey * 31 + l_partkey) % 3000 AS INT) AS depth_mm",
        )
        .groupBy("frame_id", "u", "v")
        .agg(F.min("depth_mm").alias("depth_mm"))
    )


def descriptors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.floor(F.col("vec_id") / 5).alias("image_id"),
        (F.col("vec_id") % 5).alias("feature_id"),
        descriptor(F.col("embedding"), PAIRS).alias("words"),
    )


def poses(spark: SparkSession, d: str) -> DataFrame:
    return frame_ids(spark, d).selectExpr(
        "frame_id", "0.0D AS qx", "0.0D AS qy", "sin(0.01D * frame_id) AS qz", "cos(0.01D * frame_id) AS qw",
        "0.05D * frame_id AS tx", "0.0D AS ty", "0.01D * frame_id AS tz", "0.05D * frame_id + 0.03D * region_id AS tx_prev",
    )


#: The camera of feature frames.
FEATURE_CAMERA = g.Camera(640, 480, 500.0, 500.0, 319.5, 239.5)
#: Landmarks a frame; the motion from each frame to the next, and the pixels' turn with it.
LANDMARKS, TURN, SHIFT, TURN_DEGREES = 40, (0.02, -0.01, 0.015), (0.05, -0.02, 0.03), 10.0


def next_motion() -> tuple[g.Quat, g.Vec]:
    """From a frame's camera space to the next frame's: a fixed turn, and a shift that differs by frame."""
    half = sum(a * a for a in TURN) ** 0.5
    q = g.Quat(*(F.lit(a) for a in TURN), F.lit((1 - half * half) ** 0.5))
    return q, g.Vec(F.lit(SHIFT[0]) + 0.01 * (F.col("frame_id") % 5), F.lit(SHIFT[1]), F.lit(SHIFT[2]))


def features(spark: SparkSession, d: str) -> DataFrame:
    """Features of a frame for each 40 parts: its own landmarks, those of the frame before as they are seen after the motion (a tenth
    of them at a wrong depth, two bits of each descriptor flipped), and look-alikes of those of three frames before, anywhere."""
    own = table(spark, d, "part").selectExpr(
        "CAST((p_partkey - 1) DIV 40 AS INT) AS frame_id", "p_partkey AS k", "(p_partkey * 37 % 2000) / 1000.0D - 1 AS x", "(p_partkey * 53 % 1500) / 1000.0D - 0.75 AS y",
        "1.5D + (p_partkey * 71 % 2000) / 1000.0D AS z", "(p_partkey * 37 % 360) * 1.0D AS angle", "CAST(p_partkey % 8 AS INT) AS octave",
    ).withColumn("words", F.array(*[F.xxhash64("k", F.lit(i)) for i in range(4)]))
    flip = lambda word, bit: F.array(*[F.get("words", F.lit(i)).bitwiseXOR(F.when(word == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))).otherwise(F.lit(0).cast("bigint"))) for i in range(4)])
    q, t = next_motion()
    seen = g.add(g.rotate(q, g.vec("x", "y", "z")), t)
    wrong = F.when(F.col("k") % 10 == 0, 0.4).otherwise(0.0)
    after = own.select((F.col("frame_id") + 1).alias("frame_id"), "k", seen.x.alias("x"), seen.y.alias("y"), (seen.z + wrong).alias("z"), F.pmod(F.col("angle") + TURN_DEGREES, F.lit(360.0)).alias("angle"), F.when(F.col("k") % 4 == 0, F.col("octave") + 1).otherwise(F.col("octave")).alias("octave"), flip(F.col("k") % 4, F.col("k") * 7 % 64).alias("words"))
    alike = own.select((F.col("frame_id") + 3).alias("frame_id"), "k", *[F.expr(e).alias(c) for c, e in (("x", "(k * 91 % 2000) / 1000.0D - 1"), ("y", "(k * 117 % 1500) / 1000.0D - 0.75"), ("z", "1.5D + (k * 203 % 2000) / 1000.0D"), ("angle", "(k * 61 % 360) * 1.0D"))], "octave", flip(F.col("k") % 3, F.col("k") % 61).alias("words"))
    last = own.agg(F.max("frame_id").alias("__last"))
    every = own.withColumn("kp_id", F.col("k") * 3).unionByName(after.withColumn("kp_id", F.col("k") * 3 + 1)).unionByName(alike.withColumn("kp_id", F.col("k") * 3 + 2))
    every = every.join(F.broadcast(last), F.col("frame_id") <= F.col("__last"))
    uv = g.project(g.vec("x", "y", "z"), FEATURE_CAMERA)
    return every.select("frame_id", "kp_id", "words", "x", "y", "z", uv.x.alias("u"), uv.y.alias("v"), "angle", "octave")


def feature_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each frame with the next one, which is true, and with the third after it, which is not."""
    f = features(spark, d).select(F.col("frame_id").alias("ref")).distinct()
    pairs = f.withColumn("new", F.explode(F.array(F.col("ref") + 1, F.col("ref") + 3)))
    return pairs.join(f.withColumnRenamed("ref", "new"), "new", "left_semi").select("ref", "new")


#: The same views as DuckDB common table expressions.
DUCK = {
    "fx_frames": """fx_frames AS (SELECT user_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_index,
  ts, event_id, value / 500 AS disparity, (event_id % 10) / 20.0::DOUBLE AS scale_ratio, event_type <> 'error' AS registered FROM events)""",
    "fx_dense": """fx_dense AS MATERIALIZED (SELECT s_suppkey AS frame_id, u, v,
  CASE WHEN (u * v + s_suppkey) % 23 = 0 THEN NULL ELSE 1000 + 5 * u + 3 * v + (s_suppkey * 17) % 50 END AS depth_mm,
  (u * 4) % 256 AS r, (v * 5) % 256 AS g, (u + v) % 256 AS b
  FROM supplier CROSS JOIN (SELECT unnest(range(0, 64))::INT AS u) CROSS JOIN (SELECT unnest(range(0, 48))::INT AS v))""",
    "fx_px": """fx_px AS (SELECT frame_id, u, v, min(depth_mm) AS depth_mm FROM (SELECT (l_orderkey % 40)::INT AS frame_id,
  ((l_partkey * 7 + l_linenumber) % 64)::INT AS u, ((l_suppkey * 3 + l_linenumber) % 48)::INT AS v,
  (500 + (l_orderkey * 31 + l_partkey) % 3000)::INT AS depth_mm FROM lineitem) GROUP BY frame_id, u, v)""",
    "fx_bits": """fx_bits AS (SELECT vec_id, vec_id // 5 AS image_id, vec_id % 5 AS feature_id, k,
  CAST(embedding[k % 64 + 1] < embedding[(k % 64 + 1 + (k // 64) * 17) % 64 + 1] AS INT) AS bit
  FROM embeddings CROSS JOIN (SELECT unnest(range(0, 256)) AS k))""",
    "fx_desc": """fx_desc AS (SELECT vec_id, image_id, feature_id, CAST(string_agg(bit::VARCHAR, '' ORDER BY k) AS BIT) AS d FROM fx_bits GROUP BY ALL)""",
    "fx_keys": """fx_keys AS (SELECT vec_id, image_id, feature_id, k // 8 AS table_id, CAST(sum(bit * (1 << (k % 8)::INT)) AS BIGINT) AS key
  FROM fx_bits GROUP BY ALL)""",
    "fx_pose": """fx_pose AS (SELECT s_suppkey AS frame_id, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, sin(0.01::DOUBLE * s_suppkey) AS qz, cos(0.01::DOUBLE * s_suppkey) AS qw,
  0.05::DOUBLE * s_suppkey AS tx, 0.0::DOUBLE AS ty, 0.01::DOUBLE * s_suppkey AS tz, 0.05::DOUBLE * s_suppkey + 0.03::DOUBLE * (s_nationkey % 5) AS tx_prev FROM supplier)""",
}
#: What searches join with: every image of a bucket; fx_buckets is the capped build.
DUCK["fx_index"] = "fx_index AS (SELECT table_id, key, image_id, min(feature_id) AS feature_id FROM fx_keys GROUP BY ALL)"
DUCK["fx_buckets"] = """fx_buckets AS (SELECT table_id, key, image_id, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY table_id, key ORDER BY image_id) AS rn
  FROM (SELECT table_id, key, image_id, min(feature_id) AS feature_id FROM fx_keys GROUP BY ALL)) WHERE rn <= 200)"""


def duck(*names: str) -> str:
    """WITH the named views, in order."""
    return "WITH " + ",\n".join(DUCK[n] for n in names)
