"""Text forms of results; they are written with DataFrame.write.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trajectory_lines(poses: DataFrame, keyframes: bool = False) -> DataFrame:
    """`ts tx ty tz qx qy qz qw`, with `keyframes` also `is_keyframe`, with eight decimals, as column
    value, in the order of ts."""
    form = " ".join(["%.8f"] * 8 + ["%d"] * keyframes)
    cols = ["ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw"] + ["is_keyframe"] * keyframes
    return poses.orderBy("ts").select(F.format_string(form, *cols).alias("value"))


def number_vertices(mesh: DataFrame, chunk: list[str], order: list[str]) -> DataFrame:
    """Adds `vertex`, a global number from 0: by chunk, then by `order` within it. Only the chunks'
    counts meet in one window, a row a chunk; vertices are numbered chunk by chunk."""
    counts = mesh.groupBy(*chunk).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = counts.select(*chunk, before.alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*chunk).orderBy(*order))
    return mesh.join(start, chunk).withColumn("vertex", F.col("__start") + inside - 1).drop("__start")


def mesh_lines(numbered: DataFrame) -> DataFrame:
    """(part, n, value): an ASCII mesh with colours, as lines in the order of (part, n). Part 0 is the
    head, 1 the vertices, 2 the faces, of three vertices each. numbered: vertex, x, y, z, r, g, b."""
    head = "ply|format ascii 1.0|element vertex %d|property float x|property float y|property float z|property uchar red|property uchar green|property uchar blue|element face %d|property list uchar int vertex_index|end_header"
    top = numbered.agg(F.count("*").alias("v"), F.floor(F.count("*") / 3).alias("f"))
    top = top.select(F.posexplode(F.split(F.format_string(head, "v", "f"), "[|]")).alias("n", "value"))
    body = F.format_string("%.6f %.6f %.6f %d %d %d", "x", "y", "z", *[F.col(c).cast("int") for c in "rgb"])
    face = numbered.filter("vertex % 3 = 0").select(F.lit(2).alias("part"), F.floor(F.col("vertex") / 3).alias("n"), F.format_string("3 %d %d %d", "vertex", F.col("vertex") + 1, F.col("vertex") + 2).alias("value"))
    vertices = numbered.select(F.lit(1).alias("part"), F.col("vertex").alias("n"), body.alias("value"))
    return top.select(F.lit(0).alias("part"), F.col("n").cast("bigint").alias("n"), "value").unionByName(vertices).unionByName(face)
