"""Text sources: lines are parsed as columns; what does not parse is kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Lines `value` of four tokens (time, path, time, path): the mean time and the two paths. A
    first path that begins with d is the depth; lines of other lengths are dropped."""
    rest = [c for c in lines.columns if c != "value"]
    t = lines.select(*rest, F.split(F.trim("value"), r"\s+").alias("a")).filter(F.size("a") == 4)
    depth_first = F.get("a", F.lit(1)).startswith("d")
    mean = (F.get("a", F.lit(0)).cast("double") + F.get("a", F.lit(2)).cast("double")) / 2
    pick = lambda yes, no: F.when(depth_first, F.get("a", F.lit(yes))).otherwise(F.get("a", F.lit(no)))
    return t.select(*rest, mean.alias("ts"), pick(3, 1).alias("color_path"), pick(1, 3).alias("depth_path"))


def parse_numbers(lines: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): lines `value` of exactly the named numbers, and all other lines."""
    rest = [c for c in lines.columns if c != "value"]
    t = lines.withColumn("__a", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double")))
    good = (F.size("__a") == len(names)) & ~F.exists("__a", lambda x: x.isNull())
    rows = t.filter(good).select(*rest, *[F.get("__a", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rows, t.filter(~good).drop("__a")
