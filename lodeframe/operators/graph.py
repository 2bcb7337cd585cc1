"""Iterative graph jobs over edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local master may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    return root.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut."""
    path = f"{shared_root(df.sparkSession)}/lodeframe-kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, origin): the smallest id that each node reaches over edges (a, b), either way.

    Each round a node takes its neighbours' smallest label, then that label's own label, so chains
    shorten by half or more; it ends when no label changes. Only a count comes to the driver.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = kept(nodes.select("id", F.col("id").alias("origin")).distinct())
    for _ in range(rounds):
        seen = both.join(labels, both["a"] == labels["id"]).groupBy(F.col("b").alias("id")).agg(F.min("origin").alias("low"))
        step = labels.join(seen, "id", "left").select("id", "origin", F.least("origin", F.coalesce("low", "origin")).alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("origin").alias("far"))
        after = kept(step.join(jump, "new", "left").select("id", "origin", F.least("new", F.coalesce("far", "new")).alias("now")))
        changed = after.filter("now <> origin").count()
        labels = after.select("id", F.col("now").alias("origin"))
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
