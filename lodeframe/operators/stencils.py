"""Depth filters and normals that look at a window of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bilateral(px: DataFrame, depth: str, radius: int = 4, sigma_range: float = 0.03, sigma_space: float = 4.5) -> DataFrame:
    """(frame_id, u, v, depth): each valid pixel's mean over the square of `radius` around it, weighted
    by closeness in the image and in depth.

    Each pixel is told to the pixels around it; one join brings them together with their own depth,
    and sums are partial on the map side. A missing depth takes no part and stays missing.
    """
    own = px.filter(F.col(depth).isNotNull()).select("frame_id", "u", "v", F.col(depth).alias("__d"))
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    told = own.withColumn("__i", steps).withColumn("__j", steps)
    space = (F.col("__i") * F.col("__i") + F.col("__j") * F.col("__j")) / F.lit(2.0 * sigma_space**2)
    told = told.select("frame_id", (F.col("u") + F.col("__i")).alias("u"), (F.col("v") + F.col("__j")).alias("v"), F.col("__d").alias("__o"), space.alias("__s"))
    both = told.join(own, ["frame_id", "u", "v"])
    gap = F.col("__o") - F.col("__d")
    w = F.exp(-F.col("__s") - gap * gap / F.lit(2.0 * sigma_range**2))
    return both.groupBy("frame_id", "u", "v").agg((F.sum(w * F.col("__o")) / F.sum(w)).alias("depth"))


def pca_normals(points: DataFrame, radius: int = 2, least: int = 5) -> DataFrame:
    """(frame_id, u, v, nx, ny, nz): the direction of least spread of the camera-space points in the
    square of `radius` around each pixel, turned to the camera.

    Covariances are sums in Spark; the eigenvectors of the 3 x 3 matrices are found in batches.
    Pixels with fewer than `least` points around have no normal. points: frame_id, u, v, x, y, z.
    """
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    told = points.select("frame_id", "u", "v", "x", "y", "z").withColumn("__i", steps).withColumn("__j", steps)
    told = told.select("frame_id", (F.col("u") + F.col("__i")).alias("u"), (F.col("v") + F.col("__j")).alias("v"), "x", "y", "z")
    c = ["x", "y", "z"]
    second = [F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for i, a in enumerate(c) for b in c[i:]]
    sums = told.groupBy("frame_id", "u", "v").agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{a}") for a in c], *second)
    own = points.select("frame_id", "u", "v", *[F.col(a).alias(f"p{a}") for a in c])
    rows = sums.filter(F.col("n") >= least).join(own, ["frame_id", "u", "v"])
    keys = points.select("frame_id", "u", "v").schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["n"].to_numpy(np.float64)
            mean = pdf[["sx", "sy", "sz"]].to_numpy() / n[:, None]
            cov = np.empty((len(pdf), 3, 3))
            for i, a in enumerate(c):
                for j, b in enumerate(c):
                    cov[:, i, j] = pdf["s" + "".join(sorted((a, b)))] / n - mean[:, i] * mean[:, j]
            normal = np.linalg.eigh(cov)[1][:, :, 0] if len(pdf) else np.empty((0, 3))
            away = (normal * pdf[["px", "py", "pz"]].to_numpy()).sum(1) > 0
            normal[away] *= -1
            yield pd.concat([pdf[["frame_id", "u", "v"]].reset_index(drop=True), pd.DataFrame(normal, columns=["nx", "ny", "nz"])], axis=1)

    return rows.mapInPandas(run, f"{keys}, nx double, ny double, nz double")
