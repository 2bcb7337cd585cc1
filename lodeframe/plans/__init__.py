"""Registered queries over the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.plans import graph, mesh, motion, registration, scans, similarity, space, stencils, streams, surfels, tracking, voxels  # noqa: F401
from lodeframe.plans.registry import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["t1_closure_top_k"](spark, sf_dir)
