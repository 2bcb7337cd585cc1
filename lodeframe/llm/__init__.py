"""Operators of a training-data pipeline; nothing outside this folder imports them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lodeframe.llm import registry as q

    return {name: f for name, f in vars(q).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from lodeframe.llm import oracle

    return dict(oracle.SQL)
