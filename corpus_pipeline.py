"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Stages: documents of low quality go, toxic ones go, one document of each near-duplicate group
stays, documents with benchmark passages go, and what is left is mixed to the sources' targets.
Rows are judged one by one: null and repeated ids, extra columns and their names make no difference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import read_table, stage
from lodeframe.llm.decontaminate import decontaminate
from lodeframe.llm.mixing import mix
from lodeframe.llm.neardup import Params, drop_near_duplicates
from lodeframe.llm.quality import score_quality
from lodeframe.llm.toxicity import score_toxicity

#: Classifiers, corpus passes and seeded choices: not for SQL; a test holds each stage to brute force.
ORACLE_SQL = None

#: Five-word shingles and a similarity of 0.8; a pair at 0.8 misses all 24 bands with probability 3e-6.
NEAR = Params(shingle=5, percent=80, bands=24, rows=4)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be bad go; a null or empty text is judged like any."""
    scored = score_quality(docs, read_table(spark, sf_dir, "labels"), carry=True)
    return scored.filter("predicted = 1").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go; a null or empty text shows no evidence."""
    scored = score_toxicity(docs, read_table(spark, sf_dir, "labels"), carry=True)
    return scored.filter("predicted = 0").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; texts without words all do."""
    return drop_near_duplicates(docs, params=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; an empty benchmark takes none."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (the words that it takes
    of them, a multiple of size); a document without words is not taken. Where documents have a
    column of such a name, theirs keeps it and the new one begins with mix_."""
    own = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        out = name
        while out.lower() in own:
            out = f"mix_{out}"
        own.add(out.lower())
        return out

    taken = mix(docs, carry=True).filter("taken > 0")
    return taken.select("row.*", *[F.col(c).alias(free(c)) for c in ("size", "source_size", "target", "taken")])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
