"""Mixing sources to target weights by subset sums over document lengths.

Sizes are counted once; all that follows works on (source, length) counts. Each source takes whole
copies of all its documents as far as they fit, and for the rest of its budget a set of documents
whose lengths sum to it: all but the last RESERVE words of the budget in proportion to the length
counts, these last ones by a bounded-knapsack dynamic programme over all lengths. Which documents
of a length are taken is decided by a seeded hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.common import among, stage

#: Documents that are ranked together, on average; the documents of one length are dealt over as
#: many salts as that asks for.
RANKED = 200_000
#: Words of a source's budget that the dynamic programme fills.
RESERVE = 1 << 17


def word_count(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources by code point, null last, weigh `weights`, repeating. Together they share `share` times
    all sizes by weight; a target stops at `cap` times its source's size and the excess is shared
    again. Capping in the order of cap / weight gives the level of the others in closed form, so
    this is a window over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("__w", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    by = by.withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    full = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    by = (
        by.withColumn("__all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("__weights", F.sum("__w").over(everything))
        .withColumn("__capped", F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__gone", F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    )
    # the level if exactly the sources before this one are capped; the first that holds is right
    level = (F.col("__all") - F.col("__capped")) / (F.col("__weights") - F.col("__gone"))
    by = by.withColumn("__n", F.row_number().over(full)).withColumn("__level", level)
    by = by.withColumn("__fits", F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct("__n", "__level")))
    found = F.min("__fits").over(everything)["__level"]
    target = F.when(found.isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), found * F.col("__w")))
    return by.select("source", "source_size", target.alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is as near below `budget` as can be.

    Bounded: at most counts[i] of lengths[i], which enter by powers of two. For each sum the first
    step that reaches it is kept; what it came from was reached by earlier steps, so the choice is
    read back from sum to sum. It ends when the budget itself is reached.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return take
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int32)
    steps: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        left, k = min(count, budget // length), 1
        while left > 0 and not reach[budget]:
            k = min(k, left)
            new = reach[: budget + 1 - length * k] & ~reach[length * k :]
            by[length * k :][new] = len(steps)
            reach[length * k :] |= new
            steps.append((i, k))
            left -= k
            k *= 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, k = steps[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """Documents to take of each (distinct, positive, rising) length so that their words come to
    `budget`.

    Every length gives its share of the budget beyond the reserve, rounded along the running sum;
    single documents are put back or added until the reserve is open. The exact programme then fills
    it from all lengths that still have documents, so a budget within the reserve is its work alone.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    budget = max(budget, 0)
    slack = min(budget, reserve)
    take = np.diff(np.floor(np.cumsum(counts * ((budget - slack) / total)) + 1e-9).astype(np.int64), prepend=0)
    take = np.minimum(take, counts)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(lengths, kind="stable"):
        if rest >= slack:
            break
        n = min(int(take[i]), -(-(slack - rest) // int(lengths[i])))
        take[i] -= n
        rest += n * int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        n = min(int(counts[i] - take[i]), (rest - slack) // int(lengths[i]))
        if n > 0:
            take[i] += n
            rest -= n * int(lengths[i])
    free = np.flatnonzero((counts > take) & (lengths <= rest))[::-1]
    take[free] += knapsack(lengths[free], (counts - take)[free], rest)
    return take


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target, taken (a multiple of size), and
    with `carry` the whole row as the struct `row`.

    size is the number of words (null or empty text: 0; such a document is never taken).
    A document is taken 0 to `cap` times. Per source the taken words are its target up to the
    nearest sum below it that can be reached when all but RESERVE words are taken in proportion to
    the lengths; where that much or less is open from the start, no set of documents comes nearer.
    A null source is a source of its own. Repeated rows are documents of their own; rows that share
    id and length are ranked by a hash of their texts. Reruns agree. Other columns are not read, but
    for `carry`. No row gives no row.
    """
    sizes = stage(
        docs.select(
            F.col(id_col).alias("__id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.lit(1)).alias("__deal"),
            F.xxhash64(F.col(text_col)).alias("__tie"),
            *([F.monotonically_increasing_id().alias("__row"), F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
        ),
        "mix-sizes",
    )
    wide = sizes
    sizes = wide.drop("row")
    salts = sizes.count() // RANKED + 1
    sizes = sizes.withColumn("salt", F.pmod("__deal", F.lit(salts)).cast("int"))
    targets = source_targets(sizes, list(weights), share, cap)
    cells = sizes.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    lengths = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    source_type = docs.schema[source_col].dataType
    plan = T.StructType(
        [
            T.StructField("source", source_type),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("size", T.LongType()),
            T.StructField("base", T.LongType()),
            T.StructField("extra", T.LongType()),
        ]
    )

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(int(target // whole), cap) if whole else 0
        size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        extra, some = np.zeros(len(size), np.int64), size > 0
        if base < cap:
            extra[some] = fit_lengths(size[some], n[some], round(target) - base * whole)
        return pd.DataFrame(
            {"source": pdf["source"], "source_size": whole, "target": target, "size": size, "base": base, "extra": extra}
        )

    chosen = (
        lengths.join(targets.hint("shuffle_hash"), lengths["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .groupBy("source")
        .applyInPandas(fit, plan)
    )
    along = Window.partitionBy("source", "size").orderBy("salt")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = (
        cells.withColumn("before", before)
        .join(chosen.withColumnsRenamed({"source": "__s", "size": "__z"}), F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")))
        .select(
            F.col("source").alias("__s"),
            F.col("size").alias("__z"),
            F.col("salt").alias("__p"),
            "n",
            "source_size",
            "target",
            "base",
            F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("quota"),
        )
    )
    quota = stage(quota, "mix-quota")
    placed = sizes.join(
        quota, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")) & (F.col("salt") == F.col("__p"))
    )
    sure = (F.col("quota") == 0) | (F.col("quota") == F.col("n"))
    ranked = Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64(F.lit(seed), "__id", F.lit(2)), "__id", "__tie")

    plain, split = placed.filter(sure), placed.filter(~sure).withColumn("__r", F.row_number().over(ranked))
    if carry:
        # rows with their texts stay where they lie: only the numbers of those that are taken once more meet them
        more = stage(plain.filter("quota > 0").select("__row").union(split.filter("__r <= quota").select("__row")), "mix-more")
        # a row a source
        per = F.broadcast(quota.select("__s", "source_size", "target", "base").distinct())
        known = among(wide, "__row", more, "__more").join(per, F.col("source").eqNullSafe(F.col("__s")))

    def shape(df: DataFrame, extra: Column) -> DataFrame:
        return df.select(
            F.col("__id").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.col("size") * (F.col("base") + extra)).alias("taken"),
            *(["row"] if carry else []),
        )

    if carry:
        return shape(known, F.col("__more").cast("int"))
    return shape(plain, F.when(F.col("quota") > 0, F.lit(1)).otherwise(F.lit(0))).unionByName(shape(split, F.when(F.col("__r") <= F.col("quota"), F.lit(1)).otherwise(F.lit(0))))
