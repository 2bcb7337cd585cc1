"""Whitening of embeddings along their leading components, from a blockwise QR of the centred distinct vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.bidiagonal import leading
from lodeframe.llm.common import stage

#: Components, steps of a coordinate's unit, and rows of a block that is reduced at once.
COMPONENTS, STEPS, BLOCK_ROWS = 4, 256, 4096
_HALF = 32


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S (exact), their leading components (columns), eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows; NaN along a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, (x - self.mean) @ self.directions / np.sqrt(self.eigenvalues), np.nan)


def quantised(vectors: DataFrame, vector_col: str = "embedding", steps: int = STEPS) -> DataFrame:
    """vectors with x: each entry c as the whole number floor(steps * c). Rows whose vector is null or empty or holds null or
    non-finite entries go, and rows with another dimension than most rows have (the larger of equals)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    vector = F.col(vector_col)
    good = vectors.filter(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite))
    sizes = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()
    d = sizes["m"]["d"] if sizes and sizes["m"] else 0
    return good.filter(F.size(vector) == d).withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * steps).cast("bigint")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            rows = column.slice(at, BLOCK_ROWS)
            yield rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _folded(rows: DataFrame, start: Callable, add: Callable, join: Callable) -> list | None:
    """The reduction of rows of the column x to a few numbers: each task folds its blocks (add), then about the
    square root of the tasks' results meet in each task of a second round (join), then those in one. A result's size depends on the dimension only."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in _blocks(batches):
            held = add(start(x.shape[1]) if held is None else held, x)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["held"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for raw in batch.column(0):
                one = np.frombuffer(raw.as_py(), np.float64)
                held = one if held is None else join(held, one)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["held"])

    parts = rows.rdd.getNumPartitions()
    held = rows.select("x").mapInArrow(first, "held binary")
    if parts > 16:
        held = held.repartition(math.isqrt(parts)).mapInArrow(then, "held binary")
    out = held.repartition(1).mapInArrow(then, "held binary").first()
    return None if out is None else np.frombuffer(out[0], np.float64)


def _sums(x: DataFrame) -> tuple[int, list[int]]:
    """Row count and exact sums by dimension: entries are summed in two halves, which no block overflows, and those as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            d = rows.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, len(rows))), pa.array((rows >> _HALF).sum(0)), pa.array((rows & ((1 << _HALF) - 1)).sum(0))], names=["k", "n", "high", "low"]
            )

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = x.select("x").mapInArrow(run, "k int, n long, high long, low long").groupBy("k").agg(F.sum("n").alias("n"), wide("high"), wide("low")).orderBy("k").collect()
    return (rows[0]["n"], [(int(r["high"]) << _HALF) + int(r["low"]) for r in rows]) if rows else (0, [])


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors x (a written table with a row each, long entries); None without any.

    A first pass counts and sums; a second centres each block and keeps only R of its QR together with the R before;
    R meets R in two rounds of a tree, so what moves is a d x d matrix a task. The last R, d x d, is reduced to bidiagonal form by
    Householder reflections; dqds gives the singular values, twisted factorisations the directions. A third pass measures the
    whitened vectors' covariance, centred on their own mean.
    """
    n, sums = _sums(x)
    if not n:
        return None
    mean, d = np.array([s / n for s in sums]), len(sums)
    square = lambda m: np.vstack([m, np.zeros((max(0, d - len(m)), d))])[:d]
    reduce = lambda *m: square(np.linalg.qr(np.vstack(m), mode="r"))
    r = _folded(x, lambda k: np.zeros((k, k)), lambda held, rows: reduce(held, rows - mean), lambda a, b: reduce(a.reshape(d, d), b.reshape(d, d)))
    squares, directions, total = leading(r.reshape(d, d), components)
    squares = np.where(squares > total * (np.finfo(np.float64).eps * d) ** 2, squares, 0.0)
    model = Whitening(n, sums, directions, squares / n, squares / total if total else np.zeros(len(squares)))

    def add(held: np.ndarray, rows: np.ndarray) -> np.ndarray:
        y = np.nan_to_num(model.project(rows))
        m = y.mean(0)
        return join(held, np.concatenate([[len(y)], m, ((y - m).T @ (y - m)).ravel()]))

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Count, means and centred sums of products of two sets together."""
        k, both, apart = len(directions.T), a[0] + b[0], b[1 : 1 + len(directions.T)] - a[1 : 1 + len(directions.T)]
        if not both:
            return a
        return np.concatenate([[both], a[1 : 1 + k] + apart * (b[0] / both), a[1 + k :] + b[1 + k :] + (np.outer(apart, apart) * (a[0] * b[0] / both)).ravel()])

    k = directions.shape[1]
    held = _folded(x, lambda _: np.zeros(1 + k + k * k), add, join)
    own = (held[1 + k :].reshape(k, k) / n)[np.ix_(squares > 0, squares > 0)]
    error = float(np.abs(own - np.eye(len(own))).max()) if len(own) else None
    return Whitening(n, sums, directions, model.eigenvalues, model.explained, error)


def deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2 of each row, exactly; None beyond 64 bits."""
    most = max(model.n * int(max(abs(int(x.max())), abs(int(x.min())))), max(map(abs, model.sums))) * 2
    if most * most * x.shape[1] < 1 << 63:
        gap = model.n * x - np.array(model.sums, np.int64)
        return (gap * gap).sum(1).tolist()
    gap = model.n * x.astype(object) - np.array(model.sums, object)
    return [v if v < 1 << 63 else None for v in map(int, (gap * gap).sum(1))]


def whiten(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    The model is fitted on each distinct vector once: copies are reduced before they are shuffled, and the
    distinct ones are written as a table that the three passes read. Rows that `quantised` drops give none, repeated rows repeat,
    null ids stay null, other columns are not read; a vector of fewer dimensions than `components` has as many components. A component without
    variance (all distinct vectors are equal, or lie in a plane) has whitened null and is left out of identity_error. deviation is null beyond
    64 bits. No rows, no result.
    """
    x = quantised(vectors, vector_col)
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(stage(x.select("x").distinct(), "distinct-vectors"), components)
    if model is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        k = len(model.eigenvalues)
        for batch in batches:
            at = 0
            for rows in _blocks(iter([batch])):
                m = len(rows)
                y = model.project(rows).ravel()
                ids = batch.column(0).slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                at += m
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array([v for v in deviations(model, rows) for _ in range(k)], pa.int64()),
                     pa.array(y, mask=np.isnan(y)), pa.array(np.tile(model.explained, m)), pa.array([model.identity_error] * (m * k), pa.float64())], names=names
                )

    return x.select(F.col(id_col), "x").mapInArrow(run, schema)
