"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import itertools
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII bytes with A-Z lowered; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every ASCII byte that is no letter or digit becomes a space.
LOWER_ALNUM = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's checkpoint folder. Without either there is
    none that all executors share, but on a local master, where a temporary one will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lodeframe-{tag}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Removes what was written at a scratch path, when nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


#: Paths that `stage` has written inside of `passing`.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Drops at its end what `stage` wrote inside it, but for paths that were taken out of the list."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            drop_scratch(spark, path)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a reread and no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bounds of an Arrow batch of rows with texts, unless the session sets its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(8 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by BATCH where the session leaves them at Spark's defaults: ten thousand
    texts, some of them very long, are more than a task should hold in and outside of the JVM."""
    for key, (default, bound) in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or now == default or (default is None and int(re.sub(r"\D", "", now) or 0) > int(bound)):
            spark.conf.set(key, bound)


#: Keys that count as hot, at most.
HOT_KEYS = 4096


def hot_join(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """many joined with `one` (a written table) on key; `one` has a row a key and in __n how often
    `many` holds it.

    Keys with more than total / HOT_KEYS rows (total: the rows of `many`), so fewer than HOT_KEYS of
    them, meet their rows by broadcast (and come to the driver in one job); only the others are shuffled, so no key makes a large task.
    """
    limit = max(64, -(-total // HOT_KEYS))
    hot = [r[0] for r in one.filter(F.col("__n") > limit).select(key).collect()]
    if not hot:
        return many.join(one.drop("__n"), key)
    is_hot = F.col(key).isin(hot)
    few = F.broadcast(one.filter(is_hot).drop("__n"))
    return many.filter(is_hot).join(few, key).unionByName(many.filter(~is_hot).join(one.filter(~is_hot).drop("__n"), key))


#: 64-bit words of a bitmap of hashed ids.
ID_WORDS = 1 << 18


def _place(h: Column) -> tuple[Column, Column]:
    """The word of a hash in a bitmap, and its bit there."""
    bit = F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")
    return F.pmod(h, F.lit(ID_WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def _bitmap(ids: DataFrame, id_col: str, word_as: str, bits_as: str) -> DataFrame:
    """The words of a bitmap of hashed ids that have a bit set, at most ID_WORDS, to be broadcast."""
    word, mask = _place(F.xxhash64(id_col))
    return F.broadcast(ids.select(word.alias(word_as), mask.alias("__m")).groupBy(word_as).agg(F.bit_or("__m").alias(bits_as)))


def likely(many: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of many whose key is among ids, and few others: a bitmap of hashed ids, ID_WORDS words
    long whatever their number, keeps most others out of a shuffle. Keys that are not of one integer
    type with the ids, whose hashes could differ, all stay."""
    if not isinstance(many.schema[key].dataType, T.IntegralType) or many.schema[key].dataType != ids.schema[id_col].dataType:
        return many
    word, mask = _place(F.xxhash64(key))
    return many.withColumn("__at", word).join(_bitmap(ids, id_col, "__w", "__m"), F.col("__at") == F.col("__w")).filter(F.col("__m").bitwiseAND(mask) != 0).select(*many.columns)


def among(many: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """many, a written table, with the boolean `name`: whether the row's key is among ids, a written
    table with the same key (no nulls, no key twice). Exact, and wide rows stay where they lie.

    Two bitmaps, of the keys that are among ids and of those that are not, each of ID_WORDS words
    whatever their number, settle a row that only one of them holds. A row of both is shuffled
    and held against ids themselves.
    """
    word, mask = _place(F.xxhash64(key))
    others = many.select(key).join(ids.select(key), key, "left_anti")
    marked = many.withColumn("__at", word)
    for rows, w, bits in ((ids, "__w_in", "__in"), (others, "__w_out", "__out")):
        marked = marked.join(_bitmap(rows, key, w, bits), F.col("__at") == F.col(w), "left")
        marked = marked.withColumn(bits, F.coalesce(F.col(bits).bitwiseAND(mask) != 0, F.lit(False)))
    settled = marked.filter(~(F.col("__in") & F.col("__out"))).select(*many.columns, F.col("__in").alias(name))
    named = ids.select(F.col(key).alias("__of"))
    held = marked.filter(F.col("__in") & F.col("__out")).join(named, F.col(key) == F.col("__of"), "left")
    return settled.unionByName(held.select(*many.columns, F.col("__of").isNotNull().alias(name)))


def rows_with(many: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of many whose key is among ids (a row an id, of any number)."""
    named = ids.select(F.col(id_col).alias("__of")).hint("shuffle_hash")
    return likely(many, key, ids, id_col).join(named, F.col(key) == F.col("__of"), "left_semi")


def numbered(docs: DataFrame, tag: str) -> DataFrame:
    """(__row, row): each row of docs as a struct, under a number that is written down, so that rows
    with null or equal ids are told apart and none of their columns can clash."""
    return stage(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[docs[c] for c in docs.columns]).alias("row")), tag)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def utf8_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null gives empty bytes."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        kind = pa.large_binary() if pa.types.is_large_string(chunk.type) else pa.binary()
        for value in chunk.cast(kind):
            yield value.as_py() or b""


def by_bytes(texts: list[bytes] | list[range], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts (or of anything with their lengths) of about `limit` bytes each, at least one text a range."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > limit:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids of all words one after another, words in each text, the distinct words)."""
    index: dict[bytes, int] = defaultdict(itertools.count().__next__)
    lengths = np.empty(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        words = text.split()
        lengths[i] = len(words)
        parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return ids, lengths, list(index)


def segment_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths; an empty run gives 0."""
    ends = np.cumsum(lengths)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[ends] - total[ends - lengths]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser in the style of splitmix: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
