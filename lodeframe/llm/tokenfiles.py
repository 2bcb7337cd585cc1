"""Files of token ids: documents in the order of their ids, coded in blocks by one Huffman code.

An archive is a folder. `code` holds the code's lengths (id, length). `blocks` holds a row a block: its `part` (parts
follow one another in the order of documents, blocks within a part too), the place of its first document and of its
first id within the part, whether that document began in an earlier block and whether its last one goes on, its
documents' ids and how many token ids of each it holds, and `bits`, the block itself (see huffman). A block is decoded
alone, and from any of its checkpoints.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.common import by_bytes, drop_scratch, scratch_path
from lodeframe.llm.huffman import Code, code_lengths, crc_join
from lodeframe.llm.pieces import encoder

COLUMNS = ["part", "first_doc", "first", "begun", "open", "docs", "counts", "bits"]
#: Ids of a block, ids between two checkpoints, bits of the longest code, bytes of ids of a part.
BLOCK_IDS, CHECKPOINT_IDS, MAX_BITS, PART_BYTES = 1 << 19, 128, 18, 32 << 20
#: Bytes of texts that are encoded, or of ids that are handed on, at once.
BATCH_BYTES = 1 << 21


@dataclass(frozen=True)
class TokenArchive:
    root: str
    id_type: T.DataType


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, row, n, crc, ids, counts): a row a text with its ids (unsigned little-endian, 2 bytes each if the vocabulary
    allows, else 4; end_id last) and their crc32 as 4-byte ids; and a row a task with row null and the counts of its ids."""
    id_type = docs.schema[id_col].dataType
    counts = T.ArrayType(T.StructType([_field("token", T.IntegerType()), _field("n", T.LongType())]))
    schema = T.StructType([_field("id", id_type), _field("row", T.LongType()), _field("n", T.LongType()), _field("crc", T.LongType()), _field("ids", T.BinaryType()), _field("counts", counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        kind = np.dtype("<u2" if encode.vocabulary <= 1 << 16 else "<u4")
        seen, row = np.zeros(max(encode.vocabulary, end_id + 1), np.int64), TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("token", pa.int32()), ("n", pa.int64())]))]
        id_kind = pa.null()

        def rows(ids: pa.Array, *columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

        for batch in batches:
            own = batch.column(0)
            id_kind = own.type
            column = batch.column(1)
            sizes = pa.compute.coalesce(pa.compute.binary_length(column), 0).to_pylist()
            for a, b in by_bytes(list(map(range, sizes)), BATCH_BYTES):
                got = encode(column.slice(a, b - a), end_id)
                seen += np.bincount(np.concatenate(got), minlength=len(seen))
                n = [len(x) for x in got]
                crc = [zlib.crc32(x.astype("<u4", copy=False)) for x in got]
                yield rows(own.slice(a, b - a), list(range(row, row + len(n))), n, crc, [x.astype(kind).tobytes() for x in got], [None] * len(n))
                row += len(n)
        if seen.any():
            used = np.flatnonzero(seen)
            yield rows(pa.nulls(1, id_kind), [None], [None], [None], [None], [[{"token": int(i), "n": int(seen[i])} for i in used]])

    import pyarrow.compute  # noqa: F401  (the closure uses pa.compute)

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema)


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id", root: str | None = None,
    block_ids: int = BLOCK_IDS, every: int = CHECKPOINT_IDS, max_bits: int = MAX_BITS, part_bytes: int = PART_BYTES,
) -> TokenArchive:
    """Writes the ids of all texts, end_id after each, to an archive below the shared folder (or at `root`).

    Null and empty texts have the end id alone. Documents follow one another by id, null first; rows of
    one id by the crc32 of their ids, then in any order. Repeated rows are all written; other columns of docs are not read, so their
    names don't matter; without rows the archive has no blocks. Texts are encoded once: ids and counts wait in
    a scratch table that goes when the archive is there. One range shuffle brings the ids into order; an id that many rows share
    is split by crc and row. What reaches the driver is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    root = root or scratch_path(spark, "token-files")
    scratch = scratch_path(spark, "token-ids")
    encode_texts(docs, tokenizer, end_id, text_col, id_col).write.option("compression", "zstd").parquet(scratch)
    ids = spark.read.parquet(scratch)
    counts = dict(ids.filter("counts is not null").select(F.explode("counts").alias("c")).groupBy("c.token").agg(F.sum("c.n").alias("n")).collect())
    total = np.zeros(max(counts, default=0) + 1, np.int64)
    total[list(counts)] = list(counts.values())
    length = code_lengths(total, max(max_bits, int(np.count_nonzero(total) or 1).bit_length()))
    limit = int(max(length.max(), 1))
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(length) if n], "id int, length int").coalesce(1).write.parquet(f"{root}/code")

    schema = T.StructType(
        [_field("part", T.IntegerType()), _field("block", T.LongType()), _field("first_doc", T.LongType()), _field("first", T.LongType()), _field("begun", T.BooleanType()), _field("open", T.BooleanType()),
         _field("docs", T.ArrayType(id_type)), _field("counts", T.ArrayType(T.LongType())), _field("bits", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part = Code.of(length, limit), TaskContext.get().partitionId()
        block = docs_done = first = held = 0
        begun = False
        parts: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []

        def close(goes_on: bool) -> pa.RecordBatch:
            nonlocal block, docs_done, first, held, begun, parts, names, sizes
            bits = code.write(np.concatenate(parts), every)
            row = [[part], [block], [docs_done], [first], [begun], [goes_on], [names], [sizes], [bits]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(id_kind), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=schema.names)
            docs_done, first, block, begun = docs_done + len(names) - goes_on, first + held, block + 1, goes_on
            parts, names, sizes, held = [], [], [], 0
            return out

        for batch in batches:
            id_kind = batch.column(0).type
            for name, n, raw in zip(*(batch.column(c) for c in range(3)), strict=True):
                name, n, raw = name.as_py(), n.as_py(), raw.as_py()
                own, at = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"), 0
                if held and held + n > block_ids:  # blocks end with documents, but where one is longer than a block
                    yield close(False)
                while at < n:
                    use = own[at : at + block_ids - held]
                    parts.append(use)
                    names.append(name)
                    sizes.append(len(use))
                    held, at = held + len(use), at + len(use)
                    if held == block_ids:
                        yield close(at < n)
        if held:
            yield close(False)

    n_parts = max(1, -(-2 * int(total.sum()) // part_bytes))
    rows = ids.filter("row is not null").repartitionByRange(n_parts, "id", "crc", "row").sortWithinPartitions("id", "crc", "row")
    rows.select("id", "n", "ids").mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{root}/blocks")
    drop_scratch(spark, scratch)
    return TokenArchive(root, id_type)


def _code(spark: SparkSession, archive: TokenArchive) -> tuple[np.ndarray, int]:
    rows = spark.read.schema("id int, length int").parquet(f"{archive.root}/code").collect()
    length = np.zeros(max((r[0] for r in rows), default=0) + 1, np.int32)
    for i, n in rows:
        length[i] = n
    return length, int(max(length.max(), 1))


def read_blocks(spark: SparkSession, archive: TokenArchive) -> DataFrame:
    return spark.read.parquet(f"{archive.root}/blocks")


def read_documents(spark: SparkSession, archive: TokenArchive, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of an archive's documents: ids of all documents before it, its own with the
    end id, and their crc32 as unsigned 4-byte numbers. Blocks are decoded one by one; a document that lies in more than one is put
    together by its pieces' crc. with_ids: instead a row a document and block with the column ids and the
    place `from_id` of the piece in its document."""
    length, limit = _code(spark, archive)
    blocks = read_blocks(spark, archive)
    kinds = [_field("part", T.IntegerType()), _field("doc", T.LongType()), _field("whole", T.BooleanType()), _field(id_col, archive.id_type), _field("at", T.LongType()), _field("n", T.LongType()), _field("crc", T.LongType())]
    schema = T.StructType([*kinds, _field("ids", T.ArrayType(T.IntegerType()))] if with_ids else kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code.of(length, limit)
        for batch in batches:
            part, first_doc, first, begun, goes_on, docs, counts, bits = (batch.column(c) for c in range(8))
            for k in range(batch.num_rows):
                ids = code.read(bits[k].as_py())
                n = np.array(counts[k].as_py(), np.int64)
                ends = np.cumsum(n)
                whole = np.ones(len(n), bool)
                whole[0] &= not begun[k].as_py()
                whole[-1] &= not goes_on[k].as_py()
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [np.full(len(n), part[k].as_py(), np.int32), first_doc[k].as_py() + np.arange(len(n)), whole, docs[k].values, first[k].as_py() + ends - n, n, pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    pieces = blocks.select(*COLUMNS).mapInArrow(run, schema)
    # a row a part; parts are files, not documents
    sizes = blocks.select("part", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, rows = 0, []
    for part, n in sizes:
        rows.append((part, base))
        base += n
    bases = F.broadcast(spark.createDataFrame(rows, "part int, __base long"))
    start = (F.col("__base") + F.col("at")).alias("start")
    if with_ids:
        return pieces.join(bases, "part").select(id_col, start, "ids")

    def joined(found):
        crc, size = 0, 0
        for piece in sorted(found, key=lambda p: p["at"]):
            crc = crc_join(crc, piece["crc"], 4 * piece["n"]) if size else piece["crc"]
            size += piece["n"]
        return crc

    cut = blocks.filter("begun or open").select(*COLUMNS).mapInArrow(run, schema).filter("not whole").groupBy("part", "doc").agg(F.first(id_col).alias(id_col), F.min("at").alias("at"), F.sum("n").alias("n"), F.collect_list(F.struct("at", "n", "crc")).alias("__p"))
    cut = cut.select("part", id_col, "at", "n", F.udf(joined, "long")("__p").alias("crc"))
    every = pieces.filter("whole").select("part", id_col, "at", "n", "crc").unionByName(cut)
    return every.join(bases, "part").select(id_col, start, F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
