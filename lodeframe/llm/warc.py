"""WARC archives with revisit records and a two-level capture index.

Tasks write one gzip member per record. The index holds one line per record, sorted by its
reversed-host URL key, in compressed blocks; each index file ends with a sparse directory of its
blocks. A look-up binary-searches the list of index files, the directory of one file and one
block, then reads the record's byte range from its archive.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.common import scratch_path, stage

#: Payloads shorter than this are never revisited.
MIN_REVISIT_BYTES = 100
#: Lines of an index block.
BLOCK_LINES = 1000
#: Bytes after which a task begins another archive file.
ARCHIVE_BYTES = 256 << 20
#: The capture time of every record, unless one is given.
CAPTURE_DATE = "2024-01-01T00:00:00Z"

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 9562
_FOOTER = ">QI"  # place and length of the directory

ENTRY = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def url_key(url: str | None) -> str:
    """The URL with its host reversed: http://a.b.com/x?y gives com,b,a)/x?y; empty for null."""
    rest = re.sub(r"^[^/?#]*://", "", (url or "").strip()).partition("#")[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    labels = host.lower().partition(":")[0].split(".")
    if labels[0] == "www":
        labels = labels[1:]
    key = ",".join(reversed(labels)) + ")/" + path if host else ""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, as a gzip member."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {uri}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Page-Id"] = str(refers_to)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(text.encode() + body + b"\r\n\r\n") + press.flush()


def parse_record(member: bytes) -> dict:
    """The record of a gzip member. A response's length and digest come from its payload, a
    revisit's from its headers."""
    import hashlib

    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    promised = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if not revisit and promised != len(payload):
        raise ValueError(f"record {fields['WARC-Record-ID']} holds {len(payload)} of {promised} bytes")
    page_id, other = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": None if page_id is None else int(page_id),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": promised,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "record_type": fields["WARC-Type"],
        "refers_to": None if other is None else int(other),
        "payload": None if revisit else payload,
    }


@dataclass(frozen=True)
class Capture:
    """Where archives and index lie: a folder, and the index files with their first keys."""

    root: str
    files: DataFrame  # first_key, index, n


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages with __digest and __first: the smallest id of the rows with the same payload, where
    the row is to be a revisit of it, else null.

    Payloads below `least` bytes are never revisits, nor is a row without id or one that has the
    smallest id itself (rows that repeat it are all responses). Equal payloads are reduced before
    they are joined, and only ids and digests are: the pages are shuffled by id, not by digest.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keyed = pages.withColumn("__digest", F.sha2(payload, 256))
    ids = keyed.filter((F.octet_length(payload) >= least) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col("__digest").alias("__same")).distinct()
    firsts = ids.groupBy("__same").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    again = (
        ids.join(firsts.withColumnRenamed("__same", "__d"), F.col("__same") == F.col("__d"))
        .filter("__id <> __first")
        .select("__id", "__same", "__first")
    )
    return keyed.join(again, (keyed[id_col] == F.col("__id")) & (F.col("__digest") == F.col("__same")), "left").drop("__id", "__same")


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = CAPTURE_DATE) -> DataFrame:
    """Writes a record per row of `pages` below `root` and returns the index entries (ENTRY).

    Null html is an empty payload, a null url an empty key; ids are whole numbers or null; repeated
    rows give repeated records. File names carry the task attempt, and only what a finished attempt
    returns is indexed: a repeated or speculative attempt leaves files that nothing refers to.
    """
    marked = mark_revisits(pages, id_col, html_col, least).select(
        F.col(id_col).cast("bigint"), url_col, F.coalesce(F.col(html_col), F.lit("")).alias("html"), "__digest", F.col("__first").cast("bigint")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _store(root)
        store.create_dir(base, recursive=True)
        n, out, at, name = 0, None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{n}.warc.gz"
                        out, at, n = store.open_output_stream(f"{base}/{name}", compression=None), 0, n + 1
                    member = record_bytes(page_id, url, html.encode(), digest, first, first is not None, date)
                    out.write(member)
                    rows.append((url_key(url), page_id, name, at, len(member)))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                        names=ENTRY.names,
                    )
        finally:
            if out is not None:
                out.close()

    return stage(marked.mapInArrow(run, ENTRY), "warc-entries")


def write_index(entries: DataFrame, root: str, block_lines: int = BLOCK_LINES, files: int | None = None) -> Capture:
    """Sorts entries by key into index files of compressed blocks, each with its directory."""
    spark = entries.sparkSession
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "archive", "offset"]
    ranged = entries.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shape = T.StructType([T.StructField("first_key", T.StringType()), T.StructField("index", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _store(root)
        name, out, at, n, first = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.cdx", None, 0, 0, None
        directory: list[list] = []
        lines: list[list] = []

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode())
            directory.append([lines[0][0], at, len(block)])
            out.write(block)
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out, first = store.open_output_stream(f"{base}/{name}", compression=None), row[0]
                lines.append(list(row))
                n += 1
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
            out.write(tail + struct.pack(_FOOTER, at, len(tail)))
            out.close()
            yield pa.RecordBatch.from_pydict({"first_key": [first], "index": [name], "n": [n]})

    return Capture(root, stage(ranged.mapInArrow(run, shape), "warc-index"))


class IndexFile:
    """An open index file: its directory is read once, its blocks by range."""

    def __init__(self, store, path: str):
        self.handle = store.open_input_file(path)
        size = self.handle.size()
        at, length = struct.unpack(_FOOTER, self.handle.read_at(12, size - 12))
        self.directory = json.loads(zlib.decompress(self.handle.read_at(length, at)))
        self.keys = [d[0] for d in self.directory]

    def block(self, i: int) -> list[list]:
        _, at, length = self.directory[i]
        return [json.loads(x) for x in zlib.decompress(self.handle.read_at(length, at)).decode().split("\n")]

    def find(self, key: str) -> Iterator[list]:
        """The entries of a key: binary search of the directory, then of the block."""
        i = max(bisect.bisect_left(self.keys, key) - 1, 0)
        while i < len(self.keys) and self.keys[i] <= key:
            lines = self.block(i)
            at = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == key:
                yield lines[at]
                at += 1
            i += 1


def entries_of(capture: Capture) -> DataFrame:
    """All entries, read back from the index blocks."""
    root = capture.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                index = IndexFile(store, f"{base}/{name}")
                for i in range(len(index.keys)):
                    cols = zip(*index.block(i), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                        names=ENTRY.names,
                    )

    return capture.files.select("index").repartition(64).mapInArrow(run, ENTRY)


def _read(root: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        name, handle = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    name, handle = archive, store.open_input_file(f"{base}/{archive}")
                record = parse_record(handle.read_at(length, offset))
                if not with_payload:
                    record["payload"] = None
                out.append(record)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    return run


def read_archives(capture: Capture, with_payload: bool = False) -> DataFrame:
    """Every indexed record (RECORD), archive by archive in the order of offsets.

    A part of an archive is a task's work, so that one large archive is read by several.
    """
    part = F.floor(F.col("offset") / F.lit(16 << 20))
    near = entries_of(capture).repartition("archive", part).sortWithinPartitions("archive", "offset")
    return near.mapInArrow(_read(capture.root, with_payload), RECORD)


def lookup(capture: Capture, urls: DataFrame, url_col: str = "url", with_payload: bool = True) -> DataFrame:
    """The records captured for each of `urls` (null and unknown URLs find none).

    The list of index files has one row per index file, a number that write_index sets; it is what
    goes to each task. Keys are searched in key order, so that neighbours share a block.
    """
    files = sorted((r["first_key"], r["index"]) for r in capture.files.toLocalIterator())
    root = capture.root
    keys = urls.filter(F.col(url_col).isNotNull()).select(F.udf(url_key, "string")(url_col).alias("key")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        firsts, opened = [f[0] for f in files], {}
        for batch in batches:
            hits = []
            for key in batch.column(0).to_pylist():
                i = max(bisect.bisect_left(firsts, key) - 1, 0)
                while i < len(files) and firsts[i] <= key:
                    if files[i][1] not in opened:
                        opened[files[i][1]] = IndexFile(store, f"{base}/{files[i][1]}")
                    hits += opened[files[i][1]].find(key)
                    i += 1
            if hits:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(hits, columns=ENTRY.names), preserve_index=False, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    found = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, ENTRY)
    return found.sortWithinPartitions("archive", "offset").mapInArrow(_read(root, with_payload), RECORD)


def archive_pages(pages: DataFrame, root: str | None = None, **options) -> Capture:
    """write_archives and write_index, below `root` or a fresh folder of the shared one."""
    spark: SparkSession = pages.sparkSession
    root = root or scratch_path(spark, "warc")
    if "://" not in root:
        root = ("file://" if root.startswith("/") else "file:///") + root if not root.startswith("file:") else root.replace("file:", "file://", 1)
    return write_index(write_archives(pages, root, **options), root)
