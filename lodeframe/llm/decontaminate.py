"""Benchmark decontamination over suffix arrays of document shards.

Each task packs its documents into shards of bounded size and sorts the suffixes of a shard by
their first words. Every suffix of every benchmark text is then binary-searched in the shard: the
range that shares the whole window gives all its places. Windows that follow each other both in the
document and in the item are one verbatim match, so all places together give each match's full
length; where no place shares the window, the neighbours of the empty range give the longest match.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.common import LOWER_ALNUM, by_bytes, small_batches, stage, utf8_texts

#: Words of a window.
WINDOW = 10
#: Bytes of document text in a shard.
SHARD_BYTES = 6 << 20
#: Bytes of benchmark text that go to the tasks at once; more is done in turns.
BLOCK_BYTES = 32 << 20
#: Places of windows that are put together at once; an item's places stay together.
PLACES = 1 << 21


class TestBlock:
    """Part of the benchmark: word ids one item after another, each item followed by a stop.

    item, start and length: the places that a window starts at, or with `tails` all places of words,
    where a suffix shorter than a window is searched whole.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int, tails: bool = False):
        self.names = [name for name, _ in items]
        self.index: dict[bytes, int] = {}
        add, parts, item, at, length, head = self.index.setdefault, [], [], [], [], []
        total = 0
        for k, (_, text) in enumerate(items):
            words = text.translate(LOWER_ALNUM).split()
            parts += [add(w, len(self.index) + 1) for w in words] + [0] * window
            span = min(window, len(words))
            starts = (len(words) if tails else len(words) - span + 1) if words else 0
            item += [k] * starts
            at += range(total, total + starts)
            length += [min(span, len(words) - j) for j in range(starts)]
            head.append(total)
            total += len(words) + window
        self.words = np.array(parts, np.int32)
        self.item = np.array(item, np.int64)
        self.start = np.array(at, np.int64)
        self.length = np.array(length, np.int64)
        self.head = np.array(head, np.int64)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes whose first word is above 0, sorted by their first `depth` words.

    Prefix doubling: ranks by 1, 2, 4, ... words until `depth` words are covered. A word of 0
    matches nothing and sorts first. `words` must end with `depth` zeros.
    """
    starts = np.flatnonzero(words > 0)
    rank = words.astype(np.int64)
    span, order = 1, None
    while True:
        if span >= depth:
            break
        # word ids run to the benchmark's vocabulary, which a small shard's length does not bound
        pair = rank[starts] * (int(rank.max(initial=0)) + 1) + rank[np.minimum(starts + span, len(words) - 1)]
        order = np.argsort(pair)
        ordered = pair[order]
        new = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)])) if len(ordered) else ordered
        rank = np.zeros(len(words), np.int64)
        rank[starts[order]] = new
        span *= 2
    if order is None:
        order = np.argsort(rank[starts])
    return starts[order]


def search(words: np.ndarray, sa: np.ndarray, test: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range [lo, hi) of `sa` whose suffixes begin with its first
    `length` words; binary search of all test suffixes side by side."""
    depth = int(length.max()) if len(length) else 0

    def first_word_that_differs(mid: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Sign of (suffix at sa[mid]) - (test suffix), over the test suffix's first words."""
        sign = np.zeros(len(mid), np.int64)
        live = np.arange(len(mid))
        for k in range(depth):
            live = live[(sign[live] == 0) & (k < length[which[live]])]
            if not len(live):
                break
            sign[live] = np.sign(words[sa[mid[live]] + k].astype(np.int64) - test[start[which[live]] + k])
        return sign

    bounds = []
    for above in (0, 1):
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(sa), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = first_word_that_differs(mid, open_) < above
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        bounds.append(lo)
    return bounds[0], bounds[1]


def verbatim(sa: np.ndarray, block: TestBlock, which: np.ndarray, lo: np.ndarray, hi: np.ndarray, places: int = PLACES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, test suffix, end of the verbatim match from there, whether no match begins before it)
    of all places of the test suffixes `which`, a few items at a time.

    Places on one diagonal (place - start) that follow each other belong to one match, which ends
    with the last one's window. Items and texts are followed by stops, so no match leaves its own.
    """
    n = hi[which] - lo[which]
    turn = (np.cumsum(np.bincount(block.item[which], n, minlength=1)) // places)[block.item[which]]
    cuts = np.flatnonzero(np.diff(turn, prepend=-1, append=-1)) if len(turn) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = n[a:b]
        each = np.repeat(which[a:b], some)
        place = sa[np.repeat(lo[which[a:b]] - np.cumsum(some) + some, some) + np.arange(some.sum())]
        diagonal = place - block.start[each]
        order = np.lexsort((place, diagonal))
        place, each, diagonal = place[order], each[order], diagonal[order]
        new = np.ones(len(place), bool)
        new[1:] = (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
        last = np.flatnonzero(np.append(new[1:], True)) if len(new) else np.empty(0, np.int64)
        end = (place[last] + block.length[each[last]])[np.cumsum(new) - 1]
        yield place, each, end, new


def longest_match(words: np.ndarray, sa: np.ndarray, block: TestBlock, window: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest match of each test suffix with the shard; place is one of
    those where it is, -1 without a match."""
    best, place = np.zeros(len(lo), np.int64), np.full(len(lo), -1, np.int64)
    if not len(sa):
        return best, place
    # no place shares the window: the longest match is at a neighbour, and shorter than the window
    for near in (lo - 1, lo):
        ok = np.flatnonzero((lo == hi) & (near >= 0) & (near < len(sa)))
        at, n, live = sa[near[ok]], np.zeros(len(ok), np.int64), np.arange(len(ok))
        while len(live):
            live = live[n[live] < block.length[ok[live]]]
            live = live[words[at[live] + n[live]] == block.words[block.start[ok[live]] + n[live]]]
            n[live] += 1
        win = n > best[ok]
        best[ok[win]], place[ok[win]] = n[win], at[win]
    # a whole rest of an item, shorter than a window, cannot go on; windows go on along their diagonals
    rest = np.flatnonzero((lo < hi) & (block.length < window))
    best[rest], place[rest] = block.length[rest], sa[lo[rest]]
    for at, which, end, _ in verbatim(sa, block, np.flatnonzero((lo < hi) & (block.length == window)), lo, hi):
        order = np.lexsort((at, at - end, which))
        first = order[np.flatnonzero(np.diff(which[order], prepend=-1))]
        best[which[first]], place[which[first]] = (end - at)[first], at[first]
    return best, place


def _shard(texts: list[bytes], block: TestBlock, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with `gap` zeros after each text, each text's first place, words in each text)."""
    get = block.index.get
    parts, first, count, total = [], [], [], 0
    zeros = np.zeros(gap, np.int32)
    for text in texts:
        words = text.translate(LOWER_ALNUM).split()
        parts += [np.fromiter((get(w, 0) for w in words), np.int32, len(words)), zeros]
        first.append(total)
        count.append(len(words))
        total += len(words) + gap
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(first, np.int64), np.array(count, np.int64)


def _find(texts: list[bytes], block: TestBlock, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: its number, its words, and of its verbatim matches that hold a window, none of which
    can be extended, the begins and ends, items, and begins in the item."""
    words, first, count = _shard(texts, block, window)
    sa = suffix_array(words, window)
    lo, hi = search(words, sa, block.words, block.start, block.length)
    found = [(place[new], which[new], end[new]) for place, which, end, new in verbatim(sa, block, np.flatnonzero(lo < hi), lo, hi)]
    place, which, end = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    doc = np.searchsorted(first, place, "right") - 1
    order = np.argsort(doc, kind="stable")
    place, which, end, doc = place[order], which[order], end[order], doc[order]
    item = block.item[which]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in range(len(texts)):
        part = slice(cuts[d], cuts[d + 1])
        yield d, int(count[d]), place[part] - first[d], end[part] - first[d], item[part], block.start[which[part]] - block.head[item[part]]


def covered(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, as disjoint spans in order."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    last = np.concatenate([new[1:], [True]])
    return begin[new], end[last]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's rows, in blocks of at most `block_bytes` (or one item), one at a time; without
    rows one empty block."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    now, total, some = [], 0, False
    for r in rows.filter("k is not null").toLocalIterator():
        text = r.t.encode()
        if now and total + len(text) > block_bytes:
            yield now
            now, total, some = [], 0, True
        now.append((r.k, text))
        total += len(text)
    if now or not some:
        yield now


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, items (sorted item ids as strings), spans
    (as begins and ends, the words of each hit stretch), longest (words of the longest verbatim match
    with one item, 0 without a hit) and its place: longest_word of the document, longest_item and
    longest_item_word; of equally long ones the first in the document, then by item and its word.

    A word of a document is hit if it lies in an occurrence of a window of an item: `window`
    consecutive words, or the whole item if it has fewer. Null and empty texts have no words and
    no hits; items without words have no window; items with equal texts are all counted; a null
    item id is skipped. Repeated rows give repeated rows; other columns are not read. The
    benchmark goes to the tasks in blocks of at most `block_bytes`, one pass over the documents
    each, whose result is written before the next block is read; only with several blocks are the
    (few) hit documents' spans shuffled, by row.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("begins", T.ArrayType(T.LongType())),
            T.StructField("ends", T.ArrayType(T.LongType())),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("longest", T.LongType()),
            T.StructField("longest_word", T.LongType()),
            T.StructField("longest_item", T.StringType()),
            T.StructField("longest_item_word", T.LongType()),
        ]
    )

    def finder(items: list[tuple[str, bytes]]):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TestBlock(sent.value, window)
            for batch in batches:
                texts = list(utf8_texts(batch.column(1)))
                n_words, begins, ends, items_, longest, places = [], [], [], [], [], []
                for a, b in by_bytes(texts, shard_bytes):
                    for _, n, begin, end, item, at in _find(texts[a:b], block, window):
                        u, v = covered(begin, end)
                        n_words.append(n)
                        begins.append(u)
                        ends.append(v)
                        items_.append(sorted({block.names[k] for k in np.unique(item)}))
                        longest.append(int((end - begin).max(initial=0)))
                        top = np.flatnonzero(end - begin == longest[-1])
                        places.append(min(((int(begin[j]), block.names[item[j]], int(at[j])) for j in top), default=(None, None, None)))
                word, name, item_word = zip(*places, strict=True) if places else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(n_words, pa.int64()),
                        pa.array(begins, pa.list_(pa.int64())),
                        pa.array(ends, pa.list_(pa.int64())),
                        pa.array(items_, pa.list_(pa.string())),
                        pa.array(longest, pa.int64()),
                        pa.array(word, pa.int64()),
                        pa.array(name, pa.string()),
                        pa.array(item_word, pa.int64()),
                    ],
                    names=schema.names,
                )

        return run, sent

    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    heads = list(itertools.islice(blocks, 2))
    rows = docs.select(id_col, text_col)
    if len(heads) == 1:
        return rows.mapInArrow(finder(heads[0])[0], schema)
    keyed = stage(rows.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
    every = None
    for items in itertools.chain(heads, blocks):
        run, sent = finder(items)
        found = _with_row(keyed, run, schema, id_col, text_col)
        found = stage(found if every is None else found.filter("size(begins) > 0"), "decontaminate-block")
        sent.destroy()
        every = found if every is None else every.unionByName(found)
    merged = T.StructType([T.StructField("__row", T.LongType()), *schema.fields])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = covered(np.concatenate(pdf["begins"].to_list()).astype(np.int64), np.concatenate(pdf["ends"].to_list()).astype(np.int64))
        place = ["longest_word", "longest_item", "longest_item_word"]
        row = pdf.sort_values(["longest", *place], ascending=[False, True, True, True]).iloc[:1].copy()
        row["begins"], row["ends"] = [u], [v]
        row["items"] = [sorted(set().union(*pdf["items"]))]
        row = row.astype({"longest_word": "Int64", "longest_item_word": "Int64"})
        return row[merged.names]

    return every.groupBy("__row").applyInPandas(merge, merged).drop("__row")


def _with_row(keyed: DataFrame, run, schema: T.StructType, id_col: str, text_col: str) -> DataFrame:
    """run over (id, text), with the row number carried along."""
    whole = T.StructType([T.StructField("__row", T.LongType()), *schema.fields])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[pa.Array] = []

        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers.append(batch.column(0))
                yield pa.RecordBatch.from_arrays(batch.columns[1:], names=[id_col, text_col])

        for out in run(plain()):
            yield pa.RecordBatch.from_arrays([numbers.pop(), *out.columns], names=whole.names)

    return keyed.select("__row", id_col, text_col).mapInArrow(carried, whole)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per item and word of it: the longest verbatim match from there over all documents and one
    place of it (item, item_word, n_match, doc, doc_word).

    Each shard gives its longest match and one of its places; of shards with equally long ones, the
    one whose place has the smallest (doc id, word) counts. Texts without words match nothing and are absent, as are suffixes without any match.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("n_match", T.LongType()), T.StructField("doc", id_type), T.StructField("doc_word", T.LongType())])

    def finder(items):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TestBlock(sent.value, window, tails=True)
            for batch in batches:
                texts = list(utf8_texts(batch.column(1)))
                ids = batch.column(0).to_pylist()
                for a, b in by_bytes(texts, shard_bytes):
                    words, first, _ = _shard(texts[a:b], block, window)
                    sa = suffix_array(words, window)
                    lo, hi = search(words, sa, block.words, block.start, block.length)
                    n, place = longest_match(words, sa, block, window, lo, hi)
                    keep = np.flatnonzero(n > 0)
                    doc = np.searchsorted(first, place[keep], "right") - 1
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item": pa.array([block.names[k] for k in block.item[keep]], pa.string()),
                            "item_word": block.start[keep] - block.head[block.item[keep]],
                            "n_match": n[keep],
                            "doc": pa.array([ids[a + d] for d in doc], batch.column(0).type),
                            "doc_word": place[keep] - first[doc],
                        }
                    )

        return run, sent

    def best(found: DataFrame) -> DataFrame:
        least = F.min(F.struct((-F.col("n_match")).alias("n"), "doc", "doc_word")).alias("b")
        return found.groupBy("item", "item_word").agg(least).select("item", "item_word", (-F.col("b.n")).alias("n_match"), "b.doc", "b.doc_word")

    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    heads = list(itertools.islice(blocks, 2))
    rows = docs.select(id_col, text_col)
    if len(heads) == 1:
        return best(rows.mapInArrow(finder(heads[0])[0], schema))
    every = None
    for items in itertools.chain(heads, blocks):
        run, sent = finder(items)
        found = stage(best(rows.mapInArrow(run, schema)), "longest-block")
        sent.destroy()
        every = found if every is None else every.unionByName(found)
    return best(every)


def _clean(sent, window: int, shard_bytes: int):
    """A function of a text column: whether no window of the block's items stands in the text."""
    held: list[TestBlock] = []

    def run(column: pa.Array) -> pa.Array:
        if not held:
            held.append(TestBlock(sent.value, window))
        texts = list(utf8_texts(column))
        return pa.array([not len(begin) for a, b in by_bytes(texts, shard_bytes) for _, _, begin, *_ in _find(texts[a:b], held[0], window)], pa.bool_())

    return F.arrow_udf(run, "boolean")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents without a hit word, with their own columns. Rows are judged one by one, whatever
    their ids; a null or empty text stays. No row gives no row.

    Only texts go to the search and rows are filtered by it, so nothing is joined or shuffled. Of several
    benchmark blocks each takes out its rows, and what is left is written before the next is read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    now, after = next(blocks), next(blocks, None)
    while now is not None:
        sent = docs.sparkSession.sparkContext.broadcast(now)

        rows = rows.filter(_clean(sent, window, shard_bytes)(F.col("row")[text_col]))
        if after is not None:
            rows = stage(rows, "decontaminate-block")
            sent.destroy()
        now, after = after, next(blocks, None) if after is not None else None
    return rows.select("row.*")
