"""Quality rules: text counts, and a hashed n-gram likelihood ratio of trusted against raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.common import by_bytes, fold, mix64, rows_with, segment_sum, stage, utf8_texts, word_ids

#: Buckets of hashed words and word pairs.
BUCKETS = 1 << 16
#: What rejecting a good document costs, against keeping a bad one, where the threshold is set.
GOOD_COST = 5.0
#: N-grams that are added to a text's number, so that short texts are not judged by one word.
PRIOR_NGRAMS = 40

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def hashed_ngrams(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(bucket of each word, bucket of each word with the one before or -1, word ids, words in each
    text, distinct words)."""
    import xxhash

    ids, count, vocabulary = word_ids(texts)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in vocabulary), np.uint64, len(vocabulary))
    h = h[ids] if len(ids) else np.empty(0, np.uint64)
    one = (h % np.uint64(buckets)).astype(np.int64)
    with np.errstate(over="ignore"):
        two = (mix64(np.roll(h, 1) * np.uint64(3) + h) % np.uint64(buckets)).astype(np.int64)
    two[(np.cumsum(count) - count)[count > 0]] = -1
    return one, two, ids, count, vocabulary


def ngram_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, batch_bytes: int = 4 << 20) -> DataFrame:
    """(bucket, raw, target): n-grams over all documents, and over the trusted ones.

    `trusted` (column __id) may be of any size; only texts that it, or a few others, name are shuffled.
    Each task sends at most one row a bucket.
    """
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = list(utf8_texts(batch.column(0)))
            for a, b in by_bytes(texts, batch_bytes):
                one, two, *_ = hashed_ngrams(texts[a:b], buckets)
                found += np.bincount(one, minlength=buckets) + np.bincount(two[two >= 0], minlength=buckets)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": found[some]})

    def counted(texts: DataFrame, raw: Column, target: Column) -> DataFrame:
        return texts.select("__text").mapInArrow(run, "bucket long, n long").select("bucket", raw.alias("raw"), target.alias("target"))

    n, none = F.col("n"), F.lit(0).cast("long")
    named = rows_with(rows, "__doc", trusted.select("__id").distinct(), "__id")
    return counted(rows, n, none).union(counted(named, none, n)).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smooth: float = 5.0) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw), by counts drawn `smooth` counts towards raw.

    One row a bucket comes to the driver: BUCKETS at most, whatever the corpus. Without trusted
    text all ratios are 0.
    """
    got = counts.toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[got["bucket"].to_numpy()], target[got["bucket"].to_numpy()] = got["raw"], got["target"]
    if not target.sum() or not raw.sum():
        return np.zeros(buckets)
    p = (raw + 1) / (raw.sum() + buckets)
    base = smooth * p * buckets
    q = (target + base) / (target.sum() + base.sum())
    return np.log(q) - np.log(p)


def text_counts(texts: list[bytes], ids: np.ndarray, count: np.ndarray, vocabulary: list[bytes]) -> dict[str, np.ndarray]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(texts)
    length = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    chars = segment_sum((((flat & 0xC0) != 0x80) & ~_SPACE[flat]).astype(np.int64), length)
    symbols = segment_sum(_SYMBOL[flat], length)
    dup, repeat = np.zeros(n, np.int64), np.zeros(n, np.int64)
    wide = np.int64(len(vocabulary) + 1)
    start = 0
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
        own = ids[start : start + count[i]]
        start += count[i]
        if len(own) < 4:
            continue
        _, pair = np.unique(own[:-1] * wide + own[1:], return_inverse=True)
        _, back, times = np.unique(pair[:-1] * wide + own[2:], return_inverse=True, return_counts=True)
        twice = times[back] >= 2
        if twice.any():
            hit = np.zeros(len(own), bool)
            hit[:-2] |= twice
            hit[1:-1] |= twice
            hit[2:] |= twice
            repeat[i] = hit.sum()
    return {"word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


def pick_threshold(histogram: pd.DataFrame, cost: float = GOOD_COST) -> float:
    """The log ratio (bins x of hundredths, label y, rows n) from which texts are kept: the middle
    of the widest stretch of least cost, where good rows below it cost `cost` each in proportion
    to bad rows above it. Without rows of both labels everything is kept."""
    good, bad = histogram[histogram["y"] == 1], histogram[histogram["y"] == 0]
    if not len(good) or not len(bad):
        return float("-inf")
    edges = np.unique(np.concatenate([histogram["x"], histogram["x"] + 1]))
    lost = np.array([good["n"][good["x"] < e].sum() for e in edges]) / good["n"].sum()
    left = np.array([bad["n"][bad["x"] >= e].sum() for e in edges]) / bad["n"].sum()
    total = np.round(cost * lost + left, 9)
    at = np.flatnonzero(total == total.min())
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    widest = max(runs, key=lambda r: edges[r[-1]] - edges[r[0]])
    return float(edges[widest[0]] + edges[widest[-1]]) / 200


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float | None = None, folds: int = 5, buckets: int = BUCKETS, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of `docs`: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, log_ratio (per n-gram) and kept.

    Trusted are all rows of `labels` with label 1 outside fold 0; the raw multinomial counts all
    documents. A text fails the base rules with fewer than 50 words or with over half of its words
    in repeated 3-word windows; any other is kept if its log ratio is at least `threshold`, which
    is set on all labelled rows of fold 0 unless it is given: one number for all documents. Null and empty texts have no words and
    fail. Repeated rows give repeated rows and count as often; without trusted rows every ratio is
    0 and the base rules decide. Other columns are not read.
    """
    valid = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    valid = valid.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    trusted = valid.filter((fold("__id", folds) != 0) & (F.col("__y") == 1))
    table = log_ratios(ngram_counts(docs, trusted, id_col, text_col, buckets, batch_bytes), buckets)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    scored = _scored(docs, sent, id_col, text_col, buckets, batch_bytes)
    if threshold is None:
        # scores are written, and meet the labels without their texts
        scored = stage(scored, "rules-scored")
        judged = scored.filter("not base_failed").select(F.col(id_col).alias("__doc"), F.floor(F.col("log_ratio") * 100).alias("x"))
        held = valid.filter(fold("__id", folds) == 0)
        bins = judged.join(held, F.col("__doc") == F.col("__id")).groupBy("x", F.col("__y").alias("y")).agg(F.count("*").alias("n"))
        threshold = pick_threshold(bins.toPandas())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.lit(threshold)))


def _scored(docs: DataFrame, sent, id_col: str, text_col: str, buckets: int, batch_bytes: int) -> DataFrame:
    """(id, counts, base_failed, log_ratio)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    picked = docs.select(id_col, F.col(text_col).alias("__text"))
    schema = T.StructType(
        [picked.schema.fields[0]]
        + [T.StructField(c, T.LongType()) for c in names]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("log_ratio", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.append(sent.value, 0.0)
        for batch in batches:
            texts = list(utf8_texts(batch.column(1)))
            for a, b in by_bytes(texts, batch_bytes):
                one, two, ids, count, vocabulary = hashed_ngrams(texts[a:b], buckets)
                got = {"n_words": count} | text_counts(texts[a:b], ids, count, vocabulary)
                score = segment_sum(ratio[one] + ratio[two], count) / (np.maximum(2 * count - 1, 0) + PRIOR_NGRAMS)
                failed = (count < 50) | (100 * got["n_repeat_words"] > 50 * count)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(got[c]) for c in names], pa.array(failed), pa.array(score)],
                    names=schema.names,
                )

    return picked.mapInArrow(run, schema)
