"""Quality scores by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import by_bytes, fold, segment_sum, small_batches, utf8_texts, word_ids

FEATURES = (
    "words",
    "word_chars",
    "distinct",
    "top_word",
    "repeat_pairs",
    "symbols",
    "punctuation",
    "digits",
    "upper",
    "upper_words",
    "lines",
    "repeat_lines",
    "stops",
    "odd_ends",
    "glue",
)
_CLASS = np.zeros(256, np.int64)  # bytes: 1 upper, 2 digit, 3 symbol, 4 sentence mark, 5 other ASCII mark, 6 line end
for _b in range(33, 127):
    _c = chr(_b)
    _CLASS[_b] = 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in "#*$%&|<>=~^_\\{}@" else 4 if _c in ".,;:'-" else 0 if _c.islower() else 5
_CLASS[10] = 6


def statistics(texts: list[bytes]) -> np.ndarray:
    """len(texts) x len(FEATURES) transformed statistics: rates go through a logarithm that is
    flat near 0, lengths through a plain one, and all are bounded, so that a rare kind of text is
    not infinitely far from either class. A rate's base has a few words, characters or lines added:
    one odd word in a text of five says less than a hundred in five hundred."""
    n = len(texts)
    ids, n_words, vocabulary = word_ids(texts)
    w8 = n_words + 8
    length = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    kinds = _CLASS[flat]
    count = {k: segment_sum((kinds == k).astype(np.int64), length) for k in range(1, 7)}
    chars = segment_sum(((flat & 0xC0) != 0x80).astype(np.int64), length)
    c40 = chars + 40
    word_len = np.array([len(v.decode()) for v in vocabulary] or [0], np.int64)
    is_upper = np.array([len(v) > 1 and v.upper() == v and v.lower() != v for v in vocabulary] or [False], np.int64)
    odd_end = np.array([bool(v) and not (v[-1] >= 128 or chr(v[-1]).isalnum() or v[-1:] in b".,;:'") for v in vocabulary] or [False], np.int64)
    ends = np.array([v[-1:] in (b".", b"!", b"?") for v in vocabulary] or [False], np.int64)
    size = len(vocabulary) + 1
    doc = np.repeat(np.arange(n), n_words)
    key, times = np.unique(doc * size + ids, return_counts=True)
    distinct = np.bincount(key // size, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, key // size, times)
    pair_doc = doc[1:][doc[1:] == doc[:-1]] if len(doc) else doc
    pairs = (ids[:-1] * size + ids[1:])[doc[1:] == doc[:-1]] if len(doc) else ids
    _, pair_id = np.unique(pairs, return_inverse=True)
    distinct_pairs = np.bincount(np.unique(pair_doc * (len(pairs) + 1) + pair_id) // (len(pairs) + 1), minlength=n) if len(pairs) else np.zeros(n, np.int64)
    lines, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        own = [x for x in text.split(b"\n") if x.strip()]
        lines[i], repeated[i] = len(own), len(own) - len(set(own))
    rate = lambda x, of: np.log1p(20 * np.minimum(x / of, 2.0))
    pick = lambda v: segment_sum(v[ids] if len(ids) else ids, n_words)
    return np.stack(
        [
            np.log1p(n_words),
            np.minimum((pick(word_len) + 8 * 6) / w8, 20.0),
            (distinct + 8) / w8**0.9,
            rate(np.maximum(top - 2, 0), w8),
            rate(np.maximum(n_words - 1, 0) - distinct_pairs, w8),
            rate(count[3], w8),
            rate(count[4], w8),
            rate(count[2], c40),
            rate(count[1], c40),
            rate(pick(is_upper), w8),
            rate(lines, w8),
            rate(repeated, lines + 4),
            rate(pick(ends), w8),
            rate(pick(odd_end), w8),
            rate(count[5], w8),
        ],
        1,
    ).astype(np.float64)


@dataclass(frozen=True)
class Discriminant:
    """Per class (1: good, 0: bad) its prior, mean and the Cholesky factor of its covariance."""

    mean: np.ndarray
    factor: np.ndarray
    log_prior: np.ndarray
    flat: float

    @staticmethod
    def fit(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float, ridge: float, flat: float) -> Discriminant:
        """moments: class -> (count, sums, sums of products). A class covariance is drawn towards
        the pooled one by `shrink`, and more the fewer rows it has; `ridge` of the mean variance
        goes on the diagonal."""
        d = len(FEATURES)
        n = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
        mean, scatter = np.zeros((2, d)), np.zeros((2, d, d))
        for k in (0, 1):
            if n[k]:
                mean[k] = moments[k][1] / n[k]
                scatter[k] = moments[k][2] - n[k] * np.outer(mean[k], mean[k])
        total = max(n[0] + n[1], 1)
        if not n[0] or not n[1]:
            mean[0 if not n[0] else 1] = mean[1 if not n[0] else 0]
        pooled = scatter.sum(0) / total
        scale = max(float(np.trace(pooled)) / d, 1e-3)
        factor = np.zeros((2, d, d))
        for k in (0, 1):
            a = max(shrink, d / (d + n[k]))
            own = scatter[k] / max(n[k], 1)
            cov = (1 - a) * own + a * pooled
            factor[k] = np.linalg.cholesky(cov + np.diag(ridge * scale + ridge * np.diag(pooled)))
        return Discriminant(mean, factor, np.log([(n[0] + 1) / (total + 2), (n[1] + 1) / (total + 2)]), flat)

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(class 1): logistic of the log-density difference plus the prior's. Distances beyond
        `flat` grow as their root only: far from both classes, the densities say little."""
        log = np.empty((2, len(x)))
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            d2 = (z * z).sum(0)
            far = d2 > self.flat
            d2[far] = 2 * np.sqrt(self.flat * d2[far]) - self.flat
            log[k] = self.log_prior[k] - np.log(np.diag(self.factor[k])).sum() - d2 / 2
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


#: Labelled documents that are learnt from, at most.
MAX_TRAIN = 20_000


def _of_texts(finish, returns: str, batch_bytes: int = 1 << 20):
    """A function of a text column: what finish(statistics of the batch's texts) gives; null counts as
    empty. Only texts go to Python, the other columns of a row stay where they are."""

    def run(column: pa.Array) -> pa.Array:
        texts = list(utf8_texts(column))
        return pa.concat_arrays([finish(statistics(texts[a:b])) for a, b in by_bytes(texts, batch_bytes)] or [finish(statistics([]))])

    return F.arrow_udf(run, returns)


def document_statistics(docs: DataFrame, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns `keep` and x: the transformed statistics of each text."""

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))

    return docs.select(*keep, _of_texts(lists, "array<double>")(text_col).alias("x"))


def fit_discriminant(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, max_train: int = MAX_TRAIN, shrink: float = 0.15, ridge: float = 1e-3, flat: float = 60.0
) -> Discriminant:
    """Fits on the labelled rows whose fold is not 0, at most `max_train` by hash of the id, which are
    broadcast. Each partition reduces its rows to two sums and a matrix per class; the driver gets
    those of the two classes only."""
    train = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, folds) != 0))
    train = train.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    train = train.orderBy(F.xxhash64("__id", F.lit(7)), "__id").limit(max_train)
    own = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__t")).join(F.broadcast(train), F.col("__doc") == F.col("__id"))
    rows = document_statistics(own, "__t", ("__y",)).select("x", "__y")
    d = len(FEATURES)
    schema = "y int, n long, s array<double>, p array<double>"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = np.zeros(2, np.int64), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            y = batch.column(1).to_numpy()
            for k in (0, 1):
                of = x[y == k]
                n[k] += len(of)
                s[k] += of.sum(0)
                p[k] += of.T @ of
        yield pa.RecordBatch.from_pydict({"y": pa.array([0, 1], pa.int32()), "n": n, "s": list(s), "p": [m.ravel() for m in p]})

    parts = rows.mapInArrow(reduce, schema)
    sums = parts.groupBy("y").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s"),
        F.array(*[F.sum(F.col("p")[i]) for i in range(d * d)]).alias("p"),
    )
    moments = {r.y: (r.n, np.array(r.s), np.array(r.p).reshape(d, d)) for r in sums.collect() if r.n}
    return Discriminant.fit(moments, shrink, ridge, flat)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, folds: int = 5, max_train: int = MAX_TRAIN, carry: bool = False
) -> DataFrame:
    """One row per row of `docs`: id, held_out (fold 0), score (P of label 1), predicted, and with
    `carry` the whole row as the struct `row`.

    Texts alone are scored: null and empty ones have the statistics of no word. At most `max_train`
    labelled documents are learnt from; labels that are null or neither 0 nor 1, those of fold 0 and
    of null ids are not, and an id labelled twice counts once, by its larger label. Without labels of
    one class every score is the prior's. Repeated rows give repeated rows; other columns are not
    read, but for `carry`. Sums over partitions may differ in their last digits between runs.
    """
    small_batches(docs.sparkSession)
    model = fit_discriminant(docs, labels, id_col, text_col, label_col, folds, max_train)
    score = _of_texts(lambda x: pa.array(model.score(x), pa.float64()), "double")
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    scored = docs.select(F.col(id_col), (fold(id_col, folds) == 0).alias("held_out"), score(text_col).alias("score"), *own)
    return scored.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["row"] if carry else []))
