"""Toxicity by two class-conditional Kneser-Ney bigram models with shared backoff counts."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import LOWER_ALNUM, by_bytes, fold, mix64, segment_sum, small_batches, stage, utf8_texts

#: Labelled documents that are learnt from, at most. What the models hold follows from it.
MAX_TRAIN = 6_000
#: The share of a toxic text's words that its model draws from the toxic class, the others from the ordinary one.
SHARE = 0.003
#: Bytes of text that are scored at once; a longer text goes in slices.
SLICE_BYTES = 2 << 20
#: What stands before the first word of a text.
BEGIN = np.uint64(1)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts already translated: (the words' numbers, one text after another; words per text; the
    64-bit hash of each distinct word)."""
    import xxhash

    index: dict[bytes, int] = defaultdict(itertools.count().__next__)
    parts, count = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        count[i] = len(words)
        parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), count, h


def _pair(left: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(left * np.uint64(0x9E3779B97F4A7C15) + h)


def _slices(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in parts that end at blanks, of `limit` bytes and the rest of a word."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + limit) if at + limit < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def discount(counts: np.ndarray) -> float:
    """The absolute discount n1 / (n1 + 2 n2) of positive counts, within 0.1 to 0.95."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip(one / (one + 2 * two), 0.1, 0.95)) if one else 0.5


def _find(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, of)
    at[at == len(keys)] = 0
    return at, keys[at] == of if len(keys) else np.zeros(len(of), bool)


@dataclass(frozen=True)
class KneserNey:
    """Two interpolated Kneser-Ney models that share their backoff counts.

    P_c(w | v) = a_c(v, w) + b_c(v) * (a_s(v, w) + b_s(v) * P_c(w)), with the discounted counts a and
    the weights b of class c (0 ordinary, 1 toxic) and of both together (s); P_c(w) = a_c(w) + b_c *
    P_s(w) from continuation counts, and P_s(w) from those of both classes with one half added to
    each word and to one unknown word. So an expression seen in one class only is likely in both
    as far as its counts are chance, and every distribution sums to 1.

    words: sorted hashes; single: P_c of each; unknown: P_c of any other word. heads: sorted hashes of
    left neighbours; weight: b_0, b_1, b_s of each; scale: one over the sums of its counts, 0 where
    there are none. pairs: sorted bigram hashes; counts: by class. cut:
    the discounts of the two classes and of both together.
    """

    words: np.ndarray
    single: np.ndarray
    unknown: np.ndarray
    heads: np.ndarray
    weight: np.ndarray
    scale: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray
    cut: tuple[float, float, float]
    bits: int = field(init=False)
    first: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        bits = max(1, len(self.pairs).bit_length())
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        object.__setattr__(self, "bits", bits)
        object.__setattr__(self, "first", np.append(np.searchsorted(self.pairs, edges), len(self.pairs)))

    @classmethod
    def of_tables(cls, words: np.ndarray, cont: np.ndarray, heads: np.ndarray, seen: np.ndarray, total: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> KneserNey:
        """cont: continuation counts of the words. seen, total: different words after each head and
        their counts. All by ordinary, toxic and both, counts by the first two only; hashes in any
        order."""
        shared = (np.append(cont[:, 2], 0) + 0.5) / (cont[:, 2].sum() + 0.5 * (len(words) + 1))
        single = np.empty((len(words) + 1, 2))
        for c in range(2):
            own = np.append(cont[:, c], 0)
            kept = np.maximum(own - discount(own[own > 0]), 0) / max(own.sum(), 1)
            single[:, c] = kept + (1 - kept.sum()) * shared
        cut = (*(discount(counts[:, c][counts[:, c] > 0]) for c in range(2)), discount(counts[:, 0] + counts[:, 1]))
        with np.errstate(divide="ignore"):
            scale = np.where(total > 0, 1 / total, 0.0)
        weight = np.where(total > 0, np.array(cut) * seen * scale, 1.0)
        w, h, p = np.argsort(words), np.argsort(heads), np.argsort(pairs)
        return cls(words[w], single[:-1][w], single[-1], heads[h], weight[h], scale[h], pairs[p], counts[p], cut)

    @classmethod
    def of_counts(cls, v: np.ndarray, w: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From distinct bigrams (v, w) and their counts by class, one row a bigram."""
        both = np.column_stack([counts, counts.sum(1)])
        words, at = np.unique(w, return_inverse=True)
        heads, of = np.unique(v, return_inverse=True)
        by = lambda at, n, x: np.column_stack([np.bincount(at, weights=x[:, c], minlength=n) for c in range(3)])
        return cls.of_tables(words, by(at, len(words), both > 0), heads, by(of, len(heads), both > 0), by(of, len(heads), both), _pair(v, w), counts)

    def probabilities(self, left: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
        """P_0 and P_1 of each word ids[i] after left[i]; both are numbers into the distinct `hashes`."""
        if not len(self.words):
            return [np.ones(len(ids)), np.ones(len(ids))]
        at, known = _find(self.words, hashes)
        single = np.where(known[:, None], self.single[at], self.unknown)
        at, known = _find(self.heads, hashes)
        weight = np.where(known[:, None], self.weight[at], 1.0)
        scale = np.where(known[:, None], self.scale[at], 0.0)
        at = self.place(_pair(hashes[left], hashes[ids]))
        hit = np.flatnonzero(at >= 0)
        counts, before, out = self.counts[at[hit]].astype(np.float64), left[hit], []
        shared = np.maximum(counts.sum(1) - self.cut[2], 0) * scale[before, 2]
        for c in range(2):
            p = weight[left, 2] * single[ids, c]
            p[hit] += shared
            p *= weight[left, c]
            p[hit] += np.maximum(counts[:, c] - self.cut[c], 0) * scale[before, c]
            out.append(p)
        return out

    def place(self, pair: np.ndarray) -> np.ndarray:
        """The row of each bigram hash, -1 if there is none. Hashes are even, so the first bits
        lead to a few rows, which are passed one by one."""
        bucket = (pair >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(pair), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            same = self.pairs[here] == pair[open_]
            out[open_[same]] = here[same]
            at[open_] += 1
            open_ = open_[~same & (here + 1 < end[open_])]
        return out

    def text_sums(self, texts: list[bytes], share: float = SHARE, limit: int = SLICE_BYTES) -> np.ndarray:
        """Per text: words, log P under the ordinary model, and under the toxic text model, which
        draws a word with probability `share` from the toxic class and else from the ordinary one."""
        out = np.zeros((len(texts), 3))

        def sums(part: list[bytes], before: np.uint64 = BEGIN) -> tuple[np.ndarray, np.uint64]:
            ids, count, hashes = _tokens(part)
            left = np.roll(ids, 1)
            left[(np.cumsum(count) - count)[count > 0]] = len(hashes)
            p, q = self.probabilities(left, ids, np.append(hashes, before))
            plain = np.log(p)
            mixed = plain + np.log1p(share * (q / p - 1))
            return np.column_stack([count, segment_sum(plain, count), segment_sum(mixed, count)]), hashes[ids[-1]] if len(ids) else before

        for a, b in by_bytes(texts, limit):
            if b == a + 1:
                before = BEGIN
                for piece in _slices(texts[a].translate(LOWER_ALNUM), limit):
                    got, before = sums([piece], before)
                    out[a] += got[0]
            else:
                out[a:b] = sums([t.translate(LOWER_ALNUM) for t in texts[a:b]])[0]
        return out


def training_rows(labels: DataFrame, id_col: str, label_col: str, folds: int, most: int) -> DataFrame:
    """(__id, __y, __part): labelled rows whose fold is not 0, at most `most` by hash of the id, so
    both classes are sampled at one rate. __part 1 (the last fold) is for calibration, 0 for the models."""
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, folds) != 0))
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    part = (fold("__id", folds) == folds - 1).cast("int").alias("__part")
    return rows.orderBy(F.xxhash64("__id", F.lit(5)), "__id").limit(most).select("__id", "__y", part)


def count_bigrams(texts: DataFrame) -> DataFrame:
    """(v, w, p, o, t) of (text, class): the hash p of each bigram, and in how many ordinary and toxic texts each bigram stands; a
    text counts once for each of its bigrams, so its repeated lines add nothing."""
    names = ["v", "w", "p", "o", "t"]

    def merged(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        key = _pair(every[:, 0].view(np.uint64), every[:, 1].view(np.uint64))
        key, at, back = np.unique(key, return_index=True, return_inverse=True)
        cols = [every[at, 0], every[at, 1], key.view(np.int64)]
        cols += [np.bincount(back, weights=every[:, 2] == y).astype(np.int64) for y in (0, 1)]
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[i : i + 100_000])) for c in cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for text, y in zip(utf8_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                ids, _, hashes = _tokens([text.translate(LOWER_ALNUM)])
                h = hashes[ids]
                left = np.append(BEGIN, h[:-1])[: len(h)]
                _, at = np.unique(_pair(left, h), return_index=True)
                held.append(np.column_stack([left[at].view(np.int64), h[at].view(np.int64), np.full(len(at), y, np.int64)]))
                if sum(map(len, held)) > 1_000_000:
                    yield from merged(held)
                    held = []
        if held:
            yield from merged(held)

    rows = texts.mapInArrow(run, "v long, w long, p long, o long, t long")
    return rows.groupBy("v", "w", "p").agg(F.sum("o").cast("int").alias("o"), F.sum("t").cast("int").alias("t"))


def fit_models(texts: DataFrame) -> KneserNey:
    """Both models from (text, class) rows. Their tables come through the driver, 16 bytes for each
    distinct bigram of at most MAX_TRAIN documents."""
    pairs = stage(count_bigrams(texts), "toxic-bigrams")
    sums = lambda *cols: [F.sum(c).cast("int").alias(f"c{i}") for i, c in enumerate(cols)]
    seen = [F.col(c) > 0 for c in ("o", "t")]
    seen = [*[c.cast("int") for c in seen], F.lit(1)]

    def columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.toArrow()
        return got.column(0).to_numpy().view(np.uint64), np.column_stack([c.to_numpy() for c in got.columns[1:]])

    words, cont = columns(pairs.groupBy("w").agg(*sums(*seen)))
    heads, counts = columns(pairs.groupBy("v").agg(*sums(*seen, F.col("o"), F.col("t"), F.col("o") + F.col("t"))))
    return KneserNey.of_tables(words, cont, heads, counts[:, :3], counts[:, 3:], *columns(pairs.select("p", "o", "t")))


def _evidence(sent, share: float):
    """A function of a text column that gives ordinary and toxic (mean log-likelihood a word) and x: 1000
    times their difference. Only texts go to Python."""

    def run(column: pa.Array) -> pa.Array:
        sums = sent.value.text_sums(list(utf8_texts(column)), share)
        mean = sums[:, 1:] / np.maximum(sums[:, :1], 1)
        cols = [mean[:, 0], mean[:, 1], 1000 * (mean[:, 1] - mean[:, 0])]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c), pa.float64()) for c in cols], names=["ordinary", "toxic", "x"])

    return F.arrow_udf(run, "struct<ordinary: double, toxic: double, x: double>")


def calibrate(seen: pd.DataFrame) -> tuple[float, float]:
    """(slope, middle) of the logistic curve through evidence by class (columns x, y).

    The middle is the cut of least balanced error: of the cuts that are equally good, the middle of
    the widest stretch. The slope follows from the distance of the classes' medians. Nothing is
    iterated, so classes that part cleanly are no special case. Without both classes: (1, 1).
    """
    x = [np.sort(seen["x"].to_numpy(np.float64)[seen["y"] == k]) for k in (0, 1)]
    if not all(map(len, x)):
        return 1.0, 1.0
    places = np.unique(np.concatenate(x))
    cuts = (places[1:] + places[:-1]) / 2 if len(places) > 1 else places
    below = [np.searchsorted(v, cuts) / len(v) for v in x]
    error = np.round((1 - below[0]) + below[1], 9)
    best = np.flatnonzero(error == error.min())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    edge = lambda r: (places[r[0]], places[min(r[-1] + 1, len(places) - 1)])
    lo, hi = max((edge(r) for r in runs), key=lambda e: e[1] - e[0])
    return float(np.clip(8 / max(np.median(x[1]) - np.median(x[0]), 1e-9), 0.05, 20)), float((lo + hi) / 2)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.5,
    folds: int = 5,
    max_train: int = MAX_TRAIN,
    share: float = SHARE,
    carry: bool = False,
) -> DataFrame:
    """One row per row of `docs`: id, held_out (fold 0), score (0 to 1), predicted, evidence, and the
    length-normalised log-likelihoods ordinary_loglik and toxic_loglik; with `carry` also the whole row as the
    struct `row`.

    evidence is 1000 times the difference of the two. The models learn from labelled documents
    outside fold 0 and the last fold, the curve that turns evidence into a score from the last one;
    at most `max_train` documents in all (null and other labels are ignored; an id labelled twice
    counts once, by its larger label). A null or empty text has evidence 0. Whole texts are scored,
    long ones in slices. Repeated rows give repeated rows, and a labelled id that stands in several
    rows is learnt from each; other columns are not read, but for `carry`. Without labels of both
    classes every text scores by a fixed curve.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    train = stage(training_rows(labels, id_col, label_col, folds, max_train), "toxic-train")
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    texts = stage(rows.join(F.broadcast(train), F.col("__doc") == F.col("__id")).select("__text", "__y", "__part"), "toxic-texts")
    sent = spark.sparkContext.broadcast(fit_models(texts.filter("__part = 0").select("__text", "__y")))
    # a row a labelled document of one fold, so at most max_train
    seen = texts.filter("__part = 1").select(_evidence(sent, share)("__text").alias("e"), F.col("__y").alias("y")).select("e.x", "y").toPandas()
    slope, middle = calibrate(seen)
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    scored = docs.select(F.col(id_col).alias("__id"), _evidence(sent, share)(text_col).alias("e"), *own)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(slope) * (F.col("e.x") - F.lit(middle))))
    return scored.select(
        F.col("__id").alias(id_col),
        (fold("__id", folds) == 0).alias("held_out"),
        score.alias("score"),
        F.when(score >= threshold, 1).otherwise(0).alias("predicted"),
        F.col("e.x").alias("evidence"),
        F.col("e.ordinary").alias("ordinary_loglik"),
        F.col("e.toxic").alias("toxic_loglik"),
        *(["row"] if carry else []),
    )
