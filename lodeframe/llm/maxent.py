"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

log P(token | context) = log P(class | context) + log P(token | class). The class softmax has
hashed features of the two tokens before (bigram, trigram and skip), trained by gradient steps
that run in tasks over all training documents and are averaged between rounds. The tokens of a
class share its mass by their corpus counts, which for a softmax with one weight a token is the
exact optimum (with one added to each count, and one for all unknown tokens of the class).

Counts of all training tokens are summed in Spark by a 64-bit hash. Documents get them back by
blocks: each block asks once for each of its distinct tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.common import LOWER, by_bytes, fold, mix64, segment_sum, stage, utf8_texts

#: The hash of the end token; words hash elsewhere but for one chance in 2^64.
END = 0x5EED0E2D
#: Bytes of text in a block, on average.
BLOCK_BYTES = 12 << 20
#: Parts of the tokens in which counts are summed, at least; as many as blocks if these are more.
PARTS = 32
#: The largest weight.
LIMIT = 8.0


@dataclass(frozen=True)
class Params:
    """features: rows of the weight table. top: frequent tokens that are a class each (the end
    token is one more). shapes: classes of the other tokens, by their last letters. rounds: how
    often tasks' weights are averaged; each training document takes part in one round."""

    features: int = 1 << 13
    top: int = 31
    shapes: int = 32
    rounds: int = 3
    batch: int = 2048
    rate: float = 1.0
    folds: int = 7
    held: int = 2

    @property
    def classes(self) -> int:
        return 1 + self.top + self.shapes


@dataclass
class Tokens:
    """Texts as token numbers, each text's end included: number 0 is the end."""

    ids: np.ndarray
    count: np.ndarray
    hashes: np.ndarray
    shape: np.ndarray


#: The bytes that separate words, and a table of 0 for these and 1 for all others.
SPACES = b" \t\n\r\x0b\x0c"
INSIDE = bytes(b not in SPACES for b in range(256))


def tokenize(texts: list[bytes], p: Params) -> Tokens:
    """All words lie side by side in one Arrow column, which numbers them in the order they first
    occur; only distinct words become Python objects."""
    import pyarrow.compute as pc
    import xxhash

    joined = b" ".join([b"", *texts, b""])
    inside = np.frombuffer(joined.translate(INSIDE), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    buffers = [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - begins)])), pa.py_buffer(joined.translate(LOWER, SPACES))]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), buffers).dictionary_encode()
    # a text has the words that begin before the blank behind it and are no earlier text's
    behind = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    count = np.diff(np.searchsorted(begins, behind), prepend=0) + 1
    ids = np.zeros(len(begins) + len(texts), np.int64)
    is_word = np.ones(len(ids), bool)
    is_word[np.cumsum(count) - 1] = False
    ids[is_word] = words.indices.to_numpy() + np.int64(1)
    whole = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
    index = pc.binary_join(whole, pa.scalar(b" ", pa.large_binary()))[0].as_py().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
    # the last two bytes of each word, from all words side by side; a blank stands before the first
    flat = np.frombuffer(b"  " + b" ".join(index), np.uint8).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, index), np.int64, len(index)) + 1)
    shape = (flat[ends] * 37 + flat[ends - 1] * 11 + (flat[ends] >> 3)) % p.shapes if len(index) else ends
    return Tokens(ids, count, np.concatenate([[np.uint64(END)], hashes]), np.concatenate([[0], shape]))


def run_sums(rows: np.ndarray, at: np.ndarray, first: np.ndarray, short: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(sums of rows[at] over the consecutive runs of `at` that begin at `first`, the runs in the
    order of the sums). Most runs have a row or two. They follow by falling length, so that those
    with a k-th row are one range, and are added side by side; only long ones, which come first,
    are summed one by one."""
    size = np.diff(first, append=len(at))
    order = np.argsort((short + 1 - np.minimum(size, short + 1)).astype(np.uint8), kind="stable")
    size, begin = size[order], first[order]
    n_long = int(np.count_nonzero(size > short))
    out = rows.take(at[begin], axis=0)
    for k in range(1, short):
        end = int(np.count_nonzero(size > k))
        if end == n_long:
            break
        out[n_long:end] += rows.take(at[begin[n_long:end] + k], axis=0)
    for i in range(n_long):
        out[i] = rows.take(at[begin[i] : begin[i] + size[i]], axis=0).sum(0)
    return out, order


@dataclass
class Model:
    """weights: features x classes; bias: classes. top: hashes of the tokens of the classes 1 to
    len(top). in_class: (tokens counted, different tokens) of each class. n, v: the same of all."""

    p: Params
    weights: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    in_class: np.ndarray
    n: int
    v: int
    order: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.order = np.argsort(self.top)

    def classes_of(self, t: Tokens) -> np.ndarray:
        """The class of each distinct token."""
        cls = 1 + self.p.top + t.shape
        cls[0] = 0
        if len(self.top):
            ranked = self.top[self.order]
            at = np.minimum(np.searchsorted(ranked, t.hashes), len(ranked) - 1)
            cls = np.where(ranked[at] == t.hashes, 1 + self.order[at], cls)
        return cls

    def features_of(self, t: Tokens) -> np.ndarray:
        """tokens x 3 weight rows: of the token before, of both before, and of the second before.
        A text begins after two ends."""
        size = np.uint64(self.p.features)
        h = t.hashes[t.ids]
        one, two = np.roll(h, 1), np.roll(h, 2)
        start = np.cumsum(t.count) - t.count
        one[start] = two[start] = END
        second = (start + 1)[t.count > 1]
        two[second] = END
        out = np.empty((len(h), 3), np.int64, order="F")
        with np.errstate(over="ignore"):
            # rows of one token are found once a distinct token, number 0 being the end
            for k, shift in ((0, 0), (2, 7)):
                row = (mix64(t.hashes + np.uint64(shift)) % size).astype(np.int64)
                out[:, k] = np.roll(row[t.ids], 1 + k // 2)
                out[start, k] = row[0]
                if k:
                    out[second, k] = row[0]
            out[:, 1] = mix64(one * np.uint64(3) + two * np.uint64(5)) % size
        return out

    def exp_logits(self, f: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
        """exp of every class's logit in `out`. Weights lie within LIMIT and biases are not above
        0, so nothing overflows and no maximum has to be taken out."""
        n = len(f)
        z, t = out[:n], spare[:n]
        np.take(self.weights, f[:, 0], axis=0, out=z, mode="clip")
        for k in (1, 2):
            np.take(self.weights, f[:, k], axis=0, out=t, mode="clip")
            z += t
        z += self.bias
        return np.exp(z, out=z)

    def class_scores(self, t: Tokens, cls: np.ndarray) -> np.ndarray:
        """log P(class | context) of every token, in batches of a bounded number of rows. The weights
        stay, so their exp is taken once and a context's is a product of rows."""
        f, y, out = self.features_of(t), cls[t.ids], np.empty(len(t.ids))
        each, bias = np.exp(self.weights), np.exp(self.bias)
        size = min(self.p.batch, 256)
        z, spare = (np.empty((size, self.p.classes), np.float32) for _ in range(2))
        for a in range(0, len(y), size):
            b = min(a + size, len(y))
            e, more = z[: b - a], spare[: b - a]
            np.take(each, f[a:b, 0], axis=0, out=e, mode="clip")
            for k in (1, 2):
                np.take(each, f[a:b, k], axis=0, out=more, mode="clip")
                e *= more
            out[a:b] = e[np.arange(b - a), y[a:b]] * bias[y[a:b]] / (e @ bias)
        return np.log(out)

    def in_class_scores(self, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log P(token | class) of distinct tokens with corpus counts c."""
        n, v = self.in_class[cls].T
        return np.where(cls <= len(self.top), 0.0, np.log(c + 1) - np.log(n + v + 1))

    def step(self, t: Tokens, square: np.ndarray) -> np.ndarray:
        """One pass of gradient steps over the texts; square: the sum of squared gradients of each
        weight row, by which its steps shrink. Returns how many tokens each weight row met."""
        f, y = self.features_of(t), self.classes_of(t)[t.ids]
        z, spare = (np.empty((self.p.batch, self.p.classes), np.float32) for _ in range(2))
        small, ones = np.uint16 if self.p.features <= 1 << 16 else np.int64, np.ones(self.p.classes, np.float32)
        own = np.arange(self.p.batch) * self.p.classes
        for a in range(0, len(y), self.p.batch):
            b = min(a + self.p.batch, len(y))
            g = self.exp_logits(f[a:b], z, spare)
            g /= (g @ ones)[:, None]
            g.ravel()[own[: b - a] + y[a:b]] -= 1
            rows = f[a:b].ravel()
            order = np.argsort(rows.astype(small), kind="stable")
            rows = rows[order]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            grad, by_size = run_sums(g, order // 3, first)
            rows = rows[first[by_size]]
            square[rows] += np.einsum("ij,ij->i", grad, grad)
            grad *= (self.p.rate / np.sqrt(square[rows] + 1.0))[:, None]
            self.weights[rows] = np.subtract(self.weights.take(rows, axis=0), grad, out=grad)
        np.clip(self.weights, -LIMIT, LIMIT, out=self.weights)
        return np.bincount(f.ravel(), minlength=self.p.features)


def _requests(blocked: DataFrame, p: Params, n_parts: int) -> DataFrame:
    """(part, block, h, shape, n): each block's distinct tokens with their number in its training
    texts, as lists; a token is in the part that its hash names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def sent(block: int) -> pa.RecordBatch:
            h, shape, n = (np.concatenate(c) for c in zip(*held.pop(block), strict=True))
            h, at, which = np.unique(h, return_index=True, return_inverse=True)
            shape, n = shape[at], np.bincount(which, weights=n).astype(np.int64)
            part = (h % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            size = np.bincount(part)
            there = np.flatnonzero(size)
            columns = [lists(size[there], c[order]) for c in (h.view(np.int64), shape.astype(np.int32), n)]
            return pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.full(len(there), block)), *columns], names=["part", "block", "h", "shape", "n"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts = list(utf8_texts(batch.column(2)))
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                t = tokenize([texts[i] for i in at], p)
                n = np.bincount(t.ids, weights=np.repeat(train[at], t.count), minlength=len(t.hashes))
                held.setdefault(int(b), []).append((t.hashes, t.shape, n))
                if sum(len(h) for h, _, _ in held[int(b)]) > 2_000_000:
                    yield sent(int(b))
        for b in list(held):
            yield sent(b)

    return blocked.select("block", "train", "text").mapInArrow(run, "part long, block long, h array<long>, shape array<int>, n array<long>")


def lists(size: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Consecutive lists of the given lengths."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(values))


def _answers(requests: DataFrame, p: Params) -> DataFrame:
    """Rows of two kinds. (block, h, c): the corpus counts of a block's tokens of one part, as lists.
    (kind, shape, a, b), of each part, which has all blocks' counts of its tokens: the tokens counted
    and the different ones of each shape (kind n), and its own top tokens with their counts and
    hashes (kind t), which are all that can be in the whole's top.

    A part has a row a block and as many tokens as a block has, whatever the corpus; a token has a
    number a block at most, so none is hot.
    """
    import pyarrow.compute as pc

    names = ["block", "h", "c", "kind", "shape", "a", "b"]

    def count(rows: pa.Table) -> pa.Table:
        h, shape, n = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("h", "shape", "n"))
        size = pc.list_value_length(rows.column("h")).to_numpy()
        distinct, at, which = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(which, weights=n, minlength=len(distinct)).astype(np.int64)
        counted = pa.Table.from_arrays([rows.column("block").combine_chunks(), lists(size, h), lists(size, c[which])], names=names[:3])
        known = np.flatnonzero(c > 0)
        of, each = np.where(distinct[known] == END, p.shapes, shape[at[known]]), c[known]
        sums = np.bincount(of, weights=each, minlength=p.shapes + 1).astype(np.int64)
        different = np.bincount(of, minlength=p.shapes + 1)
        best = np.argsort(-each, kind="stable")[: p.top + 1]
        told = pa.Table.from_arrays(
            [
                pa.array(["n"] * len(sums) + ["t"] * len(best), pa.string()),
                pa.array(np.concatenate([np.arange(len(sums)), of[best]]), pa.int32()),
                pa.array(np.concatenate([sums, each[best]]), pa.int64()),
                pa.array(np.concatenate([different, distinct[known[best]]]), pa.int64()),
            ],
            names=names[3:],
        )
        return pa.concat_tables([counted, told], promote_options="default").select(names)

    return requests.groupBy("part").applyInArrow(count, "block long, h array<long>, c array<long>, kind string, shape int, a long, b long")


def _statistics(answers: DataFrame, p: Params) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(N, V, (count, different) by shape, hashes and (shape, count) of the top tokens)."""
    sums = answers.filter("kind = 'n'").groupBy("shape").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    top = answers.filter("kind = 't'").select("shape", "a", "b").orderBy(F.desc("a"), "b").limit(p.top + 1)
    each = np.zeros((p.shapes + 1, 2), np.int64)
    for r in sums.collect():
        each[r.shape] = r.a, r.b
    best = [r for r in top.collect() if r.b != END][: p.top]
    hashes = np.array([r.b for r in best], np.int64).view(np.uint64)
    return int(each[:, 0].sum()), int(each[:, 1].sum()), each, hashes, np.array([(r.shape, r.a) for r in best], np.int64).reshape(-1, 2)


def start_model(answers: DataFrame, p: Params) -> Model:
    """The model before training: all weights 0, so that every context has the class totals."""
    n, v, each, top, about = _statistics(answers, p)
    in_class = np.zeros((p.classes, 2), np.float64)
    in_class[0] = each[p.shapes]
    in_class[1 : len(top) + 1, 0], in_class[1 : len(top) + 1, 1] = about[:, 1], 1
    in_class[1 + p.top :] = each[: p.shapes]
    for shape, c in about:
        in_class[1 + p.top + shape] -= c, 1
    bias = np.log(in_class.sum(1) + 1)
    return Model(p, np.zeros((p.features, p.classes), np.float32), (bias - bias.max()).astype(np.float32), top, in_class, n, v)


def train(model: Model, docs: DataFrame, id_col: str, text_col: str, batch_bytes: int = 2 << 20) -> Model:
    """Runs the rounds: tasks start from the same weights, step through their own documents of the
    round, and send how far each weight row has moved and by how many tokens. The mean, weighted by
    tokens, is the next start. Sums are taken in two steps, so no task gets every task's rows."""
    p, spark = model.p, docs.sparkSession
    texts = docs.filter(fold(id_col, p.folds) != p.held).select(F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.lit(p.rounds)).alias("__round"), text_col)
    for k in range(p.rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, base = None, None
            for batch in batches:
                raw = list(utf8_texts(batch.column(0)))
                for a, b in by_bytes(raw, batch_bytes):
                    t = tokenize(raw[a:b], p)
                    if own is None:
                        base = sent.value
                        own = Model(p, base.weights.copy(), base.bias, base.top, base.in_class, base.n, base.v)
                        square, seen = np.zeros(p.features, np.float32), np.zeros(p.features, np.float32)
                    seen += own.step(t, square)
            if own is not None:
                move = (own.weights - base.weights) * seen[:, None]
                salt = TaskContext.get().partitionId() % 64
                rows = np.flatnonzero(seen)
                for part in np.array_split(rows, max(1, len(rows) // 128)):
                    for chunk in np.split(part, np.flatnonzero(np.diff(part // 128)) + 1):
                        full = np.zeros((128, p.classes + 1), np.float32)
                        full[chunk % 128, :-1], full[chunk % 128, -1] = move[chunk], seen[chunk]
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([int(chunk[0] // 128)], pa.int32()), "salt": pa.array([salt], pa.int32()), "m": [full.tobytes()]})

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(m, np.float32) for m in pdf["m"]], axis=0, dtype=np.float32)
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "salt": [0], "m": [total.tobytes()]})

        shape = "shard int, salt int, m binary"
        moved = texts.filter(F.col("__round") == k).select(text_col).mapInArrow(run, shape)
        total = moved.groupBy("shard", "salt").applyInPandas(add, shape).groupBy("shard").applyInPandas(add, shape)
        weights = model.weights.copy()
        for r in total.collect():
            m = np.frombuffer(r.m, np.float32).reshape(128, p.classes + 1)
            weights[r.shard * 128 : r.shard * 128 + 128] += m[:, :-1] / np.maximum(m[:, -1:], 1)
        model = Model(p, weights, model.bias, model.top, model.in_class, model.n, model.v)
        sent.unpersist()
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the A-Z-lower-cased words [^\\x20\\x09-\\x0D]+ and one end; a null or empty text is
    its end alone. Training takes the documents whose fold is not `held`. base_score: the sum of
    log10((c+1)/(N+V+1)) with c, N and V over training tokens; score: log10 of the model's
    probability of the text, with one unknown token a shape class. Repeated rows give repeated rows
    and count as often; a null id has the fold of the empty text. Without training documents all
    counts are 0. Other columns are not read. Averages over tasks may differ in their last digits
    between runs.
    """
    p = params or Params()
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_blocks = max(4, -(-total // block_bytes))
    blocked = docs.select(
        F.col(id_col).alias("__id"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(n_blocks)).alias("block"),
        (fold(id_col, p.folds) != p.held).alias("train"),
        F.col(text_col).alias("text"),
    )
    answers = stage(_answers(_requests(blocked.repartition(n_blocks, "block"), p, max(PARTS, n_blocks)), p), "maxent-answers")
    model = train(start_model(answers, p), docs, id_col, text_col)
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )

    def score(texts: pa.Table, answer: pa.Table) -> pa.Table:
        m = sent.value
        lists = [answer.column(c).combine_chunks() for c in ("h", "c")]
        h, c = (x.flatten().to_numpy() for x in lists)
        order = np.argsort(h)
        h, c = h[order], c[order]
        out = {name: [] for name in ("n_tokens", "n_known", "base_score", "score")}
        raw = list(utf8_texts(texts.column("text")))
        for a, b in by_bytes(raw, 2 << 20):
            t = tokenize(raw[a:b], p)
            count = c[np.searchsorted(h, t.hashes.view(np.int64))]
            cls = m.classes_of(t)
            base = np.log10(count + 1) - np.log10(m.n + m.v + 1)
            within = m.in_class_scores(cls, count)
            tokens = m.class_scores(t, cls) + within[t.ids]
            out["n_tokens"].append(t.count)
            out["n_known"].append(segment_sum((count > 0)[t.ids].astype(np.int64), t.count))
            out["base_score"].append(segment_sum(base[t.ids], t.count))
            out["score"].append(segment_sum(tokens, t.count) / np.log(10))
        got = {k: np.concatenate(v) if v else np.empty(0) for k, v in out.items()}
        return pa.Table.from_arrays(
            [
                texts.column("__id"),
                pa.compute.invert(texts.column("train")),
                pa.array(got["n_tokens"], pa.int64()),
                pa.array(got["n_known"], pa.int64()),
                pa.array(np.full(len(raw), m.n), pa.int64()),
                pa.array(got["base_score"], pa.float64()),
                pa.array(got["score"], pa.float64()),
            ],
            names=schema.names,
        )

    import pyarrow.compute  # noqa: F401  (score uses pa.compute)

    return blocked.groupBy("block").cogroup(answers.filter("block IS NOT NULL").select("block", "h", "c").groupBy("block")).applyInArrow(score, schema)
