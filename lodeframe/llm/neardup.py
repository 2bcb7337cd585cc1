"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

Each document's MinHash samples give band keys and an odd sketch: every sample flips one bit of a
bitmap, so the bits in which two bitmaps differ count the samples that differ. Documents with
equal sets are one node from the start. In each band bucket all members are first held against the
bucket's smallest member; what that leaves unconnected is compared by sketches in blocks of a
bucket. Only pairs in different components are confirmed, so a group of near copies costs about one
pair a member, and no link between components is lost. Bitmaps of the whole sets first rule out
pairs that differ in too many shingles, without error; the others are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.common import HOT_KEYS, ID_WORDS, LOWER, among, by_bytes, hot_join, likely, mix64, numbered, passing, small_batches, stage, utf8_texts

#: Bytes of text whose shingles are hashed at once.
BATCH_BYTES = 1 << 20
#: Members of a bucket that are compared as one block.
BLOCK = 256
#: Shingles of such a block.
BLOCK_SHINGLES = 150_000


@dataclass(frozen=True)
class Params:
    """shingle: words of a shingle. percent: links have 100 * both >= percent * either. bands x
    rows: MinHash samples. sketch_words: 64-bit words of an odd sketch. sigmas: how many standard
    deviations below the threshold a sketch's estimate may lie before a pair is dropped unseen.

    A pair at the threshold s misses all bands with probability (1 - s^rows)^bands: below 1e-6 at
    the defaults and 85 percent.
    """

    shingle: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 5
    sketch_words: int = 4
    sigmas: float = 4.5
    seed: int = 1

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def max_xor(self) -> int:
        """Differing bits that a pair at the threshold has at most, but for `sigmas` deviations."""
        n, s = 64 * self.sketch_words, self.percent / 100
        differ = self.samples * (1 - s) + self.sigmas * (self.samples * s * (1 - s)) ** 0.5
        mean = n / 2 * (1 - (1 - 2 / n) ** (2 * differ))
        return int(mean + 2.5 * (n / 4 * (1 - np.exp(-8 * differ / n))) ** 0.5)


def shingle_sets(texts: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of each text's distinct shingles, rising within a text; shingles per text)."""
    import xxhash

    index: dict[bytes, int] = {}
    parts, n_words = [], []
    for text in texts:
        words = text.translate(LOWER).split()
        n_words.append(len(words))
        parts.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w, p.seed) for w in index), np.uint64, len(index))
    out, count = [], []
    with np.errstate(over="ignore"):
        for ids, n in zip(parts, n_words, strict=True):
            h, k = hashed[ids], min(p.shingle, n)
            if not n:
                out.append(h)
                count.append(0)
                continue
            s = np.full(n - k + 1, 0x9E3779B97F4A7C15 * k & (1 << 64) - 1, np.uint64)
            for j in range(k):
                s = mix64(s + h[j : n - k + 1 + j])
            s = np.unique(s)
            out.append(s)
            count.append(len(s))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.array(count, np.int64)


def signatures(flat: np.ndarray, count: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set hashes n x 2, band keys n x bands, odd sketches n x sketch_words) of non-empty sets."""
    starts = np.cumsum(count) - count
    k = np.arange(1, p.samples + 1, dtype=np.uint64) + np.uint64(1000 * p.seed)
    with np.errstate(over="ignore"):
        odd = mix64(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        mins = np.empty((len(count), p.samples), np.uint64)
        for i in range(p.samples):
            mins[:, i] = np.minimum.reduceat(flat * odd[i], starts)
        sums = np.stack([np.add.reduceat(flat, starts), np.add.reduceat(mix64(flat), starts)], 1)
        keys = np.zeros((len(count), p.bands), np.uint64)
        for j in range(p.rows):
            keys = mix64(keys + mins[:, j :: p.rows] + np.uint64(j + 1))
        keys = mix64(keys + np.arange(1, p.bands + 1, dtype=np.uint64))
        bit = mix64(mins + k) % np.uint64(64 * p.sketch_words)
    flips = np.zeros((len(count), 64 * p.sketch_words), np.uint8)
    np.add.at(flips, (np.repeat(np.arange(len(count)), p.samples), bit.ravel().astype(np.int64)), 1)
    sketch = np.packbits(flips & 1, axis=1, bitorder="little").view("<u8")
    return sums, keys, sketch


def parities(flat: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Each set's size and bitmap, as 64-bit words: every shingle flips the bit of its hash modulo
    the bitmap's length, a power of two of at least twice as many bits as shingles."""
    bits = 1 << np.ceil(np.log2(np.maximum(2 * count, 64))).astype(np.int64)
    ends = np.cumsum(bits)
    at = np.repeat(ends - bits, count) + (flat & np.repeat(bits - 1, count).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")
    return [n.tobytes() + odd[(e - b) // 8 : e // 8].tobytes() for n, b, e in zip(count.astype("<u8"), bits, ends, strict=True)]


def may_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """False where two sets cannot meet the threshold: they differ in as many shingles at least as
    their bitmaps (of `parities`, the longer folded to the shorter) do in bits."""
    (n, a), (m, b) = ((int(v[0]), v[1:]) for v in (a, b))
    width = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (a, b))
    differ = max(int(np.bitwise_count(a ^ b).sum()), abs(n - m))
    return 100 * (n + m - differ) >= percent * (n + m + differ)


def _profile(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """Per row: id, n (set size), h0, h1 (hashes of the set), parity, keys, s0.. (odd sketch)."""
    words = [f"s{i}" for i in range(p.sketch_words)]
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in ("h0", "h1")]
        + [T.StructField("parity", T.BinaryType())]
        + [T.StructField("keys", T.ArrayType(T.LongType()))]
        + [T.StructField(c, T.LongType()) for c in words]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done = list(utf8_texts(batch.column(1))), 0
            for a, b in by_bytes(texts, BATCH_BYTES):
                flat, count = shingle_sets(texts[a:b], p)
                some = count > 0
                wide = [np.zeros((b - a, w), np.int64) for w in (2, p.bands, p.sketch_words)]
                if some.any():
                    for w, got in zip(wide, signatures(flat, count[some], p), strict=True):
                        w[some] = got.view(np.int64)
                sums, keys, sketch = wide
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(count), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
                    + [pa.array(parities(flat, count), pa.binary())]
                    + [pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, p.bands, dtype=np.int32)), pa.array(keys.ravel()))]
                    + [pa.array(sketch[:, i]) for i in range(p.sketch_words)],
                    names=schema.names,
                )
                done = b

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _near(a: str, b: str, p: Params) -> Column:
    """Whether two rows' sketches differ in few enough bits."""
    differ = F.lit(0)
    for i in range(p.sketch_words):
        differ = differ + F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")))
    return differ <= p.max_xor


def _needed(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, ID_WORDS words long whatever the number of ids."""
    h = F.xxhash64("id")
    rows = (
        ids.select(
            F.pmod(h, F.lit(ID_WORDS)).cast("int").alias("w"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")).alias("m"),
        )
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
        .toArrow()
    )
    bits = np.zeros(ID_WORDS, np.int64)
    bits[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return bits


def _sets(docs: DataFrame, needed: np.ndarray, id_col: str, text_col: str, p: Params) -> DataFrame:
    """(id, set) of the documents that the bitmap may hold: sorted shingle hashes as bytes."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(needed)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("set", T.BinaryType())])
    hashed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            h = batch.column(2).to_numpy()
            at = h % ID_WORDS
            keep = (bits[at] >> ((h.view(np.uint64) >> np.uint64(40)) & np.uint64(63)).astype(np.int64)) & 1 == 1
            batch = batch.filter(pa.array(keep))
            texts = list(utf8_texts(batch.column(1)))
            for a, b in by_bytes(texts, BATCH_BYTES):
                flat, count = shingle_sets(texts[a:b], p)
                ends = np.cumsum(count)
                sets = [flat[e - n : e].tobytes() for e, n in zip(ends, count, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=schema.names)

    return hashed.filter("id is not null").mapInArrow(run, schema)


def _sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """(id, set) of the ids, and of the few others that share their bits of the bitmap."""
    return stage(_sets(docs, _needed(ids), id_col, text_col, p), "neardup-sets")


def _meet(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """(x, y, a, b) of the pairs (x, y), a written table, with the `set` that one has of x and of y.

    Sets are shuffled by id once, then those of x and of y to their pair. A y of many pairs has its
    set copied to as many salts as its pairs are dealt over."""
    limit = max(64, -(-pairs.count() // HOT_KEYS))
    # at most HOT_KEYS rows
    hot = F.broadcast(pairs.groupBy("y").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("y", F.ceil(F.col("n") / limit).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(hot, "y", "left").select("x", "y", F.pmod(F.xxhash64("x", F.lit(7)), salts).cast("int").alias("salt"))
    places = pairs.select("y").distinct().join(hot, "y", "left").select("y", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    copied = places.join(one.withColumnsRenamed({"id": "y", "set": "b"}), "y")
    return dealt.join(one.withColumnsRenamed({"id": "x", "set": "a"}), "x").join(copied, ["y", "salt"]).select("x", "y", "a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    """(id) of both sides of the pairs."""
    return pairs.select(F.col("x").alias("id")).union(pairs.select("y"))


def _possible(near: DataFrame, p: Params) -> DataFrame:
    """The pairs (x, y) of near (x, y, a, b: bitmaps of x and y) but for those that their bitmaps rule
    out; they would fail on their full sets, which are many times as large."""
    schema = T.StructType([near.schema["x"], near.schema["y"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = ((np.frombuffer(v.as_buffer(), np.uint64) for v in pair) for pair in zip(batch.column(2), batch.column(3), strict=True))
            keep = [may_link(a, b, p.percent) for a, b in words]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return near.mapInArrow(run, schema)


def _confirm(pairs: DataFrame, sets: DataFrame, p: Params, unique: bool) -> DataFrame:
    """The pairs (x, y), a written table, whose full sets meet the threshold; unique: no two rows of
    sets share an id."""
    both = _meet(pairs, sets if unique else sets.dropDuplicates(["id", "set"]))
    id_type = pairs.schema["x"].dataType
    schema = T.StructType([T.StructField("x", id_type), T.StructField("y", id_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                if len(a) > len(b):
                    a, b = b, a
                if 100 * len(a) < p.percent * len(b):
                    keep.append(False)
                    continue
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                shared = int((b[at] == a).sum())
                keep.append(100 * shared >= p.percent * (len(a) + len(b) - shared))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, schema)


def _least(edges: DataFrame, tag: str) -> DataFrame:
    """(u, m, __n), written: the least v of each u of the edges, and how many edges it has."""
    return stage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")), tag)


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(id, comp) for every id in links (x, y): comp is the smallest id that it reaches.

    Alternates two steps on edges: each node's larger neighbours move to its smallest neighbour,
    then its smaller ones do. Each round is written out. It ends when every node with a smaller
    neighbour has no other one, so that each component is a star about its smallest id; the number
    of rounds grows with the logarithm of the longest path.
    """
    edges = stage(
        links.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), tag
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, tag)
        total, tangled = least.agg(F.sum("__n"), F.count_if((F.col("m") < F.col("u")) & (F.col("__n") > 1))).first()
        if not tangled:
            return least.select(F.col("u").alias("id"), F.least("u", "m").alias("comp"))
        low = hot_join(both, least, "u", total).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stage(low.distinct(), tag)
        small = hot_join(large, _least(large, tag), "u", total // 2).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.filter("u <> v").union(large.groupBy("u").agg(F.min("v").alias("v"))).distinct(), tag)


def _columns(rows: pa.Array, p: Params) -> dict[str, np.ndarray]:
    """A block's rows: id, comp, keys (n x bands) and sketch (n x words); parity, if they have it."""
    f = dict(zip([c.name for c in rows.type], rows.flatten(), strict=True))
    return {
        "id": f["id"].to_numpy(zero_copy_only=False),
        "comp": f["comp"].to_numpy(zero_copy_only=False),
        "parity": f.get("parity"),
        "keys": f["keys"].flatten().to_numpy().reshape(-1, p.bands),
        "sketch": np.stack([f[f"s{i}"].to_numpy() for i in range(p.sketch_words)], 1).view(np.uint64),
    }


def _open_pairs(left: dict, right: dict, key: int | None, same: bool, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks that are still to be confirmed: different components and near
    sketches, and for blocks of the bucket `key` no earlier band that also has them together."""
    differ = np.zeros((len(left["id"]), len(right["id"])), np.uint16)
    for w in range(p.sketch_words):
        differ += np.bitwise_count(left["sketch"][:, w, None] ^ right["sketch"][None, :, w])
    near = (differ <= p.max_xor) & (left["comp"][:, None] != right["comp"][None, :])
    if same:
        near &= np.tri(len(left["id"]), k=-1, dtype=bool)
    i, j = np.nonzero(near)
    if key is None:
        return i, j
    equal = left["keys"][i] == right["keys"][j]
    mine = left["keys"][i, equal.argmax(1)] == key if len(i) else np.zeros(0, bool)
    return i[mine], j[mine]


def _leftovers(buckets: DataFrame, comp: DataFrame, nodes: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(members, work) for what the leaders left open.

    Only buckets with more than one component count. Their members go in blocks of bounded rows
    and shingles (members: key, block, id, comp), and block meets block. work: pairs (x, y) that
    bitmaps leave where two blocks have few open ones, else one row (key, a, b): a crowded block pair,
    whose open pairs are confirmed side by side and never become rows.
    """
    words = [f"s{i}" for i in range(p.sketch_words)]
    known = buckets.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = (
        known.groupBy("key")
        .agg(F.count("*").alias("size"), F.sum("n").alias("bulk"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .filter("lo <> hi")
        .select("key", F.col("size").alias("__n"), F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("bulk") / F.lit(BLOCK_SHINGLES))).alias("parts"))
    )
    placed = stage(
        hot_join(known, stage(mixed, "neardup-mixed"), "key", buckets.count()).select("key", "parts", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("block"), "id", "comp"),
        "neardup-members",
    )
    wide = placed.join(likely(nodes.select("id", "parity", "keys", *words), "id", placed, "id"), "id")
    blocks = wide.groupBy("key", "parts", "block").agg(F.collect_list(F.struct("id", "comp", "parity", "keys", *words)).alias("rows"))
    blocks = stage(blocks, "neardup-blocks")
    # a block meets itself where it lies; only those of larger buckets are shuffled to others
    own = blocks.select("key", F.col("block").alias("a"), F.col("block").alias("b"), F.col("rows").alias("left"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("right"))
    a, b = (blocks.filter("parts > 1").alias(side) for side in "ab")
    other = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") < F.col("b.block"))).select(
        "a.key", F.col("a.block").alias("a"), F.col("b.block").alias("b"), F.col("a.rows").alias("left"), F.col("b.rows").alias("right")
    )
    meet = own.union(other)
    id_type = nodes.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("x", id_type), T.StructField("y", id_type), T.StructField("key", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, dense = [], [], []
            for key, at, bt, left, right in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4), strict=True):
                m = _columns(left.values, p)
                o = m if at == bt else _columns(right.values, p)
                i, j = _open_pairs(m, o, key, at == bt, p)
                if len(i) > 2 * (len(m["id"]) + len(o["id"])):
                    dense.append((key, at, bt))
                else:
                    may = np.array([may_link(np.frombuffer(m["parity"][u].as_buffer(), np.uint64), np.frombuffer(o["parity"][v].as_buffer(), np.uint64), p.percent) for u, v in zip(i.tolist(), j.tolist(), strict=True)], bool)
                    i, j = i[may], j[may]
                    xs.append(np.maximum(m["id"][i], o["id"][j]))
                    ys.append(np.minimum(m["id"][i], o["id"][j]))
            n = sum(map(len, xs))
            pairs = [pa.array(np.concatenate(v) if v else [], batch.column(3).type.value_type.field("id").type) for v in (xs, ys)]
            if n:
                yield pa.RecordBatch.from_arrays([*pairs, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names=schema.names)
            if dense:
                k = len(dense)
                cols = [pa.array(c, t) for c, t in zip(zip(*dense, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pairs[0].type), pa.nulls(k, pairs[0].type), *cols], names=schema.names)

    return placed.select("key", "block", "id", "comp"), stage(meet.mapInArrow(run, schema), "neardup-work")


def _links_of_pair(left: dict, right: dict, sets: tuple[list[np.ndarray], list[np.ndarray]], i: np.ndarray, j: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Links among the open pairs that connect what is not connected yet: a row's open partners
    are intersected at once, and partners that a link has joined to it meanwhile are passed over."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
    for at, end in zip(starts, [*starts[1:], len(i)], strict=True):
        x = int(i[at])
        mine = sets[0][x]
        own = root(int(left["comp"][x]))
        some = [int(k) for k in j[at:end] if root(int(right["comp"][k])) != own]
        some = [k for k in some if 100 * min(len(mine), len(sets[1][k])) >= p.percent * max(len(mine), len(sets[1][k]))]
        if not some:
            continue
        lengths = np.array([len(sets[1][k]) for k in some])
        every = np.concatenate([sets[1][k] for k in some])
        found = np.searchsorted(mine, every)
        found[found == len(mine)] = 0
        shared = np.add.reduceat((mine[found] == every).astype(np.int64), np.cumsum(lengths) - lengths)
        for k in np.flatnonzero(100 * shared >= p.percent * (len(mine) + lengths - shared)):
            c, d = root(int(left["comp"][x])), root(int(right["comp"][some[k]]))
            if c != d:
                parent[max(c, d)] = min(c, d)
                out.append((int(left["id"][x]), int(right["id"][some[k]])))
    return out


def _families(members: DataFrame, dense: DataFrame, nodes: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(members, pairs of blocks) of the crowded buckets, joined to families where they share
    documents: the same near copies crowd together in many bands, and a family holds each once."""
    words = [f"s{i}" for i in range(p.sketch_words)]
    crowd = members.join(dense.select("key", F.col("a").alias("block")).union(dense.select("key", "b")).distinct(), ["key", "block"]).select("key", "id", "comp")
    crowd = stage(crowd, "neardup-crowd")
    first = stage(crowd.groupBy("key").agg(F.min("id").alias("y"), F.count("*").alias("__n")), "neardup-crowd")
    family = components(hot_join(crowd, first, "key", crowd.count()).select(F.col("id").alias("x"), "y"), "neardup-families")
    known = family.select("id", F.col("comp").alias("key")).join(crowd.select("id", "comp").distinct(), "id").join(likely(nodes, "id", crowd, "id"), "id")
    parts = known.groupBy("key").agg(
        F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("parts")
    )
    placed = known.join(parts, "key").select("key", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("block"), "id", "comp", "keys", *words)
    pairs = parts.select("key", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("a")).select("key", "a", F.explode(F.sequence("a", F.col("parts") - 1)).alias("b"))
    return stage(placed, "neardup-placed"), pairs


def _confirm_blocks(members: DataFrame, pairs: DataFrame, sets: DataFrame, p: Params, unique: bool) -> DataFrame:
    """Links (x, y) of the block pairs (key, a, b), confirmed on full sets."""
    words = [f"s{i}" for i in range(p.sketch_words)]
    rows = members.join(sets if unique else sets.dropDuplicates(["id"]), "id")
    blocks = stage(rows.groupBy("key", "block").agg(F.collect_list(F.struct("id", "comp", "keys", *words, "set")).alias("rows")), "neardup-families")
    meet = pairs.join(blocks.select("key", F.col("block").alias("a"), F.col("rows").alias("left")), ["key", "a"]).join(
        blocks.select("key", F.col("block").alias("b"), F.col("rows").alias("right")), ["key", "b"]
    )
    id_type = members.schema["id"].dataType
    schema = T.StructType([T.StructField("x", id_type), T.StructField("y", id_type)])

    def held(rows: pa.Array) -> list[np.ndarray]:
        return [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.flatten()[rows.type.get_field_index("set")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, bt, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                m, o = _columns(left.values, p), _columns(right.values, p)
                i, j = _open_pairs(m, o, None, at == bt, p)
                links = _links_of_pair(m, o, (held(left.values), held(right.values)), i, j, p)
                if links:
                    kind = left.values.type.field("id").type
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*links, strict=True)], names=["x", "y"])

    return meet.select("a", "b", "left", "right").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params | None = None) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (smallest id reachable over links)
    and kept (id = component_id).

    Words are lower-cased (A-Z) runs of [^\\x20\\x09-\\x0D]; a text of fewer words than a shingle
    has is one shingle; a text without words, or a null one, has none and links with nothing. Rows
    with equal sets are linked. Rows that share an id are one node, so what links to one links to
    all. A null id is no node: its component is null and it is kept. Other ids
    than integers raise TypeError. Other columns are not read. Sets are compared by 64-bit hashes of their shingles.
    """
    p = params or Params()
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"near_duplicates needs integer ids, not {docs.schema[id_col].dataType.simpleString()}")
    small_batches(docs.sparkSession)
    words = [f"s{i}" for i in range(p.sketch_words)]
    rows = stage(_profile(docs, id_col, text_col, p), "neardup-profile")
    sets = rows.filter("n > 0 and id is not null")
    nodes = stage(
        sets.groupBy("n", "h0", "h1").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("parity", "keys", *words)]),
        "neardup-nodes",
    )
    same = nodes.select("n", "h0", "h1", F.col("id").alias("rep"))
    # copies follow their node; only an id that stands for several sets links those sets' nodes
    several = sets.groupBy("id").agg(F.min("h0").alias("lo"), F.max("h0").alias("hi")).filter("lo <> hi").select("id")
    unique = sets.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    shared = sets.join(several, "id").join(same, ["n", "h0", "h1"]).select(F.col("id").alias("x"), F.col("rep").alias("y"))
    keyed = nodes.select(F.explode("keys").alias("key"), "id", "n")
    leaders = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("__n")).filter("__n > 1")
    leaders = stage(leaders, "neardup-leaders")
    buckets = stage(hot_join(likely(keyed, "key", leaders, "key"), leaders, "key", p.bands * nodes.count()), "neardup-buckets")
    stars = stage(buckets.filter("id <> lead").select(F.col("id").alias("x"), F.col("lead").alias("y")).distinct(), "neardup-stars")
    lead = stars.groupBy("y").agg(F.count("*").alias("__n"))
    lead = stage(lead.join(nodes.select(F.col("id").alias("y"), F.struct("parity", *words).alias("b")), "y"), "neardup-leads")
    side = nodes.select(F.col("id").alias("x"), F.struct("parity", *words).alias("a"))
    first = hot_join(stars.join(side, "x"), lead, "y", stars.count()).filter(_near("a", "b", p)).select("x", "y", F.col("a.parity").alias("a"), F.col("b.parity").alias("b"))
    first = stage(_possible(first, p), "neardup-pairs")
    links = stage(_confirm(first, _sets_of(docs, _ends(first), id_col, text_col, p), p, unique), "neardup-links")
    comp = components(links)
    members, work = _leftovers(buckets.select("key", "id", "n"), comp, nodes, p)
    rest, dense = work.filter("x is not null").select("x", "y"), work.filter("x is null").select("key", "a", "b")
    if dense.isEmpty():
        more = _confirm(rest, _sets_of(docs, _ends(rest), id_col, text_col, p), p, unique)
    else:
        placed, pairs = _families(members, dense, nodes, p)
        full = _sets_of(docs, _ends(rest).union(placed.select("id")), id_col, text_col, p)
        more = _confirm(rest, full, p, unique).union(_confirm_blocks(placed, pairs, full, p, unique))
    # what is linked already goes in as stars, which need no further round
    final = components(comp.select("id", "comp").withColumnsRenamed({"id": "x", "comp": "y"}).union(more).union(shared))
    own = ["n", "h0", "h1"]
    placed = same.join(final, F.col("rep") == F.col("id"), "left").select(*[F.col(c).alias("__" + c) for c in own], F.coalesce("comp", "rep").alias("comp"))
    whole = (F.col("n") > 0) & F.col("id").isNotNull()
    for c in own:
        whole = whole & (F.col(c) == F.col("__" + c))
    done = rows.join(placed, whole, "left")
    comp_id = F.coalesce("comp", "id")
    return done.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        comp_id.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == comp_id)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params | None = None) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns: that with the smallest id.

    A row whose id is null comes after all others. Rows are nodes of their own, so rows that share an
    id and no text both stay, and of equal rows one does. A text without words stays.
    """
    rows = numbered(docs, "neardup-rows")
    ids = rows.select("__row", F.col("row")[id_col].alias("__id"))
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")).alias("first")
    with passing(docs.sparkSession) as made:
        found = near_duplicates(rows.select("__row", F.col("row")[text_col].alias("__text")), "__row", "__text", params)
        kept = stage(found.join(ids, "__row").groupBy("component_id").agg(first).select("first.__row"), "neardup-kept")
        made.pop()  # of all these tables only the last is read on
    return among(rows, "__row", kept, "__kept").filter("__kept").select("row.*")
