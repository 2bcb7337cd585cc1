"""The operators that lay training data out: whitening, fill-in-the-middle, token files."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeframe.llm import bidiagonal, fim, huffman, pieces, tokenfiles, whitening

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def columns(rng):
    """Matrices with far, equal, tiny and missing singular values."""
    turn, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    for size in ((300, 24), (7, 24), (1, 4), (50, 1), (40, 2), (3, 5)):
        yield rng.normal(size=size)
    for values in (np.r_[np.full(10, 5.0), np.ones(14)], np.geomspace(1, 1e-14, 24), np.r_[1, 1 - 1e-10, 1 - 2e-10, np.full(21, 0.3)], np.r_[2, 1, 1, 1, np.zeros(20)]):
        yield np.diag(values) @ turn.T
    yield from (np.zeros((5, 6)), np.eye(8), np.ones((9, 7)), np.diag([3.0, 3, 3, 3, 3, 1, 1]))


def test_bidiagonal_solver():
    for m in columns(np.random.default_rng(0)):
        d = m.shape[1]
        r = np.linalg.qr(np.vstack([m, np.zeros((d, d))]), mode="r")
        a, b, v = bidiagonal.bidiagonalise(r)
        true = np.linalg.svd(m, compute_uv=False)
        true = np.append(true, np.zeros(d - len(true)))
        assert np.abs(np.sqrt(bidiagonal.singular_squares(a, b)) - true).max() <= 1e-12 * max(true[0], 1)
        squares, directions, total = bidiagonal.leading(r, 4)
        k = min(4, d)
        assert np.abs(directions.T @ directions - np.eye(k)).max() < 1e-12
        assert np.abs(m.T @ (m @ directions) - directions * squares).max() <= 1e-11 * max(true[0] ** 2, 1)
        assert abs(total - (true**2).sum()) <= 1e-12 * max((true**2).sum(), 1)


def brute_whitening(rows):
    """{(id, deviation): {component: |whitened|}} and shares, by an eigendecomposition."""
    rows = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in rows}), object)
    n, sums = len(fit), fit.sum(0)
    cov = np.cov(fit.T.astype(float), bias=True).reshape(len(sums), len(sums))
    w, u = np.linalg.eigh(cov)
    w, u = w[::-1], u[:, ::-1]
    out = {}
    for i, x in rows:
        gap = n * np.array(x, object) - sums
        y = (np.array(x, float) - sums.astype(float) / n) @ u / np.sqrt(np.maximum(w, 1e-300))
        out[i, int((gap * gap).sum())] = {k + 1: abs(y[k]) if w[k] > 1e-9 * w[0] else None for k in range(min(4, len(w)))}
    return n, out, w / max(w.sum(), 1e-300), len(rows)


def hold_whitening(df):
    n, want, share, count = brute_whitening([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()])
    got = whitening.whiten(df).collect()
    assert len(got) == count * min(4, len(share)) and {r.n for r in got} == {n}
    assert {(r.vec_id, r.deviation) for r in got} == set(want)
    for r in got:
        y = want[r.vec_id, r.deviation][r.component]
        assert (r.whitened is None) == (y is None) and (y is None or abs(abs(r.whitened) - y) < 1e-6)
        assert abs(r.explained - share[r.component - 1]) < 1e-9 and (r.identity_error is None or r.identity_error < 1e-9)


def test_whitening(spark):
    hold_whitening(spark.read.parquet(f"{SF}/embeddings.parquet"))


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<double>, n int, x string, component int"
    make = lambda rows: spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], kind)
    odd = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 5.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.5, -0.5]), (7, [])]
    hold_whitening(make(odd))
    assert whitening.whiten(make([(8, [1.0]), *odd])).filter("vec_id = 8").count() == 0  # another dimension
    hold_whitening(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]))  # one distinct vector: no variance
    hold_whitening(make([(i, [float(i)]) for i in range(9)]))
    assert whitening.whiten(make([])).count() == whitening.whiten(make([(1, None)])).count() == 0
    far = whitening.whiten(make([(i, [1e12 * i, float(i % 3)]) for i in range(9)])).collect()
    assert len(far) == 18 and any(r.deviation is None for r in far)  # beyond 64 bits


def test_whitening_in_many_parts(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(40)
    x = whitening.quantised(df).select("x").repartition(40)
    n, _, share, _ = brute_whitening([(r.vec_id, r.embedding) for r in df.collect()])
    model = whitening.fit_whitening(x)
    assert model.n == n and np.abs(model.explained - share[:4]).max() < 1e-10 and model.identity_error < 1e-9


TEXTS = [
    (1, None), (2, ""), (3, "a"), (4, "\n"), (5, "\n\n\n"), (6, "a\nb\r\nc d\x85e\x0bf\n$1 \\1 \n"), (7, "x<P>y\nz"), (8, "line\n" * 100_000), (None, "null id\nhere\n"), (9, "é\U0001f600\n😀b\n"),
    (10, "z" * 1_000_000), (11, "ends <\n<P\n> <S\nM>\n<\n"), (11, "ends <\n<P\n> <S\nM>\n<\n"), (12, "$3 ${x} \\\n$1\n"), (13, "\r\n\r\n"), (14, "x <|endoftext|> y"), (15, " lead\ttab  two "), (3, "b"),
]


@pytest.fixture(scope="module")
def odd_texts(spark):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in TEXTS], "doc_id long, text string, form string, n int, output int")


def brute_fim(i, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    draw = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((draw[0] % (len(lines) + 1), draw[1] % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (i, len(lines), "plain", text, None, None)
    spm = draw[3] % 100 < 50
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (i, len(lines), "spm" if spm else "psm", out, len(prefix), len(middle))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_fill_in_middle(spark, odd_texts, which):
    df = odd_texts if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = fim.fill_in_middle(df).withColumn("back", fim.restore(F.col("form"), F.col("output"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr(brute_fim(*r)) for r in rows)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)


def test_fill_in_middle_rates(spark, odd_texts):
    forms = lambda **o: {r.form for r in fim.fill_in_middle(odd_texts.filter("doc_id between 8 and 13"), **o).collect()}
    assert forms(rate=0) == {"plain"} and forms(spm_rate=100) == {"spm"} and forms(spm_rate=0) == {"psm"}
    assert fim.fill_in_middle(odd_texts.filter("doc_id < 0")).count() == 0


def test_ids_are_the_library_s():
    encode, library, rng = pieces.TokenIds(TOKENIZER), Tokenizer.from_file(TOKENIZER), random.Random(1)
    some = ["a", "B", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "23", "<|endoftext|>", "<|", "...", "ß", "\xa0", " ", "中", "\x1c", "é", "ing", "the", "'ll", "\r", "_", "😀", "\x00"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    for a in range(0, len(texts), 500):
        want = [e.ids for e in library.encode_batch_fast(texts[a : a + 500], add_special_tokens=False)]
        assert [x.tolist() for x in encode(pa.array(texts[a : a + 500]))] == want
        assert [x.tolist() for x in encode(pa.array(texts[a : a + 500]), 2)] == [[*w, 2] for w in want]
    long = "odd  words and " * 20_000  # to the library in parts
    assert encode(pa.array([long]))[0].tolist() == library.encode(long, add_special_tokens=False).ids
    small = pieces.TokenIds(TOKENIZER, cache_words=3)
    assert [small(pa.array([t]))[0].tolist() for t in texts[:300]] == [library.encode(t, add_special_tokens=False).ids for t in texts[:300]]
    other = public_tokenizers.path("word_bpe_49k.json")  # of another kind: whole texts
    assert pieces.TokenIds(other)(pa.array(["Some words, here"]))[0].tolist() == Tokenizer.from_file(other).encode("Some words, here", add_special_tokens=False).ids


def test_plain_words_need_no_text_of_their_own():
    """New words of ASCII letters are looked up by the library's model, without a text around them."""
    encode, library = pieces.TokenIds(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    asked, through = [], encode._library
    encode._library = lambda texts: asked.extend(texts) or through(texts)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeinorstABEhwy", k=rng.randrange(1, 15))) for _ in range(3000)]
    texts = ["a " + " ".join(words), "a " + ", ".join(words[:400]), "a\n" + " \u00fcber ".join(words[:50]), " ".join(words[::-1])]
    got = encode(pa.array(texts), 2)
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert asked and sum(map(len, asked)) < 100


def test_code_lengths_are_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 8))
        limit = int(rng.integers(max(1, int(np.ceil(np.log2(n)))), 6))
        counts = rng.integers(1, 10 ** int(rng.integers(1, 5)), n)
        length = huffman.code_lengths(counts, limit)
        fits = [ls for ls in itertools.combinations_with_replacement(range(1, limit + 1), n) if sum(2.0**-x for x in ls) <= 1]
        best = min(sum(a * b for a, b in zip(sorted(counts, reverse=True), ls, strict=True)) for ls in fits)
        assert (counts * length).sum() == best and (2.0**-length).sum() <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, np.int64), 2)


def test_blocks_and_checkpoints():
    rng = np.random.default_rng(3)
    counts = (1e6 / np.arange(1, 3001) ** 1.2).astype(np.int64) + 1
    length = huffman.code_lengths(counts, 14)
    code = huffman.Code.of(length, int(length.max()))
    ids = rng.choice(3000, 50_000, p=counts / counts.sum())
    for n in (0, 1, 2, 127, 128, 129, 50_000):
        for every in (1, 7, 128):
            assert (code.read(code.write(ids[:n], every)) == ids[:n]).all()
    block = code.write(ids, 128)
    for _ in range(40):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (code.read(block, a, b) == ids[a:b]).all()
    one = huffman.Code.of(huffman.code_lengths(np.array([0, 0, 5]), 18), 1)
    assert one.read(one.write(np.array([2, 2, 2]), 2)).tolist() == [2, 2, 2]
    raw = rng.bytes(1000)
    assert all(huffman.crc_join(zlib.crc32(raw[:k]), zlib.crc32(raw[k:]), 1000 - k) == zlib.crc32(raw) for k in (0, 1, 500, 1000))


@pytest.mark.parametrize("options", [{}, {"block_ids": 1000, "every": 7, "part_bytes": 20_000, "max_bits": 12}])
@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_token_files(spark, odd_texts, which, options):
    df = odd_texts.filter("doc_id is null or doc_id <> 10") if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet") if which == "documents" else odd_texts.filter("doc_id < 0")
    library, want, start = Tokenizer.from_file(TOKENIZER), [], 0
    for r in df.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id is not None, r.doc_id or 0, zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    archive = tokenfiles.write_token_files(df, TOKENIZER, **options)
    pieces_of = defaultdict(list)
    for r in tokenfiles.read_documents(spark, archive, with_ids=True).collect():
        pieces_of[r.start] = r["ids"]
    expected = []
    for known, i, crc, ids in sorted(want):
        expected.append((i if known else None, start, len(ids), crc))
        start += len(ids)
    assert sorted(map(tuple, tokenfiles.read_documents(spark, archive).collect()), key=lambda r: r[1]) == expected
    assert [x for k in sorted(pieces_of) for x in pieces_of[k]] == [x for w in sorted(want) for x in w[3]]
