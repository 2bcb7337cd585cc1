"""The llm operators against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import pathlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import common, decontaminate, maxent, mixing, neardup, quality, rules, tokens, toxicity, urlfilter, warc

SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, "a"), (4, " \t\n"), (5, "A b a B"), (5, "A b a B"), (None, "x y z w"), (7, "word " * 30_000), (8, "é ü\u2003ß <|endoftext|> ★ e\u0301.")]


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, None, "s1", "clash", 1) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens string, score int")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_token_counts(which, request):
    import public_tokenizers
    from tokenizers import Tokenizer

    df, path = request.getfixturevalue(which), public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = sorted((i is None, i or 0, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in texts_of(df))
    got = tokens.count_tokens(df, path).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(docs):
    want = brute_groups(texts_of(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicates_of_a_crowd(spark):
    """A family of near copies at all distances, whose open pairs are confirmed in blocks."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(120)] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()} == want


def test_near_duplicates_shuffle_sets_twice(spark):
    """A set goes to its id and to its pair, where no join is a broadcast; rows of one id go their own way to the same groups."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda k: F.xxhash64(F.floor(F.col("doc_id") / 2), k).cast("string")))
    df = spark.range(120).withColumnRenamed("id", "doc_id").select("doc_id", F.concat_ws(" ", words, (F.col("doc_id") % 2).cast("string")).alias("text"))
    was, sc = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.sparkContext
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc.setJobGroup("near", "near")
    try:
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
        jobs = sc.statusTracker().getJobIdsForGroup("near")
        stages = {i for j in jobs for i in sc.statusTracker().getJobInfo(j).stageIds}
        sent = sum(sc._jsc.sc().statusStore().lastStageAttempt(i).shuffleWriteBytes() for i in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {i: i // 2 * 2 for i in range(120)}
    sets = 120 * 1999 * 8
    assert 1.5 * sets < sent < 2.75 * sets
    again = neardup.near_duplicates(df.union(df.filter("doc_id < 60")).union(spark.createDataFrame([(1, "one more text")], "doc_id long, text string")))
    assert {r.doc_id: r.component_id for r in again.collect()} == got


def test_bitmaps_rule_out_no_link():
    """Bitmaps never rule out a pair that links on its sets, of whatever sizes, and most that are far from it."""
    rng = np.random.default_rng(5)
    sets = []
    for n in [1, 2, 31, 33, 700, 710, 1000, 5000, 70_000]:
        whole = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
        sets += [np.unique(np.concatenate([whole[: n - round(n * cut)], rng.integers(0, 1 << 64, round(n * new), np.uint64)])) for cut in (0, 0.03, 0.08, 0.15, 0.3) for new in (0, 0.07, 0.2) if round(n * cut) < n]
    words = [np.frombuffer(b, np.uint64) for b in neardup.parities(np.concatenate(sets), np.array([len(s) for s in sets]))]
    far = out = 0
    for a, x in zip(sets, words, strict=True):
        for b, y in zip(sets, words, strict=True):
            both = len(np.intersect1d(a, b))
            either, may = len(a) + len(b) - both, neardup.may_link(x, y, 85)
            assert may or 100 * both < 85 * either
            far, out = far + (100 * both < 75 * either), out + (100 * both < 75 * either and not may)
    assert out > 0.9 * far > 1000
    assert neardup.parities(np.empty(0, np.uint64), np.array([0, 0])) == [bytes(16)] * 2


def test_near_duplicates_move_no_sets_of_far_pairs(spark):
    """Chains of copies that share most bands but not enough shingles: their bitmaps go to the pairs, their sets stay."""
    def text(i: int, j: int) -> str:
        return " ".join(f"n{i}x{j}x{k}" if (k + 17 * j) % 58 == 0 else f"w{i}x{k}" for k in range(3000))

    rows = [(10 * i + j, text(i, j)) for i in range(12) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, was = [], neardup._sets_of
    neardup._sets_of = lambda docs, ids, *a: (lambda got: (seen.append((ids.distinct().count(), got.count())), got)[1])(was(docs, ids, *a))
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    finally:
        neardup._sets_of = was
    assert got == brute_groups(rows)
    assert all(i == c for i, (_, c) in got.items())
    assert sum(n for n, _ in seen) == 0


def shuffled(spark, run):
    """(what run() returns, bytes shuffled meanwhile), where no join is a broadcast unless it asks for it."""
    was, sc = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.sparkContext
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    group = f"shuffled-{id(run)}"
    sc.setJobGroup(group, group)
    try:
        got = run()
        stages = {i for j in sc.statusTracker().getJobIdsForGroup(group) for i in sc.statusTracker().getJobInfo(j).stageIds}
        return got, sum(sc._jsc.sc().statusStore().lastStageAttempt(i).shuffleWriteBytes() for i in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def long_texts(spark, n, words):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda k: F.xxhash64("id", k).cast("string")))
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"))


def test_dropping_near_duplicates_moves_no_texts(spark):
    """What stays is picked where it lies, and no table but those that are read on is left behind."""
    df = common.stage(long_texts(spark, 300, 1000), "test")
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir())
    got, sent = shuffled(spark, lambda: neardup.drop_near_duplicates(df.union(df.filter("doc_id < 20"))).collect())
    assert sorted(r.doc_id for r in got) == list(range(300))
    assert sent < 0.25 * sum(len(r.text) for r in got)
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before) == ["lodeframe-neardup-kept", "lodeframe-neardup-rows"]


@pytest.mark.parametrize("bits", [1, 8, 1 << 18])
def test_among(spark, bits, monkeypatch):
    """Exact whether the bitmaps settle no row, some or all."""
    monkeypatch.setattr(common, "ID_WORDS", bits)
    many = common.stage(spark.range(2000).select(F.shiftleft("id", 33).alias("k"), F.col("id").alias("v")), "test")
    for chosen in ("v % 7 < 3", "v < 0", "v >= 0", "v = 5"):
        ids = common.stage(many.filter(chosen).select("k"), "test")
        got = common.among(many, "k", ids, "has")
        assert got.columns == ["k", "v", "has"]
        assert sorted(got.collect()) == sorted(many.withColumn("has", F.expr(chosen)).collect())


def test_near_duplicates_edges(edge):
    got = neardup.near_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[4].n_shingles == 0 and by[3].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(edge.filter("doc_id < 0")).count() == 0


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = collections.defaultdict(set)
    for r in bench.collect():
        w = word.findall(low(r.text))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(str(r.item_id))
    want = {}
    for i, t in texts_of(docs):
        w, hit, items = word.findall(low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    items |= found
        want[i] = (len(w), len(hit), sorted(items))
    for options in ({}, {"block_bytes": 4000}, {"shard_bytes": 5000}):
        got = decontaminate.contamination(docs, bench, **options).collect()
        assert {r.doc_id: (r.n_words, sum(r.ends) - sum(r.begins), list(r["items"])) for r in got} == want
    for options in ({}, {"block_bytes": 4000}):
        clean = decontaminate.decontaminate(docs, bench, **options)
        assert {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[1]} and clean.columns == docs.columns
    assert decontaminate.longest_matches(docs, bench).agg(F.max("n_match")).first()[0] >= 10


def test_suffix_array_of_a_small_shard():
    """Word ids far above the shard's length keep the order of the suffixes."""
    import numpy as np

    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 4000), (50, 4000), (300, 4000), (300, 3)):
        words = np.concatenate([rng.integers(0, top + 1, n), np.zeros(10, np.int64)]).astype(np.int32)
        sa = decontaminate.suffix_array(words, 10).tolist()
        assert sorted(sa) == np.flatnonzero(words).tolist()
        # a word of 0 matches nothing, so only the words before it have an order
        begins = [words[i : i + 10].tolist() for i in sa]
        begins = [b[: b.index(0)] if 0 in b else b for b in begins]
        assert begins == sorted(begins)


def test_decontamination_of_one_document_shards(spark):
    """One-document shards against a benchmark of thousands of different words miss no passage."""
    import random

    rng = random.Random(5)
    items = [(k, " ".join(f"w{rng.randrange(4000)}" for _ in range(200))) for k in range(40)]
    rows, want = [], {}
    for i in range(60):
        item = items[rng.randrange(40)][1].split()
        at, n = rng.randrange(150), rng.choice([9, 10, 25])
        filler = [f"w{rng.randrange(4000)}" for _ in range(30)]
        rows.append((i, " ".join(filler[:15] + item[at : at + n] + filler[15:])))
        want[i] = n if n >= 10 else 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({"shard_bytes": 1}, {}):
        got = decontaminate.contamination(df, bench, **options).collect()
        assert {r.doc_id: sum(r.ends) - sum(r.begins) for r in got} == want


def test_longest_matches(spark):
    """Per document and per word of an item, against brute force: copies whose middle one in sorted
    order goes on longest, different items' windows side by side, and a tail of an item."""
    import random

    rng = random.Random(8)
    new = iter(range(10**6))
    fresh = lambda n: [f"n{next(new)}" for _ in range(n)]
    items = {str(k): fresh(60) for k in range(4)} | {"4": fresh(4), "5": []}
    items |= {"6": items["0"], "7": ["a"] * 14}
    rows = []
    for n in (16, 17, 50, 18, 16, 20, 10, 9, 3, 1):  # all share the first words; what follows sorts around the longest
        rows.append(fresh(3) + items["0"][5 : 5 + n] + [rng.choice(items["3"])] + fresh(2))
    rows.append(items["1"][:12] + items["2"][20:33] + items["4"] + items["3"][-7:])
    rows += [items["1"][50:] + items["1"][:25], ["a"] * 12 + ["b"] + ["a"] * 30, fresh(30), []]
    for _ in range(20):
        item = items[str(rng.randrange(4))]
        at = rng.randrange(60)
        rows.append(fresh(5) + item[at : at + rng.randrange(40)] + fresh(5))

    def common(x, y):
        return next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))

    by_doc, by_word = {}, collections.Counter()
    for i, w in enumerate(rows):
        best = (0, 0, "", 0)
        for name, it in items.items():
            for t in range(len(it)):
                for p in range(len(w)):
                    if w[p] == it[t]:
                        n = common(w[p:], it[t:])
                        by_word[name, t] = max(by_word[name, t], n)
                        if n >= min(10, len(it)):
                            best = min(best, (-n, p, name, t))
        by_doc[i] = (-best[0], *best[1:]) if best[0] else (0, None, None, None)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(int(k), " ".join(w)) for k, w in items.items()], "item_id long, text string").coalesce(1)
    for options in ({}, {"shard_bytes": 1}, {"block_bytes": 300}):
        got = decontaminate.contamination(df.coalesce(1), bench, **options).collect()
        assert {r.doc_id: (r.longest, r.longest_word, r.longest_item, r.longest_item_word) for r in got} == by_doc
        got = decontaminate.longest_matches(df.coalesce(1), bench, **options).collect()
        assert {(r["item"], r.item_word): r.n_match for r in got} == {k: n for k, n in by_word.items() if n}
        for r in got:
            assert rows[r.doc][r.doc_word : r.doc_word + r.n_match] == items[r["item"]][r.item_word : r.item_word + r.n_match]


def test_benchmark_blocks_go_one_at_a_time(spark, docs, monkeypatch):
    """After the first two blocks, which tell one from several, each is written before the next is read."""
    seen, blocks, stage = [], decontaminate._blocks, decontaminate.stage

    def read(*args):
        for block in blocks(*args):
            seen.append("read")
            yield block

    def written(df, tag):
        if tag.endswith("-block"):
            seen.append("written")
        return stage(df, tag)

    monkeypatch.setattr(decontaminate, "_blocks", read)
    monkeypatch.setattr(decontaminate, "stage", written)
    bench = spark.createDataFrame([(k, f"a{k} b c d") for k in range(5)], "item_id long, text string")
    few = docs.limit(5)
    for find in (decontaminate.contamination, decontaminate.longest_matches):
        seen.clear()
        find(few, bench, block_bytes=1)
        assert seen == ["read", "read", "written", "written", *["read", "written"] * 3]


def test_decontamination_edges(edge, spark):
    bench = spark.createDataFrame([(1, "a b a b"), (2, None), (3, ""), (None, "x y")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(edge, bench).collect()}
    assert len(got[5].begins) == 1 and list(got[5]["items"]) == ["1"] and not got[None].begins and got[7].n_words == 30_000


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in texts_of(docs)}
    assert {r.doc_id: r["size"] for r in got} == size
    by = collections.defaultdict(list)
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        assert r.taken % max(r["size"], 1) == 0 and 0 <= r.taken <= 2 * r["size"]
        by[source[r.doc_id]].append(r)
    total = sum(size.values())
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(1.5 * total)
    for rows in by.values():
        base = min(int(rows[0].target // rows[0].source_size), 2)
        budget, sums = round(rows[0].target) - base * rows[0].source_size, {0}
        if base < 2:
            for r in rows:
                sums |= {s + r["size"] for s in sums if s + r["size"] <= budget}
        assert sum(r.taken for r in rows) == base * rows[0].source_size + max(sums)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))


def test_mixing_of_equal_ids(spark):
    """Rows that share id and length are told apart by their texts, in every run alike."""
    rows = [(1, f"t{k} x", "a" if k % 2 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted((r.row.text, r.taken) for r in mixing.mix(df.repartition(n), carry=True).collect()) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 40


def test_mixing_moves_no_texts(spark):
    """Whole rows are handed on where they lie, with the figures that they have without `carry`."""
    df = common.stage(long_texts(spark, 300, 1000), "test")
    got, sent = shuffled(spark, lambda: mixing.mix(df, share=1.7, carry=True).collect())
    assert sent < 0.25 * sum(len(r.row.text) for r in got)
    assert len({(r.row.source, r.taken) for r in got}) == 3  # one source is capped, of the other some rows are taken twice
    want = mixing.mix(df, share=1.7).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == sorted(map(tuple, want))


def test_mixing_edges(edge):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE) and all(r.source_size == 30_018 for r in got)
    assert mixing.mix(edge.filter("doc_id < 0")).count() == 0


def test_knapsack_is_exact():
    import numpy as np

    take = mixing.knapsack(np.array([5, 7, 11]), np.array([3, 2, 4]), 43)
    assert (take <= [3, 2, 4]).all() and (take * [5, 7, 11]).sum() == 43


@pytest.mark.parametrize(("reserve", "odd"), [(10**6, True), (5_000, True), (5_000, False)])
def test_fit_lengths_of_many_lengths(reserve, odd):
    """Over a thousand lengths, within the reserve and beyond it: the budget is met exactly, or by the
    nearest even sum where all lengths are even."""
    import numpy as np

    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(1, 20_000, 3000)) * (1 if odd else 2)
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (0, 1, 777, total // 3 | 1, total // 2 | 1, total - 1, total):
        take = mixing.fit_lengths(lengths, counts, budget, reserve)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * lengths).sum())
        want = budget if odd or budget == total else budget - budget % 2
        if budget == total - 1:  # the least that can be left out is one shortest document
            want = total - int(lengths[0])
        assert got <= want and want - got <= (0 if budget > 20_000 else lengths[0])


def test_quality_rules(docs, labels, edge):
    got = {r.doc_id: r for r in rules.quality_rules(docs, labels).collect()}
    for i, t in texts_of(docs):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + o for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for o in range(3)}
        r = got[i]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert rules.quality_rules(edge, labels).count() == len(EDGE)
    assert rules.quality_rules(edge.filter("doc_id < 0"), labels.filter("doc_id < 0")).count() == 0


def test_quality_rules_learn_from_every_label(spark):
    """Over 20,000 trusted and over 20,000 held-out rows, each with a word of its own."""
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{m}_"), F.pmod(F.col("doc_id"), F.lit(m)).cast("string")) for m in range(3, 52)], F.concat(F.lit("u"), F.col("doc_id").cast("string")))
    df = spark.range(50_000).withColumnRenamed("id", "doc_id").withColumn("text", words)
    marks = df.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality"))
    got = rules.quality_rules(df, marks, folds=2).toPandas().sort_values("doc_id", ignore_index=True)
    texts = [t.encode() for _, t in sorted(texts_of(df))]
    one, two, _, count, _ = rules.hashed_ngrams(texts)
    held = np.array([zlib.crc32(str(i).encode()) % 2 == 0 for i in range(50_000)])
    good = np.arange(50_000) % 10 > 0
    assert (good & ~held).sum() > 20_000 and held.sum() > 20_000
    mine = np.repeat(good & ~held, count)
    raw, target = (np.bincount(np.append(one[m], two[m & (two >= 0)]), minlength=rules.BUCKETS) for m in (np.ones_like(mine), mine))
    ratio = np.append(rules.log_ratios(spark.createDataFrame(pd.DataFrame({"bucket": np.arange(rules.BUCKETS), "raw": raw, "target": target}))), 0.0)
    want = (ratio[one] + ratio[two]).reshape(50_000, 50).sum(1) / (99 + rules.PRIOR_NGRAMS)
    assert not got.base_failed.any() and np.abs(got.log_ratio - want).max() < 1e-9
    bins = pd.DataFrame({"x": np.floor(got.log_ratio * 100), "y": good.astype(int)})[held].value_counts().rename("n").reset_index()
    assert (got.kept == (got.log_ratio >= rules.pick_threshold(bins))).all()


def test_lm_scores(docs, edge):
    rows = texts_of(docs)
    tok = {i: WORD.findall(low(t)) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    count = collections.Counter(w for i, t in tok.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in maxent.score_documents(docs).collect()}
    for i, t in tok.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(count[w] > 0 for w in t), n, held[i])
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert maxent.score_documents(edge).count() == len(EDGE)
    assert maxent.score_documents(edge.filter("doc_id < 0")).count() == 0


def test_lm_probabilities_sum_to_one():
    import numpy as np

    p = maxent.Params(features=64, top=2, shapes=4)
    rng = np.random.default_rng(0)
    in_class = np.abs(rng.integers(1, 9, (7, 2))).astype(float)
    m = maxent.Model(p, rng.normal(size=(64, 7)).astype(np.float32), np.zeros(7, np.float32), np.array([5, 6], np.uint64), in_class, 1, 1)
    z = m.exp_logits(np.array([[1, 2, 3]]), np.empty((1, 7), np.float32), np.empty((1, 7), np.float32))
    assert (z / z.sum()).sum() == pytest.approx(1, abs=1e-5)
    # in a class: its different tokens with their counts, and one unknown token
    n, v = 10.0, 3.0
    m.in_class[5] = n, v
    known = np.exp(m.in_class_scores(np.array([5, 5, 5]), np.array([4.0, 5.0, 1.0]))).sum()
    assert known + np.exp(m.in_class_scores(np.array([5]), np.array([0.0])))[0] == pytest.approx(1)


def test_lm_tokens():
    """Numbers, hashes and shapes by a plain loop; the work in Python does not grow with the texts."""
    import sys

    import xxhash

    p = maxent.Params()
    odd = ["", " ", "a", "A b\x0ba\x0c\x1c\x85 \u00a0", "\n\nxyz\t", "", "q \u00e9\u0301 Q"]
    for texts in (odd, odd[::-1], [""], ["", ""], ["x"]):
        t = maxent.tokenize([x.encode() for x in texts], p)
        words = [re.findall(rb"[^\x20\x09-\x0d]+", low(x).encode()) for x in texts]
        number = {w: k for k, w in enumerate(dict.fromkeys(w for ws in words for w in ws), 1)}
        assert t.ids.tolist() == [k for ws in words for k in [*map(number.__getitem__, ws), 0]] and t.count.tolist() == [len(ws) + 1 for ws in words]
        assert t.hashes.tolist() == [maxent.END, *map(xxhash.xxh3_64_intdigest, number)]
        assert t.shape.tolist() == [0] + [(w[-1] * 37 + (b" " + w)[-2] * 11 + (w[-1] >> 3)) % p.shapes for w in number]

    def calls(n):
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event))
        try:
            maxent.tokenize([b"one two three"] * n, p)
        finally:
            sys.setprofile(None)
        return len(seen)

    calls(10)  # imports
    assert calls(3000) < calls(10) + 100


def test_lm_step_and_class_scores():
    """A training step and the class scores by dense formulas, with weight rows that few and many tokens meet."""
    p = maxent.Params(features=4096, top=3, shapes=4, batch=256)
    rng = np.random.default_rng(5)
    words = [b"w%d" % k for k in rng.zipf(1.3, 2000) % 500]
    t = maxent.tokenize([b" ".join(words[k : k + 37]) for k in range(0, 2000, 37)], p)
    start = rng.normal(size=(p.features, p.classes)).astype(np.float32)
    bias = -np.arange(p.classes, dtype=np.float32)
    m = maxent.Model(p, start.copy(), bias, t.hashes[1:4], np.ones((p.classes, 2)), 1, 1)
    f, y = m.features_of(t), m.classes_of(t)[t.ids]
    weights, squares, most = start.astype(float), np.zeros(p.features), 0
    for a in range(0, len(y), p.batch):
        z = np.exp(weights[f[a : a + p.batch]].sum(1) + bias)
        z = z / z.sum(1, keepdims=True) - np.eye(p.classes)[y[a : a + p.batch]]
        grad, met = np.zeros_like(weights), np.zeros(p.features, int)
        for k in range(3):
            np.add.at(grad, f[a : a + p.batch, k], z)
            np.add.at(met, f[a : a + p.batch, k], 1)
        squares += (grad**2).sum(1)
        weights -= grad * p.rate / np.sqrt(squares + 1)[:, None]
        most = max(most, met.max())
    square = np.zeros(p.features, np.float32)
    seen = m.step(t, square)
    assert most > 30 and (np.bincount(seen)[1:3] > 0).all()
    assert np.abs(m.weights - np.clip(weights, -maxent.LIMIT, maxent.LIMIT)).max() < 1e-4 and np.abs(square - squares).max() < 1e-2
    assert seen.tolist() == np.bincount(f.ravel(), minlength=p.features).tolist()
    z = m.weights.astype(float)[f].sum(1) + bias
    want = z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))
    assert np.abs(m.class_scores(t, m.classes_of(t)) - want).max() < 1e-4


def test_lm_counts_of_many_blocks(spark, docs):
    """Counts that are summed over many blocks, and over more parts than at least, are those of few."""
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    few, many = (maxent.score_documents(docs, block_bytes=b).select(*columns).toPandas().sort_values("doc_id", ignore_index=True) for b in (maxent.BLOCK_BYTES, 4000))
    assert docs.select(F.sum(F.octet_length("text"))).first()[0] > 4000 * maxent.PARTS
    pd.testing.assert_frame_equal(few, many)


def test_lm_scores_do_not_depend_on_blocks(spark):
    """Two hundred words that occur equally often: which of them are a class each is the same
    however the counts were dealt out."""
    words = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("w"), F.pmod(F.col("id") + 10 * k, F.lit(200)).cast("string")))
    df = spark.range(400, numPartitions=2).select("id", F.array_join(words, " ").alias("text")).cache()
    few, many = (maxent.score_documents(df, "id", block_bytes=b).toPandas().sort_values("id", ignore_index=True) for b in (maxent.BLOCK_BYTES, 400))
    assert np.abs(few.score / many.score - 1).max() < 1e-5


@pytest.mark.parametrize(("score", "label", "least"), [(quality.score_quality, "quality", 0.97), (toxicity.score_toxicity, "toxic", 0.9)])
def test_classifiers_on_held_out_rows(spark, score, label, least, edge):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = score(d, y).join(y, "doc_id").filter("held_out").select("predicted", label).collect()
    assert sum(r.predicted == r[label] for r in got) / len(got) >= least
    few = score(edge, y.filter("doc_id < 0")).collect()
    assert len(few) == len(EDGE) and all(0 <= r.score <= 1 for r in few)
    assert score(edge.filter("doc_id < 0"), y).count() == 0


def test_quality_against_brute_force(spark, docs, labels):
    """Scores by the formulas of the discriminant, from the statistics of each text alone."""
    import numpy as np

    rows = texts_of(docs)
    x = {i: quality.statistics([(t or "").encode()])[0] for i, t in rows}
    y = {r.doc_id: r.quality for r in labels.collect()}
    train = {i: y[i] for i in x if i in y and zlib.crc32(str(i).encode()) % 5}
    own = [np.array([x[i] for i in train if train[i] == k]) for k in (0, 1)]
    n, d = [len(a) for a in own], len(quality.FEATURES)
    pooled = sum(n[k] * np.cov(own[k].T, bias=True) for k in (0, 1)) / sum(n)
    ridge = 1e-3 * (np.trace(pooled) / d * np.eye(d) + np.diag(np.diag(pooled)))

    def log_density(v, k):
        a = max(0.15, d / (d + n[k]))
        cov = (1 - a) * np.cov(own[k].T, bias=True) + a * pooled + ridge
        gap = v - own[k].mean(0)
        d2 = gap @ np.linalg.inv(cov) @ gap
        d2 = d2 if d2 <= 60 else 2 * math.sqrt(60 * d2) - 60
        return math.log((n[k] + 1) / (sum(n) + 2)) - np.linalg.slogdet(cov)[1] / 2 - d2 / 2

    for r in quality.score_quality(docs, labels).collect():
        gap = log_density(x[r.doc_id], 0) - log_density(x[r.doc_id], 1)
        assert r.score == pytest.approx(1 / (1 + math.exp(min(max(gap, -700), 700))), abs=1e-6) and r.predicted == (r.score >= 0.3)


def test_url_edges(spark):
    rows = [(1, None, "clash"), (2, "no-scheme.com/x", ""), (3, "http://A.COM/p?q=1#f", ""), (3, "http://A.COM/p?q=1#f", ""), (4, "http://a.com/p?q=2", ""), (5, "https://x.net/es/1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = urlfilter.judge_urls(pages, [("block", "net", "/es/")], urlfilter.crawl_traps(pages)).collect()
    by = {r.page_id: tuple(r)[1:] for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == ("", "", None, "allow")
    assert by[3] == ("a.com", "/p", None, "block") and by[5] == ("x.net", "/es/1", "net/es/", "block")


def test_warc_round_trip(spark):
    big = "é" * 80
    rows = [(4, "http://b.com/1", big), (2, "http://www.a.com/x y", big), (9, None, big), (5, "u://c", "short"), (6, "u://c", "short"), (7, "", None), (None, "http://n.org/", big), (2, "http://www.a.com/x y", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    capture = warc.archive_pages(pages)
    got = warc.read_archives(capture, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    digest = hashlib.sha256(big.encode()).hexdigest()
    assert (by[4].record_type, by[4].refers_to, by[4].payload_bytes, by[4].payload_digest) == ("revisit", 2, 160, digest)
    assert by[2].record_type == by[5].record_type == by[6].record_type == by[7].record_type == by[None].record_type == "response"
    assert bytes(by[2].payload) == big.encode() and by[7].payload_bytes == 0
    found = warc.lookup(capture, spark.createDataFrame([("http://www.a.com/x y",), ("http://none/",), (None,)], "url string")).collect()
    assert [r.page_id for r in found] == [2, 2]


def test_index_blocks(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.com/{i}", "x") for i in range(500)], "page_id long, url string, html string")
    root = "file://" + warc.scratch_path(spark, "warc-test").removeprefix("file://").removeprefix("file:")
    capture = warc.write_index(warc.write_archives(pages, root), root, block_lines=16, files=3)
    assert warc.entries_of(capture).count() == 500
    want = spark.createDataFrame([("http://h3.com/10",), ("http://h2.com/499",), ("http://h2.com/498",)], "url string")
    assert sorted(r.page_id for r in warc.lookup(capture, want).collect()) == [10, 499 if 499 % 7 == 2 else 10][: 1 + (499 % 7 == 2)] + ([498] if 498 % 7 == 2 else [])


def shingle_groups(rows, k, percent):
    """The smallest (id is null, id, number) of each row's group, by brute force."""
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return group


def test_pipeline(spark, tmp_path):
    """Every stage against brute force, over planted rows: null ids and texts, repeated rows, one id
    with two texts, near copies, benchmark passages, toxic documents, and clashing columns."""
    import random

    import corpus_pipeline

    rng = random.Random(11)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, "s", "q", 1.0) for r in docs.collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = [r for r in rows if r[1] and 150 < len(r[1].split()) < 900]
    tail = lambda r: r[2:]
    toxic = " ".join(rng.choices(["idiot", "moron", "scum", "trash", "pathetic", "stupid"], k=30))
    rows.append((9001, long[0][1] + " one more word", *tail(long[0])))  # a near copy
    rows.append((None, long[1][1] + " and more", *tail(long[1])))  # a near copy without an id
    rows.append((None, long[2][1] + " " + toxic, *tail(long[2])))
    rows.append((9002, long[3][1] + " " + bench[0], *tail(long[3])))
    rows.append((None, long[4][1] + " " + bench[0], *tail(long[4])))
    rows += [rows[5], rows[5]]  # repeated rows
    rows.append((long[6][0], long[7][1][::-1], *tail(long[6])))  # one id, two texts
    rows += [(9003, None, *tail(long[0])), (9004, "", *tail(long[0])), (None, None, None, None, None, None, None)]
    shape = "doc_id long, text string, lang string, source string, size string, __row string, taken double"
    folder = str(tmp_path)
    spark.createDataFrame(rows, shape).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    key = lambda rs: sorted(map(str, (tuple(r) for r in rs)))
    whole = lambda df: [tuple(r) for r in df.collect()]
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(step(spark, docs, folder), "test")
        if name != "mixing sources":
            assert docs.columns == before.columns
        out[name] = (whole(before), whole(docs))
    # quality and toxicity: a row goes by what its own text scores, whatever its id
    for name, score, good in (("quality classifier", quality.score_quality, 1), ("toxicity", toxicity.score_toxicity, 0)):
        had, has = out[name]
        texts = spark.createDataFrame([(r[0], k, r[1]) for k, r in enumerate(had)], "doc_id long, k long, text string")
        verdict = {r.row.k: r.predicted for r in score(texts, labels, carry=True).collect()}
        assert key(has) == key(r for k, r in enumerate(had) if verdict[k] == good) and len(has) < len(had)
    assert not any(r[1] and toxic in r[1] for r in out["toxicity"][1])
    had, has = out["minhash near-dedup"]
    group, best = shingle_groups([(r[0], r[1]) for r in had], 5, 80), {}
    for k, r in enumerate(had):
        best.setdefault(group[k], []).append((r[0] is None, r[0] or 0, str(r)))
    best = {g: min(members) for g, members in best.items()}
    assert key(has) == sorted(x[2] for x in best.values()) and len(has) < len(had)
    had, has = out["benchmark decontamination"]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for t in bench:
        w = word.findall(low(t))
        n = min(10, len(w))
        windows |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1) if n}
    sizes = {len(x) for x in windows}

    def clean(t):
        w = word.findall(low(t))
        return not any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))

    assert key(has) == key(r for r in had if clean(r[1])) and len(has) < len(had)
    assert not any(r[1] and bench[0] in r[1] for r in has)
    # mixing: whole rows, near their targets, and the documents' own `size` and `taken` kept
    had, has = out["mixing sources"]
    assert docs.columns[-4:] == ["mix_size", "source_size", "target", "mix_taken"]
    assert {str(r[:7]) for r in has} <= {str(r) for r in had}
    by = collections.defaultdict(list)
    for r in had:
        by[r[3]].append(len(WORD.findall(r[1] or "")))
    for source, all_sizes in by.items():
        mine = [r for r in has if r[3] == source]
        assert all(r[10] % r[7] == 0 and 0 < r[10] <= 2 * r[7] and r[8] == sum(all_sizes) for r in mine)
        if mine:
            target, total = mine[0][9], sum(all_sizes)
            base = min(int(target // total), 2)
            sums, budget = {0}, round(target) - base * total if base < 2 else 0
            for x in all_sizes:
                sums |= {y + x for y in sums if y + x <= budget}
            assert sum(r[10] for r in mine) == base * total + max(sums)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_toxicity(rows, labels, share, folds=5):
    """Evidence per text by the formulas in plain Python: {id: evidence}."""
    import itertools

    def words(t):
        return re.findall("[a-z0-9\x80-\U0010ffff]+", low(t))

    def fold_of(i):
        return zlib.crc32(str(i).encode()) % folds

    counts = ({}, {})
    for i, t in rows:
        if i in labels and fold_of(i) not in (0, folds - 1):
            for pair in set(itertools.pairwise([None, *words(t)])):
                counts[labels[i]][pair] = counts[labels[i]].get(pair, 0) + 1
    both = {k: counts[0].get(k, 0) + counts[1].get(k, 0) for k in counts[0].keys() | counts[1].keys()}
    tables = [*counts, both]

    def discounted(table):
        one, two = (sum(n == k for n in table.values()) for k in (1, 2))
        return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5

    cont = [collections.Counter(w for _, w in t) for t in tables]
    heads = [collections.Counter() for _ in tables]
    for head, table in zip(heads, tables, strict=True):
        for (v, _), n in table.items():
            head[v] += n
    cut, below = [discounted(t) for t in tables], [discounted(c) for c in cont]
    vocabulary = len(cont[2])
    kept = [collections.Counter() for _ in tables]
    for k, table in zip(kept, tables, strict=True):
        for (v, _), n in table.items():
            k[v] += max(n - cut[tables.index(table)], 0)

    def shared(w):
        return (cont[2][w] + 0.5) / (sum(cont[2].values()) + 0.5 * (vocabulary + 1))

    def single(w, c):
        total = sum(cont[c].values())
        mass = sum(max(n - below[c], 0) for n in cont[c].values()) / total
        return max(cont[c][w] - below[c], 0) / total + (1 - mass) * shared(w)

    def after(v, w, c, lower):
        if v not in heads[c]:
            return lower
        return max(tables[c].get((v, w), 0) - cut[c], 0) / heads[c][v] + (1 - kept[c][v] / heads[c][v]) * lower

    def p(v, w, c):
        return after(v, w, c, after(v, w, 2, single(w, c)))

    out = {}
    for i, t in rows[:25]:
        terms = []
        for v, w in itertools.pairwise([None, *words(t)][:400]):
            a, b = p(v, w, 0), p(v, w, 1)
            terms.append(math.log((1 - share) * a + share * b) - math.log(a))
        out[i] = 1000 * sum(terms) / max(len(terms), 1)
    return out


def test_toxicity_against_brute_force(spark, docs, labels):
    short = docs.withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, 60), " "))
    rows = sorted(texts_of(short))
    want = brute_toxicity(rows, {r.doc_id: r.toxic for r in labels.collect()}, 0.2)
    got = {r.doc_id: r for r in toxicity.score_toxicity(short, labels, share=0.2).collect()}
    for i, x in want.items():
        assert got[i].evidence == pytest.approx(x, rel=1e-4, abs=1e-3)
        assert got[i].evidence == pytest.approx(1000 * (got[i].toxic_loglik - got[i].ordinary_loglik))


def test_toxicity_models_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(2)
    v, w = np.divmod(np.unique(rng.integers(0, 400, 150)), 20)
    counts = rng.integers(0, 4, (len(v), 2)).astype(float)
    counts[counts.sum(1) == 0] = 1
    m = toxicity.KneserNey.of_counts(v.astype(np.uint64) + 5, w.astype(np.uint64) + 5, counts)
    every = np.append(m.words, np.uint64(999))  # 999: the unknown word
    for head in [*m.heads, np.uint64(77)]:
        hashes = np.append(every, head)
        p = m.probabilities(np.full(len(every), len(every)), np.arange(len(every)), hashes)
        assert [x.sum() for x in p] == pytest.approx([1, 1], abs=1e-5)


def test_toxicity_slices_and_rare_words(spark):
    """Slices of a long text give what the whole gives, and what few documents show is learnt."""
    import random

    import numpy as np

    rng = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(400):
        text = rng.choices(words, k=40)
        if i % 8 == 0:
            text[7:9] = ["rare", "insult"] if i % 16 else ["w1", "w2"]  # a rare word, and a phrase of common words
        rows.append((i, " ".join(text), int(i % 8 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score_toxicity(df, df.select("doc_id", "toxic")).join(df.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.toxic]
    assert held and sum(r.predicted for r in held) / len(held) >= 0.8
    assert sum(r.predicted for r in got if not r.toxic) <= 20
    m = toxicity.KneserNey.of_counts(np.array([1, 5], np.uint64), np.array([5, 6], np.uint64), np.array([[1.0, 2], [3, 1]]))
    text = b"ab cd ef " * 1000
    assert m.text_sums([text], limit=50) == pytest.approx(m.text_sums([text]))
