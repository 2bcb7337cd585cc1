"""State that outlives a restart: the voxel map and its mesh, and the visit filter."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import meshing, voxels
from lodeframe.operators.graph import kept
from lodeframe.plans import fixtures as fx
from lodeframe.plans import streams
from lodeframe.plans import voxels as plan
from lodeframe.streaming import beliefs, maps

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.select(*voxels.CELL, *voxels.SUMS).collect()))


def test_map_counts_each_batch_once_over_restarts(spark, tmp_path):
    one = [(i, 0, 0, 0.1 * i, 1.0, 1, 2, 3, 1) for i in range(10)]
    two = [(i, 1, 0, 0.2, 2.0, 4, 5, 6, 1) for i in range(20)]
    back = [(x[0], x[1], x[2], *[-y for y in x[3:]]) for x in one]
    batches = [spark.createDataFrame(b, maps.GRID) for b in (one, two, back)]
    fresh = lambda: maps.VoxelMap(spark, str(tmp_path / "map"), 8, 0.05, buckets=4)
    assert fresh().last() is None and fresh().grid().count() == fresh().mesh().count() == 0
    for k, batch in enumerate(batches):
        fresh().apply(batch, k)  # another object each time
        assert fresh().last() == k
        if k == 1:
            assert fresh().grid().count() == 30
    want = rows_of(batches[1])
    assert rows_of(fresh().grid()) == want
    fresh().apply(batches[2], 2)
    fresh().apply(batches[0], 0)
    assert rows_of(fresh().grid()) == want
    fresh().apply(batches[0].limit(0), 3)
    assert fresh().last() == 3 and rows_of(fresh().grid()) == want


def test_a_batch_that_failed_before_its_commit_is_applied_anew(spark, tmp_path, monkeypatch):
    one = spark.createDataFrame([(i, 0, 0, 0.1 * i, 1.0, 1, 2, 3, 1) for i in range(10)], maps.GRID)
    two = spark.createDataFrame([(i, 1, 0, 0.2, 2.0, 4, 5, 6, 1) for i in range(5)], maps.GRID)
    fresh = lambda: maps.VoxelMap(spark, str(tmp_path / "map"), 8, 0.05)
    fresh().apply(one, 0)
    with monkeypatch.context() as m:
        m.setattr(maps.VoxelMap, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            fresh().apply(two, 1)
    assert rows_of(fresh().grid()) == rows_of(one)
    fresh().apply(two, 1)
    assert rows_of(fresh().grid()) == rows_of(one.unionByName(two))


def test_mesh_of_dirty_chunks_is_the_whole_grid_s(spark, tmp_path):
    """After each of three batches the kept mesh equals a mesh of the whole grid, in a stream that is stopped between them."""
    seen = kept(plan.observations(spark, SF))
    for k in range(3):
        seen.filter(f"frame_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        here = maps.VoxelMap(spark, str(tmp_path / "map"), fx.CHUNK, fx.VOXEL, least_weight=1.0, buckets=16, block=2)
        q = here.follow(stream).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        top = voxels.surface(here.grid())
        whole = meshing.extract_triangles(top, voxels.gradients(top, fx.VOXEL), fx.VOXEL, 1.0)
        key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*voxels.CELL, "tri", "corner", "x", "y", "z", "nx", "r", "g", "b").collect())
        got = key(here.mesh())
        assert got == key(whole)
    assert here.last() == 2 and got


def brute_beliefs(steps, o):
    """{(step, idx): (belief, visited)} of [(step, n, {idx: score})] by plain loops over dense vectors."""
    prior, flags, out = [], [], {}
    for step, n, scored in steps:
        size = n - o.recent
        if size <= 0:
            continue
        score = [scored.get(i, 0.0) for i in range(size)]
        mean = sum(score) / size
        spread = (sum((s - mean) ** 2 for s in score) ** 0.5) / max((size - 1) ** 0.5, 1)
        now = []
        for i in range(size):
            salient = 1.0 if score[i] < o.least or mean == 0 else max((score[i] - spread) / mean, 1.0)
            near = [prior[j] if j < len(prior) else 0.0 for j in range(max(i - 2, 0), min(size - 1, i + 3))]
            alpha = max(near, default=0.0)
            yes = salient * 0.05 * (1 - alpha) + salient * 0.95 * alpha
            no = o.gate * 0.95 * (1 - alpha) + o.gate * 0.05 * alpha
            now.append(yes / (yes + no))
        own = [b > o.threshold for b in now]
        if len(flags) >= 4:
            last = flags[-1][1]
            i = 0
            while i < len(last):
                if last[i]:
                    a = max(i - o.reach, 0)
                    while i < len(last) and last[i]:
                        i += 1
                    b = min(i + o.reach, len(last) - 3)
                    if b > a and not any(own[a:b]) and any(flags[-3][1][a:b]) + any(flags[-2][1][a:b]) < 2:
                        for _, f in flags[-3:]:
                            for j in range(a, min(b, len(f))):
                                f[j] = False
                i += 1
        flags.append((step, own))
        prior = now
        for i in scored:
            if i < size:
                out[step, i] = now[i]
    by = dict(flags)
    return {(s, i): (b, by[s][i]) for (s, i), b in out.items()}


def visits(seed):
    """Steps with a base of similar places, revisits of several lengths and lone flashes."""
    rng = np.random.default_rng(seed)
    out = []
    for step in range(40):
        n = step + 3
        scored = {int(i): float(rng.uniform(0.05, 0.3)) for i in rng.choice(n, min(n, 6), replace=False)}
        for begin, end, place in ((8, 14, 2), (18, 19, 9), (22, 24, 15), (30, 37, 20), (33, 34, 4)):
            if begin <= step < end and place + step - begin < n:
                scored[place + step - begin] = float(rng.uniform(3, 6))
                if rng.random() < 0.5 and place + step - begin + 1 < n:
                    scored[place + step - begin + 1] = float(rng.uniform(2, 5))
        out.append((step, n, scored if rng.random() > 0.1 else {}))
    return out


KIND = "seq long, step int, n int, idx int, score double"


def as_rows(seq, steps):
    return [(seq, step, n, None, None) for step, n, _ in steps] + [(seq, step, n, i, s) for step, n, scored in steps for i, s in scored.items()]


@pytest.mark.parametrize("options", [beliefs.VisitOptions(gate=2.0), beliefs.VisitOptions(gate=1.2, recent=4), beliefs.VisitOptions(gate=3.0, reach=1)])
def test_visit_beliefs_by_loop(spark, options):
    every = {seq: visits(seq) for seq in range(5)}
    df = spark.createDataFrame([r for seq, steps in every.items() for r in as_rows(seq, steps)], KIND).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)  # steps lie across batches
    try:
        got = {seq: {} for seq in every}
        for r in beliefs.visit_beliefs(df, options).collect():
            got[r.seq][r.step, r.idx] = (r.belief, r.visited)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for seq, steps in every.items():
        want = brute_beliefs(steps, options)
        assert got[seq].keys() == want.keys()
        assert all(abs(got[seq][k][0] - b) < 1e-9 and got[seq][k][1] == v for k, (b, v) in want.items())
    assert any(v for seq in got.values() for _, v in seq.values())
    assert beliefs.visit_beliefs(df.limit(0)).count() == 0


def test_visit_stream_over_restarts_is_the_table_s(spark, tmp_path):
    options = beliefs.VisitOptions(gate=2.0)
    df = spark.createDataFrame([r for seq in range(3) for r in as_rows(seq, visits(seq))], KIND)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, (a, b) in enumerate(((0, 11), (11, 12), (12, 31), (31, 40))):
            df.filter(f"step >= {a} and step < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = beliefs.stream_visit_beliefs(stream, options).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.seq, r.step, r.idx): (r.belief, r.visited) for r in spark.read.schema(beliefs.OUTPUT).parquet(str(tmp_path / "out")).collect()}
    want = {(r.seq, r.step, r.idx): (r.belief, r.visited) for r in beliefs.visit_beliefs(df, options).collect() if r.step < 37}  # three steps are open still
    assert got == want and got


def test_registered_scores_hold_old_places(spark):
    far = streams.visit_scores(spark, SF).filter(F.col("step") - F.col("idx") > 40)
    assert streams.visit_scores(spark, SF).agg(F.max("step")).first()[0] <= 40 or far.count() > 0
