"""A voxel map, and its mesh, that follow a stream of signed observations and outlive a restart."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators.meshing import extract_triangles
from lodeframe.operators.voxels import CELL, SUMS, fuse, gradients, surface

CHUNK = ["cx", "cy", "cz"]
MANIFEST = "batch long, kind string, bucket int, version long"
MESH = "gx int, gy int, gz int, tri int, corner int, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double"
GRID = "gx int, gy int, gz int, sum_wd double, sum_w double, sum_r long, sum_g long, sum_b long, n_c long"
#: A cube's triangles depend on its corners, one cell further, and on their gradients, one more on either side: a cell
#: tells cubes from two before it to one after it.
REACH = (-2, 1)


class VoxelMap:
    """The fused grid in a shared folder, in buckets of neighbouring chunks, and the mesh of each chunk.

    A micro-batch writes new versions of the buckets that its cells lie in and of the buckets whose meshes they
    make stale, under its own number; then the manifest of all buckets' versions as the commit. Whoever opens the folder, after a
    restart too, reads the last commit. A batch that was committed is not applied again; one that was not starts
    from the commit before it and overwrites what it had left. So each batch counts once, and its cost follows the buckets it
    touches. The state is in the folder alone.
    """

    def __init__(self, spark: SparkSession, folder: str, chunk: int, voxel: float, least_weight: float = 50.0, buckets: int = 64, block: int = 8):
        self.spark, self.folder, self.chunk, self.voxel = spark, folder.rstrip("/"), chunk, voxel
        self.least_weight, self.buckets, self.block = least_weight, buckets, block

    def _exists(self, path: str) -> bool:
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(there)

    def commits(self, below: int | None = None) -> dict[tuple[str, int], int]:
        """{(kind, bucket): version} of the last commit (below a batch's number); one line a bucket."""
        path = f"{self.folder}/commits"
        if not self._exists(path):
            return {}
        every = self.spark.read.schema(MANIFEST).parquet(path)
        every = every if below is None else every.filter(F.col("batch") < below)
        last = every.agg(F.max("batch")).first()[0]
        return {(r.kind, r.bucket): r.version for r in every.filter(F.col("batch") == last).collect() if r.bucket is not None}

    def last(self) -> int | None:
        """The number of the last committed batch."""
        path = f"{self.folder}/commits"
        return self.spark.read.schema(MANIFEST).parquet(path).agg(F.max("batch")).first()[0] if self._exists(path) else None

    def _read(self, kind: str, manifest: dict, only: set[int] | None = None) -> DataFrame:
        schema = GRID if kind == "grid" else MESH
        paths = [f"{self.folder}/{kind}/version={v}/bucket={b}" for (k, b), v in sorted(manifest.items()) if k == kind and (only is None or b in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def grid(self) -> DataFrame:
        """Cells and their sums as of the last commit."""
        return self._read("grid", self.commits())

    def mesh(self) -> DataFrame:
        """Triangle corners as of the last commit."""
        return self._read("mesh", self.commits())

    def _bucket(self, *chunk: Column) -> Column:
        """Blocks of `block` chunks a side share a bucket, so that a chunk's surroundings lie in few."""
        return F.pmod(F.xxhash64(*[F.floor(c / self.block) for c in chunk]), F.lit(self.buckets)).cast("int")

    def _chunks(self, shift: tuple[int, int, int] = (0, 0, 0)) -> list[Column]:
        return [F.floor((F.col(g) + o) / self.chunk).cast("int") for g, o in zip(CELL, shift, strict=True)]

    def _told(self) -> Column:
        """The chunks whose meshes a cell tells, as an array."""
        return F.array_distinct(F.array(*[F.struct(*[c.alias(n) for c, n in zip(self._chunks(o), CHUNK, strict=True)]) for o in itertools.product(REACH, repeat=3)]))

    def _put(self, kind: str, rows: DataFrame, number: int) -> set[int]:
        """Writes rows by bucket; the buckets that have any."""
        path = f"{self.folder}/{kind}/version={number}"
        rows.withColumn("bucket", self._bucket(*self._chunks())).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return {r[0] for r in self.spark.read.schema("bucket int").parquet(path).select("bucket").distinct().collect()}

    def _ids(self, chunks: DataFrame) -> set[int]:
        return {r[0] for r in chunks.select(self._bucket(*[F.col(c) for c in CHUNK])).distinct().collect()}

    def apply(self, batch: DataFrame, number: int) -> None:
        """Adds the observations (cell and sums; negative ones retract) of micro-batch `number`, and meshes anew the chunks that
        they tell, from those chunks' cells and the few around them."""
        last = self.last()
        if last is not None and number <= last:
            return
        before = self.commits(number)
        batch = batch.select(*CELL, *SUMS).persist()
        try:
            own = self._ids(batch.select(*[c.alias(n) for c, n in zip(self._chunks(), CHUNK, strict=True)]))
            if not own:
                self._commit(number, before)
                return
            after = {k: v for k, v in before.items() if k[0] != "grid" or k[1] not in own}
            after |= {("grid", b): number for b in self._put("grid", fuse(self._read("grid", before, own), batch), number)}
            dirty = batch.select(F.explode(self._told()).alias("c")).select("c.*").distinct().persist()
            stale = self._ids(dirty)
            around = dirty.select(F.explode(F.array(*[F.struct(*[(F.col(c) + o).alias(c) for c, o in zip(CHUNK, shift, strict=True)]) for shift in itertools.product((-1, 0, 1), repeat=3)])).alias("c")).select("c.*").distinct()
            cells = self._read("grid", after, self._ids(around))
            near = cells.select("*", F.explode(self._told()).alias("c")).select(*CELL, *SUMS, "c.*").join(dirty, CHUNK, "left_semi").drop(*CHUNK).distinct()
            top = surface(near)
            fresh = extract_triangles(top, gradients(top, self.voxel), self.voxel, self.least_weight)
            placed = lambda df: df.withColumns(dict(zip(CHUNK, self._chunks(), strict=True)))
            fresh = placed(fresh).join(dirty, CHUNK, "left_semi")
            stays = placed(self._read("mesh", before, stale)).join(dirty, CHUNK, "left_anti")
            after = {k: v for k, v in after.items() if k[0] != "mesh" or k[1] not in stale}
            after |= {("mesh", b): number for b in self._put("mesh", stays.unionByName(fresh.select(stays.columns)).drop(*CHUNK), number)}
            self._commit(number, after)
            dirty.unpersist()
        finally:
            batch.unpersist()

    def _commit(self, number: int, manifest: dict) -> None:
        rows = [(number, k, b, v) for (k, b), v in manifest.items()] or [(number, "grid", None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def follow(self, stream: DataFrame):
        """A writer that applies the stream's micro-batches; start it with a checkpoint location."""
        return stream.select(*CELL, *SUMS).writeStream.foreachBatch(self.apply)
