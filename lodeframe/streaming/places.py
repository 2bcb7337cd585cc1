"""Keyframes registered as they come: a growing index of places, with poses and edges, that outlives a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.geometry import Camera
from lodeframe.operators.graph import kept, map_components
from lodeframe.operators.registration import pair_moments
from lodeframe.operators.rigid import register_pairs
from lodeframe.operators.similarity import build_buckets, candidates, explode_keys, image_scores, salience, top_candidates

FEATURES = "seq long, frame_id int, kp_id long, words array<long>, x double, y double, z double, u double, v double, angle double, octave int"
KEYFRAMES = "seq long, frame_id int, place long, reference int, registrations int, in_index boolean, r array<double>, t array<double>"
EDGES = "seq long, ref int, new int, n long, error double, disparity double, scale_change double, sum_w double, sp array<double>, sq array<double>, spp array<double>, sqq array<double>, spq array<double>"
SCHEMAS = {"features": FEATURES, "keyframes": KEYFRAMES, "edges": EDGES, "commits": "step long, batch long"}
STILL = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


class PlaceIndex:
    """The keyframes of any number of sequences in a shared folder, each registered against its sequence's earlier ones.

    A keyframe's candidates are the keyframe before it and the `most` places whose scores are most salient (above `salient`), the newest place
    left out. All candidate pairs are registered at once (see register_pairs). Of those that succeed the one with the least disparity gives the pose;
    without any the keyframe stands at the origin and begins a map. Its features enter the index only if fewer than
    `enough` registrations succeeded; its place is taken in either case, so scores keep their positions.

    What a keyframe finds depends on those before it, so a micro-batch is taken in steps of one keyframe a sequence, in
    the order of frames; sequences are the parallelism. Each step appends its tables under its own number, and then the commit. A
    restart reads the last commit: a step that was not committed is written again, and keyframes that are there are left out, so a micro-batch
    that runs twice counts once, wherever it was cut off.
    """

    def __init__(self, spark: SparkSession, folder: str, camera: Camera, tables: int = 32, bits: int = 8, hamming: int = 50, covariance: float = 900.0, salient: float = 1.5, most: int = 5, enough: int = 4, **registration):
        self.spark, self.folder, self.camera = spark, folder.rstrip("/"), camera
        self.tables, self.bits, self.hamming, self.covariance = tables, bits, hamming, covariance
        self.salient, self.most, self.enough, self.registration = salient, most, enough, registration

    def _table(self, kind: str, steps: int | None = None) -> DataFrame:
        """The rows of a table up to the last commit; each step's lie in a folder of their own."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMAS[kind] + ("" if kind == "commits" else ", step long"))
        rows = self.spark.read.schema(SCHEMAS[kind] + ("" if kind == "commits" else ", step long")).parquet(f"{self.folder}/{kind}")
        return rows if kind == "commits" else rows.filter(F.col("step") <= (self.last() if steps is None else steps))

    def last(self) -> int:
        """The number of the last committed step, -1 before any."""
        got = self._table("commits").agg(F.max("step")).first()[0]
        return -1 if got is None else got

    def keyframes(self) -> DataFrame:
        return self._table("keyframes").drop("step")

    def edges(self) -> DataFrame:
        """Registered pairs with their inliers' moments, as a pose graph takes them."""
        return self._table("edges").drop("step")

    def poses(self) -> DataFrame:
        """(frame_id, map, r, t): keyframes with the smallest frame that their registrations reach."""
        nodes = self.keyframes()
        maps = map_components(nodes.select(F.col("frame_id").alias("id")), self.edges().select(F.col("ref").alias("a"), F.col("new").alias("b")))
        return nodes.join(maps.withColumnRenamed("id", "frame_id"), "frame_id").select("frame_id", F.col("origin").alias("map"), "r", "t")

    def _put(self, kind: str, rows: DataFrame, step: int) -> DataFrame:
        path = f"{self.folder}/{kind}/step={step}"
        rows.select(*[c.split()[0] for c in SCHEMAS[kind].split(", ")]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(SCHEMAS[kind]).parquet(path)

    def closures(self, new: DataFrame, features: DataFrame, known: DataFrame) -> DataFrame:
        """(seq, frame_id, place): the salient earlier places of each new keyframe (seq, frame_id, place; one a sequence)."""
        word = lambda df: explode_keys(df, self.tables, self.bits)
        indexed = features.join(known.filter("in_index").select("frame_id", F.col("place").alias("image_id")), "frame_id").select("seq", "image_id", F.col("kp_id").alias("feature_id"), "words")
        asks = features.join(new.select("frame_id", F.struct("seq", F.col("place").alias("n")).alias("image_id")), "frame_id").select("seq", "image_id", F.col("kp_id").alias("feature_id"), "words")
        table = F.struct("seq", "table_id").alias("table_id")
        buckets = build_buckets(word(indexed).select("image_id", "feature_id", "words", table, "key"), None)
        pairs = candidates(word(asks).select("image_id", "feature_id", "words", table, "key"), buckets, self.hamming, earlier=False)
        scores = image_scores(pairs, F.col("q_image.n"), self.covariance).withColumnRenamed("image_id", "idx")
        sizes = scores.select("q_image").distinct().withColumn("n", F.col("q_image.n"))
        late = salience(scores, sizes).filter(F.col("idx") < F.col("q_image.n") - 1)
        return top_candidates(late, self.salient, self.most).select(F.col("q_image.seq").alias("seq"), F.col("idx").alias("place"))

    def _step(self, batch: DataFrame, chosen: DataFrame, step: int, number: int) -> None:
        """Registers the chosen keyframes (seq, frame_id), one a sequence."""
        known = self._table("keyframes", step - 1)
        counts = known.groupBy("seq").agg(F.count("*").alias("place"))
        new = chosen.join(counts, "seq", "left").select("seq", "frame_id", F.coalesce("place", F.lit(0).cast("bigint")).alias("place"))
        self._put("features", batch.join(chosen, ["seq", "frame_id"], "left_semi"), step)
        features = self._table("features", step)
        found = self.closures(new, features, known).unionByName(new.filter("place > 0").select("seq", (F.col("place") - 1).alias("place"))).distinct()
        pairs = found.join(known.select("seq", "place", F.col("frame_id").alias("ref")), ["seq", "place"]).join(new.select("seq", F.col("frame_id").alias("new")), "seq").select("ref", "new")
        pairs = pairs.persist()
        own = kept(features.join(pairs.select(F.explode(F.array("ref", "new")).alias("frame_id")).distinct(), "frame_id", "left_semi"))
        if pairs.isEmpty():  # first keyframes only
            good = self.spark.createDataFrame([], "ref int, new int, r array<double>, t array<double>, disparity double")
            self._put("edges", self.spark.createDataFrame([], EDGES), step)
        else:
            registered, inliers = register_pairs(own.drop("seq", "step"), pairs, self.camera, hamming_below=self.hamming, **self.registration)
            good = registered.filter("registered")
            sums = pair_moments(inliers, F.col("weight"))
            self._put("edges", good.join(sums, ["ref", "new"]).join(new.select("seq", F.col("frame_id").alias("new")), "new"), step)
        best = good.groupBy("new").agg(F.min_by(F.struct("ref", "r", "t"), F.struct("disparity", "ref")).alias("b"), F.count("*").cast("int").alias("registrations"))
        at = new.join(best.withColumnRenamed("new", "frame_id"), "frame_id", "left")
        at = at.join(known.select(F.col("frame_id").alias("reference"), F.col("r").alias("rr"), F.col("t").alias("tr")), F.col("b.ref") == F.col("reference"), "left")
        g = lambda c, k: F.get(c, F.lit(k))
        turn = [[sum((g("rr", 3 * i + k) * g("b.r", 3 * j + k) for k in (1, 2)), g("rr", 3 * i) * g("b.r", 3 * j)) for j in range(3)] for i in range(3)]  # reference to world after new to reference
        move = [g("tr", i) - sum((turn[i][k] * g("b.t", k) for k in (1, 2)), turn[i][0] * g("b.t", 0)) for i in range(3)]
        some = F.col("reference").isNotNull()
        count = F.coalesce("registrations", F.lit(0))
        self._put("keyframes", at.select(
            "seq", "frame_id", "place", "reference", count.alias("registrations"), (count < self.enough).alias("in_index"),
            F.when(some, F.array(*[c for row in turn for c in row])).otherwise(F.array(*map(F.lit, STILL))).alias("r"), F.when(some, F.array(*move)).otherwise(F.array(*[F.lit(0.0)] * 3)).alias("t"),
        ), step)
        self.spark.createDataFrame([(step, number)], SCHEMAS["commits"]).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        pairs.unpersist()

    def apply(self, batch: DataFrame, number: int = -1) -> None:
        """Takes the keyframes of a micro-batch (features as FEATURES) that are not there yet."""
        batch = batch.select(*[c.split()[0] for c in FEATURES.split(", ")]).persist()
        try:
            while True:
                waiting = batch.select("seq", "frame_id").distinct().join(self.keyframes().select("frame_id"), "frame_id", "left_anti")
                chosen = waiting.groupBy("seq").agg(F.min("frame_id").alias("frame_id")).persist()
                if chosen.isEmpty():
                    return
                self._step(batch, chosen, self.last() + 1, number)
                chosen.unpersist()
        finally:
            batch.unpersist()

    def follow(self, stream: DataFrame):
        """A writer that registers the stream's micro-batches; start it with a checkpoint location."""
        return stream.writeStream.foreachBatch(self.apply)
