"""Multi-index-hash similarity search: buckets, candidate joins, scores, salience, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.hashing import hamming, neighbour_keys, similarity, substring_keys


def explode_keys(descriptors: DataFrame, tables: int, bits: int) -> DataFrame:
    """image_id, feature_id, words, table_id, key: a row for each hash table."""
    return descriptors.withColumn("__k", F.explode(substring_keys(F.col("words"), tables, bits))).select(
        *descriptors.columns, "__k.table_id", "__k.key"
    )


def build_buckets(keys: DataFrame, capacity: int | None = 200) -> DataFrame:
    """At most one feature an image and `capacity` images a bucket, first come by (image, feature).

    row_number <= capacity prunes on the map side too, so a hot key does not reach one task whole.
    Without a capacity every image is kept: what a search that must not lose links joins with.
    """
    first = keys.groupBy("table_id", "key", "image_id").agg(F.min(F.struct("feature_id", "words")).alias("__f"))
    if capacity is None:
        return first.select("table_id", "key", "image_id", "__f.feature_id", "__f.words")
    w = Window.partitionBy("table_id", "key").orderBy("image_id")
    return (
        first.withColumn("__r", F.row_number().over(w))
        .filter(F.col("__r") <= capacity)
        .select("table_id", "key", "image_id", "__f.feature_id", "__f.words")
    )


def candidates(queries: DataFrame, buckets: DataFrame, threshold: int, depth: int = 0, bits: int = 8, earlier: bool = True) -> DataFrame:
    """Colliding pairs below `threshold` bits, one row for each table they collide in.

    depth > 0 also probes the buckets whose keys differ in up to `depth` bits.
    """
    q = queries.select(F.col("image_id").alias("q_image"), F.col("feature_id").alias("q_feature"), F.col("words").alias("q_words"), "table_id", "key")
    if depth:
        q = q.withColumn("key", F.explode(neighbour_keys(F.col("key"), bits, depth)))
    pairs = q.join(buckets, ["table_id", "key"])
    if earlier:
        pairs = pairs.filter(F.col("image_id") < F.col("q_image"))
    d = hamming(F.col("q_words"), F.col("words"))
    return pairs.withColumn("distance", d).filter(F.col("distance") < threshold).select(
        "q_image", "q_feature", "image_id", "feature_id", "table_id", "distance"
    )


def image_scores(pairs: DataFrame, n_images: Column | int, covariance: float = 900.0) -> DataFrame:
    """q_image, image_id, score: similarities summed by (query feature, image), normalised over a
    feature's images, weighted by inverse image frequency and summed over features. Pairs, of which there may be very
    many, are shuffled once, by the query's image: all groups and windows lie within it."""
    n = F.lit(n_images) if isinstance(n_images, int) else n_images
    per = pairs.select("q_image", "q_feature", "image_id", "distance").repartition("q_image").groupBy("q_image", "q_feature", "image_id").agg(F.sum(similarity(F.col("distance"), covariance)).alias("s"))
    w = Window.partitionBy("q_image", "q_feature")
    base = similarity(F.lit(20), covariance)
    idf = F.log(F.greatest(F.lit(1.0), n / F.count("*").over(w)))
    part = per.withColumn("part", F.col("s") / (base + F.sum("s").over(w)) * idf)
    return part.groupBy("q_image", "image_id").agg(F.sum("part").alias("score"))


def salience(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds `salient` to sparse scores (q_image, idx, score); sizes has (q_image, n), the length
    of each query's score vector, whose missing entries are 0.

    The last index below the mean ends a prefix; salient = (score - its standard deviation) / its
    mean. An index of at most 0 gives 3; one below 3, or a prefix mean below 1e-8, gives 1. The
    zeros are counted, not made: the vectors stay sparse.
    """
    q = Window.partitionBy("q_image")
    s = scores.join(sizes, "q_image").withColumn("__mean", F.sum("score").over(q) / F.col("n"))
    high = F.col("score") >= F.col("__mean")
    down = Window.partitionBy("q_image", high).orderBy(F.desc("idx"))
    run = F.when(high & (F.col("idx") + F.row_number().over(down) == F.col("n")), 1).otherwise(0)
    s = s.withColumn("__run", run)
    last = F.col("n") - 1 - F.sum("__run").over(q)
    s = s.withColumn("__last", F.when(F.col("__mean") == 0, F.lit(-1)).otherwise(last))
    inside = F.col("idx") < F.col("__last")
    s = s.withColumn("__s1", F.coalesce(F.sum(F.when(inside, F.col("score"))).over(q), F.lit(0.0)))
    s = s.withColumn("__m", F.try_divide(F.col("__s1"), F.col("__last")))
    # squared deviations of the entries that are there, and of the zeros that are not
    seen = F.sum(F.when(inside, 1).otherwise(0)).over(q)
    dev = F.coalesce(F.sum(F.when(inside, (F.col("score") - F.col("__m")) * (F.col("score") - F.col("__m")))).over(q), F.lit(0.0))
    zeros = (F.col("__last") - seen) * F.col("__m") * F.col("__m")
    s = s.withColumn("__sd", F.sqrt(F.try_divide(dev + zeros, F.col("__last") - F.lit(1))))
    value = (
        F.when(F.col("__last") <= 0, F.lit(3.0))
        .when((F.col("__last") < 3) | (F.col("__m") < 1e-8), F.lit(1.0))
        .otherwise(F.try_divide(F.col("score") - F.col("__sd"), F.col("__m")))
    )
    return s.withColumn("salient", value).select(*scores.columns, "salient")


def top_candidates(scores: DataFrame, threshold: float = 1.5, k: int = 5) -> DataFrame:
    """Per query the k most salient entries above `threshold`, ties by the smaller index; what differs by the order of a sum only is a tie."""
    w = Window.partitionBy("q_image").orderBy(F.desc(F.round("salient", 12)), "idx")
    return scores.filter(F.col("salient") > threshold).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_by_hash(queries: DataFrame, train: DataFrame, threshold: int | None = None, inclusive: bool = False, radius: float | None = None) -> DataFrame:
    """The nearest of the train descriptors that share a bucket with a query: smallest distance,
    then feature. With `radius` also within that many pixels of the predicted place (qx, qy).

    queries: q_id, words, table_id, key (qx, qy); train: t_id, words, table_id, key (x, y).
    """
    extra = ["qx", "qy"] if radius is not None else []
    q = queries.select("q_id", F.col("words").alias("__q"), "table_id", "key", *extra)
    pairs = q.join(train, ["table_id", "key"]).withColumn("distance", hamming(F.col("__q"), F.col("words")))
    if threshold is not None:
        pairs = pairs.filter(F.col("distance") <= threshold if inclusive else F.col("distance") < threshold)
    if radius is not None:
        dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
        pairs = pairs.filter(dx * dx + dy * dy < radius * radius)
    best = pairs.groupBy("q_id").agg(F.min(F.struct("distance", "t_id")).alias("b"))
    return best.select("q_id", "b.t_id", "b.distance")


def distances_to_all(queries: DataFrame, train: DataFrame, block: int = 1000) -> DataFrame:
    """(q_id, t_id, distance) of every query and every other train row. The queries, a set that the
    caller names, go in blocks of about `block`; each train row meets each block once."""
    n_blocks = -(-queries.count() // block) or 1
    deal = F.pmod(F.xxhash64("q_id"), F.lit(n_blocks)).cast("int").alias("__block")
    blocks = queries.groupBy(deal).agg(F.collect_list(F.struct("q_id", "words")).alias("__q"))
    met = train.select("t_id", F.col("words").alias("__w"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("__block")).join(blocks, "__block")
    pairs = met.select("t_id", "__w", F.explode("__q").alias("q")).filter("q.q_id <> t_id")
    return pairs.select("q.q_id", "t_id", hamming(F.col("q.words"), F.col("__w")).alias("distance"))


def nearest_brute_force(queries: DataFrame, train: DataFrame, threshold: int) -> DataFrame:
    """The nearest of all other train descriptors within `threshold`; the first id wins ties. Pairs beyond it go before they are
    grouped, and the others are hashed to a row a distance: a smallest struct of all pairs would sort them all."""
    pairs = distances_to_all(queries, train).filter(F.col("distance") <= threshold)
    best = pairs.groupBy("q_id", "distance").agg(F.min("t_id").alias("t_id")).groupBy("q_id").agg(F.min(F.struct("distance", "t_id")).alias("b"))
    return best.select("q_id", "b.t_id", "b.distance")


def closure_quality(closures: DataFrame) -> DataFrame:
    """One row: row-level precision and recall of flags against truth (i, j, flag, truth)."""
    rows = closures.groupBy("i").agg(F.max("flag").alias("f"), F.max("truth").alias("t"), F.max(F.col("flag") * F.col("truth")).alias("h"))
    return rows.agg(
        F.sum("f").alias("n_flagged"), F.sum("t").alias("n_true"), F.sum("h").alias("n_hit"), (F.sum("h") / F.sum("f")).alias("precision"), (F.sum("h") / F.sum("t")).alias("recall")
    )
