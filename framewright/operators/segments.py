"""Comparing fingerprints that share a segment, whatever the size of a bucket.

Of d + 1 segments of two fingerprints at most d bits apart one at least is equal, so only fingerprints
of one (position, segment) bucket are compared. Ids meet first; words are fetched for distinct pairs.
A bucket of n ids is n² comparisons of which no task gets more than BLOCK²: both sides are cut into
blocks of at most about BLOCK ids, and each pair of blocks is a join key of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.bits import WORDS, distance, segment_array

BLOCK = 1_000
LEADER = 32  # ids of a bucket above which its members are linked to its smallest one first


def segment_entries(looks: DataFrame, parts: int, key: str = "id") -> DataFrame:
    """(bucket, id): one row per segment of each fingerprint; the high bits of a bucket are its position."""
    return looks.select(F.explode(segment_array(parts)).alias("bucket"), key)


def meet(left: DataFrame, right: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of `left` and `right` that share a bucket, joined.

    left: bucket, a columns; right: bucket, b columns (no name in common but bucket). sizes: (bucket, n), the
    number of ids of every bucket that holds more than `block`; buckets that it lacks are small. Sides are hashed
    into ceil(n / block) blocks, so a hot bucket is spread over the square of that many join keys.
    """
    cuts = sizes.where(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("_cuts"))

    def cut(side: DataFrame, own: str, other: str) -> DataFrame:
        names = [c for c in side.columns if c != "bucket"]
        placed = side.join(cuts, "bucket", "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1)))
        return placed.select(
            "bucket", *names, F.pmod(F.xxhash64(*names), F.col("_cuts")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias(other),
        )

    return cut(left, "_i", "_j").join(cut(right, "_j", "_i"), ["bucket", "_i", "_j"]).drop("bucket", "_i", "_j")


def verified(pairs: DataFrame, looks: DataFrame, max_distance: int) -> DataFrame:
    """(a, b, distance) of the distinct pairs (a, b) of ids at most `max_distance` bits apart."""
    one = looks.select(F.col("id").alias("a"), *[F.col(w).alias(f"a{w}") for w in WORDS])
    two = looks.select(F.col("id").alias("b"), *[F.col(w).alias(f"b{w}") for w in WORDS])
    near = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").withColumn("distance", distance("a", "b"))
    return near.where(F.col("distance") <= max_distance).select("a", "b", "distance")


def all_pairs(looks: DataFrame, max_distance: int, block: int = BLOCK) -> DataFrame:
    """(a, b, distance), a < b: every pair of distinct fingerprints at most `max_distance` bits apart.

    looks: id, w0..w3; ids are unique.
    """
    entries = segment_entries(looks, max_distance + 1)
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    met = meet(entries.withColumnRenamed("id", "a"), entries.withColumnRenamed("id", "b"), sizes, block)
    return verified(met.where("a < b"), looks, max_distance)


def links(looks: DataFrame, max_distance: int, leader: int = LEADER, block: int = BLOCK) -> DataFrame:
    """(a, b): links that tie together what chains of pairs at most `max_distance` apart tie together.

    In a bucket of more than `leader` ids each is compared with the smallest one first. Two ids near it are tied
    by it and need no comparison of their own, so a family of re-saved pictures costs its members, not
    their square; an id that is not near it is compared with all of the bucket.
    """
    entries = segment_entries(looks, max_distance + 1)
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("_least")).where(F.col("n") > leader)
    large = entries.join(sizes.select("bucket", "_least"), "bucket")
    led = verified(large.where("id > _least").select(F.col("_least").alias("a"), F.col("id").alias("b")), looks, max_distance)
    near = led.select(F.col("a").alias("_least"), F.col("b").alias("id"))
    rest = large.where("id > _least").join(near, ["_least", "id"], "left_anti").select("bucket", F.col("id").alias("a"))
    small = entries.join(sizes.select("bucket"), "bucket", "left_anti")
    none = sizes.select("bucket", "n").where("n < 0")
    met = meet(rest, large.select("bucket", F.col("id").alias("b")), sizes.select("bucket", "n"), block).unionByName(
        meet(small.withColumnRenamed("id", "a"), small.withColumnRenamed("id", "b"), none, block)
    )
    pairs = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return led.select("a", "b").unionByName(verified(pairs, looks, max_distance).select("a", "b"))
