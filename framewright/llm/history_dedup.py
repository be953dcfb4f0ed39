"""Deduplicating new batches against all history (problem 4): a segment index.

A fingerprint of 256 bits is cut into a fixed number of segments at fixed positions, three more
than the `max_distance` bits that may differ; two fingerprints within that distance so agree
in three segments at least. The index holds (position, segment) -> fingerprint, and a new
fingerprint is compared only with those it shares a segment with. Edit distance here means
substitutions of bits, as the strings have one fixed length, so the substring to probe stands
at the segment's own position. The compare is exact; the load is appended afterwards.

`SegmentIndex` lies on disk: `hashes` and `prints` of what was accepted and `entries` of the segments. A
load is normalised, cut and compared by itself; of the history only entries in the load's buckets and prints
among the candidates leave the scan, and no row of the history is shuffled for a load of up to SMALL rows. One manifest names
the parts of all three tables, so a load is in the index as a whole or not at all.

Only distinct fingerprints are indexed, with the first batch that brought them, so exact copies
cost nothing. Buckets of very many different fingerprints are treated without loss:

* every member is first compared with the bucket's earliest one (linear). Who is near it has
  its match and asks no further; this takes in families of re-saved pictures;
* for the rest a bucket is cut by a second and a third equal segment, of which there must be
  some by the above;
* what is still large then is compared block against block, in as many tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.bits import WORDS, distance, segment_array, with_words
from framewright.functions.normal import fingerprint, hash_text, key_text
from framewright.operators.segments import meet
from framewright.session import released, stored
from framewright.sources.storage import ParquetTables

MAX_DISTANCE = 10
SPARE = 2  # segments beyond the pigeonhole's number: levels at which a bucket can be cut
LEADER = 32  # entries of a bucket above which members meet its earliest one first
HOT = 1_000  # entries of a bucket above which it is cut further
SMALL = 200_000  # rows up to which a side is broadcast; they are counted first
WAVES = 4  # a backfill of many loads: each wave at most doubles the index
MAX_LOADS = 8_000  # versions of an index, and loads of one backfill
EARLIER = -(2**31)  # the batch of everything accepted before


def position(segment: str) -> Column:
    return F.shiftrightunsigned(F.col(segment), 56)


def hash_bytes(c: Column) -> Column:
    """The normal form of an image_hash in half the space; other texts than hex keep a mark."""
    text = hash_text(c)
    return F.when(text.rlike("^[0-9a-f]{64}$"), F.unhex(text)).otherwise(
        F.concat(F.lit(b"\0"), F.encode(text, "UTF-8"))
    )


def fetched(images: DataFrame) -> DataFrame:
    """(id, batch_no, image_hash, w0..w3) of fetched images with a batch, hashes in normal form, one row per id and content."""
    rows = images.where((key_text(F.col("fetch_status")) == "ok") & F.col("batch_no").isNotNull()).select(
        "id", "batch_no",
        hash_bytes(F.col("image_hash")).alias("image_hash"),
        fingerprint(F.col("perceptual_hash")).alias("_p"),
    )
    return with_words(rows, "_p").drop("_p")


def index_entries(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(bucket, print_id, first_batch): an entry per segment of each fingerprint.

    The high bits of a bucket are the position of its last segment.
    """
    return prints.select(
        F.explode(segment_array(max_distance + 1 + SPARE)).alias("bucket"), "print_id", "first_batch"
    )


def _deeper(entries: DataFrame, prints: DataFrame, max_distance: int) -> DataFrame:
    """Entries of the next level: a bucket cut by each segment behind its last position."""
    rows = entries.join(prints.select("print_id", *WORDS), "print_id")
    return (
        rows.withColumn("_s", segment_array(max_distance + 1 + SPARE))
        .select("bucket", "print_id", "first_batch", F.explode("_s").alias("_s"))
        .where(position("_s") > position("bucket"))
        .select(
            F.xxhash64("bucket", "_s").bitwiseAND(F.lit((1 << 56) - 1))
            .bitwiseOR(F.shiftleft(position("_s"), 56)).alias("bucket"),
            "print_id", "first_batch",
        )
    )


def _sized(df: DataFrame) -> DataFrame:
    """A stored table, with the hint to broadcast it if it has at most SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _met(fresh: DataFrame, known: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(new_id, old_id) of entries in one bucket, the old one of a lower batch; buckets of `sizes` in blocks."""
    left = fresh.select("bucket", F.col("print_id").alias("new_id"), F.col("first_batch").alias("_new"))
    right = known.select("bucket", F.col("print_id").alias("old_id"), F.col("first_batch").alias("_old"))
    both = left.join(right, "bucket") if sizes is None else meet(left, right, sizes, HOT)
    return both.where("_old < _new").select("new_id", "old_id")


def _verified(pairs: DataFrame, new: DataFrame, old: DataFrame, max_distance: int) -> DataFrame:
    """(print_id) of the new fingerprints in candidate pairs (new_id, old_id) that are near."""
    a = new.select(F.col("print_id").alias("new_id"), *[F.col(w).alias(f"a{w}") for w in WORDS])
    b = old.select(F.col("print_id").alias("old_id"), *[F.col(w).alias(f"b{w}") for w in WORDS])
    asked = _sized(stored(pairs.distinct()))
    near = b.join(asked, "old_id").join(a, "new_id").where(distance("a", "b") <= max_distance)
    return near.select(F.col("new_id").alias("print_id")).distinct()


def probe(
    fresh: DataFrame, known: DataFrame, new: DataFrame, old: DataFrame,
    max_distance: int = MAX_DISTANCE, hot: int = HOT, leader: int = LEADER,
) -> DataFrame:
    """(print_id) of the fingerprints of `new` near one of `old` with a lower first batch.

    fresh, known: entries of `new` and those entries of `old` that lie in their buckets. new, old:
    print_id, w0..w3. print_id is unique in `old`, which holds `new` as well.
    """
    found: list[DataFrame] = []
    pairs: list[DataFrame] = []
    for level in range(SPARE + 1):
        sizes = known.groupBy("bucket").agg(F.count("*").alias("n"))
        large = stored(sizes.where(F.col("n") > leader))
        if large.isEmpty():
            pairs.append(_met(fresh, known))
            break
        keys = large.select("bucket")
        pairs.append(_met(fresh.join(keys, "bucket", "left_anti"), known))
        fresh, known = fresh.join(keys, "bucket", "left_semi"), known.join(keys, "bucket", "left_semi")
        first = known.groupBy("bucket").agg(F.min(F.struct("first_batch", "print_id")).alias("_first"))
        led = fresh.join(first, "bucket").where(
            F.col("_first.first_batch") < F.col("first_batch")
        ).select(F.col("print_id").alias("new_id"), F.col("_first.print_id").alias("old_id"))
        near = stored(_verified(led, new, old, max_distance))
        found.append(near)
        fresh = fresh.join(near, "print_id", "left_anti")
        hotter = large.where(F.col("n") > hot)
        if level == SPARE or hotter.isEmpty():
            pairs.append(_met(fresh, known, hotter))
            break
        cut = hotter.select("bucket")
        pairs.append(_met(fresh.join(cut, "bucket", "left_anti"), known))
        fresh = stored(_deeper(fresh.join(cut, "bucket", "left_semi"), new, max_distance))
        known = stored(_deeper(known.join(cut, "bucket", "left_semi"), old, max_distance))
    candidates = pairs[0]
    for more in pairs[1:]:
        candidates = candidates.unionByName(more)
    result = _verified(candidates, new, old, max_distance)
    for near in found:
        result = result.unionByName(near)
    return result.distinct()


class SegmentIndex:
    """The index on disk. `accept` takes a load: it tells which of its images history holds, and appends the rest."""

    TABLES = {
        "hashes": "image_hash binary",
        "prints": "print_id long, w0 long, w1 long, w2 long, w3 long",
        "entries": "bucket long, print_id long",
    }

    def __init__(self, spark: SparkSession, path: str, max_distance: int = MAX_DISTANCE, hot: int = HOT, leader: int = LEADER):
        self.spark, self.path, self.max_distance, self.hot, self.leader = spark, path, max_distance, hot, leader
        self.versions = ParquetTables(spark, path)

    def _read(self, name: str, parts: list[str]) -> DataFrame | None:
        own = [f"{self.path}/index/{p}" for p in parts if p.startswith(name)]
        return self.spark.read.schema(self.TABLES[name]).parquet(*own) if own else None

    def _write(self, name: str, df: DataFrame) -> str:
        part = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/index/{part}")
        return part

    def accept(self, load: DataFrame) -> DataFrame:
        """(id) of the load's images that earlier loads, or lower batches of this one, brought; the load is then in the index.

        load: as `seen_before` takes it. All of it counts as later than the index, whatever its batch numbers. If it
        fails nothing was added, and it may be given again; of two writers at once one is told by WriteConflict.
        """
        return self._take(stored(fetched(load)), True)

    def probe(self, load: DataFrame) -> DataFrame:
        """What `accept` would tell; nothing is added."""
        return self._take(stored(fetched(load)), False)

    def append(self, load: DataFrame) -> None:
        self._take(stored(fetched(load)), True)

    def _take(self, rows: DataFrame, keep: bool) -> DataFrame:
        version, parts = self.versions._manifest("index")
        if version >= MAX_LOADS:
            raise ValueError(f"an index of more than {MAX_LOADS} loads: build it anew")
        hashes, prints, entries = (self._read(name, parts) for name in self.TABLES)
        words = list(WORDS)
        looks = rows.where("w0 IS NOT NULL").groupBy(*words).agg(F.min("batch_no").cast("int").alias("first_batch"))
        # unique by construction: the version, the partition and the row in it
        number = F.monotonically_increasing_id() + F.lit(version << 50)
        looks = stored(looks.coalesce(1 << 17).withColumn("print_id", number))
        bytes_ = stored(rows.where("image_hash IS NOT NULL").groupBy("image_hash").agg(F.min("batch_no").alias("first_batch")))
        fresh, known_hashes, known_looks = looks, None, None
        if prints is not None:
            known_looks = stored(prints.select(*words).join(_sized(looks.select(*words)), words, "left_semi"))
            fresh = stored(looks.join(_sized(known_looks), words, "left_anti"))
        if hashes is not None:
            known_hashes = stored(hashes.join(_sized(bytes_.select("image_hash")), "image_hash", "left_semi"))
        part = self._write("entries", index_entries(fresh, self.max_distance).sortWithinPartitions("bucket"))
        own = self.spark.read.schema(f"{self.TABLES['entries']}, first_batch int").parquet(f"{self.path}/index/{part}")
        everything, met = fresh.select("print_id", *words), own
        if prints is not None:
            old = entries.join(_sized(own.select("bucket").distinct()), "bucket", "left_semi")
            met = stored(old.withColumn("first_batch", F.lit(EARLIER)).unionByName(own))
            everything = everything.unionByName(prints.select("print_id", *words))
        near = probe(own, met, fresh, everything, self.max_distance, self.hot, self.leader)
        # the earliest batch that holds a look or its like
        seen = looks.join(near.withColumn("_near", F.lit(True)), "print_id", "left").select(
            *words, F.when(F.col("_near"), EARLIER).otherwise(F.col("first_batch")).alias("_look")
        )
        if known_looks is not None:
            seen = seen.join(known_looks.withColumn("_known", F.lit(EARLIER)), words, "left").select(
                *words, F.coalesce("_known", "_look").alias("_look")
            )
        same = bytes_.select("image_hash", F.col("first_batch").alias("_bytes"))
        if known_hashes is not None:
            same = same.join(known_hashes.withColumn("_known", F.lit(EARLIER)), "image_hash", "left").select(
                "image_hash", F.coalesce("_known", "_bytes").alias("_bytes")
            )
        judged = rows.join(same, "image_hash", "left").join(seen, words, "left")
        found = stored(judged.where("batch_no > _bytes OR batch_no > _look").select("id").distinct())
        if keep:
            new_hashes = bytes_.select("image_hash")
            if known_hashes is not None:
                new_hashes = new_hashes.join(known_hashes, "image_hash", "left_anti")
            made = [self._write("hashes", new_hashes), self._write("prints", fresh.select("print_id", *words)), part]
            self.versions._commit("index", version, [*parts, *made])
        return found


def waves(counts: dict[int, int], number: int) -> list[tuple[int, int]]:
    """(first, last) batches of consecutive waves, each at most about as large as all before it."""
    total, done, out, first = sum(counts.values()), 0, [], None
    for batch in sorted(counts):
        first = batch if first is None else first
        done += counts[batch]
        if done >= total / 2 ** (number - 1 - len(out)) or batch == max(counts):
            out.append((first, batch))
            first = None
    return out


def seen_before(images: DataFrame, path: str, max_distance: int = MAX_DISTANCE, hot: int = HOT, leader: int = LEADER) -> DataFrame:
    """(id) of the fetched images of which an earlier batch brought the same bytes or, within
    `max_distance` bits, the same look.

    The loads go through an index at `path`, a folder that all executors share, in WAVES waves of consecutive loads;
    inside a wave lower batches count as earlier.

    images: id, batch_no, fetch_status, image_hash, perceptual_hash. Images without a batch are
    no cases and no history; without a fingerprint, or with one that is not hex, only the
    image_hash counts, and without both the image is no case. Repeated ids come out once.
    """
    spark = images.sparkSession
    rows = stored(fetched(images))
    counted = rows.groupBy("batch_no").count().limit(MAX_LOADS + 1).collect()  # one row per load
    if len(counted) > MAX_LOADS:
        raise ValueError(f"more than {MAX_LOADS} loads")
    index = SegmentIndex(spark, path, max_distance, hot, leader)
    found = rows.select("id").limit(0)
    for first, last in waves({r["batch_no"]: r["count"] for r in counted}, WAVES):
        with released() as keep:  # a wave leaves its answer and its part of the index
            found = found.unionByName(keep(index._take(rows.where(F.col("batch_no").between(first, last)), True)))
    return found.distinct()
