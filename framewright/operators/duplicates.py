"""Duplicate pictures (AGG-01..06, JN-01..03, ORD-02, ORD-08..11).

Uploads: (sha, folder, transaction_id, image_id, path, w0..w3), one row per upload; sha NULL means
the file could not be read. Reports work on distinct files, so exact copies never meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.bits import WORDS
from framewright.operators import segments
from framewright.operators.components import connected_components
from framewright.operators.ranks import bucketed_row_number
from framewright.session import stored

NEAR = 10  # bits of 256 up to which two pictures are the same
BLOCK = 2_048  # files of a block where all pairs are compared
SIDE = 16  # blocks of a partition that meets another
ROWS = 16  # files that are compared with a block at a time


def least_words() -> Column:
    """The smallest words of a group's rows that have any; NULL if none has."""
    return F.min(F.when(F.col(WORDS[0]).isNotNull(), F.struct(*WORDS)))


def upload_name(prefix: str = "") -> Column:
    return F.concat(
        F.col(f"{prefix}folder"), F.lit("/"), F.col(f"{prefix}transaction_id").cast("string"),
        F.lit("_"), F.col(f"{prefix}image_id"),
    )


def distinct_files(uploads: DataFrame) -> DataFrame:
    """One row per sha: sha, copies, first (struct of the first upload in folder and file order),
    w0..w3 (the smallest of the uploads that have any, should they differ)."""
    order = F.struct("folder", "path", "transaction_id", "image_id")
    return (
        uploads.where("sha IS NOT NULL")
        .groupBy("sha")
        .agg(F.count("*").alias("copies"), F.min(order).alias("first"), least_words().alias("_w"))
        .select("sha", "copies", "first", *[F.col(f"_w.{w}").alias(w) for w in WORDS])
    )


def looks_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, w0..w3) of the distinct fingerprints, named by their smallest file, and (id, sha) of every file that has one."""
    known = files.where(F.col("w0").isNotNull())
    looks = known.groupBy(*WORDS).agg(F.min("sha").alias("id"))
    return looks, known.join(looks, list(WORDS)).select("id", "sha")


def near_pairs(files: DataFrame, max_distance: int = NEAR) -> DataFrame:
    """(a, b, distance): every pair of distinct files a < b by sha, at most `max_distance` bits apart.

    Fingerprints are compared by segments (see `segments`), once for all files that share one; pairs of
    fingerprints are then spelt out as pairs of files, since the report asks for each.
    """
    looks, members = looks_of(files)
    one = members.select(F.col("id").alias("a"), F.col("sha").alias("_a"))
    two = members.select(F.col("id").alias("b"), F.col("sha").alias("_b"))
    apart = segments.all_pairs(looks, max_distance).join(one, "a").join(two, "b")
    same = one.join(two, F.col("a") == F.col("b")).where("_a < _b").withColumn("distance", F.lit(0))
    both = apart.select("_a", "_b", "distance").unionByName(same.select("_a", "_b", "distance"))
    return both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "distance")


def near_links(files: DataFrame, max_distance: int = NEAR) -> DataFrame:
    """(a, b): links between files that tie the same groups as `near_pairs`, at a cost that follows the files."""
    looks, members = looks_of(files)
    same = members.where("sha <> id").select(F.col("id").alias("a"), F.col("sha").alias("b"))
    return segments.links(looks, max_distance).unionByName(same)


def _packed(files: DataFrame, blocks: int) -> DataFrame:
    """(block, words, folders, ends, shas): one row per block of files, which are ordered by folder and sha.

    words: four rows of 64-bit words, one after the other. The files of folders[n] end before ends[n].
    """

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(pdf["folder"], use_na_sentinel=False)
        order = np.lexsort((pdf["sha"].to_numpy(dtype=object), code))
        words = pdf[list(WORDS)].to_numpy(dtype="int64")[order]
        return pd.DataFrame({
            "block": [key[0]], "words": [np.ascontiguousarray(words.T).tobytes()], "folders": [[None if pd.isna(x) else x for x in names]],
            "ends": [np.cumsum(np.bincount(code)).astype("int32")], "shas": [pdf["sha"].to_numpy()[order]],
        })

    keyed = files.where(F.col("w0").isNotNull()).select(
        "sha", F.col("first.folder").alias("folder"), *WORDS,
        F.pmod(F.xxhash64("sha"), F.lit(blocks)).cast("int").alias("block"),
    )
    return stored(keyed.groupBy("block").applyInPandas(
        pack, "block int, words binary, folders array<string>, ends array<int>, shas array<string>"
    ))


def block_pairs(files: DataFrame, max_distance: int, histogram: bool, block: int = BLOCK) -> DataFrame:
    """All pairs of distinct files, block against block, in numpy.

    histogram: (distance, pairs_same_folder, pairs_cross_folder) of every pair. Else (a, b, distance) up
    to `max_distance`. Blocks have about `block` files whatever their number. They are packed into one row each, and
    partitions of at most about SIDE such rows meet as a Cartesian product, which reads the blocks again for each
    partner and writes no copies of them; no pair leaves a task but as a count or a hit. The work is quadratic, as the
    report asks for every pair.
    """
    blocks = max(1, -(-files.where(F.col("w0").isNotNull()).count() // block))
    held = _packed(files, blocks)
    sides = max(-(-blocks // SIDE), min(blocks, 8))
    names = ("block", "words", "folders", "ends") if histogram else ("block", "words")
    left, right = (held.select(*names).repartition(sides).select(*[F.col(c).alias(f"{c}_{x}") for c in names]) for x in "ij")
    i, j = F.col("block_i"), F.col("block_j")
    once = (i == j) | ((i < j) == ((i + j) % 2 == 0))  # one of (i, j) and (j, i), evenly from both triangles
    met = left.join(right.hint("shuffle_replicate_nl"), once)
    if histogram:
        out = met.mapInPandas(_counted, "distance int, pairs_same_folder long, pairs_cross_folder long")
        return out.groupBy("distance").agg(
            F.sum("pairs_same_folder").alias("pairs_same_folder"), F.sum("pairs_cross_folder").alias("pairs_cross_folder")
        )
    hits = met.mapInPandas(lambda rows: _hits(rows, max_distance), "block_i int, at_i int, block_j int, at_j int, distance int")
    ids = held.select("block", F.posexplode("shas").alias("at", "sha"))
    for x in "ij":
        hits = hits.join(ids.select(F.col("block").alias(f"block_{x}"), F.col("at").alias(f"at_{x}"), F.col("sha").alias(f"sha_{x}")), [f"block_{x}", f"at_{x}"])
    return hits.select(F.least("sha_i", "sha_j").alias("a"), F.greatest("sha_i", "sha_j").alias("b"), "distance")


def _unpacked(words: bytes) -> np.ndarray:
    return np.frombuffer(words, dtype="uint64").reshape(4, -1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Different bits of each column of x with each of y, modulo 256 (they are 256 only for opposites)."""
    out = np.bitwise_count(x[0][:, None] ^ y[0])
    for one, two in zip(x[1:], y[1:], strict=True):
        out += np.bitwise_count(one[:, None] ^ two)
    return out


def _counted(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    same, every = np.zeros(257, "int64"), np.zeros(257, "int64")

    def count(into: np.ndarray, d: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        n = np.bincount(d.ravel(), minlength=256)
        opposite = int(((d == 0) & (np.bitwise_count(x[0][:, None] ^ y[0]) == 64)).sum()) if n[0] else 0
        into[:256] += n
        into[0] -= opposite
        into[256] += opposite

    for pdf in rows:
        for r in pdf.itertuples(index=False):
            x, y = _unpacked(r.words_i), _unpacked(r.words_j)
            begins = dict(zip(r.folders_j, zip([0, *r.ends_j[:-1]], r.ends_j, strict=True), strict=True))
            one, all_ = np.zeros(257, "int64"), np.zeros(257, "int64")
            low = 0
            for folder, end in zip(r.folders_i, r.ends_i, strict=True):
                a, b = begins.get(folder, (0, 0))
                for k in range(low, end, ROWS):
                    part = x[:, k : min(k + ROWS, end)]
                    d = _apart(part, y)
                    count(all_, d, part, y)
                    if a < b:
                        count(one, d[:, a:b], part, y[:, a:b])
                low = end
            if r.block_i == r.block_j:  # every pair was met twice, and each file met itself
                for n in (one, all_):
                    n[0] -= x.shape[1]
                    n //= 2
            same += one
            every += all_
    seen = np.flatnonzero(every)
    yield pd.DataFrame({"distance": seen, "pairs_same_folder": same[seen], "pairs_cross_folder": (every - same)[seen]})


def _hits(rows: Iterator[pd.DataFrame], max_distance: int) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        for r in pdf.itertuples(index=False):
            x, y = _unpacked(r.words_i), _unpacked(r.words_j)
            for k in range(0, x.shape[1], ROWS):
                part = x[:, k : k + ROWS]
                few = np.flatnonzero(_apart(part[:2], y[:2]) <= max_distance)  # half of the words rule out most
                at, to = np.divmod(few, y.shape[1])
                d = np.bitwise_count(part[:, at] ^ y[:, to]).sum(axis=0, dtype="int64")
                near = (d <= max_distance) & ((r.block_i != r.block_j) | (k + at < to))
                if near.any():
                    yield pd.DataFrame({
                        "block_i": r.block_i, "at_i": k + at[near], "block_j": r.block_j, "at_j": to[near], "distance": d[near],
                    })


def distance_histogram(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs per distance, within and across the folders of the files' first uploads."""
    return block_pairs(files, 0, True, block)


def close_pairs(files: DataFrame, review_distance: int = 40, max_distance: int = NEAR, block: int = BLOCK) -> DataFrame:
    """(distance, duplicate, upload_a, upload_b) of every pair up to `review_distance`, named by first uploads.

    Both ways give every pair: segments of 16 bits or more select well, shorter ones don't, and then block meets block.
    """
    selective = 256 // (review_distance + 1) >= 16
    pairs = near_pairs(files, review_distance) if selective else block_pairs(files, review_distance, False, block)
    named = files.select("sha", "first.*").select("sha", upload_name().alias("name"))
    return (
        pairs.join(named.select(F.col("sha").alias("a"), F.col("name").alias("upload_a")), "a")
        .join(named.select(F.col("sha").alias("b"), F.col("name").alias("upload_b")), "b")
        .select("distance", (F.col("distance") <= max_distance).alias("duplicate"), "upload_a", "upload_b")
    )


def file_groups(files: DataFrame, max_distance: int | None = NEAR) -> DataFrame:
    """(sha, root): the group of every distinct file; root is its smallest sha.

    Groups are transitive. max_distance None groups byte-identical files only.
    """
    if max_distance is None:
        return files.select("sha", F.col("sha").alias("root"))
    tied = connected_components(near_links(files, max_distance))
    return files.select("sha").join(tied.withColumnRenamed("vertex", "sha"), "sha", "left").select(
        "sha", F.coalesce("root", "sha").alias("root")
    )


def group_rows(uploads: DataFrame, groups: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """One row per picture uploaded at least twice: image_hash (16 characters of the smallest sha), copies,
    kind, max_distance, folders, cross_folder, uploads (names by folder, transaction, side, path).

    spread: (root, max_distance) of groups of several files; others have 0.
    """
    tied = uploads.where("sha IS NOT NULL").join(groups, "sha")
    by = tied.groupBy("root").agg(
        F.count("*").alias("copies"),
        F.count_distinct("sha").alias("_files"),
        F.min("sha").alias("_least"),
        F.array_sort(F.collect_set("folder")).alias("_folders"),
        F.array_sort(F.collect_list(F.struct("folder", "transaction_id", "image_id", "path"))).alias("_uploads"),
    ).where("copies > 1")
    if spread is not None:
        by = by.join(spread, "root", "left")
    else:
        by = by.withColumn("max_distance", F.lit(None).cast("int"))
    return by.select(
        F.substring("_least", 1, 16).alias("image_hash"),
        "copies",
        F.when(F.col("_files") == 1, "exact").otherwise("near").alias("kind"),
        F.coalesce("max_distance", F.lit(0)).alias("max_distance"),
        F.array_join("_folders", " ").alias("folders"),
        (F.size("_folders") > 1).alias("cross_folder"),
        F.array_join(
            F.transform("_uploads", lambda u: F.concat(u["folder"], F.lit("/"), u["transaction_id"].cast("string"), F.lit("_"), u["image_id"])), " "
        ).alias("uploads"),
    )


def group_spread(files: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(root, max_distance): the largest distance inside each group of several looks.

    The report's column is a maximum over all pairs of a group. Equal looks count once; a group of
    more than `block` looks is compared block against block, in as many tasks.
    """
    looks = files.join(groups, "sha").select("root", *WORDS).distinct()
    several = looks.groupBy("root").agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    placed = (
        looks.join(several.select("root", blocks.alias("_blocks")), "root")
        .withColumn("_block", F.pmod(F.xxhash64(*WORDS), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("root", *WORDS, "_block", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"))
    )

    def widest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        root, i, j = key
        x = pdf.loc[pdf["_block"] == i, list(WORDS)].to_numpy(dtype="int64").view("uint64")
        y = pdf.loc[pdf["_block"] == j, list(WORDS)].to_numpy(dtype="int64").view("uint64")
        most = max((int(np.bitwise_count(a ^ y).sum(axis=1, dtype="int64").max(initial=0)) for a in x), default=0)
        return pd.DataFrame({"root": [root], "max_distance": [most]})

    each = placed.groupBy("root", "i", "j").applyInPandas(widest, "root string, max_distance int")
    return each.groupBy("root").agg(F.max("max_distance").alias("max_distance"))


def folder_summary(uploads: DataFrame, groups: DataFrame, folders: DataFrame) -> DataFrame:
    """folder, zips, distinct_exact, distinct_near, unreadable; a row of zeros for an empty folder."""
    tied = uploads.join(groups, "sha", "left")
    counts = tied.groupBy("folder").agg(
        F.count("*").alias("zips"),
        F.count_distinct("sha").alias("distinct_exact"),
        F.count_distinct("root").alias("distinct_near"),
        F.count_if(F.col("sha").isNull()).alias("unreadable"),
    )
    return folders.select("folder").distinct().join(counts, "folder", "left").na.fill(0)


def greedy_distinct_sample(
    files: DataFrame, k: int, order: str, max_distance: int = NEAR, group: str = "folder"
) -> DataFrame:
    """Per group the first k files, by `order`, that are not near one already taken; adds `taken` from 0.

    files: group, sha, order (a number; equal numbers go by sha), w0..w3. A sha counts once, at its
    lowest order. The result depends on the order and is not transitive. Groups may have any
    size: candidates come in slices of the order, and further slices are read only for groups
    that are not full. A file without words is only compared by sha.
    """
    names = [group, "sha", order, *WORDS, "_rank"]
    if k <= 0:
        return files.select(*names[:-1]).limit(0).withColumn("taken", F.lit(0).cast("long"))
    once = files.where("sha IS NOT NULL").groupBy(group, "sha").agg(
        F.min(order).alias(order), least_words().alias("_w")
    ).select(group, "sha", order, *[F.col(f"_w.{w}").alias(w) for w in WORDS])
    low, high = once.agg(F.min(order).cast("double"), F.max(order).cast("double")).first()
    width = 1.0 if low is None or high <= low else (high - low) / 256
    bucket = F.coalesce(F.floor((F.col(order).cast("double") - F.lit(low or 0.0)) / width), F.lit(-1))
    ranked = stored(bucketed_row_number(once, [group], [order, "sha"], bucket, "_rank").select(*names))

    def take(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank").reset_index(drop=True)
        known = pdf[list(WORDS)].notna().all(axis=1).to_numpy()
        words = np.array([[0 if pd.isna(x) else int(x) for x in row] for row in pdf[list(WORDS)].to_numpy(dtype=object)], dtype="int64").reshape(-1, 4).view("uint64")
        kept: list[int] = []
        for n in range(len(pdf)):
            if len(kept) == k:
                break
            others = [m for m in kept if known[m]]
            if known[n] and others and (np.bitwise_count(words[n] ^ words[others]).sum(axis=1, dtype="int64") <= max_distance).any():
                continue
            kept.append(n)
        return pdf.iloc[kept][names]

    last = ranked.groupBy(group).agg(F.max("_rank").alias("_last"))
    upto, size = 0, 4 * k + 64
    taken: DataFrame | None = None
    while True:
        part = ranked.where((F.col("_rank") >= upto) & (F.col("_rank") < upto + size))
        if taken is not None:
            full = taken.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= k)
            part = part.join(full, group, "left_anti").unionByName(taken)
        taken = stored(part.groupBy(group).applyInPandas(take, ranked.schema))
        upto, size = upto + size, 2 * size
        counts = taken.groupBy(group).agg(F.count("*").alias("_n"))
        if last.where(F.col("_last") >= upto).join(counts, group).where(F.col("_n") < k).isEmpty():
            break
    return bucketed_row_number(taken, [group], ["_rank"], F.lit(0), "taken").drop("_rank")
