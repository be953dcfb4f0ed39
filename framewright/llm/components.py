"""Consolidating pairwise matches into groups (problem 5): seed-tree pruning.

Every vertex proposes the smallest vertex of its neighbourhood to that neighbourhood. Vertices
that nobody proposed drop out and hang under the smallest proposal they got (the propagation
forest); the proposed ones are linked among each other and go on. When no links are left, the
survivors are the seeds, and their identifiers flow down the forest, youngest level first.

All state is in DataFrames; the driver only sees whether links are left. A hub's rows are
reduced by partial aggregation or split by the skew join of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.normal import hash_text, strip
from framewright.session import stored


SEEDS = (1, 2, 3, 4)


def star_links(members: DataFrame, group: str, member: str) -> DataFrame:
    """Links (a, b) from the smallest member of each group to the others: n - 1, not n²."""
    rows = members.select(
        F.col(group).alias("_g"), F.col(member).alias("b")
    ).where("_g IS NOT NULL AND b IS NOT NULL")
    least = rows.groupBy("_g").agg(F.min("b").alias("a"))
    return rows.join(least, "_g").where("a <> b").select("a", "b").distinct()


def _numbered(vertices: DataFrame) -> tuple[DataFrame, int] | None:
    """(vertex, id) and the seed of the ids, with a random-looking 64-bit id of its own for every vertex.

    Ids are hashes; that none is shared is checked, with another seed if one is. None if every
    seed fails, as it may from some billions of vertices on.
    """
    for seed in SEEDS:
        ids = stored(vertices.select("vertex", F.xxhash64(F.lit(seed), "vertex").alias("id")))
        if ids.groupBy("id").count().where("count > 1").isEmpty():
            return ids, seed
    return None


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex of `links`; root is the smallest vertex of its group.

    Links have no direction; repeated links and self-links are harmless (a vertex with only
    a self-link is its own root), links with a NULL end are left out, an empty table gives an
    empty result. Other columns are ignored. Strings compare by code point.

    The pruning runs on hashed ids: in the order of names, a chain of ascending names would keep
    all its vertices and square its links; in a random order a fixed share drops out each round.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(
        "u IS NOT NULL AND v IS NOT NULL"
    )
    vertices = ends.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    numbered = _numbered(vertices)
    if numbered is None:  # exact as well, only not protected against ordered chains
        ids = stored(vertices.select("vertex", F.col("vertex").alias("id")))
        number = lambda c: F.col(c)
    else:
        ids, seed = numbered
        number = lambda c: F.xxhash64(F.lit(seed), c)
    pruned = _seed_trees(ends.select(number("u").alias("u"), number("v").alias("v")))
    rooted = ids.join(pruned.withColumnRenamed("vertex", "id"), "id", "left").select(
        "vertex", F.coalesce("root", "id").alias("_seed")
    )
    least = rooted.groupBy("_seed").agg(F.min("vertex").alias("root"))
    return rooted.join(least, "_seed").select("vertex", "root")


def _seed_trees(ends: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex (u, v) that has a link to another; root is the group's seed."""
    active = stored(
        ends.where("u <> v")
        .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .distinct()
    )
    forest: list[DataFrame] = []
    while not active.isEmpty():
        proposal = active.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        proposed = stored(
            active.join(proposal, "u").select(F.col("v").alias("w"), "m")
            .unionByName(proposal.select(F.col("u").alias("w"), "m"))
            .distinct()
        )
        least = proposed.groupBy("w").agg(
            F.min("m").alias("parent"), F.max(F.col("m") == F.col("w")).alias("survives")
        )
        forest.append(stored(least.where(~F.col("survives")).select("w", "parent")))
        joined = proposed.join(least.select("w", "parent"), "w").where("m <> parent")
        active = stored(
            joined.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("parent").alias("v")), F.struct(F.col("parent").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .distinct()
        )
    rooted: DataFrame | None = None
    for level in reversed(forest):
        if rooted is None:
            rooted = level.select(F.col("w").alias("vertex"), F.col("parent").alias("root"))
            continue
        above = rooted.select(F.col("vertex").alias("parent"), F.col("root").alias("_root"))
        below = level.join(above, "parent", "left").select(
            F.col("w").alias("vertex"), F.coalesce("_root", "parent").alias("root")
        )
        rooted = stored(rooted.unionByName(below))
    if rooted is None:
        return active.select(F.col("u").alias("vertex"), F.col("v").alias("root"))  # no links: no rows
    seeds = rooted.select("root").distinct().select(F.col("root").alias("vertex"), "root")
    return rooted.unionByName(seeds)


def upload_name(c):
    """An upload's name with `/` and without blanks around; NULL if nothing is left."""
    name = strip(F.translate(c, "\\", "/"))
    return F.when(name != "", name)


def listed_uploads(groups: DataFrame) -> DataFrame:
    """(image_hash, upload): the uploads that rows of duplicate_groups name, one a row."""
    return groups.select(
        hash_text(F.col("image_hash")).alias("image_hash"),
        F.explode(F.split(F.translate("uploads", "\\", "/"), "\\s+")).alias("upload"),
    ).where("image_hash IS NOT NULL AND upload <> ''").distinct()


def upload_links(pairs: DataFrame, groups: DataFrame, max_distance: int = 10) -> DataFrame:
    """Links (a, b) between uploads of one picture, from both kinds of evidence.

    Pairs without a distance and groups without a hash link nothing.
    """
    near = pairs.where(F.col("distance") <= max_distance).select(
        upload_name(F.col("upload_a")).alias("a"), upload_name(F.col("upload_b")).alias("b")
    )
    return near.unionByName(star_links(listed_uploads(groups), "image_hash", "upload"))
