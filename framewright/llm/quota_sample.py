"""Sample matching target category proportions (problem 2): hierarchical allocation.

The categories form a tree: sample, document type, (document type, country). The sample size
is handed down the tree by target shares and minima. What a leaf can't supply goes first to
its siblings (same document type), then to its cousins (other types), in proportion to their
targets and up to what they hold. Leaves draw the images of lowest permuted dense rank.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.normal import document_type, issuing_country
from framewright.operators.ranks import bucketed_row_number, hash_bucket

MAX_TARGETS = 100_000  # rows of the targets table that the driver takes


def _shared_out(amount: int, room: dict, weight: dict) -> dict:
    """Whole parts of `amount` by weight, none above its room; largest remainders first."""
    given = dict.fromkeys(room, 0)
    while amount > 0:
        free = {k: weight[k] for k in room if given[k] < room[k]}
        if not free:
            break
        total = sum(free.values())
        shares = {k: amount * (w / total if total > 0 else 1 / len(free)) for k, w in free.items()}
        whole = {k: min(room[k] - given[k], math.floor(s)) for k, s in shares.items()}
        if not any(whole.values()):
            for k in sorted(free, key=lambda k: (math.floor(shares[k]) - shares[k], str(k)))[:amount]:
                whole[k] = 1
        for k, n in whole.items():
            given[k] += n
            amount -= n
    return given


def hand_down(size: int, weight: dict, least: dict) -> dict:
    """Whole parts of `size` for the children of one node: their minima first, the rest towards their shares."""
    total = sum(weight.values())
    ideal = {k: math.ceil(w / total * size) if total > 0 else 0 for k, w in weight.items()}
    gap = {k: max(0, ideal[k] - least[k]) for k in weight}
    extra = _shared_out(size - sum(least.values()), gap, gap)
    return {k: least[k] + extra[k] for k in weight}


def allocate(size: int, leaves: list[dict]) -> dict[tuple, dict]:
    """Allocation for one sample over the tree sample, document type, (document type, country).

    leaves: dicts of type, country, share, least (minimum or 0), held (images that can be drawn).
    Returns per (type, country): quota (what came down the tree), given. Minima come before shares; if they alone exceed
    the size, the sample grows to hold them. Unmet quota goes to siblings, then to cousins, as far as they hold images.
    """
    keys = [(x["type"], x["country"]) for x in leaves]
    of = dict(zip(keys, leaves, strict=True))
    share = {k: max(0.0, of[k]["share"] or 0.0) for k in keys}
    total = sum(share.values())
    wanted = round(size * min(1.0, total)) if total < 0.999 or total > 1.001 else size
    least = {k: max(0, of[k]["least"] or 0) for k in keys}
    by_type: dict[str, list] = defaultdict(list)
    for k in keys:
        by_type[k[0]].append(k)
    size = max(wanted, sum(least.values()))
    types = hand_down(
        size, {t: sum(share[k] for k in own) for t, own in by_type.items()}, {t: sum(least[k] for k in own) for t, own in by_type.items()}
    )
    quota: dict[tuple, int] = {}
    for t, own in by_type.items():
        quota |= hand_down(types[t], {k: share[k] for k in own}, {k: least[k] for k in own})
    given = {k: min(quota[k], of[k]["held"]) for k in keys}
    unmet = 0
    for t, own in by_type.items():  # siblings first
        short = types[t] - sum(given[k] for k in own)
        more = _shared_out(short, {k: of[k]["held"] - given[k] for k in own}, share)
        for k, n in more.items():
            given[k] += n
        unmet += short - sum(more.values())
    unmet += size - sum(types.values())
    more = _shared_out(unmet, {k: of[k]["held"] - given[k] for k in keys}, share)  # cousins
    return {k: {"quota": quota[k], "given": given[k] + more[k]} for k in keys}


def demand(share: float | None, size: int | None, least: int | None) -> int:
    """Images that a row of the targets asks of its category: its share of the size and its minimum."""
    return max(math.ceil((share or 0.0) * (size or 0)), least or 0)


def categorised(images: DataFrame) -> DataFrame:
    """Distinct (category_type, category_country, transaction_id, image_id) in the taxonomy.

    An image listed under several categories belongs to each; images without a key or with
    a label outside the taxonomy belong to none.
    """
    return (
        images.select(
            document_type(F.col("document_type")).alias("category_type"),
            issuing_country(F.col("issuing_country")).alias("category_country"),
            "transaction_id",
            "image_id",
        )
        .where(
            "category_type IS NOT NULL AND category_country IS NOT NULL "
            "AND transaction_id IS NOT NULL AND image_id IS NOT NULL"
        )
        .distinct()
    )


def drawable(images: DataFrame) -> DataFrame:
    """Each image of `categorised` once, in the rarest of its categories, so that no sample draws it twice."""
    rows = categorised(images)
    sizes = rows.groupBy("category_type", "category_country").agg(F.count("*").alias("_n"))  # the taxonomy
    best = rows.join(F.broadcast(sizes), ["category_type", "category_country"]).groupBy("transaction_id", "image_id").agg(
        F.min(F.struct("_n", "category_type", "category_country")).alias("_c")
    )
    return best.select("_c.category_type", "_c.category_country", "transaction_id", "image_id")


def allocation(images: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per row of `targets`: its keys, target_share, min_count, wanted (share x size,
    unrounded), available (images of the category), quota (what came down the tree), allocated (what is drawn), unmet
    (images that the row asks for and the category lacks).

    Categories are compared in taxonomy spelling and kept as `targets` spells them; repeated
    rows of `targets` count once. Targets outside the taxonomy have nothing available.
    """
    spark = images.sparkSession
    category = ["category_type", "category_country"]
    listed = categorised(images).groupBy(*category).agg(F.count("*").alias("available"))
    free = drawable(images).groupBy(*category).agg(F.count("*").alias("free"))
    held = listed.join(free, category, "left")  # at most the taxonomy
    wants = targets.select(
        "sample_name", F.col("sample_size").cast("long").alias("sample_size"), "document_type",
        "issuing_country", F.col("target_share").cast("double").alias("target_share"),
        F.col("min_count").cast("long").alias("min_count"),
        document_type(F.col("document_type")).alias("category_type"),
        issuing_country(F.col("issuing_country")).alias("category_country"),
    ).distinct()
    rows = wants.join(held, ["category_type", "category_country"], "left").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} sample targets")
    samples: dict[str, list] = defaultdict(list)
    for r in rows:
        samples[r["sample_name"]].append(r)
    out = []
    for name, own in samples.items():
        size = max(r["sample_size"] or 0 for r in own)
        merged: dict[tuple, dict] = {}
        for r in own:  # spellings of one category are one leaf
            key = (r["category_type"], r["category_country"])
            leaf = merged.setdefault(key, {"type": key[0], "country": key[1], "share": 0.0, "least": 0, "held": r["free"] or 0})
            leaf["share"] += r["target_share"] or 0.0
            leaf["least"] = max(leaf["least"], r["min_count"] or 0)
        plan = allocate(size, list(merged.values()))
        for r in own:
            got = plan[r["category_type"], r["category_country"]]
            out.append((
                name, r["sample_size"], r["document_type"], r["issuing_country"],
                r["category_type"], r["category_country"], r["target_share"], r["min_count"],
                (r["target_share"] or 0.0) * (r["sample_size"] or 0), r["available"] or 0,
                got["quota"], got["given"], max(0, demand(r["target_share"], r["sample_size"], r["min_count"]) - (r["available"] or 0)),
            ))
    return spark.createDataFrame(
        out,
        "sample_name string, sample_size long, document_type string, issuing_country string, "
        "category_type string, category_country string, target_share double, min_count long, "
        "wanted double, available long, quota long, allocated long, unmet long",
    )


def unfilled(plan: DataFrame) -> DataFrame:
    """The rows of `allocation` of which the images hold fewer than share or minimum ask."""
    return plan.where("unmet > 0")


def quota_sample(images: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(sample_name, document_type, issuing_country, transaction_id, image_id, draw) of the
    drawn images, in taxonomy spelling. draw is the permuted dense rank from 0.

    One permutation serves all samples, so draws of a category are nested.
    """
    plan = allocation(images, targets).where("category_type IS NOT NULL AND category_country IS NOT NULL")
    plan = plan.groupBy("sample_name", "category_type", "category_country").agg(
        F.max("allocated").alias("allocated")
    )
    pool = drawable(images).withColumn(
        "_order", F.xxhash64(F.lit(seed), "transaction_id", "image_id")
    )
    ranked = bucketed_row_number(
        pool, ["category_type", "category_country"], ["_order", "transaction_id", "image_id"],
        hash_bucket(F.col("_order")), "draw",
    )
    drawn = ranked.join(F.broadcast(plan), ["category_type", "category_country"])  # <= MAX_TARGETS
    return drawn.where(F.col("draw") < F.col("allocated")).select(
        "sample_name",
        F.col("category_type").alias("document_type"),
        F.col("category_country").alias("issuing_country"),
        "transaction_id",
        "image_id",
        "draw",
    )
