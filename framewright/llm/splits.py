"""Splits that keep related records together (problem 6): grouped iterative stratification.

Records that share a transaction, or whose transactions share a picture, form a component. The
label vectors of components are aggregated; components go, rarest outstanding label first,
into the split that needs that label most.

A component is filed under its globally rarest label, and labels are placed one after the other, rarest first. Of a
label's components those that hold at least 1/LARGE of it (so at most LARGE) are placed singly, largest first, each
into the split that needs the label most. The others stand in a random order with running totals of the label; the
splits' remaining needs cut these totals into intervals, and a component goes where its middle lies. The
driver holds needs per split and label and the large components of one label; both are bounded by the taxonomy.
Components are never divided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.normal import document_type, issuing_country
from framewright.llm.components import connected_components, listed_uploads, star_links
from framewright.operators.ranks import bucketed_running_sum, hash_bucket
from framewright.session import scratch, stored

LARGE = 128  # a component with this part of its label is placed singly
MAX_LABELS = 10_000  # 7 types x 678 countries are possible
MAX_SPLITS = 1000  # rows of the targets table that the driver takes


def tied_transactions(groups: DataFrame) -> DataFrame:
    """(vertex, root) of the transactions that share pictures, directly or through others."""
    members = listed_uploads(groups).select(
        "image_hash",
        F.regexp_extract("upload", "([0-9]+)_[^/]*$", 1).cast("long").alias("transaction_id"),
    )
    return connected_components(star_links(members, "image_hash", "transaction_id"))


def keep_together(images: DataFrame, groups: DataFrame) -> DataFrame:
    """(transaction_id, keep_with): for every transaction of `images` the smallest one of
    `images` in its component, itself if there is no other."""
    held = images.select("transaction_id").where("transaction_id IS NOT NULL").distinct()
    tied = tied_transactions(groups)
    rows = held.join(tied, held["transaction_id"] == tied["vertex"], "left").select(
        "transaction_id", F.coalesce("root", "transaction_id").alias("_root")
    )
    least = rows.groupBy("_root").agg(F.min("transaction_id").alias("keep_with"))
    return rows.join(least, "_root").select("transaction_id", "keep_with")


class Placement:
    """What the splits still need of every label; `shares` add up to 1."""

    def __init__(self, shares: dict[str, float], totals: dict[str, int]):
        self.shares = shares
        self.need = {s: {x: share * n for x, n in totals.items()} for s, share in shares.items()}
        self.room = {s: share * sum(totals.values()) for s, share in shares.items()}

    def take(self, split: str, labels: dict[str, int]) -> None:
        for label, n in labels.items():
            self.need[split][label] -= n
            self.room[split] -= n

    def place(self, label: str, labels: dict[str, int]) -> str:
        """One component, into the split that needs the label most (then the one with most room)."""
        split = max(self.shares, key=lambda s: (self.need[s][label], self.room[s], s))
        self.take(split, labels)
        return split

    def intervals(self, label: str, amount: int) -> list[tuple[str, float, float]]:
        """(split, from, to): 0 to `amount` of a label cut by what the splits need of it; the last has no end."""
        needs = {s: max(0.0, self.need[s][label]) for s in sorted(self.shares)}
        whole = sum(needs.values())
        if whole <= 0:
            needs, whole = dict(self.shares), 1.0
        out, at = [], 0.0
        for s, n in needs.items():
            if n > 0:
                out.append((s, at, at + amount * n / whole))
                at = out[-1][2]
        out[-1] = (*out[-1][:2], float("inf"))
        return out


def grouped_splits(images: DataFrame, groups: DataFrame, targets: DataFrame, large: int = LARGE) -> DataFrame:
    """(transaction_id, image_id, keep_with, split_name), one row per distinct image.

    images: transaction_id, image_id, document_type, issuing_country. targets: split_name,
    target_share, of a fixed small number of rows; shares are normalised, NULL shares are 0.
    An image with several labels counts in each; labels outside the taxonomy form one class.
    Images without a transaction_id are left out, a NULL image_id is an image like others.
    """
    spark = images.sparkSession
    rows = targets.where("split_name IS NOT NULL").limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} split targets")
    shares = {r["split_name"]: float(r["target_share"] or 0) for r in rows}
    total = sum(shares.values())
    if total <= 0:
        raise ValueError("split targets must have a positive share")
    shares = {s: x / total for s, x in shares.items()}
    label = F.concat_ws(
        "/",
        F.coalesce(document_type(F.col("document_type")), F.lit("?")),
        F.coalesce(issuing_country(F.col("issuing_country")), F.lit("?")),
    )
    rows = (
        images.where("transaction_id IS NOT NULL")
        .select("transaction_id", "image_id", label.alias("label"))
        .distinct()
    )
    kept = stored(keep_together(images, groups))
    counts = rows.join(kept, "transaction_id").groupBy("keep_with", "label").agg(F.count("*").alias("n"))
    # one row per component: labels of a component are bounded by the taxonomy
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    sizes = F.broadcast(spark.createDataFrame(list(totals.items()), "label string, total long"))  # <= MAX_LABELS
    vectors = counts.join(sizes, "label").groupBy("keep_with").agg(
        F.min(F.struct("total", "label", "n")).alias("rarest"),
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels"),
    )
    order = F.xxhash64("keep_with")
    filed = vectors.select(
        "keep_with", "labels", F.col("rarest.label").alias("filed_under"), F.col("rarest.n").alias("n"), order.alias("_o"),
        (F.col("rarest.n") * large >= F.col("rarest.total")).alias("single"),
    )
    placed = bucketed_running_sum(filed, ["filed_under", "single"], ["_o", "keep_with"], hash_bucket(F.col("_o"), 12), "n")
    path = scratch(spark, "filed")
    placed.drop("_o").write.partitionBy("filed_under").parquet(path)
    filed = spark.read.schema("keep_with long, labels map<string,bigint>, n long, single boolean, before long, filed_under string").parquet(path)
    state = Placement(shares, totals)
    where_to: list[tuple] = []
    for label in sorted(totals, key=lambda x: (totals[x], x)):
        own = filed.where(F.col("filed_under") == label)  # reads this label's files only
        singles = own.where("single").select("keep_with", "labels", "n").collect()  # at most `large`
        for r in sorted(singles, key=lambda r: (-r["n"], r["keep_with"])):
            where_to.append((label, True, state.place(label, r["labels"]), r["keep_with"], 0.0, 0.0))
        rest = own.where("NOT single").withColumn("_middle", F.col("before") + F.col("n") / 2)
        amount = rest.agg(F.sum("n")).first()[0]
        if not amount:
            continue
        cuts = state.intervals(label, amount)
        where_to += [(label, False, s, 0, low, high) for s, low, high in cuts]
        choice = F.coalesce(*[F.when(F.col("_middle") < high, F.lit(s)) for s, _, high in cuts])
        taken = rest.select(choice.alias("s"), F.explode("labels").alias("label", "n")).groupBy("s", "label").agg(F.sum("n").alias("n"))
        for r in taken.collect():  # splits x labels
            state.take(r["s"], {r["label"]: r["n"]})
    # rules: at most `large` + splits rows per label of the taxonomy
    rules = spark.createDataFrame(where_to, "filed_under string, single boolean, split_name string, _keep long, _low double, _high double")
    middle = F.col("before") + F.col("n") / 2
    ruled = filed.select("filed_under", "single", "keep_with", middle.alias("_middle")).join(F.broadcast(rules), ["filed_under", "single"]).where(
        F.when(F.col("single"), F.col("keep_with") == F.col("_keep")).otherwise((F.col("_middle") >= F.col("_low")) & (F.col("_middle") < F.col("_high")))
    )
    return (
        rows.select("transaction_id", "image_id").distinct()
        .join(kept, "transaction_id")
        .join(ruled.select("keep_with", "split_name"), "keep_with")
        .select("transaction_id", "image_id", "keep_with", "split_name")
    )


def split_report(assigned: DataFrame) -> DataFrame:
    """Rows and share of rows per split."""
    counts = assigned.groupBy("split_name").agg(F.count("*").alias("images"))
    whole = Window.partitionBy()  # over the few splits, not over rows
    return counts.withColumn("share", F.col("images") / F.sum("images").over(whole))
