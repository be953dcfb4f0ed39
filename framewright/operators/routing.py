"""Voting and routing of an ensemble's predictions (AGG-07..11, AGG-21, JN-04, PRJ-12, PRJ-13, §2.6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names of review reasons.
LOW_CONFIDENCE, UNKNOWN_COUNTRY, DISAGREEMENT = "low_confidence", "unknown_country", "disagreement"
MULTIPLE_DOCUMENTS, NO_DOCUMENT, FETCH_FAILED = "multiple_documents", "no_document", "fetch_failed"
FIELDS = ("document_type", "issuing_country", "document_side")
EXACT = "decimal(18,9)"  # confidences are summed exactly, so that partitioning can't change a mean


@dataclass(frozen=True)
class RoutingConfig:
    """Settings of routing; unknown keys raise."""

    confidence_threshold: float = 0.8

    def describe(self) -> str:
        """What a router row states as its model version."""
        return f"threshold={self.confidence_threshold}"


def majority(counts: Column) -> Column:
    """The most frequent value of MAP<value, n>; NULL if two share the first place or there is none."""
    entries = F.filter(F.map_entries(counts), lambda e: e["key"] != "")
    most = F.array_max(F.transform(entries, lambda e: e["value"]))
    first = F.filter(entries, lambda e: e["value"] == most)
    return F.when(F.size(first) == 1, first[0]["key"])


def vote(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the three voted labels, confidence (NULL if any is NULL), valid, disagree, failing.

    predictions: keys, labels, confidence, status, seen (order of arrival, total). Only rows
    of status `ok` vote; NULL labels do not vote but count as a value of their own for
    disagreement. failing: the other statuses, in order of first arrival.
    """
    ok = F.col("status") == "ok"
    counts = [
        F.filter(F.collect_list(F.when(ok, F.coalesce(F.col(f), F.lit("")))), lambda x: x.isNotNull()).alias(f"_{f}")
        for f in FIELDS
    ]
    grouped = predictions.groupBy(*keys).agg(
        *counts,
        *[F.collect_set(F.when(ok, F.coalesce(F.col(f), F.lit("")))).alias(f"_d_{f}") for f in FIELDS],
        F.count(F.when(ok, 1)).alias("valid"),
        F.count(F.when(ok, F.col("confidence"))).alias("_known"),
        F.sum(F.when(ok, F.col("confidence").cast(EXACT))).alias("_sum"),
        F.collect_list(F.when(~ok, F.struct("seen", "status"))).alias("_bad"),
    )
    tally = lambda a: F.map_from_entries(
        F.transform(F.array_distinct(a), lambda v: F.struct(v, F.size(F.filter(a, lambda x: x == v))))
    )
    disagree = F.lit(False)
    for f in FIELDS:
        disagree = disagree | (F.size(f"_d_{f}") > 1)
    return grouped.select(
        *keys,
        *[majority(tally(F.col(f"_{f}"))).alias(f) for f in FIELDS],
        F.when((F.col("valid") > 0) & (F.col("valid") == F.col("_known")), F.col("_sum").cast("double") / F.col("valid")).alias("confidence"),
        "valid",
        disagree.alias("disagree"),
        F.array_distinct(F.transform(F.array_sort("_bad"), lambda b: b["status"])).alias("failing"),
    )


def route(voted: DataFrame, threshold: float = 0.8, multiple: Column | None = None) -> DataFrame:
    """Adds reasons (in fixed order) and needs_review to the rows of `vote`."""
    low = F.col("confidence").isNull() | (F.col("confidence") < threshold)
    nothing = F.col("document_type") == "none"
    unknown = (F.col("valid") > 0) & F.coalesce(F.col("issuing_country") == "unknown", F.lit(True))
    reasons = F.concat(
        F.col("failing"),
        F.filter(
            F.array(
                F.when(F.col("disagree"), DISAGREEMENT),
                F.when(low, LOW_CONFIDENCE),
                F.when(nothing, NO_DOCUMENT).when(unknown, UNKNOWN_COUNTRY),
                F.when(F.lit(False) if multiple is None else multiple, MULTIPLE_DOCUMENTS),
            ),
            lambda x: x.isNotNull(),
        ),
    )
    return voted.withColumn("reasons", reasons).withColumn("needs_review", F.size("reasons") > 0)


def route_images(images: DataFrame, regions: DataFrame, predictions: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One routed row per region, per image without a region and per failed fetch.

    images: transaction_id, image_id, fetch_status. regions: transaction_id, image_id, region_id.
    predictions: region_id, labels, confidence, status, seen. Result: transaction_id, image_id,
    region_id, labels, confidence, needs_review, reasons.
    """
    key = ["transaction_id", "image_id"]
    of_image = Window.partitionBy(*key)  # the regions of one image
    placed = regions.select(*key, "region_id").distinct()
    placed = placed.withColumn("_several", F.count("*").over(of_image) > 1)
    said = placed.select("region_id").join(predictions, "region_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("-"))
    )
    voted = vote(said, ["region_id"]).withColumn("failing", F.array_remove("failing", "-"))
    columns = [*key, "region_id", *FIELDS, "confidence", "needs_review", "reasons"]
    fetched = images.where("fetch_status = 'ok'").select(*key).distinct()
    seen = route(placed.join(voted, "region_id"), threshold, F.col("_several")).join(fetched, key, "left_semi")
    none = F.lit(None).cast("string")
    empty = fetched.join(placed, key, "left_anti").select(
        *key, F.concat_ws(":", *key, F.lit("none")).alias("region_id"),
        F.lit("none").alias("document_type"), F.lit("unknown").alias("issuing_country"), F.lit("n/a").alias("document_side"),
        F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("needs_review"),
        F.array(F.lit(NO_DOCUMENT)).alias("reasons"),
    )
    failed = images.where("fetch_status <> 'ok'").select(*key).distinct().select(
        *key, F.concat_ws(":", *key, F.lit(FETCH_FAILED)).alias("region_id"),
        *[none.alias(f) for f in FIELDS], F.lit(None).cast("double").alias("confidence"),
        F.lit(True).alias("needs_review"), F.array(F.lit(FETCH_FAILED)).alias("reasons"),
    )
    return seen.select(*columns).unionByName(empty.select(*columns)).unionByName(failed.select(*columns))


def summarize_images(routed: DataFrame, keys: list[str], order: str = "region_id") -> DataFrame:
    """The routed row of highest confidence per image (NULL counts as -1); ties: first by `order`."""
    rest = [c for c in routed.columns if c not in keys]
    best = routed.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), order)).alias("_b")
    )
    return best.select(*keys, "_b.*")


def count_label(fetch_status: Column, document_type: Column, country: Column) -> Column:
    """Bucket of an image in the counts of a run."""
    return (
        F.when(fetch_status != "ok", "FETCH_FAILED")
        .when(document_type == "none", "NO_DOC")
        .otherwise(F.coalesce(F.nullif(country, F.lit("")), F.lit("ERROR")))
    )


def prediction_rows(classifier_rows: DataFrame, routed: DataFrame) -> DataFrame:
    """Classifier rows and router rows in one table; columns only one side has are NULL."""
    router = routed.withColumn("model_name", F.lit("router")).withColumn("status", F.lit("ok"))
    if "reasons" in router.columns:
        router = router.withColumn("review_reasons", F.array_join("reasons", ",")).drop("reasons")
    return classifier_rows.unionByName(router, allowMissingColumns=True)
