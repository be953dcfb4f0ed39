"""Detector threshold sweep (AGG-22, AGG-23, JN-09, JN-11, ORD-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DETECTORS = 1000

def image_confidences(images: DataFrame, detectors: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per image and detector: detector_name, folder, keys, confidences (descending).

    images: keys, folder. boxes: keys, detector_name, confidence. Images without a box keep an empty array.
    """
    found = boxes.where("confidence IS NOT NULL").groupBy(*keys, "detector_name").agg(
        F.sort_array(F.collect_list("confidence"), asc=False).alias("confidences")
    )
    # detectors are a short list of configured names
    names = detectors.select("detector_name").distinct()
    if names.limit(MAX_DETECTORS + 1).count() > MAX_DETECTORS:
        raise ValueError(f"more than {MAX_DETECTORS} detectors")
    grid = images.select(*keys, "folder").distinct().join(F.broadcast(names))
    return grid.join(found, [*keys, "detector_name"], "left").withColumn(
        "confidences", F.coalesce("confidences", F.array().cast("array<double>"))
    )


def threshold_counts(per_image: DataFrame, thresholds: list[float], folders: DataFrame, detectors: DataFrame) -> DataFrame:
    """detector_name, folder, threshold, images, detected, multiple; all cells, empty ones with zeros.

    One scan serves all thresholds, as confidences were kept from the lowest one.
    """
    spark = per_image.sparkSession
    levels = spark.createDataFrame([(float(t),) for t in sorted(set(thresholds))], "threshold double")
    hits = lambda t: F.size(F.filter("confidences", lambda c: c >= t))
    sums = per_image.groupBy("detector_name", "folder").agg(
        F.count("*").alias("images"),
        *[F.count_if(hits(t) >= n).alias(f"{name}_{i}") for i, t in enumerate(sorted(set(thresholds))) for n, name in ((1, "detected"), (2, "multiple"))],
    )
    long = sums.select(
        "detector_name", "folder", "images",
        F.explode(F.array(*[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"detected_{i}").alias("detected"), F.col(f"multiple_{i}").alias("multiple"))
            for i, t in enumerate(sorted(set(thresholds)))
        ])).alias("c"),
    ).select("detector_name", "folder", "images", "c.*")
    grid = detectors.select("detector_name").distinct().join(folders.select("folder").distinct()).join(levels)
    return grid.join(long, ["detector_name", "folder", "threshold"], "left").na.fill(0, ["images", "detected", "multiple"])


def mean_latency(runs: DataFrame, detectors: DataFrame, column: str = "latency_ms") -> DataFrame:
    """(detector_name, mean_latency_ms): 0 for a detector without a run."""
    means = runs.groupBy("detector_name").agg(F.avg(F.col(column).cast("decimal(18,6)")).cast("double").alias("_m"))
    return detectors.select("detector_name").distinct().join(means, "detector_name", "left").select(
        "detector_name", F.coalesce("_m", F.lit(0.0)).alias("mean_latency_ms")
    )
