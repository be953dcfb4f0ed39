"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "images regions predictions reviews labelled_images duplicate_groups close_pairs "
    "sample_targets mix_targets container_sizes split_targets"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of `folder`; columns and filters are pushed into this scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
