"""Label files: reading, checking and building them (SRC-08, SRC-09, ORD-05, PRJ-18, SET-03, SET-05)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.keyed import repeated_keys
from framewright.operators.labels import label_problems

# Header of the label file; labels of the share's folders.
COLUMNS = ("transaction_id", "image_id", "image_path", "document_type", "issuing_country", "document_side")
FOLDER_LABELS = {
    "tun_nid_ocr": ("national_id", "TN"),
    "mar_nid_ocr": ("national_id", "MA"),
    "dza_nid_ocr": ("national_id", "DZ"),
    "mar_driver_license_ocr": ("driving_license", "MA"),
    "UAE_RESIDENT_ID_OCR": ("residence_permit", "AE"),
}


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The label file, checked: header, labels, repeated keys, at least one row; the first bad row is named.

    Rows are counted from 1, which is the header. Relative image paths are taken from the file's folder.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)  # quoted cells may hold line ends
    missing = [c for c in COLUMNS if c not in header.columns]
    if missing:
        raise ValueError(f"{path}: columns missing: {', '.join(missing)}")
    lines = header.select(*COLUMNS).coalesce(1).withColumn("_row", F.monotonically_increasing_id() + 2)  # one file, one order
    rows = lines.withColumn("_key", F.expr("try_cast(transaction_id AS BIGINT)"))
    problems = F.concat(
        F.filter(F.array(F.when(F.col("_key").isNull(), F.concat(F.lit("transaction_id "), F.coalesce("transaction_id", F.lit("NULL"))))), lambda x: x.isNotNull()),
        label_problems(F.col("document_type"), F.col("issuing_country"), F.col("document_side")),
    )
    bad = rows.withColumn("_bad", problems).where(F.size("_bad") > 0).orderBy("_row").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: row {bad[0]['_row']}: {'; '.join(bad[0]['_bad'])}")
    twice = repeated_keys(rows, ["transaction_id", "image_id"]).orderBy("transaction_id", "image_id").limit(1).collect()
    if twice:
        raise ValueError(f"{path}: {twice[0]['transaction_id']}:{twice[0]['image_id']} occurs {twice[0]['rows']} times")
    if rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    base = os.path.dirname(os.path.abspath(path))
    full = F.when(F.col("image_path").startswith("/"), F.col("image_path")).otherwise(F.concat(F.lit(base + "/"), F.col("image_path")))
    return rows.select(F.col("_key").alias("transaction_id"), "image_id", full.alias("image_path"), *COLUMNS[3:])


def label_rows(keys: DataFrame, folder_labels: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Label rows from listed keys: type and country of the file's folder, the image_id as side."""
    spark = keys.sparkSession
    known = [(f, *x) for f, x in (folder_labels or FOLDER_LABELS).items()]
    labels = spark.createDataFrame(known, "folder string, document_type string, issuing_country string")
    rows = keys.withColumn("folder", F.regexp_extract("reference", "([^/]+)/[^/]*$", 1))
    return rows.join(F.broadcast(labels), "folder").select(  # a configured list
        "transaction_id", "image_id", F.col("reference").alias("image_path"), "document_type", "issuing_country",
        F.col("image_id").alias("document_side"),
    )


def load_yaml(path: str) -> dict:
    """A YAML file as a dict; an empty file is an empty dict."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}
