"""Label checks and parsing of names (PRJ-01..07, AGG-24, SRC-08 checks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.normal import DOCUMENT_SIDES, DOCUMENT_TYPES, UNKNOWN_COUNTRY

# Name patterns and file extensions of the sources.
STEM = r"^([0-9]+)_([A-Za-z0-9-]+)$"
ZIP_NAME = r"^([0-9]+)_([0-9]{4}-[0-9]{2}-[0-9]{2})_([0-9.-]+)_(front|back)_(img|url)\.zip$"
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")


def is_valid_country(c: Column) -> Column:
    """`unknown` or two capital letters; false for NULL."""
    return F.coalesce((c == UNKNOWN_COUNTRY) | c.rlike("^[A-Z]{2}$"), F.lit(False))


def label_problems(kind: Column, country: Column, side: Column) -> Column:
    """ARRAY<STRING> of what is wrong with a label triple, empty if nothing is."""
    text = lambda c: F.coalesce(c, F.lit("NULL"))
    return F.filter(
        F.array(
            F.when(~F.coalesce(kind.isin(*DOCUMENT_TYPES), F.lit(False)), F.concat(F.lit("document_type "), text(kind))),
            F.when(~is_valid_country(country), F.concat(F.lit("issuing_country "), text(country))),
            F.when(~F.coalesce(side.isin(*DOCUMENT_SIDES), F.lit(False)), F.concat(F.lit("document_side "), text(side))),
        ),
        lambda x: x.isNotNull(),
    )


def region_id(transaction_id: Column, image_id: Column, detector: Column, index: Column) -> Column:
    return F.concat_ws(":", transaction_id, image_id, detector, index)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def has_image_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*EXTENSIONS)


def parse_stem(path: Column) -> Column:
    """struct<transaction_id, image_id> of `<number>_<name>.<extension>`; NULL if it is none."""
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    return F.when(
        stem.rlike(STEM),
        F.struct(
            F.regexp_extract(stem, STEM, 1).cast("long").alias("transaction_id"),
            F.regexp_extract(stem, STEM, 2).alias("image_id"),
        ),
    )


def parse_zip_name(path: Column) -> Column:
    """struct<transaction_id, day, time, image_id, kind> of an upload's zip name; NULL if it is none."""
    name = file_name(path)
    part = lambda n: F.regexp_extract(name, ZIP_NAME, n)
    return F.when(
        name.rlike(ZIP_NAME),
        F.struct(
            part(1).cast("long").alias("transaction_id"), part(2).alias("day"), part(3).alias("time"),
            part(4).alias("image_id"), part(5).alias("kind"),
        ),
    )


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("document_type", "issuing_country").agg(F.count("*").alias("images"))
