"""Keyed writes on immutable tables (SNK-02..06, SNK-09, ORD-07, JN-06, SET-05, SET-06).

Spark has no unique keys on Parquet; keys are enforced by what is written. Each function returns
the new state or the rows to append; `framewright.sources.storage` writes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.ranks import bucketed_row_number


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by `order`, found by partial aggregation; rows with a NULL key are dropped."""
    names = rows.columns
    known = rows.dropna(subset=list(keys), how="any")
    rest = [c for c in names if c not in keys]
    best = known.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, "_b.*").select(*names)


def insert_ignore(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of `batch` to append: one per key that `existing` does not have."""
    fresh = first_per_key(batch, keys, order)
    return fresh if existing is None else fresh.join(existing.select(*keys), list(keys), "left_anti")


def union_rows(*parts: DataFrame) -> DataFrame:
    """Rows of several shapes in one table; missing columns are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str], refreshed: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole new state: new keys are added, of known ones only `refreshed` columns are taken over.

    A NULL in the batch overwrites; the row's presence decides, not the value. Other columns (an
    id, a first ingestion time) keep the existing row's values. Of a key twice in the batch the last by `order` counts.
    """
    names = existing.columns
    last = last_per_key(batch, keys, order)
    new = last.select(*keys, F.struct(*[c for c in names if c not in keys]).alias("_new"), F.lit(True).alias("_is_new"))
    old = existing.select(*keys, F.struct(*[c for c in names if c not in keys]).alias("_old"), F.lit(True).alias("_is_old"))
    both = old.join(new, list(keys), "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c in refreshed:
            return F.when(F.col("_is_new"), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
        return F.when(F.col("_is_old"), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c)

    return both.select(*[value(c) for c in names])


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order`; rows with a NULL key are dropped."""
    names = rows.columns
    rest = [c for c in names if c not in keys]
    known = rows.dropna(subset=list(keys), how="any")
    best = known.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, "_b.*").select(*names)


def review_rows(routed: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Review rows for regions without one: `pending` if a review is needed, else `auto_accepted`."""
    rows = routed.withColumn(
        "review_status", F.when(F.col("needs_review"), "pending").otherwise("auto_accepted")
    ).drop("needs_review")
    return insert_ignore(existing, rows, ["region_id"], [c for c in rows.columns if c != "region_id"])


def gapless_ids(existing: DataFrame | None, batch: DataFrame, order: str, name: str = "id") -> DataFrame:
    """Adds ids that go on from the largest existing one without a gap, by a numeric `order`.

    Ranks come from order ranges that are counted first, so no task sorts the whole batch.
    """
    start = 0 if existing is None else existing.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    low, high = batch.agg(F.min(order), F.max(order)).first()
    width = 1 if low is None else max(1, (high - low) // 256 + 1)
    bucket = F.floor((F.col(order) - F.lit(low or 0)) / width)
    ranked = bucketed_row_number(batch, [], [order], F.coalesce(bucket, F.lit(-1)), name)
    return ranked.withColumn(name, F.col(name) + F.lit(start + 1))


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
