"""Row numbers and running totals inside groups of any size.

A window over a group sorts that group in one task. Where a group may hold a third of all
rows, the group is cut along its own order into buckets: buckets are counted first (with
map-side combine), their offsets are a window over those few counts, and the rows are ranked
bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(order: Column, bits: int = 8) -> Column:
    """Buckets that follow the order of a 64-bit hash: its leading bits."""
    return F.shiftright(order, 64 - bits)


def bucketed_row_number(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "rank",
) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... inside each group by `order`.

    `bucket` must not be NULL nor decrease along `order`, and its values per group must be few enough for
    one window over the counts. NULL group keys form a group of their own. Equal order values
    get different numbers in no given order, so `order` should be total.
    """
    keyed = df.withColumn("_bucket", bucket)
    # as fields of one struct, NULL group keys compare equal
    keys = F.struct(*group) if group else F.struct(F.lit(0).alias("one"))
    keyed = keyed.withColumn("_group", keys)
    counts = keyed.groupBy("_group", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_bucket")
    offsets = counts.select(
        F.col("_group").alias("_g"),
        F.col("_bucket").alias("_b"),
        (F.sum("_n").over(before) - F.col("_n")).alias("_offset"),
    )
    joined = keyed.join(
        offsets,
        (F.col("_group") == F.col("_g")) & (F.col("_bucket") == F.col("_b")),
    )
    within = Window.partitionBy("_group", "_bucket").orderBy(*order)
    return joined.withColumn(
        name, F.col("_offset") + F.row_number().over(within) - 1
    ).drop("_bucket", "_group", "_g", "_b", "_offset")


def bucketed_running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, value: str, name: str = "before"
) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the group that come before by (bucket, `order`).

    As `bucketed_row_number`, with sums in place of counts; `order` should be total inside a bucket.
    """
    keyed = df.withColumn("_bucket", bucket).withColumn("_group", F.struct(*group))
    sums = keyed.groupBy("_group", "_bucket").agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_bucket")
    offsets = sums.select(
        F.col("_group").alias("_g"), F.col("_bucket").alias("_b"), (F.sum("_n").over(earlier) - F.col("_n")).alias("_offset")
    )
    joined = keyed.join(offsets, (F.col("_group") == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    within = Window.partitionBy("_group", "_bucket").orderBy(*order)
    return joined.withColumn(name, F.col("_offset") + F.sum(value).over(within) - F.col(value)).drop(
        "_bucket", "_group", "_g", "_b", "_offset"
    )
