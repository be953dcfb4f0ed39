"""Connected components for the core's reports (AGG-03): alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root): root is the smallest vertex linked directly or through others.

    Links have no direction. Each round, every vertex links its larger neighbours to its smallest
    one (large star), then its smaller neighbours likewise (small star); both keep components and
    end in stars after a logarithmic number of rounds. Rounds stop when the links stay as they are.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    state = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        state = stored(small)
        sums = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
    return state.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    )
