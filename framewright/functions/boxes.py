"""Bounding boxes: clipping, overlap and suppression (FN-04, FN-05, ORD-03, ORD-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """struct<x0, y0, x1, y1 INT>: grown to whole pixels, cut to the image; NULL if nothing is left
    or any coordinate is NULL."""
    low = lambda c: F.greatest(F.floor(c), F.lit(0)).cast("int")
    high = lambda c, most: F.least(F.ceil(c), most).cast("int")
    a, b, c, d = low(x0), low(y0), high(x1, width), high(y1, height)
    known = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    return F.when(
        known & (c > a) & (d > b),
        F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")),
    )


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; boxes that only touch have 0."""
    wide = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0))
    tall = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0))
    both = (wide * tall).cast("double")
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    union = (area(a) + area(b)).cast("double") - both
    return F.when(both > 0, both / union).otherwise(F.lit(0.0))


def suppress(boxes: Column, max_iou: float) -> Column:
    """The boxes that no better kept box overlaps by more than `max_iou`, best first.

    boxes: ARRAY<STRUCT<confidence, tie..., box>>, where `tie` makes the order total. Sorted by
    confidence, then tie; greedy, whatever the classes.
    """
    ordered = F.array_sort(
        F.transform(boxes, lambda x: F.struct((-x["confidence"]).alias("_r"), x["tie"].alias("_t"), x.alias("x")))
    )
    best_first = F.transform(ordered, lambda o: o["x"])
    return F.aggregate(
        best_first,
        F.slice(best_first, 1, 0),
        lambda kept, x: F.when(
            F.exists(kept, lambda k: box_iou(k["box"], x["box"]) > max_iou), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )


def suppressed_regions(candidates: DataFrame, keys: list[str], max_iou: float = 0.7) -> DataFrame:
    """One row per kept box: keys, region_index (rank after suppression from 0), confidence, tie, box.

    candidates: keys, confidence, tie, box (NULL boxes are dropped). A NULL confidence ranks last.
    Repeated candidates overlap each other fully, so one is kept. The boxes of one key are one
    detector's output for one image, which is the unit that fits a task by construction.
    """
    rows = candidates.where("box IS NOT NULL").select(
        *keys, F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), "tie", "box").alias("_c")
    )
    grouped = rows.groupBy(*keys).agg(F.collect_set("_c").alias("_all"))
    kept = grouped.select(*keys, F.posexplode(suppress(F.col("_all"), max_iou)).alias("region_index", "_k"))
    return kept.select(*keys, "region_index", "_k.confidence", "_k.tie", "_k.box")
