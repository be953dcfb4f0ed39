import pytest
from pyspark.sql import functions as F

from framewright.functions import boxes as B

CANDIDATE = "key int, x0 double, y0 double, x1 double, y1 double, confidence double"


def kept(spark, *candidates, max_iou=0.7):
    df = spark.createDataFrame([(1, *map(float, c[:4]), c[4]) for c in candidates], CANDIDATE)
    c = [F.col(x) for x in ("x0", "y0", "x1", "y1")]
    boxed = df.select("key", "confidence", F.struct(*c).alias("tie"), B.clip_box(*c, F.lit(100), F.lit(80)).alias("box"))
    rows = B.suppressed_regions(boxed, ["key"], max_iou).orderBy("region_index").collect()
    return [tuple(r["box"]) for r in rows]


@pytest.mark.parametrize(
    ("candidates", "expected"),
    [
        ([(10, 20, 60, 50, 0.9)], [(10, 20, 60, 50)]),
        ([(-5.2, 10.7, 120.3, 79.9, 0.8)], [(0, 10, 100, 80)]),
        ([(0, 0, 40, 40, 0.6), (50, 0, 90, 40, 0.9)], [(50, 0, 90, 40), (0, 0, 40, 40)]),
        ([(10, 10, 90, 70, 0.7), (12, 11, 91, 70, 0.85)], [(12, 11, 91, 70)]),
        ([(0, 0, 45, 80, 0.9), (55, 0, 100, 80, 0.8)], [(0, 0, 45, 80), (55, 0, 100, 80)]),
        ([(150, 10, 200, 50, 0.9)], []),
        ([(0, 0, 10, 10, None), (0, 0, 10, 10, 0.2)], [(0, 0, 10, 10)]),
    ],
)
def test_suppression(spark, candidates, expected):
    assert kept(spark, *candidates) == expected


def test_values(spark):
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    row = spark.range(1).select(
        B.clip_box(*[F.lit(x) for x in (10.5, 10.5, 20.5, 20.5)], F.lit(100), F.lit(100)).alias("clip"),
        B.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10)).alias("third"),
        B.box_iou(box(0, 0, 10, 10), box(10, 0, 20, 10)).alias("touch"),
        B.clip_box(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(9), F.lit(9)).alias("null"),
    ).first()
    assert tuple(row["clip"]) == (10, 10, 21, 21)
    assert row["third"] == 50 / 150 and row["touch"] == 0 and row["null"] is None
