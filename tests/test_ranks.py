import random

from pyspark.sql import functions as F

from framewright.operators.ranks import bucketed_row_number, bucketed_running_sum, hash_bucket


def test_contiguous_in_order_with_null_groups(spark):
    rows = [("hot" if i % 3 else None, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i long").withColumn("h", F.xxhash64("i"))
    out = bucketed_row_number(df, ["g"], ["h", "i"], hash_bucket(F.col("h"), 5)).collect()
    for g in ("hot", None):
        own = sorted((r["rank"], r["h"]) for r in out if r["g"] == g)
        assert [k for k, _ in own] == list(range(len(own)))
        assert [h for _, h in own] == sorted(h for _, h in own)


def test_no_group_and_empty(spark):
    df = spark.range(5)
    assert [r["rank"] for r in bucketed_row_number(df, [], ["id"], F.lit(0)).orderBy("id").collect()] == list(range(5))
    assert bucketed_row_number(df.limit(0), [], ["id"], F.lit(0)).count() == 0


def test_running_sums(spark):
    r = random.Random(6)
    rows = [("a" if r.random() < 0.6 else None, r.randint(0, 10**6), r.randint(1, 9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, o long, n long")
    got = {(x["g"], x["o"]): x["before"] for x in bucketed_running_sum(df, ["g"], ["o"], F.floor(F.col("o") / 100_000), "n").collect()}
    for g, o, _ in rows:
        assert got[g, o] == sum(n for h, p, n in rows if h == g and p < o)
