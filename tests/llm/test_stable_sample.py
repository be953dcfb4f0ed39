import pytest
from pyspark.sql import functions as F

from framewright.llm import stable_sample as S

ID = "transaction_id long, image_id string, permuted string"


def images(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], ID)


def chosen(df, rate, seed=20):
    return {(r["transaction_id"], r["image_id"]) for r in S.stable_sample(df, rate, seed).collect()}


ROWS = [(t, s) for t in range(-40, 400) for s in ("front", "back", "", "é" * 30)]


def test_stable_and_nested(spark):
    first = images(spark, ROWS[:1000])
    small = chosen(first, 0.2)
    assert 120 < len(small) < 290
    again = images(spark, ROWS[:1000][::-1] * 2).repartition(7)
    assert chosen(again, 0.2) == small
    grown = chosen(images(spark, ROWS), 0.2)
    assert small <= grown
    assert grown <= chosen(images(spark, ROWS), 0.5)
    assert chosen(images(spark, ROWS), 0.2, seed=21) != grown
    assert chosen(first, 0) == set() and len(chosen(first, 1)) == 1000


def test_edges(spark):
    df = images(spark, [(None, "a"), (1, None), (1, ""), (2**63 - 1, "x" * 500)])
    assert chosen(df, 1) == {(1, ""), (2**63 - 1, "x" * 500)}
    assert chosen(df.limit(0), 1) == set()
    with pytest.raises(ValueError):
        S.stable_sample(df, 1.5)


def test_permutation_has_no_collisions(spark):
    """Every step can be undone, so different identifiers stay different in all their words."""
    names = [(1, "a"), (1, "a\0"), (1, "a\x80"), (256, "a"), (1, "aa"), (1, "b")] + ROWS
    df = images(spark, names).select(S.identifier_words(F.col("transaction_id"), F.col("image_id")).alias("w"))
    words = [tuple(r["w"]) for r in df.collect()]
    assert len(set(words)) == len(set(names))
    assert all(0 <= x < 2**56 for w in words for x in w)
    low = S.permuted(df, "w", 3).select("permuted").collect()
    assert len({r[0] for r in low}) == len(set(names))  # 56 bits: no chance of a meeting here
