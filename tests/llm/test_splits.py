import random
from collections import Counter

import pytest

from framewright.llm import splits as S

IMAGE = "transaction_id long, image_id string, document_type string, issuing_country string, split_name string"
TARGETS = [("train", 0.7), ("validation", 0.15), ("test", 0.15)]


def frames(spark, images, groups, targets=TARGETS):
    return (
        spark.createDataFrame([(*x, "clash") for x in images], IMAGE),
        spark.createDataFrame(groups, "image_hash string, uploads string"),
        spark.createDataFrame(targets, "split_name string, target_share double"),
    )


def test_together_with_a_hot_transaction_and_ties(spark):
    r = random.Random(1)
    kinds = ["national_id"] * 8 + ["passport", "Driving-License ", "card"]
    images = [(7 if r.random() < 0.3 else r.randint(100, 900), f"i{i}", r.choice(kinds), r.choice(["TN", " ma", None])) for i in range(3000)]
    images += images[:50]
    groups = [("h1", "f/101_a f/50_b"), ("H1 ", "f/50_c  f/900_a"), ("h2", "f/900_x f\\300_y"), (None, "f/400_a f/401_a")]
    out = S.grouped_splits(*frames(spark, images, groups)).collect()
    keys = {(t, i) for t, i, _, _ in images}
    assert {(r["transaction_id"], r["image_id"]) for r in out} == keys and len(out) == len(keys)
    where = {}
    for row in out:
        assert where.setdefault(row["transaction_id"], row["split_name"]) == row["split_name"]
    assert len({where[t] for t in (101, 900, 300) if t in where}) == 1
    shares = Counter(r["split_name"] for r in out)
    for name, share in TARGETS:
        assert shares[name] / len(out) == pytest.approx(share, abs=0.02)


def test_keep_together(spark):
    images, groups, _ = frames(spark, [(5, "a", None, None), (9, "a", None, None), (9, None, None, None), (None, "a", None, None)], [("h", "f/5_a f/3_a"), ("k", "f/3_b f/9_a")])
    assert {tuple(r) for r in S.keep_together(images, groups).collect()} == {(5, 5), (9, 5)}


def test_edges(spark):
    assert S.grouped_splits(*frames(spark, [], [])).count() == 0
    one = S.grouped_splits(*frames(spark, [(1, None, None, None)], [])).collect()
    assert len(one) == 1 and one[0]["split_name"] == "train"
    with pytest.raises(ValueError):
        S.grouped_splits(*frames(spark, [(1, "a", None, None)], [], [("train", None)]))


def test_placement():
    state = S.Placement({"a": 0.5, "b": 0.5}, {"rare": 4, "common": 84})
    assert sorted(state.place("rare", {"rare": 1, "common": 1}) for _ in range(4)) == ["a", "a", "b", "b"]
    state.take("a", {"common": 20})
    assert state.intervals("common", 60) == [("a", 0.0, 20.0), ("b", 20.0, float("inf"))]
    assert S.Placement({"a": 1.0, "b": 0.0}, {"x": 4}).intervals("x", 4) == [("a", 0.0, float("inf"))]


def test_every_label_is_split_as_asked(spark):
    r = random.Random(4)
    images = [(t, f"i{k}", r.choice(["passport"] * 20 + ["national_id"] * 5 + ["other"]), "TN") for t in range(3000) for k in range(r.choice([1, 1, 2, 5]))]
    out = S.grouped_splits(*frames(spark, images, []), large=500).collect()
    where = {(x["transaction_id"], x["image_id"]): x["split_name"] for x in out}
    assert len(where) == len({x[:2] for x in images})
    for kind in ("passport", "national_id", "other"):
        own = Counter(where[x[:2]] for x in images if x[2] == kind)
        for name, share in TARGETS:
            assert own[name] / sum(own.values()) == pytest.approx(share, abs=0.03), (kind, name)


def test_too_many_targets(spark):
    targets = [(f"s{i}", 1.0) for i in range(S.MAX_SPLITS + 1)]
    with pytest.raises(ValueError, match="split targets"):
        S.grouped_splits(*frames(spark, [(1, "a", "passport", "TN")], [("h", "f/1_a f/1_b")], targets))
