from collections import Counter

from framewright.llm import quota_sample as Q

IMAGE = "transaction_id long, image_id string, document_type string, issuing_country string, draw int"
TARGET = "sample_name string, sample_size long, document_type string, issuing_country string, target_share double, min_count long"


def leaf(kind, country, share, held, least=0):
    return {"type": kind, "country": country, "share": share, "least": least, "held": held}


def given(size, *leaves):
    return {k: v["given"] for k, v in Q.allocate(size, list(leaves)).items()}


def test_allocation_tree():
    assert given(100, leaf("a", "x", 0.5, 500), leaf("b", "x", 0.5, 500)) == {("a", "x"): 50, ("b", "x"): 50}
    # unmet quota goes to the sibling before the cousin
    assert given(100, leaf("a", "x", 0.4, 10), leaf("a", "y", 0.1, 500), leaf("b", "x", 0.5, 500)) == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}
    assert given(100, leaf("a", "x", 0.4, 10), leaf("a", "y", 0.1, 20), leaf("b", "x", 0.5, 500)) == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 70}
    assert given(100, leaf("a", "x", 0.9, 500), leaf("b", "x", 0.1, 500, least=30)) == {("a", "x"): 70, ("b", "x"): 30}
    assert sum(given(100, *[leaf("a", str(i), 1 / 7, 1000) for i in range(7)]).values()) == 100
    assert given(10, leaf("a", "x", 1.0, 3)) == {("a", "x"): 3}
    assert given(0, leaf("a", "x", 1.0, 3)) == {("a", "x"): 0}


def test_quota_comes_down_the_tree():
    # type a gets 10 of 20; inside it the minimum of y comes first
    plan = Q.allocate(20, [leaf("a", "x", 0.4, 99), leaf("a", "y", 0.1, 99, least=6), leaf("b", "x", 0.5, 99)])
    assert {k: v["quota"] for k, v in plan.items()} == {("a", "x"): 4, ("a", "y"): 6, ("b", "x"): 10}


def test_an_image_of_two_categories_is_drawn_once(spark):
    rows = [(i, "f", "passport", "TN", 0) for i in range(50)] + [(i, "f", "other", "FR", 0) for i in range(20)]
    images = spark.createDataFrame(rows, IMAGE)
    targets = spark.createDataFrame([("s", 50, "passport", "TN", 0.6, None), ("s", 50, "other", "FR", 0.4, None)], TARGET)
    drawn = [(r["transaction_id"], r["image_id"]) for r in Q.quota_sample(images, targets).collect()]
    assert len(drawn) == len(set(drawn)) == 50
    assert Q.unfilled(Q.allocation(images, targets)).count() == 0


def test_sample(spark):
    rows = [(i, "f", "national_id", "TN") for i in range(600)] + [(i, "f", " National-ID", "tn\t") for i in range(300)]
    rows += [(i, "b", "passport", "MA") for i in range(40)] + [(None, "z", "passport", "MA"), (1, None, "passport", "MA"), (1, "q", "card?", "MA"), (2, "q", None, None)]
    images = spark.createDataFrame([(*r, 9) for r in rows], IMAGE)
    targets = spark.createDataFrame([("s", 200, "National_ID", "TN", 0.5, None), ("s", 200, "passport", "MA", 0.5, 20), ("s", 200, "passport", "XX", 0.0, 5), ("t", 10, "nonsense", "TN", 1.0, 1)], TARGET)
    plan = Q.allocation(images, targets)
    by = {(r["sample_name"], r["document_type"], r["issuing_country"]): r for r in plan.collect()}
    assert by["s", "National_ID", "TN"]["available"] == 600 and by["s", "passport", "MA"]["available"] == 40
    short = {(r["sample_name"], r["document_type"], r["issuing_country"]) for r in Q.unfilled(plan).collect()}
    assert short == {("s", "passport", "MA"), ("s", "passport", "XX"), ("t", "nonsense", "TN")}
    drawn = Q.quota_sample(images, targets).collect()
    assert Counter((r["document_type"], r["issuing_country"]) for r in drawn) == {("national_id", "TN"): 160, ("passport", "MA"): 40}
    assert len({(r["transaction_id"], r["image_id"]) for r in drawn}) == 200
    again = Q.quota_sample(images.repartition(5), targets).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in drawn}


def test_empty(spark):
    images, targets = spark.createDataFrame([], IMAGE), spark.createDataFrame([("s", 10, "passport", "MA", 1.0, 2)], TARGET)
    assert Q.unfilled(Q.allocation(images, targets)).count() == 1
    assert Q.quota_sample(images, targets).count() == 0
    assert Q.allocation(images, targets.limit(0)).count() == 0
