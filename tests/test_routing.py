import pytest

from framewright.operators import routing as R

SAID = "region_id string, document_type string, issuing_country string, document_side string, confidence double, status string, seen int"
OK = ("national_id", "TN", "front")


def routed(spark, *answers, threshold=0.8):
    rows = [("r", *a, i) for i, a in enumerate(answers)]
    out = R.route(R.vote(spark.createDataFrame(rows, SAID), ["region_id"]), threshold).collect()
    assert len(out) == 1
    return out[0]


@pytest.mark.parametrize(
    ("answers", "labels", "reasons"),
    [
        ([(*OK, 0.9, "ok")], OK, []),
        ([(*OK, 0.7, "ok")], OK, ["low_confidence"]),
        ([(*OK, 0.8, "ok")], OK, []),
        ([(*OK, None, "ok")], OK, ["low_confidence"]),
        ([("passport", "unknown", "n/a", 0.9, "ok")], ("passport", "unknown", "n/a"), ["unknown_country"]),
        ([("passport", None, "n/a", 0.9, "ok")], ("passport", None, "n/a"), ["unknown_country"]),
        ([(*OK, 0.9, "ok"), ("national_id", "MA", "front", 0.9, "ok")], ("national_id", None, "front"), ["disagreement", "unknown_country"]),
        ([(*OK, 0.9, "ok"), (*OK, 0.9, "ok"), ("national_id", "MA", "front", 0.9, "ok")], OK, ["disagreement"]),
        ([(*OK, 0.9, "ok"), (None, "TN", "front", 0.9, "ok")], OK, ["disagreement"]),
        ([(None, None, None, None, "parse_error")], (None, None, None), ["parse_error", "low_confidence"]),
        ([(None, None, None, None, "model_error"), (*OK, 0.9, "ok"), (None, None, None, None, "parse_error")], OK, ["model_error", "parse_error"]),
        ([("none", "unknown", "n/a", 0.95, "ok")], ("none", "unknown", "n/a"), ["no_document"]),
        ([(*OK, 0.9, "ok"), (*OK, 0.5, "ok")], OK, ["low_confidence"]),
        ([(*OK, 0.9, "ok"), (*OK, None, "ok")], OK, ["low_confidence"]),
    ],
)
def test_rules(spark, answers, labels, reasons):
    row = routed(spark, *answers)
    assert tuple(row[f] for f in R.FIELDS) == labels
    assert row["reasons"] == reasons
    assert row["needs_review"] == bool(reasons)


def test_images(spark):
    images = spark.createDataFrame([(1, "a", "ok"), (2, "a", "ok"), (3, "a", "failed"), (4, "a", "ok")], "transaction_id long, image_id string, fetch_status string")
    regions = spark.createDataFrame([(1, "a", "1:a:0"), (4, "a", "4:a:0"), (4, "a", "4:a:1")], "transaction_id long, image_id string, region_id string")
    said = spark.createDataFrame([("1:a:0", *OK, 0.9, "ok", 0), ("4:a:0", *OK, 0.9, "ok", 0)], SAID)
    rows = {r["region_id"]: r for r in R.route_images(images, regions, said).collect()}
    assert rows["1:a:0"]["reasons"] == []
    assert rows["2:a:none"]["document_type"] == "none" and rows["2:a:none"]["reasons"] == ["no_document"]
    assert rows["3:a:fetch_failed"]["document_type"] is None and rows["3:a:fetch_failed"]["reasons"] == ["fetch_failed"]
    assert rows["4:a:0"]["reasons"] == ["multiple_documents"]
    assert rows["4:a:1"]["reasons"] == ["low_confidence", "multiple_documents"]
    best = {r["transaction_id"]: r["region_id"] for r in R.summarize_images(R.route_images(images, regions, said), ["transaction_id", "image_id"]).collect()}
    assert best[4] == "4:a:0"


def test_empty(spark):
    assert R.route(R.vote(spark.createDataFrame([], SAID), ["region_id"])).count() == 0
