import pytest

from framewright.operators import evaluation as E
from framewright.operators import sweep as S

FACT = (
    "config string, repeat int, true_document_type string, true_issuing_country string, true_document_side string, "
    "pred_document_type string, pred_issuing_country string, pred_document_side string, needs_review boolean, latency_ms double"
)
ROWS = [
    ("a", 1, "national_id", "TN", "front", "national_id", "TN", "front", False, 10.0),
    ("a", 1, "national_id", "TN", "back", "national_id", "TN", "front", False, 20.0),
    ("a", 1, "passport", "MA", "n/a", "passport", "unknown", "n/a", True, 30.0),
    ("a", 1, "passport", "MA", "n/a", None, None, None, True, None),
    ("a", 1, "none", "unknown", "n/a", "none", "unknown", "n/a", True, 40.0),
    ("a", 1, "none", "unknown", "n/a", None, None, None, True, 50.0),
    ("b", 1, "national_id", "TN", "front", "national_id", "TN", "front", False, 10.0),
]


def test_metrics(spark):
    m = {r["config"]: r for r in E.image_metrics(spark.createDataFrame(ROWS, FACT)).collect()}
    a = m["a"]
    assert (a["type_accuracy"], a["country_accuracy"], a["side_accuracy"]) == (0.75, 0.5, 0.5)
    assert a["country_accuracy_macro"] == 0.5 and a["negative_rejection_rate"] == 0.5
    assert (a["coverage"], a["accepted_accuracy"], a["unknown_rate"]) == (0.5, 0.5, 0.25)
    assert a["review_rate"] == 4 / 6
    assert m["b"]["negative_rejection_rate"] is None
    latency = {r["config"]: (r["latency_mean_ms"], r["latency_std_ms"]) for r in E.latency(spark.createDataFrame(ROWS, FACT)).collect()}
    assert latency["a"] == (30.0, pytest.approx(200**0.5)) and latency["b"] == (10.0, 0.0)


def test_confusion(spark):
    counts = E.confusion_counts(spark.createDataFrame(ROWS, FACT).where("config = 'a'"))
    axis = [r["label"] for r in E.confusion_axis(counts).orderBy("position").collect()]
    assert axis == ["MA", "TN", "unknown", "NO_DOC", "ERROR"]
    matrix = {(r["true_label"], r["pred_label"]): r["n"] for r in E.confusion_matrix(counts).collect()}
    assert len(matrix) == 25 and matrix["MA", "unknown"] == 1 and matrix["NO_DOC", "ERROR"] == 1 and matrix["ERROR", "TN"] == 0
    wide = E.confusion_pivot(counts, "a", axis).collect()
    assert [r["true_label"] for r in wide] == axis and wide[1]["TN"] == 2


SUMMARY = "config string, position int, negative_rejection_rate double, parse_error_rate double, country_accuracy_macro double, latency_mean_ms double"


def winner(spark, rows):
    return [r["config"] for r in E.select_winner(spark.createDataFrame(rows, SUMMARY)).where("winner").collect()]


def test_selection(spark):
    rows = [("slow", 0, 1.0, 0.0, 0.9, 900.0), ("fast", 1, 1.0, 0.0, 0.9, 50.0), ("accepts_empty", 2, 0.5, 0.0, 0.99, 1.0), ("broken", 3, 1.0, 0.1, 0.99, 1.0)]
    assert winner(spark, rows) == ["fast"]
    assert winner(spark, [("n", 0, None, None, None, None)]) == ["n"]
    assert winner(spark, rows[2:]) == []
    assert winner(spark, [("x", 0, 1.0, 0.0, 0.9, None), ("y", 1, 1.0, 0.0, 0.9, 5.0)]) == ["y"]
    with pytest.raises(ValueError):
        E.SelectionRule(primary_metric="review_rate")
    with pytest.raises(TypeError):
        E.SelectionRule(other=1)


def test_means_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1, 0.5, None), ("a", 2, 1.0, 0.25), ("b", 1, None, None)], "config string, repeat int, x double, y double")
    assert {r["config"]: (r["x"], r["y"]) for r in E.mean_over_repeats(df).collect()} == {"a": (0.75, 0.25), "b": (None, None)}


def test_sweep(spark):
    images = spark.createDataFrame([(1, "f"), (2, "f")], "k int, folder string")
    detectors = spark.createDataFrame([("two",), ("nothing",)], "detector_name string")
    boxes = spark.createDataFrame([(k, "two", c) for k in (1, 2) for c in (0.12, 0.30)], "k int, detector_name string, confidence double")
    folders = spark.createDataFrame([("f",), ("empty",)], "folder string")
    per = S.image_confidences(images, detectors, boxes, ["k"])
    rows = {(r["detector_name"], r["folder"], r["threshold"]): (r["images"], r["detected"], r["multiple"]) for r in S.threshold_counts(per, [0.25, 0.05], folders, detectors).collect()}
    assert rows["two", "f", 0.05] == (2, 2, 2) and rows["two", "f", 0.25] == (2, 2, 0)
    assert rows["nothing", "f", 0.05] == (2, 0, 0) and rows["two", "empty", 0.05] == (0, 0, 0)


def test_dataset_info_and_latency(spark):
    schema = FACT + ", position int, reasons array<string>"
    rows = [(*r, 0, []) for r in ROWS] + [(*ROWS[0][:1], 2, *ROWS[0][2:], 1, []), (*ROWS[4][:1], 2, *ROWS[4][2:], 1, ["fetch_failed"])]
    assert tuple(E.dataset_info(spark.createDataFrame(rows, schema)).first()) == (2, 1, 1, 1)
    runs = spark.createDataFrame([("a", 10.0), ("a", 20.0)], "detector_name string, latency_ms double")
    names = spark.createDataFrame([("a",), ("b",)], "detector_name string")
    assert {tuple(r) for r in S.mean_latency(runs, names).collect()} == {("a", 15.0), ("b", 0.0)}


def test_too_many_detectors(spark):
    names = spark.range(S.MAX_DETECTORS + 1).selectExpr("concat('d', id) AS detector_name")
    images = spark.createDataFrame([(1, "a")], "k long, folder string")
    boxes = spark.createDataFrame([], "k long, detector_name string, confidence double")
    with pytest.raises(ValueError, match="detectors"):
        S.image_confidences(images, names, boxes, ["k"])
    assert S.image_confidences(images, names.limit(S.MAX_DETECTORS), boxes, ["k"]).count() == S.MAX_DETECTORS
