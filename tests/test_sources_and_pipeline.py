import csv
import zipfile

import pytest
from helpers import STRIPED, SameBoxes, StripeCounter, blocks, plain, png, striped, zipped

from framewright import cli, pipeline, plugins
from framewright.functions import pixels
from framewright.operators import labels as L
from framewright.plugins import FullImageDetector, YoloDetector
from framewright.sources.images import LocalFolderSource, NfsZipSource, sample_listing, shuffled_order
from framewright.sources.labels import read_labels
from framewright.sources.reports import Report, file_stem, grid, speller
from framewright.sources.storage import Storage, tables

NAMES = ["31_front", "32_front", "33_back", "32_back", "34_front"]  # the n-th has n stripes


@pytest.fixture
def pictures(tmp_path):
    folder = tmp_path / "pictures"
    folder.mkdir()
    for n, name in enumerate(NAMES):
        (folder / f"{name}.png").write_bytes(png(striped(n)))
    return folder


def test_decoding_and_grey():
    picture = blocks(3)
    assert (pixels.decode(png(picture)) == picture).all()
    with pytest.raises(pixels.UndecodableImage):
        pixels.decode(b"\x89PNG\r\n\x1a\nbroken")
    if not pixels.has_pillow():
        with pytest.raises(pixels.NoDecoder):
            pixels.decode(b"\xff\xd8\xff\xe0 a JPEG")
    flat = pixels.grey_matrix(plain(200))
    assert len(flat) == 17 * 16 and set(flat) == {200}
    assert (pixels.resized(pixels.grey(picture), 64, 48) == pixels.grey(picture)).all()


def test_folder_source(spark, pictures):
    (pictures / "notes.txt").write_text("x")
    (pictures / "nokey.png").write_bytes(b"x")
    (pictures / "35_back.PNG").write_bytes(b"no picture")
    source = LocalFolderSource(spark, str(pictures))
    keys = source.list_keys()
    assert {(r["transaction_id"], r["image_id"]) for r in keys.collect()} == {tuple([int(n.split("_")[0]), n.split("_")[1]]) for n in [*NAMES, "35_back"]}
    assert source.skipped() == 1
    gone = keys.limit(1).selectExpr("999L AS transaction_id", "'front' AS image_id", "'file:/nowhere/999_front.png' AS reference")
    rows = {r["transaction_id"]: r for r in source.fetch(keys.union(gone)).collect()}
    assert rows[33]["fetch_status"] == "ok" and (rows[33]["width"], rows[33]["height"]) == (40, 30) and len(rows[33]["image_hash"]) == 64
    assert rows[35]["failure_reason"] == "decode_error: UndecodableImage" and rows[35]["image_hash"] is None
    assert rows[999]["failure_reason"] == "read_error: FileNotFoundError"
    with pytest.raises(FileNotFoundError):
        LocalFolderSource(spark, str(pictures / "none"))


def share(tmp_path):
    root = tmp_path / "share"
    name = "{}_2026-10-01_15-29-25-873057_{}_img.zip"
    for txn, folder, side, picture, noise in (
        (1, "tun_nid_ocr", "front", 1, 0), (2, "tun_nid_ocr", "front", 1, 0), (3, "tun_nid_ocr", "front", 1, 9),
        (4, "tun_nid_ocr", "back", 2, 0), (5, "mar_nid_ocr", "back", 2, 0), (6, "mar_nid_ocr", "front", 3, 0),
    ):
        (root / folder).mkdir(parents=True, exist_ok=True)
        zipped(root / folder / name.format(txn, side), png(blocks(picture, noise)))
    return root, name


def test_zip_source(spark, tmp_path):
    root, name = share(tmp_path)
    folder = root / "tun_nid_ocr"
    (folder / "strange.zip").write_bytes(b"x")
    (folder / name.format(7, "back")).write_bytes(b"no zip")
    zipped(folder / name.format(8, "back"), b"x", "other.txt")
    source = NfsZipSource(spark, str(root), ["tun_nid_ocr", "mar_nid_ocr"])
    assert source.list_keys().count() == 8 and source.skipped() == 1
    reasons = {r["transaction_id"]: r["failure_reason"] for r in source.fetch().collect()}
    assert reasons[7] == "zip_error: BadZipFile" and reasons[8] == "zip_error: KeyError" and reasons[1] is None
    with pytest.raises(FileNotFoundError):
        NfsZipSource(spark, str(root), ["missing"])
    with zipfile.ZipFile(folder / name.format(1, "front")) as z:
        assert z.namelist() == ["original.jpeg"]


def table(path):
    with open(path, newline="", encoding="utf-8") as file:
        return list(csv.DictReader(file))


def test_find_duplicates(spark, tmp_path):
    root, _ = share(tmp_path)
    out = cli.main(["find-duplicates", "--root", str(root), "--folders", "tun_nid_ocr", "mar_nid_ocr", "--out", str(tmp_path / "out"), "--review-images"], spark)
    assert len(list((out / "review").glob("*.png"))) == len(table(out / "close_pairs.csv"))
    summary = {r["folder"]: tuple(r.values())[1:] for r in table(out / "summary.csv")}
    assert summary == {"tun_nid_ocr": ("4", "3", "2", "0"), "mar_nid_ocr": ("2", "2", "2", "0")}
    groups = table(out / "groups.csv")
    assert [(g["copies"], g["kind"], g["cross_folder"]) for g in groups] == [("3", "near", "False"), ("2", "exact", "True")]
    assert sum(int(r["pairs_same_folder"]) + int(r["pairs_cross_folder"]) for r in table(out / "distances.csv")) == 6
    assert [r["duplicate"] for r in table(out / "close_pairs.csv")][0] == "True"


def test_detection(spark, pictures):
    records = LocalFolderSource(spark, str(pictures)).fetch(keep_content=True).where("transaction_id = 32")
    boxes = [(1.2, 1.0, 20.0, 20.0, 0.5), (1.0, 1.0, 20.5, 20.0, 0.9), (-5.0, 0.0, 3.0, 4.0, 0.7), (90.0, 0.0, 99.0, 9.0, 0.9)]
    latencies = plugins.detections(records, SameBoxes([])).collect()  # a row for every image, also without a box
    assert len(latencies) == 2 and all(r["latency_ms"] >= 0 and r["candidates"] == [] for r in latencies)
    whole = plugins.detect(records.withColumn("content", records["content"].substr(1, 3)), FullImageDetector()).collect()
    assert {(r["x0"], r["y0"], r["x1"], r["y1"]) for r in whole} == {(0, 0, 40, 30)}  # nothing was decoded
    rows = plugins.detect(records, SameBoxes(boxes)).where("image_id = 'front'").orderBy("region_id").collect()
    assert [(r["region_id"], r["x0"], r["x1"], r["detector_confidence"]) for r in rows] == [("32:front:fixed:0", 1, 21, 0.9), ("32:front:fixed:1", 0, 3, 0.7)]

    class Boxes:
        def __init__(self, xyxy, conf):
            import numpy as np

            self.boxes = type("B", (), {"xyxy": np.array(xyxy), "conf": np.array(conf)})

    class Model:
        def predict(self, image, **settings):
            assert settings == {"conf": 0.1, "imgsz": 320, "device": "cpu", "verbose": False}
            return [Boxes([[1.0, 2.0, 9.0, 9.0]], [0.4])]

    yolo = YoloDetector("w", ["card"], confidence=0.1, image_size=320, model=Model())
    assert YoloDetector("own.pt").prompts == []  # the weights' own classes
    assert yolo.detect(plain(3)) == [(1.0, 2.0, 9.0, 9.0, 0.4)]


def test_classify_run(spark, pictures, tmp_path):
    (pictures / "35_front.png").write_bytes(b"broken")
    storage = Storage(tables(spark, str(tmp_path / "store")))
    source = LocalFolderSource(spark, str(pictures))
    run = lambda name: pipeline.run_classify(source, FullImageDetector(), [StripeCounter()], storage, name)
    counts = run("one")
    assert counts["labels"] == {"EG": 2, "FETCH_FAILED": 1, "FR": 1, "LB": 1, "NO_DOC": 1}
    assert counts["statuses"] == {"auto_accepted": 4, "needs_review": 2}
    rows = lambda: {t: storage.count_rows(t) for t in ("images", "regions", "predictions", "reviews")}
    assert rows() == {"images": 6, "regions": 5, "predictions": 10, "reviews": 5}
    run("one")
    assert rows()["predictions"] == 10
    run("two")
    assert rows() == {"images": 6, "regions": 5, "predictions": 20, "reviews": 5}
    answer = storage.read("predictions").where("model_name = 'stripes'").first()
    assert answer["status"] == "ok" and answer["latency_ms"] >= 0


def test_evaluation_files(spark, pictures, tmp_path):
    labels = tmp_path / "labels.csv"
    lines = ["transaction_id,image_id,image_path,document_type,issuing_country,document_side"]
    for name, triple in zip(NAMES, STRIPED, strict=True):
        lines.append(",".join([*name.split("_"), f"pictures/{name}.png", *triple]))
    labels.write_text("\n".join(lines))
    plugins.CLASSIFIERS["stripes"] = StripeCounter
    config = tmp_path / "config.yaml"
    config.write_text(f"""
experiment_name: my run
ground_truth: {labels}
output_dir: {tmp_path / "runs"}
repeats: 2
configurations:
  - name: good
    classifiers: [{{type: stripes}}]
  - name: broken/one
    classifiers: [{{type: stripes, out_of_order: true}}]
""")
    out = cli.main(["evaluate", "--config", str(config)], spark)
    rows = {r["config"]: r for r in table(out / "comparison.csv")}
    assert rows["good"]["selection"] == "WINNER" and rows["good"]["type_accuracy"] == "1.000" and rows["good"]["review_rate"] == "0.200"
    assert rows["broken/one"]["selection"] == "negative_rejection_rate 0.000 < 0.95" and rows["broken/one"]["model_error_rate"] == "1.000"
    assert rows["broken/one"]["accepted_accuracy"] == "n/a" and rows["good"]["repeats"] == "2" and " ± " in rows["good"]["latency_ms (mean ± std)"]
    countries = {(r["config"], r["country"]): r for r in table(out / "per_country.csv")}
    assert countries["good", "EG"]["n"] == "2" and countries["good", "EG"]["side_accuracy"] == "1.000"  # n of one repeat
    assert countries["broken/one", "LB"]["country_accuracy"] == "0.000" and len(countries) == 6
    summary = (out / "comparison.md").read_text()
    assert "Winner: good" in summary and "5 (4 documents, 1 without one, 0 not loaded)" in summary and "| EG | 2 |" in summary
    matrix = {r["true \\ predicted"]: r for r in table(out / "confusion_good.csv")}
    assert matrix["EG"]["EG"] == "4" and matrix["NO_DOC"]["NO_DOC"] == "2"
    said = table(out / "predictions_broken_one.csv")
    assert len(said) == 10 and {r["reasons"] for r in said} == {"model_error,low_confidence"} and said[0]["confidence"] == "n/a"
    assert list(said[0])[:6] == ["repeat", "transaction_id", "image_id", "true_type", "true_country", "true_side"]
    assert "| EG | 4 |" in (out / "confusion_good.md").read_text() and (out / "config.yaml").exists()
    config.write_text("configurations: []")
    with pytest.raises(ValueError, match="no configurations"):
        cli.main(["evaluate", "--config", str(config)], spark)


def test_labelled_images_in_many_folders(spark, tmp_path):
    for i in range(10_050):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / f"{i}_front.png").write_bytes(b"x")
    keys = spark.range(10_051).selectExpr("id AS transaction_id", "'front' AS image_id", f"concat('{tmp_path}/', id, '/', id, '_front.png') AS reference")
    reasons = cli._PathSource(spark).fetch(keys).groupBy("failure_reason").count().collect()
    assert {r["failure_reason"]: r["count"] for r in reasons} == {"decode_error: UndecodableImage": 10_050, "read_error: FileNotFoundError": 1}


def test_label_files(spark, tmp_path):
    path = tmp_path / "labels.csv"
    head = "transaction_id,image_id,image_path,document_type,issuing_country,document_side\n"
    good = "1,front,a.png,national_id,TN,front\n"
    path.write_text(head + good)
    assert read_labels(spark, str(path)).first()["image_path"] == str(tmp_path / "a.png")
    for content, message in (
        (head + good + "2,front,/b.png,national_id,Turkey,front\n", "row 3"), (head + good + good, "occurs 2"),
        (head, "no rows"), ("transaction_id\n1\n", "columns missing"), (head + "x,front,a,none,TN,front\n", "row 2"),
    ):
        path.write_text(content)
        with pytest.raises(ValueError, match=message):
            read_labels(spark, str(path))


def test_ground_truth(spark, tmp_path):
    root, _ = share(tmp_path)
    out = cli.main(["build-ground-truth", "--root", str(root), "--out", str(tmp_path / "g.csv"), "--per-folder", "2"], spark)
    rows = table(out)
    assert [r["image_path"].split("/")[-2] for r in rows] == ["tun_nid_ocr"] * 2 + ["mar_nid_ocr"] * 2
    assert [(r["transaction_id"], r["image_id"]) for r in rows[2:]] == [("5", "back"), ("6", "front")]
    assert len(rows) == 4 and {(r["document_type"], r["issuing_country"]) for r in rows} == {("national_id", "TN"), ("national_id", "MA")}
    assert read_labels(spark, str(out)).count() == 4


def test_sweep_command(spark, tmp_path, monkeypatch):
    root, _ = share(tmp_path)
    monkeypatch.setitem(plugins.DETECTORS, "fixed", lambda name, prompts, confidence: SameBoxes([(0, 0, 20, 20, 0.3), (30, 0, 60, 40, 0.12)] if prompts == ["card"] else [], name))
    config = tmp_path / "sweep.yaml"
    config.write_text(f"""
sweep:
  root: {root}
  folders: [tun_nid_ocr, mar_nid_ocr]
  per_folder: 5
  thresholds: [0.25, 0.05]
  output_dir: {tmp_path / "sweeps"}
  detector: {{type: fixed}}
  prompt_sets: {{two_boxes: [card], nothing: [x]}}
""")
    out = cli.main(["sweep-detector", "--config", str(config)], spark)
    rows = {(r["prompt_set"], r["folder"], r["threshold"]): (r["images"], r["detected"], r["multiple"]) for r in table(out / "sweep.csv")}
    assert rows["two_boxes", "tun_nid_ocr", "0.05"] == ("2", "2", "2") and rows["two_boxes", "tun_nid_ocr", "0.25"] == ("2", "2", "0")
    assert rows["nothing", "mar_nid_ocr", "0.05"] == ("2", "0", "0")
    each = table(out / "per_image.csv")
    assert len(each) == 8 and {(r["confidences"], r["bboxes"]) for r in each if r["prompt_set"] == "two_boxes"} == {("0.300 0.120", "0,0,20,20 30,0,60,40")}
    assert all(r["latency_ms"].isdigit() and len(r["image_hash"]) == 16 for r in each)
    grid_ = (out / "sweep.md").read_text()
    assert "| two_boxes | tun_nid_ocr | 2/2 (2) | 2/2 |" in grid_ and "ms per image" in grid_
    again = cli.main(["sweep-detector", "--config", str(config), "--folders", "mar_nid_ocr", "--root", str(root)], spark)
    assert {r["folder"] for r in table(again / "sweep.csv")} == {"mar_nid_ocr"}


def test_samples_follow_the_seeded_order(spark, tmp_path, monkeypatch):
    root, _ = share(tmp_path)
    listed = NfsZipSource(spark, str(root), ["tun_nid_ocr"]).list_keys().collect()
    order = shuffled_order([r["reference"] for r in listed], 5)
    opened = []
    fetch = NfsZipSource.fetch
    monkeypatch.setattr(NfsZipSource, "fetch", lambda self, keys=None, **k: opened.append(keys.count()) or fetch(self, keys, **k))
    rows = cli._sampled(spark, str(root), ["tun_nid_ocr"], 2, False, 5).collect()
    assert {r["reference"] for r in rows} == set(order[:2]) and sum(opened) <= 12
    kept, looks = [], set()
    for name in order:  # transactions 1 to 3 show one picture
        look = "one" if name.split("/")[-1][0] in "123" else name
        if look not in looks and len(kept) < 3:
            kept.append(name), looks.add(look)
    assert {r["reference"] for r in cli._sampled(spark, str(root), ["tun_nid_ocr"], 3, True, 5).collect()} == set(kept)


def test_preview_command(spark, tmp_path, monkeypatch):
    root, _ = share(tmp_path)
    monkeypatch.setitem(plugins.DETECTORS, "fixed", lambda: SameBoxes([(0, 0, 20, 20, 0.3), (30, 0, 60, 40, 0.12)]))
    config = tmp_path / "preview.yaml"
    config.write_text(f"preview: {{root: {root}, folders: [tun_nid_ocr, mar_nid_ocr], per_folder: 5, output_dir: {tmp_path / 'p'}, detector: {{type: fixed}}}}")
    rows = table(cli.main(["preview-detector", "--config", str(config)], spark))
    assert [(r["folder"], r["regions"], r["confidences"]) for r in rows if r["latency_ms"].isdigit()] == [("mar_nid_ocr", "2", "0.300 0.120")] * 2 + [("tun_nid_ocr", "2", "0.300 0.120")] * 2
    assert len(list((tmp_path / "p").rglob("*.png"))) == 12
    drawn = pixels.draw_boxes(plain(0), [(2, 2, 20, 20)])
    assert tuple(drawn[2, 10]) == pixels.COLOURS[0] and tuple(drawn[10, 10]) == (0, 0, 0)
    assert pixels.thumbnail(plain(9, 64, 32), 16).shape == (8, 16, 3)


def test_registry_and_reports(tmp_path):
    with pytest.raises(ValueError):
        plugins.build_detector({"type": "unknown"})
    with pytest.raises(TypeError):
        plugins.build_detector({"type": "full_image", "strange": 1})
    with pytest.raises(ValueError):
        plugins.build_classifiers([])
    assert plugins.build_detector(None).name == "full_image"
    from pyspark.sql import types as T

    number = speller(T.DoubleType())
    assert (number(None), number(1 / 80), speller(T.LongType())(3)) == ("n/a", "0.013", "3") and file_stem("a/b c") == "a_b_c"
    assert speller(T.ArrayType(T.StringType()))(["a", "b"]) == "a,b" and "| n/a |" in grid(["x"], [[number(None)]])
    assert Report.reserved(tmp_path, "r").folder != Report.reserved(tmp_path, "r").folder
    assert shuffled_order(["b", "a", "c"], 42) == shuffled_order(["c", "b", "a"], 42)
    assert sample_listing({"x": ["2", "1"], "y": list("abcdef")}, 3, 1)["x"] == ["1", "2"]


def test_label_checks(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("national_id", "TN", "front"), ("card", "Turkey", None), (None, None, "n/a")], "t string, c string, s string")
    got = [r[0] for r in rows.select(L.label_problems(F.col("t"), F.col("c"), F.col("s"))).collect()]
    assert got == [[], ["document_type card", "issuing_country Turkey", "document_side NULL"], ["document_type NULL", "issuing_country NULL"]]
