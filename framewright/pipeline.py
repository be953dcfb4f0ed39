"""The operational path: keys, records, regions, predictions, routing, storage (§3.1), and the reports of §3.2-3.4."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators import duplicates as D
from framewright.operators import evaluation as E
from framewright.operators import routing as R
from framewright.operators import sweep as S
from framewright.plugins import Classifier, Detector, classify, detections, regions_of
from framewright.session import stored
from framewright.sources.images import ImageSource, NfsZipSource, with_fingerprint
from framewright.sources.pictures import write_heat_map, write_reviews
from framewright.sources.reports import MISSING, Report, file_stem, grid, plain_rows, speller, spelt_rows
from framewright.sources.storage import Storage


def process(records: DataFrame, detector: Detector, classifiers: list[Classifier], threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(detections, regions, predictions, routed) of fetched records. Models run once: what they said is stored before it fans out."""
    found = stored(detections(records, detector))
    regions = stored(regions_of(found, detector))
    said = classify(regions, records, classifiers)
    predictions = stored(said.withColumn("seen", F.struct("model_name", "latency_ms")))
    order = {c.name: i for i, c in enumerate(classifiers)}
    position = F.coalesce(*[F.when(F.col("model_name") == n, F.lit(i)) for n, i in order.items()])
    ordered = predictions.withColumn("seen", position)
    routed = R.route_images(records, regions, ordered.select("region_id", *R.FIELDS, "confidence", "status", "seen"), threshold)
    return found, regions, predictions.drop("seen"), stored(routed)


def run_classify(source: ImageSource, detector: Detector, classifiers: list[Classifier], storage: Storage, run: str,
                 version: str = "1", threshold: float = 0.8, keys: DataFrame | None = None) -> dict[str, dict[str, int]]:
    """One run over a source; returns counts of images per label and per status. Repeating a run adds nothing."""
    records = stored(source.fetch(keys, keep_content=True))
    storage.save_images(records.select(
        "transaction_id", "image_id", F.col("reference").alias("image_reference"), "image_hash", "fetch_status", "failure_reason",
        F.current_timestamp().alias("ingested_at"),
    ))
    _, regions, predictions, routed = process(records, detector, classifiers, threshold)
    storage.save_regions(regions)
    kept = routed.where(~F.array_contains("reasons", R.FETCH_FAILED))  # failed fetches leave no predictions or reviews
    router = kept.withColumn("model_version", F.lit(R.RoutingConfig(threshold).describe()))
    rows = R.prediction_rows(predictions, router)
    storage.save_predictions(rows.withColumns({"run_id": F.lit(run), "pipeline_version": F.lit(version)}))
    storage.ensure_reviews(kept)
    best = R.summarize_images(routed, ["transaction_id", "image_id"])
    failed = F.when(F.array_contains("reasons", R.FETCH_FAILED), "failed").otherwise("ok")
    label = R.count_label(failed, F.col("document_type"), F.col("issuing_country"))
    status = F.when(F.col("needs_review"), "needs_review").otherwise("auto_accepted")
    counts = {}
    for name, column in (("labels", label), ("statuses", status)):
        rows = best.groupBy(column.alias("k")).agg(F.count("*").alias("n")).orderBy("k").collect()
        counts[name] = {r["k"]: r["n"] for r in rows}
    return counts


def evaluation_fact(labels: DataFrame, records: DataFrame, configs: dict[str, tuple[Detector, list[Classifier]]], repeats: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(fact, calls) of every config and repeat over labelled records; records are decoded from one stored copy."""
    truth = labels.select("transaction_id", "image_id", *[F.col(f).alias(f"true_{f}") for f in R.FIELDS])
    facts, calls = [], []
    for position, (name, (detector, classifiers)) in enumerate(configs.items()):
        for repeat in range(1, repeats + 1):
            found, _, said, routed = process(records, detector, classifiers, threshold)
            best = R.summarize_images(routed, ["transaction_id", "image_id"])
            # time of an image: its detection and all its classifier calls
            calls_of = said.select("transaction_id", "image_id", "latency_ms")
            spent = found.select(*calls_of.columns).unionByName(calls_of).groupBy("transaction_id", "image_id").agg(F.sum("latency_ms").alias("latency_ms"))
            tags = {"config": F.lit(name), "repeat": F.lit(repeat), "position": F.lit(position)}
            facts.append(
                best.select("transaction_id", "image_id", *[F.col(f).alias(f"pred_{f}") for f in R.FIELDS], "confidence", "needs_review", "reasons")
                .join(truth, ["transaction_id", "image_id"]).join(spent, ["transaction_id", "image_id"], "left").withColumns(tags)
            )
            calls.append(said.select("status").withColumns(tags))
    fact, call = facts[0], calls[0]
    for more, also in zip(facts[1:], calls[1:], strict=True):
        fact, call = fact.unionByName(more), call.unionByName(also)
    return stored(fact), stored(call)


COMPARED = tuple(E.MEANINGS)
PER_COUNTRY = ("config", "country", "n", "type_accuracy", "country_accuracy", "side_accuracy")
# fixed values: headers of the reports
LATENCY = "latency_ms (mean ± std)"
PREDICTED = ("repeat", "transaction_id", "image_id", "true_type", "true_country", "true_side", "pred_type", "pred_country", "pred_side",
             "confidence", "needs_review", "reasons", "latency_ms")


def judged_configs(fact: DataFrame, calls: DataFrame, rule: E.SelectionRule) -> DataFrame:
    """One row per config: metrics averaged over repeats, latency, repeats, position, eligible and winner."""
    metrics = E.image_metrics(fact).join(E.call_metrics(calls), ["config", "repeat"], "left")
    place = fact.groupBy("config").agg(F.min("position").alias("position"), F.count_distinct("repeat").alias("repeats"))
    summary = E.mean_over_repeats(metrics).join(E.latency(fact), "config", "left").join(place, "config")
    return stored(E.select_winner(summary, rule))


def evaluate(fact: DataFrame, calls: DataFrame, rule: E.SelectionRule, report: Report, about: dict[str, str] | None = None) -> DataFrame:
    """Writes comparison, per-country, confusion and prediction files; returns the judged summaries.

    about: what else comparison.md states (title, ground truth, routing).
    """
    judged = judged_configs(fact, calls, rule)
    configs = [r.asDict() for r in judged.orderBy("position").collect()]  # one row per configuration
    notes = E.selection_notes(configs, rule)
    spell = speller(T.DoubleType())
    compared = [
        [
            c["config"], *[spell(c[m]) for m in COMPARED],
            MISSING if c["latency_mean_ms"] is None else f"{c['latency_mean_ms']:.2f} ± {c['latency_std_ms']:.2f}", str(c["repeats"]), notes[c["config"]],
        ]
        for c in configs
    ]
    header = ["config", *COMPARED, LATENCY, "repeats", "selection"]
    report.rows("comparison.csv", header, compared)
    places = judged.select("config", "position")
    countries = E.country_means(fact).join(places, "config").select(*PER_COUNTRY, "position")
    by_country = [r[:-1] for r in spelt_rows(countries, ["position", "country"])]  # configurations x countries
    report.rows("per_country.csv", PER_COUNTRY, by_country)
    seen = E.dataset_info(fact).first() or dict.fromkeys(("images", "documents", "negatives", "fetch_failed"), 0)
    winner = next((c["config"] for c in configs if c["winner"]), None)
    facts = dict(about or {}) | {
        "Images": f"{seen['images']} ({seen['documents']} documents, {seen['negatives']} without one, {seen['fetch_failed']} not loaded)",
        "Repeats": str(max((c["repeats"] for c in configs), default=0)), "Selection rule": rule.describe(),
    }
    report.text(
        "comparison.md", *[f"* {k}: {v}" for k, v in facts.items()], "",
        f"## Winner: {winner}" if winner else "## No configuration meets the selection rule", "",
        "## Comparison", "", grid(header, compared), "## Countries", "", grid(PER_COUNTRY, by_country),
        "## Metrics", "", *[f"* {k}: {v}" for k, v in E.MEANINGS.items()], "* latency: detection and all calls of an image, over all images and repeats",
    )
    counts = stored(E.confusion_counts(fact))
    axis = E.confusion_axis(counts)
    for c in configs:
        name, stem = c["config"], file_stem(c["config"])
        labels = [r["label"] for r in axis.where(F.col("config") == name).orderBy("position").collect()]  # the taxonomy
        matrix = [tuple(r) for r in E.confusion_pivot(counts, name, labels).collect()]
        top = ["true \\ predicted", *labels]
        report.rows(f"confusion_{stem}.csv", top, matrix)
        report.text(f"confusion_{stem}.md", f"# {name}", "", "True countries in rows, predicted ones in columns, all repeats together.", "", grid(top, [list(map(str, r)) for r in matrix]))
        write_heat_map(labels, [list(r[1:]) for r in matrix], report.folder / f"confusion_{stem}.png")
        own = fact.where(F.col("config") == name).select(
            "repeat", "transaction_id", "image_id", *[F.col(f"{side}_{f}") for side in ("true", "pred") for f in R.FIELDS],
            "confidence", "needs_review", "reasons", F.round("latency_ms", 2).alias("latency_ms"),
        )
        report.table(f"predictions_{stem}.csv", own, ["repeat", "transaction_id", "image_id"], PREDICTED)
    return judged


def uploads_of(source: NfsZipSource) -> DataFrame:
    """Uploads of a share with one fingerprint each, as the duplicate reports take them."""
    records = with_fingerprint(source.fetch()).withColumn("folder", F.regexp_extract("reference", "([^/]+)/[^/]*$", 1))
    return stored(records.select(
        "folder", "transaction_id", "image_id", F.col("reference").alias("path"),
        F.when(F.col("fetch_status") == "ok", F.col("image_hash")).alias("sha"), "w0", "w1", "w2", "w3",
    ))


def find_duplicates(spark: SparkSession, root: str, folders: list[str], out: Path, max_distance: int = D.NEAR, review_distance: int = 40, review_images: bool = False) -> Path:
    """summary.csv, groups.csv, distances.csv and close_pairs.csv of a share, and review pictures if asked for."""
    report = Report(out)
    uploads = uploads_of(NfsZipSource(spark, root, folders))
    files = stored(D.distinct_files(uploads))
    groups = stored(D.file_groups(files, max_distance))
    named = spark.createDataFrame(list(enumerate(folders)), "position int, folder string")
    summary = D.folder_summary(uploads, groups, named).join(named, "folder")
    own = [c for c in summary.columns if c != "position"]
    report.rows("summary.csv", own, [r[:-1] for r in plain_rows(summary.select(*own, "position"), ["position"])])
    report.table("groups.csv", D.group_rows(uploads, groups, D.group_spread(files, groups)), [F.desc("copies"), "image_hash"], plain=True)
    report.table("distances.csv", D.distance_histogram(files), ["distance"], plain=True)
    pairs = stored(D.close_pairs(files, review_distance, max_distance))
    report.table("close_pairs.csv", pairs, ["distance", "upload_a", "upload_b"], plain=True)
    if review_images:
        shown = NfsZipSource(spark, root, folders).fetch(keep_content=True).where("fetch_status = 'ok'")
        named = shown.withColumn("folder", F.regexp_extract("reference", "([^/]+)/[^/]*$", 1))
        write_reviews(pairs, named.select(D.upload_name().alias("name"), "content"), str(out / "review"))
    return out


# fixed values: headers of the sweep's files
SWEPT = ("prompt_set", "folder", "threshold", "images", "detected", "multiple", "detection_rate")
PER_IMAGE = ("prompt_set", "folder", "transaction_id", "image_id", "image_hash", "confidences", "bboxes", "latency_ms")


def detected_images(records: DataFrame, detector: Detector) -> tuple[DataFrame, DataFrame]:
    """(one row per image: detector_name, folder, key, image_hash, size, regions, confidences, bboxes, latency_ms; its regions).

    confidences (highest first) and bboxes are texts, as the reports print them.
    """
    found = stored(detections(records, detector))
    regions = stored(regions_of(found, detector))
    index = F.element_at(F.split("region_id", ":"), -1).cast("int")
    boxes = regions.groupBy("transaction_id", "image_id").agg(
        F.array_sort(F.collect_list(F.struct(index.alias("i"), "detector_confidence", "x0", "y0", "x1", "y1"))).alias("_b")
    )
    shown = records.where("fetch_status = 'ok'").select("folder", "transaction_id", "image_id", F.substring("image_hash", 1, 16).alias("image_hash"), "width", "height")
    key = ["transaction_id", "image_id"]
    rows = shown.join(found.select(*key, "latency_ms"), key).join(boxes, key, "left").withColumn("_b", F.coalesce("_b", F.array()))
    return rows.select(
        F.lit(detector.name).alias("detector_name"), "folder", *key, "image_hash", F.col("width").alias("image_width"),
        F.col("height").alias("image_height"), F.size("_b").alias("regions"),
        F.transform("_b", lambda b: b["detector_confidence"]).alias("confidences"),
        F.array_join(F.transform("_b", lambda b: F.concat_ws(",", b["x0"], b["y0"], b["x1"], b["y1"])), " ").alias("bboxes"), "latency_ms",
    ), regions


def spelt_image(row) -> list:
    """Confidences with three digits, the latency in whole milliseconds; the rest as it is."""
    out = row.asDict()
    out["confidences"] = " ".join(f"{c:.3f}" for c in out["confidences"])
    out["latency_ms"] = f"{out['latency_ms']:.0f}"
    return list(out.values())


def sweep_detectors(records: DataFrame, detectors: list[Detector], thresholds: list[float], folders: list[str], report: Report) -> Report:
    """sweep.csv, per_image.csv and sweep.md; each detector runs once, at the lowest threshold."""
    spark = records.sparkSession
    each = [detected_images(records, d)[0] for d in detectors]
    images = each[0]
    for more in each[1:]:
        images = images.unionByName(more)
    images = stored(images)
    names = spark.createDataFrame([(i, d.name) for i, d in enumerate(detectors)], "_d int, detector_name string")
    places = spark.createDataFrame(list(enumerate(folders)), "_f int, folder string")
    counts = S.threshold_counts(images, thresholds, places, names)
    placed = counts.join(names, "detector_name").join(places, "folder").orderBy("_d", "_f", "threshold")
    swept = [  # detectors x folders x thresholds
        (r["detector_name"], r["folder"], r["threshold"], r["images"], r["detected"], r["multiple"], round(r["detected"] / r["images"], 3) if r["images"] else None)
        for r in placed.collect()
    ]
    report.rows("sweep.csv", SWEPT, swept)
    listed = images.join(names, "detector_name").join(places, "folder").orderBy("_f", "transaction_id", "image_id", "_d").select(
        "detector_name", "folder", "transaction_id", "image_id", "image_hash", "confidences", "bboxes", "latency_ms"
    )
    report.rows("per_image.csv", PER_IMAGE, map(spelt_image, listed.toLocalIterator()))
    means = {r["detector_name"]: r["mean_latency_ms"] for r in S.mean_latency(images, names).collect()}
    cells = {(d, f, t): f"{hit}/{n}" + (f" ({many})" if many else "") for d, f, t, n, hit, many, _ in swept}
    levels = sorted(set(thresholds))
    report.text(
        "sweep.md", "# Detector sweep", "", "Cells: images with a detection / images (images with two or more).", "",
        *[f"* {d.name}: prompts {getattr(d, 'prompts', '')}, {means[d.name]:.0f} ms per image on average" for d in detectors], "",
        grid(["prompt set", "folder", *(f">= {t}" for t in levels)], [[d.name, f, *(cells[d.name, f, t] for t in levels)] for d in detectors for f in folders]),
    )
    return report
