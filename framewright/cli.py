"""Command line (CLI-01..06): python -m framewright.cli <command>."""

from __future__ import annotations

import argparse
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import pipeline, plugins
from framewright.functions.pixels import has_pillow
from framewright.operators import duplicates as D
from framewright.operators.evaluation import SelectionRule
from framewright.operators.ranks import bucketed_row_number
from framewright.operators.routing import RoutingConfig
from framewright.session import build_session, stored
from framewright.sources import reports
from framewright.sources.images import LocalFolderSource, NfsZipSource, sample_listing, shuffled_order, with_fingerprint
from framewright.sources.labels import FOLDER_LABELS, label_rows, load_yaml, read_labels
from framewright.sources.pictures import write_previews
from framewright.sources.storage import Storage, tables


SHARE = "/mnt/nfs"  # fixed value: where the share is mounted unless --root says otherwise


def build_ground_truth(spark: SparkSession, root: str, out: str, per_folder: int | None, seed: int) -> Path:
    """The label file of the known folders that exist; sampled names come from one generator."""
    present = [f for f in FOLDER_LABELS if Path(root, f).is_dir()]
    if not present:
        raise FileNotFoundError(f"{root}: none of the known folders")
    keys = NfsZipSource(spark, root, present).list_keys()
    names = keys.withColumn("folder", F.regexp_extract("reference", "([^/]+)/[^/]*$", 1))
    if per_folder is not None:
        listing = {f: [r["reference"] for r in names.where(F.col("folder") == f).select("reference").collect()] for f in present}
        wanted = [(n,) for own in sample_listing(listing, per_folder, seed).values() for n in own]
        keys = keys.join(spark.createDataFrame(wanted, "reference string"), "reference", "left_semi")
    rows = label_rows(keys).withColumn("image_path", F.regexp_replace("image_path", "^file:", ""))
    # folder by folder as configured, inside it by transaction, side and path
    places = spark.createDataFrame(list(enumerate(present)), "_f int, _folder string")
    placed = rows.withColumn("_folder", F.regexp_extract("image_path", "([^/]+)/[^/]*$", 1)).join(places, "_folder")
    ordered = placed.orderBy("_f", "transaction_id", "image_id", "image_path").select(*rows.columns)
    return reports.Report(Path(out).parent).table(Path(out).name, ordered, plain=True)


def _source(spark: SparkSession, spec: dict):
    kind = spec.get("type", "local_folder")
    if kind == "local_folder":
        return LocalFolderSource(spark, spec["path"], bool(spec.get("recursive", False)))
    if kind == "nfs_zip":
        return NfsZipSource(spark, spec["root"], spec["folders"])
    raise ValueError(f"unknown source type {kind!r}")


def run_evaluate(spark: SparkSession, config: str) -> Path:
    values = load_yaml(config)
    rule = SelectionRule(**(values.get("selection_rule") or {}))
    specs = values.get("configurations") or []
    if not specs:
        raise ValueError("no configurations to run")
    names = [s["name"] for s in specs]
    if len(set(names)) < len(names):
        raise ValueError("configuration names must differ")
    built = {s["name"]: (plugins.build_detector(s.get("detector")), plugins.build_classifiers(s.get("classifiers"))) for s in specs}
    labels = read_labels(spark, values["ground_truth"])
    title = values.get("experiment_name", Path(config).stem)
    report = reports.Report.reserved(Path(values.get("output_dir", "data/runs")), title, Path(config))
    keys = labels.select("transaction_id", "image_id", F.col("image_path").alias("reference"))
    records = stored(_PathSource(spark).fetch(keys, keep_content=True))
    threshold = RoutingConfig(**(values.get("routing") or {})).confidence_threshold
    fact, calls = pipeline.evaluation_fact(labels, records, built, int(values.get("repeats", 1)), threshold)
    about = {"Experiment": title, "Ground truth": str(values["ground_truth"]), "Routing": RoutingConfig(threshold).describe()}
    pipeline.evaluate(fact, calls, rule, report, about)
    return report.folder


class _PathSource(LocalFolderSource):
    """Fetches files by the names in the keys, wherever they lie: the workers open them, so no folder is listed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark


def run_classify(spark: SparkSession, config: str, run: str | None) -> dict:
    values = load_yaml(config)
    own = values.get("classify")
    if not own:
        raise ValueError("the config has no `classify` section")
    return pipeline.run_classify(
        _source(spark, own["source"]), plugins.build_detector(own.get("detector")), plugins.build_classifiers(own.get("classifiers")),
        Storage(tables(spark, own["storage"])), run or reports.run_id(), str(own.get("pipeline_version", "1")),
        RoutingConfig(**(values.get("routing") or {})).confidence_threshold,
    )


def _sampled(spark: SparkSession, root: str, folders: list[str], per_folder: int, unique: bool, seed: int) -> DataFrame:
    """Records of up to `per_folder` readable images a folder in seeded order, copies left out if `unique`.

    The order is a seeded shuffle of a folder's names, which the driver lists. Files are then read slice by slice of that
    order, and only for folders that are not full.
    """
    source = NfsZipSource(spark, root, folders)
    keys = stored(source.list_keys().withColumn("folder", F.regexp_extract("reference", "([^/]+)/[^/]*$", 1)))
    named = [(name, i) for f in folders for i, name in enumerate(shuffled_order([r[0] for r in keys.where(F.col("folder") == f).select("reference").collect()], seed))]
    placed = stored(keys.join(spark.createDataFrame(named, "reference string, _o long"), "reference"))
    upto, size, left = 0, 2 * per_folder + 8, list(folders)
    seen = None
    while True:
        part = placed.where(F.col("folder").isin(left) & (F.col("_o") >= upto) & (F.col("_o") < upto + size))
        records = with_fingerprint(source.fetch(part.select("transaction_id", "image_id", "reference"), keep_content=True))
        read = stored(records.where("fetch_status = 'ok'").join(part.select("reference", "folder", "_o"), "reference").withColumn("sha", F.col("image_hash")))
        seen = read if seen is None else seen.unionByName(read)
        if unique:
            taken = D.greedy_distinct_sample(seen, per_folder, "_o").select("folder", "_o")
        else:
            taken = bucketed_row_number(seen, ["folder"], ["_o"], F.lit(0), "_k").where(F.col("_k") < per_folder).select("folder", "_o")
        taken = stored(taken)
        counts = {r["folder"]: r["count"] for r in taken.groupBy("folder").count().collect()}
        upto, size = upto + size, 2 * size
        more = {r["folder"] for r in placed.where(F.col("_o") >= upto).select("folder").distinct().collect()}
        left = [f for f in left if counts.get(f, 0) < per_folder and f in more]
        if not left:
            return stored(seen.join(taken, ["folder", "_o"], "left_semi"))


def run_sweep(spark: SparkSession, config: str, root: str | None, folders: list[str] | None, per_folder: int | None) -> Path:
    own = load_yaml(config)["sweep"]
    thresholds = sorted(own["thresholds"])
    shared = own.get("detector") or {}
    detectors = [
        plugins.build_detector(shared | {"name": name, "prompts": prompts, "confidence": thresholds[0]})
        for name, prompts in own["prompt_sets"].items()
    ]
    names = folders or own["folders"]
    records = _sampled(spark, root or own["root"], names, per_folder or own.get("per_folder", 20), own.get("unique_only", True), own.get("seed", 42))
    report = reports.Report.reserved(Path(own.get("output_dir", "data/sweeps")), "sweep")
    return pipeline.sweep_detectors(records, detectors, thresholds, names, report).folder


def run_preview(spark: SparkSession, config: str, root: str | None, folders: list[str] | None, per_folder: int | None) -> Path:
    own = load_yaml(config)["preview"]
    names = folders or own["folders"]
    records = _sampled(spark, root or own["root"], names, per_folder or own.get("per_folder", 5), own.get("unique_only", True), own.get("seed", 42))
    images, found = pipeline.detected_images(records, plugins.build_detector(own.get("detector")))
    report = reports.Report(Path(own.get("output_dir", "data/preview")))
    if own.get("images", True):
        write_previews(records, found, str(report.folder))
    images = images.drop("detector_name").orderBy("folder", "transaction_id", "image_id")
    return report.rows("summary.csv", images.columns, map(pipeline.spelt_image, images.toLocalIterator()))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framewright")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for option, kind in options.items():
            flag = "--" + option.replace("_", "-")
            if kind is bool:
                sub.add_argument(flag, action="store_true")
            elif kind is list:
                sub.add_argument(flag, nargs="+")
            else:
                sub.add_argument(flag, type=kind)
        return sub

    command("build-ground-truth", root=str, out=str, per_folder=int, seed=int).set_defaults(root=SHARE, out="data/ground_truth.csv", seed=42)
    command("evaluate", config=str)
    command("classify", config=str, run_id=str)
    command("preview-detector", config=str, root=str, folders=list, per_folder=int)
    command("sweep-detector", config=str, root=str, folders=list, per_folder=int)
    command("find-duplicates", root=str, folders=list, out=str, max_distance=int, review_distance=int, review_images=bool).set_defaults(
        root=SHARE, folders=list(FOLDER_LABELS), out="data/duplicates", max_distance=D.NEAR, review_distance=40
    )
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(arguments)
    if not has_pillow():
        warnings.warn("Pillow is not installed: images other than PNG become failed rows (decode_error: NoDecoder)", stacklevel=2)
    spark = spark or build_session()
    if a.command == "build-ground-truth":
        done = build_ground_truth(spark, a.root, a.out, a.per_folder, a.seed)
    elif a.command == "evaluate":
        done = run_evaluate(spark, a.config)
    elif a.command == "classify":
        done = run_classify(spark, a.config, a.run_id)
    elif a.command == "preview-detector":
        done = run_preview(spark, a.config, a.root, a.folders, a.per_folder)
    elif a.command == "sweep-detector":
        done = run_sweep(spark, a.config, a.root, a.folders, a.per_folder)
    else:
        done = pipeline.find_duplicates(spark, a.root, a.folders, Path(a.out), a.max_distance, a.review_distance, a.review_images)
    print(done)
    return done


if __name__ == "__main__":
    main()
