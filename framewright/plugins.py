"""Detectors and classifiers as plug-ins that run in Python workers (UDF-01..08, SRC of regions, JN-08, FN-11).

A detector gives boxes for a record, a classifier a label triple for a crop. Both run once per partition,
so that a model is loaded once; boxes are clipped and suppressed in Catalyst.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import boxes as B
from framewright.functions.pixels import decode
from framewright.operators.labels import region_id

BOX = "x0 double, y0 double, x1 double, y1 double, confidence double"
IMAGE_KEY = "transaction_id long, image_id string"
PREDICTION = (
    "model_name string, model_version string, document_type string, issuing_country string, document_side string, "
    "confidence double, status string, raw_output string, error string, latency_ms double"
)


@dataclass
class Prediction:
    document_type: str | None = None
    issuing_country: str | None = None
    document_side: str | None = None
    confidence: float | None = None
    status: str = "ok"
    raw_output: str | None = None
    error: str | None = None


class Detector(ABC):
    name: str
    duplicate_iou: float = 0.7
    needs_pixels = True  # else `whole` is asked, and no image is decoded

    def whole(self, width: int, height: int) -> list[tuple[float, float, float, float, float]]:
        """Candidates from the image's size alone."""
        raise NotImplementedError

    @abstractmethod
    def detect(self, pixels: np.ndarray) -> list[tuple[float, float, float, float, float]]:
        """(x0, y0, x1, y1, confidence) per candidate; no order, overlaps allowed."""

    def open(self) -> None:
        """Called once in each worker before the first image."""


class FullImageDetector(Detector):
    """One region that is the whole image, with confidence 1."""

    needs_pixels = False

    def __init__(self, name: str = "full_image"):
        self.name = name

    def whole(self, width: int, height: int) -> list[tuple[float, float, float, float, float]]:
        return [(0.0, 0.0, float(width), float(height), 1.0)]

    def detect(self, pixels: np.ndarray) -> list[tuple[float, float, float, float, float]]:
        return self.whole(pixels.shape[1], pixels.shape[0])


class YoloDetector(Detector):
    """Detection of what the prompts name, or of the weights' own classes without any; needs the `ultralytics` package, or a `model`."""

    def __init__(self, weights: str = "yoloe-26s-seg.pt", prompts: list[str] | None = None, confidence: float = 0.25, duplicate_iou: float = 0.7,
                 image_size: int = 640, device: str = "cpu", name: str = "yolo", model=None):
        self.weights, self.prompts, self.confidence = weights, list(prompts or ()), confidence
        self.duplicate_iou, self.image_size, self.device = duplicate_iou, image_size, device
        self.name, self.model = name, model

    def open(self) -> None:
        if self.model is None:
            import ultralytics

            self.model = (ultralytics.YOLOE if self.prompts else ultralytics.YOLO)(self.weights)
            if self.prompts:
                self.model.set_classes(self.prompts)

    def detect(self, pixels: np.ndarray) -> list[tuple[float, float, float, float, float]]:
        # the model library takes arrays in BGR order
        found = self.model.predict(
            pixels[:, :, ::-1], conf=self.confidence, imgsz=self.image_size, device=self.device, verbose=False
        )[0].boxes
        return [(*map(float, box), float(c)) for box, c in zip(found.xyxy.tolist(), found.conf.tolist(), strict=True)]


class Classifier(ABC):
    name: str
    model_version: str = "1"

    @abstractmethod
    def classify(self, crop: np.ndarray) -> Prediction: ...

    def open(self) -> None:
        """Called once in each worker before the first crop."""


def detections(records: DataFrame, detector: Detector) -> DataFrame:
    """One row per fetched record: its key, width, height, candidates (ARRAY of BOX) and the model's latency_ms.

    records: fetch_status, content, width, height and the key. Failed fetches never reach the model. Contents are only
    read for detectors that look at pixels; decoding is not part of the latency.
    """
    fields = [x.split()[0] for x in BOX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = False
        for pdf in batches:
            if not opened and len(pdf):
                detector.open()
                opened = True
            for x in pdf.itertuples(index=False):
                pixels = decode(x.content) if detector.needs_pixels else None
                began = time.perf_counter()
                boxes = detector.detect(pixels) if detector.needs_pixels else detector.whole(int(x.width), int(x.height))
                spent = (time.perf_counter() - began) * 1000
                found = [dict(zip(fields, map(float, box), strict=True)) for box in boxes]
                yield pd.DataFrame([(x.transaction_id, x.image_id, int(x.width), int(x.height), found, spent)], columns=names)

    names = ["transaction_id", "image_id", "width", "height", "candidates", "latency_ms"]
    wanted = ["transaction_id", "image_id", "width", "height", *(["content"] if detector.needs_pixels else [])]
    struct = ", ".join(f"{x}: double" for x in fields)
    schema = f"{IMAGE_KEY}, width int, height int, candidates array<struct<{struct}>>, latency_ms double"
    return records.where("fetch_status = 'ok'").select(*wanted).mapInPandas(run, schema)


def regions_of(found: DataFrame, detector: Detector) -> DataFrame:
    """Regions of `detections`: transaction_id, image_id, region_id, detector_name, box, confidence."""
    each = found.select("transaction_id", "image_id", "width", "height", F.explode("candidates").alias("c")).select(
        "transaction_id", "image_id", "width", "height", "c.*"
    )
    c = [F.col(x) for x in ("x0", "y0", "x1", "y1")]
    boxed = each.select(
        "transaction_id", "image_id", "confidence", F.struct(*c).alias("tie"),
        B.clip_box(*c, F.col("width"), F.col("height")).alias("box"),
    )
    kept = B.suppressed_regions(boxed, ["transaction_id", "image_id"], detector.duplicate_iou)
    return kept.select(
        "transaction_id", "image_id",
        region_id(F.col("transaction_id"), F.col("image_id"), F.lit(detector.name), F.col("region_index")).alias("region_id"),
        F.lit(detector.name).alias("detector_name"), "box.x0", "box.y0", "box.x1", "box.y1",
        F.col("confidence").alias("detector_confidence"),
    )


def detect(records: DataFrame, detector: Detector) -> DataFrame:
    """Regions of fetched records, where latencies do not matter."""
    return regions_of(detections(records, detector), detector)


def safe_classify(classifier: Classifier, crop: np.ndarray) -> dict:
    """The classifier's answer with its latency; an exception becomes a `model_error` with its type."""
    began = time.perf_counter()
    try:
        answer = classifier.classify(crop)
    except Exception as error:
        answer = Prediction(status="model_error", error=type(error).__name__)
    spent = (time.perf_counter() - began) * 1000
    return asdict(answer) | {"model_name": classifier.name, "model_version": classifier.model_version, "latency_ms": spent}


def classify(regions: DataFrame, records: DataFrame, classifiers: list[Classifier]) -> DataFrame:
    """One row per region and classifier: the region's key and PREDICTION.

    An image is decoded once for all its regions and all classifiers.
    """
    names = [x.split()[0] for x in f"{IMAGE_KEY}, region_id string, {PREDICTION}".split(", ")]
    boxes = regions.groupBy("transaction_id", "image_id").agg(
        F.array_sort(F.collect_list(F.struct("region_id", "x0", "y0", "x1", "y1"))).alias("regions")
    )
    pictures = records.where("fetch_status = 'ok'").select("transaction_id", "image_id", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = False
        for pdf in batches:
            if not opened and len(pdf):
                for c in classifiers:
                    c.open()
                opened = True
            for x in pdf.itertuples(index=False):
                pixels, rows = decode(x.content), []
                for r in x.regions:
                    crop = pixels[r["y0"] : r["y1"], r["x0"] : r["x1"]]
                    for c in classifiers:
                        rows.append(safe_classify(c, crop) | {"transaction_id": x.transaction_id, "image_id": x.image_id, "region_id": r["region_id"]})
                yield pd.DataFrame(rows, columns=names)

    return pictures.join(boxes, ["transaction_id", "image_id"]).mapInPandas(run, f"{IMAGE_KEY}, region_id string, {PREDICTION}")


Factory = Callable[..., object]
DETECTORS: dict[str, Factory] = {"full_image": FullImageDetector, "yolo": YoloDetector}
CLASSIFIERS: dict[str, Factory] = {}


def build(kinds: dict[str, Factory], spec: dict):
    """A component from {"type": ..., parameters}; unknown types and parameters raise."""
    values = dict(spec)
    kind = values.pop("type", None)
    if kind not in kinds:
        raise ValueError(f"unknown type {kind!r}; known: {', '.join(sorted(kinds)) or 'none'}")
    return kinds[kind](**values)


def build_detector(spec: dict | None) -> Detector:
    return build(DETECTORS, spec or {"type": "full_image"})


def build_classifiers(specs: list[dict] | None) -> list[Classifier]:
    """At least one classifier, each with a name of its own."""
    built = [build(CLASSIFIERS, s) for s in specs or []]
    if not built:
        raise ValueError("no classifiers")
    names = [c.name for c in built]
    if len(set(names)) < len(names):
        raise ValueError("classifier names must differ")
    return built
