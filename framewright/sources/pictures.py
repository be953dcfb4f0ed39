"""Pictures for people to look at (SNK-12, SNK-13, SNK-14): opt-in, written by the tasks that hold the pixels.

Real documents are copied by these, so nothing calls them unless asked to. Files are PNG.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.pixels import decode, draw_boxes, encode_png, side_by_side, thumbnail
from framewright.sources.reports import file_stem

MAX_REVIEW = 300  # fixed value: review pictures at most


def _write(folder: str, name: str, pixels) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{file_stem(name)}.png", "wb") as file:
        file.write(encode_png(pixels))


def write_previews(records: DataFrame, regions: DataFrame, out: str) -> int:
    """One picture with its boxes, and one crop per box, for each record; returns the number of pictures.

    records: folder, key, content. `out` is a folder that all workers share.
    """
    boxes = regions.groupBy("transaction_id", "image_id").agg(
        F.array_sort(F.collect_list(F.struct("region_id", "x0", "y0", "x1", "y1"))).alias("boxes")
    )
    rows = records.select("folder", "transaction_id", "image_id", "content").join(boxes, ["transaction_id", "image_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                pixels = decode(x.content)
                name = f"{x.transaction_id}_{x.image_id}"
                found = [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in (x.boxes if x.boxes is not None else [])]
                _write(f"{out}/{x.folder}", name, thumbnail(draw_boxes(pixels, found)))
                for i, (x0, y0, x1, y1) in enumerate(found):
                    _write(f"{out}/{x.folder}/crops", f"{name}_{i}", thumbnail(pixels[y0:y1, x0:x1]))
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_reviews(pairs: DataFrame, records: DataFrame, out: str, most: int = MAX_REVIEW) -> int:
    """Close pairs side by side, the closest first, `most` at most; returns their number.

    pairs: distance, upload_a, upload_b. records: name (folder/transaction_image), content. File names hold the folders.
    """
    first = pairs.orderBy("distance", "upload_a", "upload_b").limit(most)
    named = records.groupBy("name").agg(F.first("content").alias("content"))
    rows = first.join(named.select(F.col("name").alias("upload_a"), F.col("content").alias("a")), "upload_a").join(
        named.select(F.col("name").alias("upload_b"), F.col("content").alias("b")), "upload_b"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                _write(out, f"{x.distance:03d}_{x.upload_a}_{x.upload_b}", side_by_side(decode(x.a), decode(x.b)))
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_heat_map(labels: list[str], counts: list[list[int]], path: Path) -> Path | None:
    """A confusion matrix as a picture; None if matplotlib can't be imported."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return None
    figure = Figure(figsize=(1 + 0.5 * len(labels), 1 + 0.5 * len(labels)))
    axes = figure.subplots()
    axes.imshow(counts, cmap="Blues")
    axes.set_xticks(range(len(labels)), labels, rotation=90)
    axes.set_yticks(range(len(labels)), labels)
    axes.set_xlabel("predicted")
    axes.set_ylabel("true")
    for i, row in enumerate(counts):
        for j, n in enumerate(row):
            if n:
                axes.text(j, i, str(n), ha="center", va="center")
    figure.tight_layout()
    figure.savefig(path)
    return path
