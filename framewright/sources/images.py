"""Image sources: folders of images and shares of zips (SRC-01..07, SRC-12, SRC-13, ORD-01, ORD-05, ORD-08).

A source lists keys (transaction_id, image_id, reference) and fetches records; a file that can't be
read or decoded gives a failed row, never an exception. Listing prunes the file contents.
"""

from __future__ import annotations

import io
import random
import zipfile
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.bits import gradient_words
from framewright.functions.pixels import decode, grey_matrix
from framewright.operators.labels import (
    ZIP_NAME,
    file_name,
    has_image_extension,
    parse_stem,
    parse_zip_name,
)

MEMBER = "original.jpeg"  # fixed value: the file inside an upload's zip
KEY_SCHEMA = "transaction_id long, image_id string, reference string"
RECORD = (
    "transaction_id long, image_id string, reference string, fetch_status string, failure_reason string, "
    "image_hash string, width int, height int, grey array<int>, content binary"
)


class ImageSource(ABC):
    """Lists keys and fetches records."""

    spark: SparkSession

    def fetch(self, keys: DataFrame | None = None, keep_content: bool = False) -> DataFrame:
        """Records of the keys (of all, if None): columns of RECORD.

        A key without a file is a failed row with `read_error`. image_hash is NULL when decoding fails. Without keys, files
        are read where they are listed. With keys, a task opens the files of its own keys, and no others, if they lie
        in a file system that all workers mount; elsewhere the listing is joined.
        """
        if keys is None:
            return self._keyed(self._listing()).mapInPandas(_records(keep_content), RECORD)
        if self.mounted:
            spread = keys.repartition(self.spark.sparkContext.defaultParallelism, "reference")
            return spread.mapInPandas(_records(keep_content, _opened), RECORD)
        files = self._listing().select(F.col("path").alias("_path"), "content")
        joined = keys.join(files, F.col("reference") == F.col("_path"), "left").drop("_path")
        return joined.mapInPandas(_records(keep_content), RECORD)

    mounted = True

    def list_keys(self) -> DataFrame:
        return self._keyed(self._listing()).drop("content")

    @abstractmethod
    def _keyed(self, files: DataFrame) -> DataFrame:
        """transaction_id, image_id, reference and content of the files whose names hold a key."""

    @abstractmethod
    def _listing(self) -> DataFrame: ...


def existing_folder(spark: SparkSession, path: str) -> str:
    """The folder's full name; raises if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target) or not system.getFileStatus(target).isDirectory():
        raise FileNotFoundError(path)
    return system.getFileStatus(target).getPath().toString()


class LocalFolderSource(ImageSource):
    """Images `<transaction_id>_<image_id>.<extension>` of a folder; other files are skipped."""

    def __init__(self, spark: SparkSession, path: str, recursive: bool = False):
        self.spark, self.path, self.recursive = spark, existing_folder(spark, path), recursive
        self.mounted = self.path.startswith("file:")

    def _listing(self) -> DataFrame:
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", str(self.recursive).lower())
        return reader.load(self.path).where(has_image_extension(F.col("path")))

    def _keyed(self, files: DataFrame) -> DataFrame:
        rows = files.select(parse_stem(F.col("path")).alias("k"), F.col("path").alias("reference"), "content")
        return rows.where("k IS NOT NULL").select("k.transaction_id", "k.image_id", "reference", "content")

    def skipped(self) -> int:
        """Image files whose names hold no key."""
        return self._listing().where(parse_stem(F.col("path")).isNull()).count()


class NfsZipSource(ImageSource):
    """Zips `<transaction_id>_<date>_<time>_<side>_<img|url>.zip` of the named sub-folders only."""

    def __init__(self, spark: SparkSession, root: str, folders: Sequence[str], member: str = MEMBER):
        self.spark, self.member = spark, member
        self.folders = [existing_folder(spark, f"{root}/{f}") for f in folders]
        self.mounted = all(f.startswith("file:") for f in self.folders)

    def _listing(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(self.folders)

    def _keyed(self, files: DataFrame) -> DataFrame:
        rows = files.select(parse_zip_name(F.col("path")).alias("k"), F.col("path").alias("reference"), "content")
        return rows.where("k IS NOT NULL").select("k.transaction_id", "k.image_id", "reference", "content")

    def skipped(self) -> int:
        return self._listing().where(~file_name(F.col("path")).rlike(ZIP_NAME)).count()


def read_member(content: bytes, member: str = MEMBER) -> bytes:
    """One member of a zip, in memory only."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return archive.read(member)


def record(reference: str, content: bytes | None) -> dict:
    """Status, hash, size and grey matrix of one file's bytes."""
    import hashlib

    failed = lambda reason: {"fetch_status": "failed", "failure_reason": reason}
    if content is None:
        return failed("read_error: FileNotFoundError")
    data = content
    if reference.lower().endswith(".zip"):
        try:
            data = read_member(content)
        except (zipfile.BadZipFile, KeyError) as error:
            return failed(f"zip_error: {type(error).__name__}")
        except Exception as error:  # encrypted members, broken streams: a row too
            return failed(f"zip_error: {type(error).__name__}")
    try:
        pixels = decode(data)
    except Exception as error:
        return failed(f"decode_error: {type(error).__name__}")
    return {
        "fetch_status": "ok", "image_hash": hashlib.sha256(data).hexdigest(), "height": pixels.shape[0],
        "width": pixels.shape[1], "grey": grey_matrix(pixels), "content": data,
    }


def _opened(reference: str | None) -> bytes | None:
    """The bytes of a mounted file, None if there is none."""
    path = Path((reference or "").removeprefix("file:"))
    return path.read_bytes() if path.is_file() else None


def _records(keep_content: bool, opened: Callable[[str | None], bytes | None] | None = None):
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key in pdf.itertuples(index=False):  # one file's pixels in memory at a time
                try:
                    row = record(key.reference or "", opened(key.reference) if opened else key.content)
                except OSError as error:
                    row = {"fetch_status": "failed", "failure_reason": f"read_error: {type(error).__name__}"}
                if not keep_content:
                    row.pop("content", None)
                row |= {"transaction_id": key.transaction_id, "image_id": key.image_id, "reference": key.reference}
                yield pd.DataFrame([[row.get(n) for n in names]], columns=names).astype({"width": "Int32", "height": "Int32"})

    return run


def with_fingerprint(records: DataFrame) -> DataFrame:
    """Adds w0..w3 of the grey matrix and drops the matrix; NULL for failed fetches."""
    words = gradient_words(F.col("grey"))
    return records.select("*", *[F.when(F.col("grey").isNotNull(), w).alias(f"w{i}") for i, w in enumerate(words)]).drop("grey")


def shuffled_order(keys: Sequence[str], seed: int) -> list[str]:
    """Names in the order of a seeded shuffle of the sorted listing (driver side: names only)."""
    order = sorted(keys)
    random.Random(seed).shuffle(order)
    return order


def sample_listing(listings: dict[str, Sequence[str]], per_folder: int | None, seed: int) -> dict[str, list[str]]:
    """Names per folder: one generator for all folders in their order, drawn from only where a folder has
    more than `per_folder` names. Unsampled folders keep name order."""
    generator = random.Random(seed)
    out = {}
    for folder, names in listings.items():
        names = sorted(names)
        out[folder] = generator.sample(names, per_folder) if per_folder is not None and len(names) > per_folder else names
    return out
