"""Session settings and the two ways in which this engine touches shared storage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[8]", app: str = "framewright", **conf: str
) -> SparkSession:
    """A session with the engine's defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (
        DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    ).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers, wherever the program was started from."""
    context = spark.sparkContext
    if any(str(f).endswith("framewright.zip") for f in context.listFiles):
        return
    folder = tempfile.mkdtemp(prefix="framewright-code-")  # of the driver; Spark sends the file to the workers
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    here = Path(__file__).resolve().parent
    context.addPyFile(shutil.make_archive(f"{folder}/framewright", "zip", here.parent, here.name))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that `spark.checkpoint.dir` names.

    Only a local session may do without: it gets a temporary folder. On a cluster that would lie on one
    machine, so it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="framewright-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` by a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` by a Parquet table in the shared checkpoint folder.

    Against `checkpointed` it is compressed and columnar. The table stays until `purge_stored`
    or the end of the process, as plans made from it may still be run.
    """
    spark = df.sparkSession
    path = scratch(spark, "stored")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, which `purge_stored` deletes."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    if not _STORED:
        atexit.register(purge_stored)
    _STORED.append((spark, path))
    return path


@contextlib.contextmanager
def released():
    """Deletes what `stored` and `scratch` made inside, when it ends; stored tables passed to the yielded function stay.

    Shuffle files go with the plans that made them, which the JVM is asked to collect.
    """
    before, kept = len(_STORED), []
    yield lambda df: kept.append(df) or df
    stay = {df.stored_at for df in kept}
    mine = _STORED[before:]
    held = [x for x in mine if x[1] in stay]
    rest = [x for x in mine if x not in held]
    _STORED[before:] = held
    for spark, path in rest:
        _delete(spark, path)
    for spark in {id(s): s for s, _ in rest}.values():
        spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def purge_stored() -> None:
    """Delete what `stored` and `scratch` made; no plan made from them may be run afterwards."""
    while _STORED:
        _delete(*_STORED.pop())
