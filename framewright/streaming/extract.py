"""Incremental extraction above a high-water mark (INC-01..06, SRC-10, SRC-11, PRJ-10, PRJ-11).

When runs start (INC-07) is a scheduler's business: `run_extract` is idempotent and may be called by any."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.keyed import gapless_ids
from framewright.session import stored


@dataclass(frozen=True)
class ExtractWindow:
    """Rows with after_id < id <= up_to_id and start <= time < end (None: open)."""

    after_id: int
    up_to_id: int
    start: dt.datetime | None = None
    end: dt.datetime | None = None


def highest(df: DataFrame | None, column: str) -> int:
    """The largest value of a column, 0 for an empty or absent table."""
    return 0 if df is None else df.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def utc_day(text: str) -> dt.datetime:
    """Start of an ISO day in UTC. A time of day is kept and a given offset is replaced by UTC."""
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC)


def plan_window(source: DataFrame, target: DataFrame | None, first_day: str | None = None, last_day: str | None = None) -> ExtractWindow:
    """The window of a run: above the checkpoint, or a backfill of whole days, which ignores it."""
    up_to = highest(source, "id")
    if first_day is None and last_day is None:
        return ExtractWindow(highest(target, "transaction_id"), up_to)
    if first_day is None or last_day is None:
        raise ValueError("a backfill needs both its first and its last day")
    start, end = utc_day(first_day), utc_day(last_day) + dt.timedelta(days=1)
    if end <= start:
        raise ValueError("the last day is before the first")
    return ExtractWindow(0, up_to, start, end)


def extract(source: DataFrame, window: ExtractWindow, code: str) -> DataFrame:
    """(transaction_id, time, error_codes, api_version) of rows whose codes start with `code`.

    All predicates reach the scan. `code` is a prefix: longer codes that begin with it match too.
    """
    rows = source.where(
        F.col("error_codes").startswith(code) & (F.col("id") > window.after_id) & (F.col("id") <= window.up_to_id)
    )
    if window.start is not None:
        rows = rows.where(F.col("time") >= F.lit(window.start))
    if window.end is not None:
        rows = rows.where(F.col("time") < F.lit(window.end))
    return rows.select(
        F.col("id").alias("transaction_id"), "time", F.left("error_codes", F.lit(len(code))).alias("error_codes"), "api_version"
    )


def rows_to_load(extracted: DataFrame, target: DataFrame | None) -> DataFrame:
    """The extracted rows that the target lacks, with gap-free ids in the order of the source's ids."""
    fresh = extracted.dropDuplicates(["transaction_id"])
    if target is not None:
        fresh = fresh.join(target.select("transaction_id"), "transaction_id", "left_anti")
    return gapless_ids(target, fresh, "transaction_id")


def reconcile(extracted: DataFrame, target: DataFrame) -> DataFrame:
    """One row: extracted, present (of them, in the target)."""
    ids = extracted.select("transaction_id").distinct()
    seen = target.select("transaction_id", F.lit(1).alias("_p")).distinct()
    return ids.join(seen, "transaction_id", "left").agg(
        F.count("*").alias("extracted"), F.count("_p").alias("present")
    )


def run_extract(source: DataFrame, read_target: Callable[[], DataFrame | None], append: Callable[[DataFrame], None], code: str, **days: str) -> dict[str, int]:
    """One idempotent run: plan, load what is missing, reconcile; raises if rows are missing afterwards.

    read_target gives None only if there is no target table yet, and raises if it can't be read. A target that
    does not exist after rows were found is an error, not an empty table.
    """
    target = read_target()
    window = plan_window(source, target, **days)
    found = extract(source, window, code)
    fresh = stored(rows_to_load(found, target).withColumn("ingested_at", F.current_timestamp()))  # ids are given once
    loaded = fresh.count()
    if loaded:
        append(fresh)
    after = read_target()
    if after is None:
        missing = found.select("transaction_id").distinct().count()
        if missing:
            raise RuntimeError(f"{missing} extracted rows are not in the target, which does not exist")
        return {"extracted": 0, "loaded": 0}
    got = reconcile(found, after).first()
    if got["extracted"] != got["present"]:
        raise RuntimeError(f"{got['extracted'] - got['present']} extracted rows are not in the target")
    return {"extracted": got["extracted"], "loaded": loaded}


def stream_extract(stream: DataFrame, code: str, read_target, append, checkpoint: str):
    """The same for a file source as a stream: each micro-batch loads what the target lacks.

    The stream's own checkpoint takes the place of the high-water mark, so rows that come late with
    a low id are not skipped. Runs over what is there and stops.
    """

    def load(batch: DataFrame, _: int) -> None:
        everything = ExtractWindow(-(2**63) + 1, 2**63 - 1)
        fresh = rows_to_load(extract(batch, everything, code), read_target())
        append(stored(fresh.withColumn("ingested_at", F.current_timestamp())))

    query = (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
