"""Queries of incremental extraction and keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.normal import key_text, sql_key
from framewright.operators import keyed as K
from framewright.streaming import extract as X
from framewright.tables import table

CODE = "err"  # prefix of the codes to extract
SPLIT = 24  # loads up to this batch are the state, later ones the batch to write


def _source(spark: SparkSession, folder: str) -> DataFrame:
    """events in the shape of the extracted source."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("time"),
        F.col("event_type").alias("error_codes"), F.col("props").alias("api_version"),
    )


def _half_loaded(source: DataFrame) -> DataFrame:
    """A target that an earlier run filled: extracted rows with an even id among the first half."""
    whole = X.ExtractWindow(0, X.highest(source, "id") // 2)
    early = X.extract(source, whole, CODE).where("transaction_id % 2 = 0")
    return X.rows_to_load(early, None)


def full_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The first run: all of the source into an empty target."""
    source = _source(spark, folder)
    return X.rows_to_load(X.extract(source, X.plan_window(source, None), CODE), None)


def incremental_extract(spark: SparkSession, folder: str) -> DataFrame:
    """What the next run loads above the checkpoint, with gap-free ids."""
    source = _source(spark, folder)
    target = _half_loaded(source)
    return X.rows_to_load(X.extract(source, X.plan_window(source, target), CODE), target)


def backfill_window(spark: SparkSession, folder: str) -> DataFrame:
    """A backfill of whole days ignores the checkpoint and loads what the target lacks."""
    source = _source(spark, folder)
    target = _half_loaded(source)
    window = X.plan_window(source, target, "2024-01-03", "2024-01-09")
    return X.rows_to_load(X.extract(source, window, CODE), target).drop("id")


def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    source = _source(spark, folder)
    return X.reconcile(X.extract(source, X.plan_window(source, None), CODE), _half_loaded(source))


_IMAGE = ["image_reference", "image_hash", "fetch_status", "failure_reason"]
_LATE = ["ingested_at", "id"]


def _image_states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "images").select("transaction_id", "image_id", *_IMAGE, "ingested_at", "id", "batch_no").distinct()
    old = K.first_per_key(rows.where(F.col("batch_no") <= SPLIT).drop("batch_no"), ["transaction_id", "image_id"], _LATE)
    return old, rows.where(F.col("batch_no") > SPLIT).drop("batch_no")


def upsert_images(spark: SparkSession, folder: str) -> DataFrame:
    """Later loads over earlier ones: four fields refreshed, id and first ingestion kept."""
    old, new = _image_states(spark, folder)
    return K.upsert(old, new, ["transaction_id", "image_id"], _IMAGE, _LATE)


def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """A delivery that overlaps what is stored: only keys that are not there are added."""
    rows = table(spark, folder, "predictions").select("run_id", key_text(F.col("region_id")).alias("region_id"), "model_name", "created_at", "id", "pipeline_version")
    old = rows.where("created_at < TIMESTAMP '2026-06-01'")
    keys = ["run_id", "region_id", "model_name"]
    return K.insert_ignore(old, rows.where("created_at >= TIMESTAMP '2026-05-01'"), keys, ["created_at", "id"])


def ensure_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews to add for router rows where no person has reviewed the region yet."""
    existing = table(spark, folder, "reviews").where("reviewer IS NOT NULL").select(key_text(F.col("region_id")).alias("region_id"))
    router = table(spark, folder, "predictions").where(key_text(F.col("model_name")) == "router").select(
        key_text(F.col("region_id")).alias("region_id"), "document_type", "issuing_country", "document_side", "needs_review", "created_at", "id",
    )
    first = K.first_per_key(router, ["region_id"], ["created_at", "id"])
    return K.review_rows(first, existing)


def gapless_ids(spark: SparkSession, folder: str) -> DataFrame:
    """New ids for all orders, in the order of their keys, after the existing customers'."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    return K.gapless_ids(customers, orders, "o_orderkey")


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = ("images", "regions", "predictions", "reviews")
    parts = [table(spark, folder, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in names]
    return K.union_rows(*parts)


QUERIES = {
    f.__name__: f
    for f in (
        full_extract, incremental_extract, backfill_window, reconcile, upsert_images, insert_ignore, ensure_reviews, gapless_ids, row_counts,
    )
}

_SOURCE = f"""
source AS (SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS time, event_type AS error_codes, props AS api_version FROM events),
wanted AS (SELECT id AS transaction_id, time, left(error_codes, {len(CODE)}) AS error_codes, api_version FROM source WHERE error_codes LIKE '{CODE}%' AND id > 0),
target AS (SELECT row_number() OVER (ORDER BY transaction_id) AS id, * FROM wanted
  WHERE transaction_id <= (SELECT max(id) // 2 FROM source) AND transaction_id % 2 = 0)"""
_IMAGES = ", ".join(_IMAGE)

SQL = {
    "full_extract": f"WITH {_SOURCE} SELECT row_number() OVER (ORDER BY transaction_id) AS id, transaction_id, time, error_codes, api_version FROM wanted",
    "incremental_extract": f"""WITH {_SOURCE}
SELECT (SELECT max(id) FROM target) + row_number() OVER (ORDER BY transaction_id) AS id, transaction_id, time, error_codes, api_version
FROM wanted WHERE transaction_id > (SELECT max(transaction_id) FROM target)""",
    "backfill_window": f"""WITH {_SOURCE}
SELECT transaction_id, time, error_codes, api_version FROM wanted
WHERE time >= TIMESTAMP '2024-01-03' AND time < TIMESTAMP '2024-01-10' AND transaction_id NOT IN (SELECT transaction_id FROM target)""",
    "reconcile": f"WITH {_SOURCE} SELECT count(*) AS extracted, count(t.transaction_id) AS present FROM wanted w LEFT JOIN target t USING (transaction_id)",
    "upsert_images": f"""
WITH rows AS (SELECT DISTINCT transaction_id, image_id, {_IMAGES}, ingested_at, id, batch_no FROM images WHERE transaction_id IS NOT NULL AND image_id IS NOT NULL),
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id, image_id ORDER BY ingested_at, id) AS k FROM rows WHERE batch_no <= {SPLIT}) WHERE k = 1),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id, image_id ORDER BY ingested_at DESC, id DESC) AS k FROM rows WHERE batch_no > {SPLIT}) WHERE k = 1)
SELECT coalesce(o.transaction_id, n.transaction_id) AS transaction_id, coalesce(o.image_id, n.image_id) AS image_id,
  {", ".join(f"CASE WHEN n.k = 1 THEN n.{c} ELSE o.{c} END AS {c}" for c in _IMAGE)},
  CASE WHEN o.k = 1 THEN o.ingested_at ELSE n.ingested_at END AS ingested_at, CASE WHEN o.k = 1 THEN o.id ELSE n.id END AS id
FROM old o FULL JOIN new n ON o.transaction_id = n.transaction_id AND o.image_id = n.image_id""",
    "insert_ignore": f"""
WITH rows AS (SELECT run_id, {sql_key("region_id")} AS region_id, model_name, created_at, id, pipeline_version FROM predictions
  WHERE run_id IS NOT NULL AND region_id IS NOT NULL AND model_name IS NOT NULL)
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, region_id, model_name ORDER BY created_at, id) AS k FROM rows WHERE created_at >= TIMESTAMPTZ '2026-05-01 00:00:00+00')
WHERE k = 1 AND (run_id, region_id, model_name) NOT IN (SELECT (run_id, region_id, model_name) FROM rows WHERE created_at < TIMESTAMPTZ '2026-06-01 00:00:00+00')""",
    "ensure_reviews": f"""
WITH rows AS (SELECT {sql_key("region_id")} AS region_id, document_type, issuing_country, document_side, needs_review, created_at, id
  FROM predictions WHERE {sql_key("model_name")} = 'router' AND region_id IS NOT NULL)
SELECT region_id, document_type, issuing_country, document_side, created_at, id, CASE WHEN needs_review THEN 'pending' ELSE 'auto_accepted' END AS review_status
FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY created_at, id) AS k FROM rows)
WHERE k = 1 AND region_id NOT IN (SELECT {sql_key("region_id")} FROM reviews WHERE region_id IS NOT NULL AND reviewer IS NOT NULL)""",
    "gapless_ids": "SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders",
    "row_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in ("images", "regions", "predictions", "reviews")),
}
