"""Queries over predictions, regions and images: voting, routing, summaries, sweeps, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import boxes as B
from framewright.functions.normal import (
    document_type,
    issuing_country,
    key_text,
    sql_country,
    sql_document_type,
    sql_key,
)
from framewright.operators import routing as R
from framewright.operators import sweep as S
from framewright.tables import table

WIDTH, HEIGHT = 1600, 1000  # pixels of the images that boxes are clipped to
THRESHOLDS = (0.05, 0.25, 0.4, 0.6, 0.9)


def classifier_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Classifier rows in normal spelling, repeated rows once."""
    rows = table(spark, folder, "predictions").where(key_text(F.col("model_name")) != "router")
    return rows.select(
        "run_id", key_text(F.col("region_id")).alias("region_id"), "transaction_id", "image_id", "model_name",
        document_type(F.col("document_type")).alias("document_type"),
        issuing_country(F.col("issuing_country")).alias("issuing_country"),
        key_text(F.col("document_side")).alias("document_side"),
        "confidence", key_text(F.col("status")).alias("status"), "latency_ms", "created_at", "id",
    ).distinct()


def _voted(spark: SparkSession, folder: str) -> DataFrame:
    said = classifier_answers(spark, folder).where("region_id IS NOT NULL")
    seen = said.withColumn("seen", F.struct("created_at", "id"))
    return R.vote(seen, ["run_id", "region_id"])


def route_predictions(spark: SparkSession, folder: str) -> DataFrame:
    routed = R.route(_voted(spark, folder))
    return routed.select(
        "run_id", "region_id", *R.FIELDS, "confidence", "needs_review", F.array_join("reasons", ",").alias("reasons")
    )


def _latest_run(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a region's last run, with the order in which they came."""
    said = classifier_answers(spark, folder).where("region_id IS NOT NULL AND model_name IS NOT NULL")
    last = said.groupBy("region_id").agg(F.max(F.struct("created_at", "run_id"))["run_id"].alias("run_id"))
    return said.join(last, ["region_id", "run_id"]).withColumn("seen", F.struct("created_at", "id"))


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "images").select(
        "transaction_id", "image_id",
        F.when(key_text(F.col("fetch_status")) == "ok", "ok").otherwise("failed").alias("fetch_status"), "id",
    )
    # an image that was fetched at least once is a fetched image
    seen = images.groupBy("transaction_id", "image_id").agg(F.max("fetch_status").alias("fetch_status"))
    regions = table(spark, folder, "regions").where("deleted_at IS NULL").select(
        "transaction_id", "image_id", key_text(F.col("region_id")).alias("region_id")
    )
    return R.route_images(seen, regions, _latest_run(spark, folder).select("region_id", *R.FIELDS, "confidence", "status", "seen"))


def route_images(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).withColumn("reasons", F.array_join("reasons", ","))


def summarize_image(spark: SparkSession, folder: str) -> DataFrame:
    best = R.summarize_images(_routed(spark, folder), ["transaction_id", "image_id"])
    return best.withColumn("reasons", F.array_join("reasons", ","))


def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    best = R.summarize_images(_routed(spark, folder), ["transaction_id", "image_id"])
    fetched = F.when(F.array_contains("reasons", R.FETCH_FAILED), "failed").otherwise("ok")
    return best.select(
        R.count_label(fetched, F.col("document_type"), F.col("issuing_country")).alias("label"),
        F.when(F.col("needs_review"), "needs_review").otherwise("auto_accepted").alias("status"),
    ).groupBy("label", "status").agg(F.count("*").alias("images"))


def prediction_rows(spark: SparkSession, folder: str) -> DataFrame:
    said = classifier_answers(spark, folder).where("region_id IS NOT NULL").select(
        "run_id", "region_id", "model_name", *R.FIELDS, "confidence", "status", "latency_ms"
    )
    routed = R.route(_voted(spark, folder)).select("run_id", "region_id", *R.FIELDS, "confidence", "needs_review", "reasons")
    return R.prediction_rows(said, routed)


def box_suppression(spark: SparkSession, folder: str) -> DataFrame:
    """Kept regions of each image over all detectors, boxes clipped and overlaps above 0.3 dropped."""
    c = [F.col(x).cast("double") for x in ("x0", "y0", "x1", "y1")]
    boxes = table(spark, folder, "regions").select(
        "transaction_id", "image_id", F.col("detector_confidence").alias("confidence"),
        F.struct("x0", "y0", "x1", "y1").alias("tie"), B.clip_box(*c, F.lit(WIDTH), F.lit(HEIGHT)).alias("box"),
    )
    kept = B.suppressed_regions(boxes, ["transaction_id", "image_id"], 0.3)
    return kept.select("transaction_id", "image_id", "region_index", "confidence", "box.x0", "box.y0", "box.x1", "box.y1")


def _folders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "images").where(key_text(F.col("fetch_status")) == "ok").select(
        "transaction_id", "image_id", F.regexp_extract("image_reference", "^.*/([^/]+)/[^/]*$", 1).alias("folder")
    ).distinct()


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    regions = table(spark, folder, "regions")
    detectors = regions.select("detector_name").distinct()
    boxes = regions.select("transaction_id", "image_id", "detector_name", "region_id", F.col("detector_confidence").alias("confidence")).distinct()
    images = _folders(spark, folder)
    per_image = S.image_confidences(images, detectors, boxes, ["transaction_id", "image_id"])
    return S.threshold_counts(per_image, list(THRESHOLDS), images, detectors)


QUERIES = {
    f.__name__: f
    for f in (
        route_predictions, route_images, summarize_image, run_counts, prediction_rows, box_suppression, threshold_sweep,
    )
}

_SAID = f"""
said AS (
  SELECT DISTINCT run_id, {sql_key("region_id")} AS region_id, transaction_id, image_id, model_name, {sql_document_type("document_type")} AS document_type,
    {sql_country("issuing_country")} AS issuing_country, {sql_key("document_side")} AS document_side, confidence, {sql_key("status")} AS status,
    latency_ms, created_at, id FROM predictions WHERE {sql_key("model_name")} <> 'router' AND region_id IS NOT NULL)"""


def _vote_sql(source: str, keys: str) -> str:
    fields = []
    for f in R.FIELDS:
        fields.append(f"""
{f}_n AS (SELECT {keys}, {f} AS v, count(*) AS n FROM {source} WHERE status = 'ok' AND {f} IS NOT NULL GROUP BY ALL),
{f}_v AS (SELECT {keys}, CASE WHEN count(*) FILTER (n = most) = 1 THEN max(v) FILTER (n = most) END AS {f}
  FROM (SELECT *, max(n) OVER (PARTITION BY {keys}) AS most FROM {f}_n) GROUP BY {keys})""")
    joins = " ".join(f"LEFT JOIN {f}_v USING ({keys})" for f in R.FIELDS)
    differ = " OR ".join(
        f"count(DISTINCT {f}) FILTER (status = 'ok') + max(CASE WHEN status = 'ok' AND {f} IS NULL THEN 1 ELSE 0 END) > 1" for f in R.FIELDS
    )
    return f"""{",".join(fields)},
bad AS (SELECT {keys}, string_agg(status, ',' ORDER BY seen) AS failing FROM (
  SELECT {keys}, status, min(struct_pack(created_at, id)) AS seen FROM {source} WHERE status <> 'ok' GROUP BY ALL) GROUP BY {keys}),
voted AS (
  SELECT *, CASE WHEN valid > 0 AND valid = known THEN total / valid END AS confidence FROM (
    SELECT {keys}, count(*) FILTER (status = 'ok') AS valid, count(confidence) FILTER (status = 'ok') AS known,
      CAST(sum(CAST(confidence AS DECIMAL(18, 9))) FILTER (status = 'ok') AS DOUBLE) AS total, {differ} AS disagree
    FROM {source} GROUP BY {keys}) {joins} LEFT JOIN bad USING ({keys}))"""


def _reasons_sql(multiple: str = "false") -> str:
    return f"""concat_ws(',', failing, CASE WHEN disagree THEN 'disagreement' END,
    CASE WHEN confidence IS NULL OR confidence < 0.8 THEN 'low_confidence' END,
    CASE WHEN document_type = 'none' THEN 'no_document' WHEN valid > 0 AND coalesce(issuing_country, 'unknown') = 'unknown' THEN 'unknown_country' END,
    CASE WHEN {multiple} THEN 'multiple_documents' END)"""


_ROUTED_RUNS = f"""{_SAID}, {_vote_sql("said", "run_id, region_id")},
routed AS (SELECT *, {_reasons_sql()} AS reasons FROM voted)"""

_ROUTED_IMAGES = f"""{_SAID},
runs AS (SELECT region_id, arg_max(run_id, struct_pack(created_at, run_id)) AS run_id FROM said WHERE model_name IS NOT NULL GROUP BY region_id),
last_said AS (SELECT s.* FROM said s JOIN runs USING (region_id, run_id) WHERE model_name IS NOT NULL),
{_vote_sql("last_said", "region_id")},
seen_images AS (SELECT transaction_id, image_id, max(CASE WHEN {sql_key("fetch_status")} = 'ok' THEN 'ok' ELSE 'failed' END) AS fetch_status FROM images GROUP BY ALL),
placed AS (SELECT *, count(*) OVER (PARTITION BY transaction_id, image_id) > 1 AS several FROM (
  SELECT DISTINCT transaction_id, image_id, {sql_key("region_id")} AS region_id FROM regions WHERE deleted_at IS NULL)),
full_vote AS (SELECT p.*, coalesce(valid, 0) AS valid, coalesce(disagree, false) AS disagree, failing, confidence, document_type, issuing_country, document_side
  FROM placed p JOIN seen_images USING (transaction_id, image_id) LEFT JOIN voted USING (region_id) WHERE fetch_status = 'ok'),
routed AS (
  SELECT transaction_id, image_id, region_id, document_type, issuing_country, document_side, confidence, reasons <> '' AS needs_review, reasons
  FROM (SELECT *, {_reasons_sql("several")} AS reasons FROM full_vote)
  UNION ALL
  SELECT transaction_id, image_id, CAST(transaction_id AS VARCHAR) || ':' || image_id || ':none', 'none', 'unknown', 'n/a', NULL, true, 'no_document'
  FROM seen_images WHERE fetch_status = 'ok' AND (transaction_id, image_id) NOT IN (SELECT (transaction_id, image_id) FROM placed)
  UNION ALL
  SELECT transaction_id, image_id, CAST(transaction_id AS VARCHAR) || ':' || image_id || ':fetch_failed', NULL, NULL, NULL, NULL, true, 'fetch_failed'
  FROM seen_images WHERE fetch_status <> 'ok')"""

_BEST = f"""{_ROUTED_IMAGES},
best AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id, image_id ORDER BY coalesce(confidence, -1) DESC, region_id) AS rn FROM routed) WHERE rn = 1)"""

SQL = {
    "route_predictions": f"WITH {_ROUTED_RUNS} SELECT run_id, region_id, document_type, issuing_country, document_side, confidence, reasons <> '' AS needs_review, reasons FROM routed",
    "route_images": f"WITH {_ROUTED_IMAGES} SELECT * FROM routed",
    "summarize_image": f"WITH {_BEST} SELECT * FROM best",
    "run_counts": f"""WITH {_BEST}
SELECT CASE WHEN reasons = 'fetch_failed' THEN 'FETCH_FAILED' WHEN document_type = 'none' THEN 'NO_DOC' ELSE coalesce(nullif(issuing_country, ''), 'ERROR') END AS label,
  CASE WHEN needs_review THEN 'needs_review' ELSE 'auto_accepted' END AS status, count(*) AS images FROM best GROUP BY ALL""",
    "prediction_rows": f"""WITH {_ROUTED_RUNS}
SELECT run_id, region_id, model_name, document_type, issuing_country, document_side, confidence, status, latency_ms, NULL AS needs_review, NULL AS review_reasons FROM said
UNION ALL SELECT run_id, region_id, 'router', document_type, issuing_country, document_side, confidence, 'ok', NULL, reasons <> '', reasons FROM routed""",
    "box_suppression": f"""
WITH RECURSIVE boxes AS (
  SELECT DISTINCT transaction_id AS t, image_id AS i, coalesce(detector_confidence, -1) AS c, x0 AS r0, y0 AS r1, x1 AS r2, y1 AS r3,
    greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, {WIDTH}) AS x1, least(y1, {HEIGHT}) AS y1 FROM regions
  WHERE x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL),
ranked AS (
  SELECT t, i, c, x0, y0, x1, y1, row_number() OVER (PARTITION BY t, i ORDER BY c DESC, r0, r1, r2, r3) AS rn
  FROM boxes WHERE x1 > x0 AND y1 > y0),
steps AS (
  SELECT t, i, rn, [struct_pack(c, x0, y0, x1, y1)] AS kept FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.t, r.i, r.rn, CASE WHEN len(list_filter(s.kept, lambda k:
      greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0) * greatest(least(k.y1, r.y1) - greatest(k.y0, r.y0), 0) > 0 AND
      CAST(greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0) * greatest(least(k.y1, r.y1) - greatest(k.y0, r.y0), 0) AS DOUBLE) /
      (CAST((k.x1 - k.x0) * (k.y1 - k.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) AS DOUBLE) -
       greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0) * greatest(least(k.y1, r.y1) - greatest(k.y0, r.y0), 0)) > 0.3)) > 0
    THEN s.kept ELSE list_append(s.kept, struct_pack(c := r.c, x0 := r.x0, y0 := r.y0, x1 := r.x1, y1 := r.y1)) END
  FROM steps s JOIN ranked r ON r.t = s.t AND r.i = s.i AND r.rn = s.rn + 1),
done AS (SELECT t, i, arg_max(kept, rn) AS kept FROM steps GROUP BY t, i),
out AS (SELECT t, i, generate_subscripts(kept, 1) - 1 AS k, unnest(kept) AS b FROM done)
SELECT t AS transaction_id, i AS image_id, CAST(k AS INT) AS region_index, b.c AS confidence, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM out""",
    "threshold_sweep": f"""
WITH pics AS (
  SELECT DISTINCT transaction_id, image_id, regexp_extract(image_reference, '^.*/([^/]+)/[^/]*$', 1) AS folder FROM images WHERE {sql_key("fetch_status")} = 'ok'),
detectors AS (SELECT DISTINCT detector_name FROM regions), levels AS (SELECT unnest({list(THRESHOLDS)}) AS threshold),
boxes AS (SELECT DISTINCT transaction_id, image_id, detector_name, region_id, detector_confidence AS c FROM regions),
hits AS (
  SELECT d.detector_name, p.folder, l.threshold, p.transaction_id, p.image_id, count(*) FILTER (b.c >= l.threshold) AS n
  FROM pics p CROSS JOIN detectors d CROSS JOIN levels l
  LEFT JOIN boxes b ON b.transaction_id = p.transaction_id AND b.image_id = p.image_id AND b.detector_name = d.detector_name GROUP BY ALL)
SELECT detector_name, folder, CAST(threshold AS DOUBLE) AS threshold, count(*) AS images, count(*) FILTER (n >= 1) AS detected, count(*) FILTER (n >= 2) AS multiple FROM hits GROUP BY ALL""",
}
