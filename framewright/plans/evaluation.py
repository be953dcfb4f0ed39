"""Queries that evaluate the models of predictions against labelled_images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.normal import (
    document_type,
    issuing_country,
    key_text,
    sql_country,
    sql_document_type,
    sql_key,
)
from framewright.operators import evaluation as E
from framewright.operators import labels as L
from framewright.operators.keyed import repeated_keys
from framewright.operators.routing import summarize_images
from framewright.tables import table


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """One label triple per labelled image; of several the first in alphabetical order counts."""
    rows = table(spark, folder, "labelled_images").select(
        "transaction_id", "image_id",
        document_type(F.col("document_type")).alias("t"), issuing_country(F.col("issuing_country")).alias("c"),
        key_text(F.col("document_side")).alias("s"),
    ).where("t IS NOT NULL AND c IS NOT NULL AND s IS NOT NULL AND transaction_id IS NOT NULL AND image_id IS NOT NULL")
    one = rows.groupBy("transaction_id", "image_id").agg(F.min(F.struct("t", "c", "s")).alias("x"))
    return one.select(
        "transaction_id", "image_id", F.col("x.t").alias("true_document_type"),
        F.col("x.c").alias("true_issuing_country"), F.col("x.s").alias("true_document_side"),
    )


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    """All answers with config = model_name and repeat = pipeline version, repeated rows once."""
    return table(spark, folder, "predictions").select(
        "transaction_id", "image_id", key_text(F.col("model_name")).alias("config"), F.col("pipeline_version").alias("repeat"),
        key_text(F.col("region_id")).alias("region_id"), document_type(F.col("document_type")).alias("pred_document_type"),
        issuing_country(F.col("issuing_country")).alias("pred_issuing_country"),
        key_text(F.col("document_side")).alias("pred_document_side"), "confidence", key_text(F.col("status")).alias("status"),
        "latency_ms", "id",
    ).where("config IS NOT NULL AND repeat IS NOT NULL").distinct()


def fact(spark: SparkSession, folder: str) -> DataFrame:
    """One row per config, repeat and labelled image: the answer of highest confidence."""
    keys = ["config", "repeat", "transaction_id", "image_id"]
    best = summarize_images(_calls(spark, folder), keys, "id")
    review = F.coalesce(F.col("confidence") < 0.8, F.lit(True)) | (F.col("status") != "ok")
    return best.join(truth(spark, folder), ["transaction_id", "image_id"]).withColumn("needs_review", review)


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = fact(spark, folder)
    return E.image_metrics(rows).join(E.call_metrics(_calls(spark, folder)), ["config", "repeat"], "left")


def eval_per_country(spark: SparkSession, folder: str) -> DataFrame:
    return E.per_country(fact(spark, folder))


def eval_latency(spark: SparkSession, folder: str) -> DataFrame:
    return E.latency(fact(spark, folder))


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Means over repeats with latency: what the selection reads."""
    return E.mean_over_repeats(eval_metrics(spark, folder)).join(E.latency(fact(spark, folder)), "config", "left")


RULE = E.SelectionRule(min_negative_rejection_rate=0.6, max_parse_error_rate=0.03)


def select_winner(spark: SparkSession, folder: str) -> DataFrame:
    judged = E.select_winner(eval_summary(spark, folder), RULE, "config")
    return judged.select("config", "eligible", "winner")


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return E.confusion_matrix(E.confusion_counts(fact(spark, folder)))


def validate_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labelled_images").distinct()
    found = L.label_problems(F.col("document_type"), F.col("issuing_country"), F.col("document_side"))
    return rows.select("transaction_id", "image_id", "image_path", F.array_join(found, "; ").alias("problems")).where("problems <> ''")


def repeated_labels(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_keys(table(spark, folder, "labelled_images"), ["transaction_id", "image_id"])


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = truth(spark, folder)
    return L.label_counts(rows.select(F.col("true_document_type").alias("document_type"), F.col("true_issuing_country").alias("issuing_country")))


def parse_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "images").select("id", L.parse_zip_name(F.col("image_reference")).alias("z")).distinct()
    return rows.where("z IS NOT NULL").select("id", "z.*")


QUERIES = {
    f.__name__: f
    for f in (
        eval_metrics, eval_per_country, eval_latency, eval_summary, select_winner, confusion_matrix,
        validate_labels, repeated_labels, label_counts, parse_names,
    )
}

_FACT = f"""
truth AS (
  SELECT transaction_id, image_id, x.t AS tt, x.c AS tc, x.s AS ts FROM (
    SELECT transaction_id, image_id, min(struct_pack(t, c, s)) AS x FROM (
      SELECT transaction_id, image_id, {sql_document_type("document_type")} AS t, {sql_country("issuing_country")} AS c, {sql_key("document_side")} AS s FROM labelled_images)
    WHERE t IS NOT NULL AND c IS NOT NULL AND s IS NOT NULL AND transaction_id IS NOT NULL AND image_id IS NOT NULL GROUP BY ALL)),
calls AS (
  SELECT DISTINCT transaction_id, image_id, {sql_key("model_name")} AS config, pipeline_version AS repeat, {sql_key("region_id")} AS region_id,
    {sql_document_type("document_type")} AS pt, {sql_country("issuing_country")} AS pc, {sql_key("document_side")} AS ps, confidence,
    {sql_key("status")} AS status, latency_ms, id FROM predictions WHERE model_name IS NOT NULL AND pipeline_version IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, repeat, transaction_id, image_id ORDER BY coalesce(confidence, -1) DESC, id) AS rn FROM calls) WHERE rn = 1),
fact AS (
  SELECT *, coalesce(confidence < 0.8, true) OR status <> 'ok' AS review, tt <> 'none' AS doc,
    coalesce(pt = tt, false) AS okt, coalesce(pc = tc, false) AS okc, coalesce(ps = ts, false) AS oks FROM best JOIN truth USING (transaction_id, image_id)),
country AS (
  SELECT config, repeat, tc AS country, count(*) AS n, count(*) FILTER (okt) / count(*) AS type_accuracy,
    count(*) FILTER (okc) / count(*) AS country_accuracy, count(*) FILTER (oks) / count(*) AS side_accuracy
  FROM fact WHERE doc GROUP BY ALL)"""


def _rate(hit: str, among: str) -> str:
    return f"count(*) FILTER (coalesce({hit}, false) AND {among}) / nullif(count(*) FILTER ({among}), 0)"


_METRICS = f"""{_FACT},
metrics AS (
  SELECT config, repeat, {_rate("okt", "doc")} AS type_accuracy, {_rate("okc", "doc")} AS country_accuracy, {_rate("oks", "doc")} AS side_accuracy,
    {_rate("pt = 'none'", "NOT doc")} AS negative_rejection_rate, {_rate("NOT review", "doc")} AS coverage,
    {_rate("okt AND okc AND oks", "doc AND NOT review")} AS accepted_accuracy, {_rate("pc = 'unknown'", "doc")} AS unknown_rate, {_rate("review", "true")} AS review_rate
  FROM fact GROUP BY ALL),
macro AS (SELECT config, repeat, list_sum(list(country_accuracy ORDER BY country)) / count(*) AS country_accuracy_macro FROM country GROUP BY ALL),
errors AS (SELECT config, repeat, {_rate("status = 'parse_error'", "true")} AS parse_error_rate, {_rate("status = 'model_error'", "true")} AS model_error_rate FROM calls GROUP BY ALL),
full_metrics AS (SELECT * FROM metrics LEFT JOIN macro USING (config, repeat) LEFT JOIN errors USING (config, repeat)),
slow AS (
  SELECT config, s / n AS latency_mean_ms, CASE WHEN n > 1 THEN sqrt(greatest(q / n - (s / n) * (s / n), 0)) ELSE 0 END AS latency_std_ms FROM (
    SELECT config, count(*) AS n, CAST(sum(CAST(latency_ms AS DECIMAL(18, 6))) AS DOUBLE) AS s,
      CAST(sum(CAST(CAST(latency_ms AS DECIMAL(18, 6)) * CAST(latency_ms AS DECIMAL(18, 6)) AS DECIMAL(38, 6))) AS DOUBLE) AS q
    FROM fact WHERE latency_ms IS NOT NULL GROUP BY ALL))"""

_MEANS = ", ".join(
    f"list_sum(list({m} ORDER BY repeat) FILTER ({m} IS NOT NULL)) / nullif(count({m}), 0) AS {m}"
    for m in (
        *E.HIGHER_IS_BETTER[:3], "negative_rejection_rate", "coverage", "accepted_accuracy", "unknown_rate", "review_rate",
        "country_accuracy_macro", "parse_error_rate", "model_error_rate",
    )
)
_SUMMARY = f"{_METRICS}, summary AS (SELECT * FROM (SELECT config, {_MEANS} FROM full_metrics GROUP BY config) LEFT JOIN slow USING (config))"

SQL = {
    "eval_metrics": f"WITH {_METRICS} SELECT * FROM full_metrics",
    "eval_per_country": f"WITH {_FACT} SELECT * FROM country",
    "eval_latency": f"WITH {_METRICS} SELECT * FROM slow",
    "eval_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
    "select_winner": f"""WITH {_SUMMARY},
judged AS (SELECT *, coalesce(negative_rejection_rate >= 0.6, true) AND coalesce(parse_error_rate <= 0.03, true) AS eligible FROM summary)
SELECT config, eligible, eligible AND row_number() OVER (PARTITION BY eligible ORDER BY coalesce(country_accuracy_macro, -1) DESC,
  coalesce(latency_mean_ms, 'inf'::DOUBLE), config) = 1 AS winner FROM judged""",
    "confusion_matrix": f"""WITH {_FACT},
counts AS (SELECT config, CASE WHEN tt = 'none' THEN 'NO_DOC' ELSE tc END AS t, CASE WHEN pt = 'none' THEN 'NO_DOC' ELSE coalesce(nullif(pc, ''), 'ERROR') END AS p, count(*) AS n FROM fact GROUP BY ALL),
axis AS (
  SELECT config, l, CAST(row_number() OVER (PARTITION BY config ORDER BY CASE l WHEN 'ERROR' THEN 3 WHEN 'NO_DOC' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END, l) - 1 AS INT) AS k
  FROM (SELECT config, t AS l FROM counts UNION SELECT config, p FROM counts))
SELECT a.config, a.l AS true_label, b.l AS pred_label, a.k AS true_position, b.k AS pred_position, coalesce(n, 0) AS n
FROM axis a JOIN axis b USING (config) LEFT JOIN counts c ON c.config = a.config AND c.t = a.l AND c.p = b.l""",
    "validate_labels": """
SELECT * FROM (
  SELECT transaction_id, image_id, image_path, concat_ws('; ',
    CASE WHEN NOT coalesce(document_type IN ('national_id', 'passport', 'residence_permit', 'driving_license', 'other', 'none'), false) THEN 'document_type ' || coalesce(document_type, 'NULL') END,
    CASE WHEN NOT coalesce(issuing_country = 'unknown' OR regexp_full_match(issuing_country, '[A-Z]{2}'), false) THEN 'issuing_country ' || coalesce(issuing_country, 'NULL') END,
    CASE WHEN NOT coalesce(document_side IN ('front', 'back', 'n/a', 'unknown'), false) THEN 'document_side ' || coalesce(document_side, 'NULL') END) AS problems
  FROM (SELECT DISTINCT * FROM labelled_images)) WHERE problems <> ''""",
    "repeated_labels": "SELECT transaction_id, image_id, count(*) AS rows FROM labelled_images GROUP BY ALL HAVING count(*) > 1",
    "label_counts": f"WITH {_FACT} SELECT tt AS document_type, tc AS issuing_country, count(*) AS images FROM truth GROUP BY ALL",
    "parse_names": f"""
SELECT DISTINCT id, CAST(regexp_extract(n, p, 1) AS BIGINT) AS transaction_id, regexp_extract(n, p, 2) AS day, regexp_extract(n, p, 3) AS time,
  regexp_extract(n, p, 4) AS image_id, regexp_extract(n, p, 5) AS kind
FROM (SELECT id, regexp_extract(image_reference, '([^/]*)$', 1) AS n, '^([0-9]+)_([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})_([0-9.-]+)_(front|back)_(img|url)\\.zip$' AS p FROM images) WHERE regexp_matches(n, p)""",
}
