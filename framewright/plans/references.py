"""Queries of problem 1 over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.normal import key_text, sql_key
from framewright.operators import orphans as O
from framewright.tables import table


def _region_references(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name in ("predictions", "reviews"):
        key = key_text(F.col("region_id"))
        rows = table(spark, folder, name).where(~key.endswith(":none"))
        parts.append(
            O.references(rows, "region", key, name, F.col("id"), F.col("created_at"))
        )
    return parts[0].unionByName(parts[1])


def _timeline(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    regions, images = table(spark, folder, "regions"), table(spark, folder, "images")
    refs = _region_references(spark, folder).unionByName(
        O.references(
            regions, "image", F.col("transaction_id"), "regions",
            F.col("region_id"), F.col("created_at"), F.col("deleted_at"),
        )
    )
    records = O.lives(
        regions, "region", key_text(F.col("region_id")),
        F.col("created_at"), F.col("deleted_at"),
    ).unionByName(
        O.lives(
            images, "image", F.col("transaction_id"),
            F.col("ingested_at"), F.col("deleted_at"),
        )
    )
    return refs, records


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = O.orphans_in_time(*_timeline(spark, folder))
    return found.select("table_name", "row_key", "state").distinct()


def p1_orphans_per_month(spark: SparkSession, folder: str) -> DataFrame:
    return O.orphan_report(O.orphans_in_time(*_timeline(spark, folder)))


def p1_current_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Signed counts after all changes: references of deleted rows are taken off again, identical rows count once."""
    refs, records = _timeline(spark, folder)
    changes = O.ledger(O.distinct_references(refs), records)
    return O.current_orphans(O.apply_deltas(None, changes))


QUERIES = {
    "p1_found": p1_found,
    "p1_orphans_per_month": p1_orphans_per_month,
    "p1_current_orphans": p1_current_orphans,
}

_REFS = f"""
refs AS (
  SELECT DISTINCT 'region' AS relation, table_name, row_key, key, said, CAST(NULL AS TIMESTAMPTZ) AS unsaid FROM (
    SELECT 'predictions' AS table_name, CAST(id AS VARCHAR) AS row_key, {sql_key("region_id")} AS key, created_at AS said FROM predictions
    UNION ALL
    SELECT 'reviews', CAST(id AS VARCHAR), {sql_key("region_id")}, created_at FROM reviews)
  WHERE key NOT LIKE '%:none'
  UNION
  SELECT 'image', 'regions', region_id, CAST(transaction_id AS VARCHAR), created_at, deleted_at FROM regions WHERE transaction_id IS NOT NULL
),
records AS (
  SELECT DISTINCT 'region' AS relation, {sql_key("region_id")} AS key, created_at AS born, deleted_at AS died FROM regions WHERE region_id IS NOT NULL
  UNION
  SELECT 'image', CAST(transaction_id AS VARCHAR), ingested_at, deleted_at FROM images WHERE transaction_id IS NOT NULL
)"""

_ORPHANS = f"""{_REFS},
orphans AS (
  SELECT r.table_name, r.row_key, r.key, r.said,
         CASE WHEN count(e.key) = 0 THEN 'missing'
              WHEN count(*) FILTER (e.born <= r.said) = 0 THEN 'late' ELSE 'deleted' END AS state
  FROM refs r LEFT JOIN (SELECT relation, key, born, died FROM records) e
    ON e.relation = r.relation AND e.key = r.key
  GROUP BY r.relation, r.table_name, r.row_key, r.key, r.said
  HAVING count(*) FILTER (e.born <= r.said AND (e.died IS NULL OR e.died > r.said)) = 0
)"""

SQL = {
    "p1_found": f"WITH {_ORPHANS} SELECT DISTINCT table_name, row_key, state FROM orphans",
    "p1_orphans_per_month": f"""WITH {_ORPHANS}
SELECT table_name, strftime(CAST(said AS TIMESTAMP), '%Y-%m') AS month, state, count(*) AS orphans
FROM orphans GROUP BY ALL""",
    "p1_current_orphans": f"""WITH {_REFS}
SELECT relation, key, CAST(sum(r) AS BIGINT) AS "references", CAST(sum(e) AS BIGINT) AS existing FROM (
  SELECT relation, key, CASE WHEN unsaid IS NULL THEN 1 ELSE 0 END AS r, 0 AS e FROM refs
  UNION ALL SELECT relation, key, 0, CASE WHEN died IS NULL THEN 1 ELSE 0 END FROM records WHERE born IS NOT NULL)
GROUP BY relation, key HAVING sum(r) > 0 AND sum(e) <= 0""",
}
