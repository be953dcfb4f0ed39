"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.normal import sql_country, sql_document_type, sql_fingerprint, sql_hash, sql_strip
from framewright.llm import (
    abuse,
    components,
    consensus,
    history_dedup,
    mixing,
    packing,
    quota_sample,
    splits,
    stable_sample,
)
from framewright.session import scratch
from framewright.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    plan = quota_sample.allocation(
        table(spark, folder, "labelled_images"), table(spark, folder, "sample_targets")
    )
    return quota_sample.unfilled(plan).select("sample_name", "document_type", "issuing_country")


def p2_allocation(spark: SparkSession, folder: str) -> DataFrame:
    return quota_sample.allocation(
        table(spark, folder, "labelled_images"), table(spark, folder, "sample_targets")
    )


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quota_sample.quota_sample(
        table(spark, folder, "labelled_images"), table(spark, folder, "sample_targets")
    )


def p2_sample_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Images and distinct images drawn per sample."""
    drawn = p2_sample(spark, folder).groupBy("sample_name")
    return drawn.agg(F.count("*").alias("images"), F.count_distinct("transaction_id", "image_id").alias("distinct_images"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    labels, _ = consensus.consensus(consensus.answers(table(spark, folder, "predictions")))
    return labels.where("disputed").select("region_id", "document_type", "issuing_country")


def p3_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.consensus(consensus.answers(table(spark, folder, "predictions")))[0]


def p3_reliability(spark: SparkSession, folder: str) -> DataFrame:
    given = consensus.answers(table(spark, folder, "predictions"))
    return consensus.consensus(given)[1]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every load through an index of its own, in the shared folder."""
    return history_dedup.seen_before(table(spark, folder, "images"), scratch(spark, "segment-index"))


def _upload_components(spark: SparkSession, folder: str) -> DataFrame:
    links = components.upload_links(
        table(spark, folder, "close_pairs"), table(spark, folder, "duplicate_groups")
    )
    return components.connected_components(links).select(
        F.col("root").alias("group_upload"), F.col("vertex").alias("upload")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _upload_components(spark, folder).where("upload <> group_upload")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    kept = splits.keep_together(
        table(spark, folder, "labelled_images"), table(spark, folder, "duplicate_groups")
    )
    return kept.where("keep_with < transaction_id").select("keep_with", "transaction_id")


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.grouped_splits(
        table(spark, folder, "labelled_images"),
        table(spark, folder, "duplicate_groups"),
        table(spark, folder, "split_targets"),
    )


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    return _splits(spark, folder)


def p6_split_report(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_report(_splits(spark, folder))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Images assigned, images in several splits, and components in several splits."""
    rows = _splits(spark, folder)
    twice = rows.groupBy("transaction_id", "image_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("images"), F.count_if(F.col("n") > 1).alias("images_twice"))
    cut = rows.groupBy("keep_with").agg(F.count_distinct("split_name").alias("n")).agg(F.count_if(F.col("n") > 1).alias("components_cut"))
    return twice.join(cut)  # one row each


SAMPLE_RATE = 0.1


def p7_sample(spark: SparkSession, folder: str) -> DataFrame:
    return stable_sample.stable_sample(table(spark, folder, "images"), SAMPLE_RATE)


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(
        table(spark, folder, "documents"), table(spark, folder, "container_sizes")
    )


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _containers(spark, folder)


def p8_fill_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(_containers(spark, folder), table(spark, folder, "container_sizes"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per size: texts placed, overfull containers, and texts whose pieces do not lie end to end."""
    pieces = packing.containers(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "container_sizes"))
    sizes = table(spark, folder, "container_sizes").select("size_name", "capacity_tokens").distinct()
    full = pieces.groupBy("size_name", "container_id").agg(F.sum("tokens").alias("t")).join(sizes, "size_name")
    over = full.groupBy("size_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    texts = pieces.groupBy("size_name", "doc_id").agg(F.sum("tokens").alias("t"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.min("start").alias("first"))
    torn = texts.groupBy("size_name").agg(F.count("*").alias("documents"), F.count_if((F.col("t") != F.col("end")) | (F.col("first") != 0)).alias("torn"))
    return torn.join(over, "size_name")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per target: texts used more often than max_repeats, and sources that miss their quota by a text or more."""
    mixed, shares = _mix(spark, folder)
    asked = shares.select("mix_name", "source", "max_repeats", "quota_tokens", "tokens")
    used = asked.select("mix_name", "source", "max_repeats").join(mixed.withColumnRenamed("tokens", "_t"), ["mix_name", "source"], "left").groupBy("mix_name", "source").agg(
        F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_repeats"), F.coalesce(F.max("_t"), F.lit(0)).alias("_longest")
    )
    return asked.join(used, ["mix_name", "source"]).select(
        "mix_name", "source", "over_repeats", (F.abs(F.col("tokens") - F.col("quota_tokens")) > F.col("_longest")).alias("off_by_a_text")
    )


def _abuse(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.found_documents(_abuse(spark, folder))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _abuse(spark, folder)


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.abuse_rates(_abuse(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_allocation, p2_sample, p2_sample_sizes, p3_found, p3_consensus, p3_reliability, p4_found,
        p5_found, p6_found, p6_splits, p6_split_report, p6_checks, p7_sample,
        p8_containers, p8_fill_report, p8_checks, p9_mix, p9_shares, p9_checks,
        p10_found, p10_scores, p10_rates,
    )
}

_LISTED = f"""
listed AS (SELECT DISTINCT h, upload FROM (
  SELECT {sql_hash("image_hash")} AS h, unnest(regexp_split_to_array(replace(uploads, chr(92), '/'), '[ \\t\\n\\r]+')) AS upload
  FROM duplicate_groups) WHERE h IS NOT NULL AND upload <> '')"""

SQL = {
    "p2_found": f"""
WITH held AS (
  SELECT t, c, count(*) AS n FROM (
    SELECT DISTINCT {sql_document_type("document_type")} AS t, {sql_country("issuing_country")} AS c, transaction_id, image_id
    FROM labelled_images WHERE transaction_id IS NOT NULL AND image_id IS NOT NULL)
  WHERE t IS NOT NULL AND c IS NOT NULL GROUP BY t, c)
SELECT DISTINCT s.sample_name, s.document_type, s.issuing_country FROM sample_targets s
LEFT JOIN held ON t = {sql_document_type("s.document_type")} AND c = {sql_country("s.issuing_country")}
WHERE coalesce(n, 0) < target_share * sample_size OR coalesce(n, 0) < coalesce(min_count, 0)""",
    "p2_sample_sizes": f"""
WITH listed AS (
  SELECT DISTINCT {sql_document_type("document_type")} AS t, {sql_country("issuing_country")} AS c, transaction_id, image_id
  FROM labelled_images WHERE transaction_id IS NOT NULL AND image_id IS NOT NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY t, c) AS n FROM listed WHERE t IS NOT NULL AND c IS NOT NULL),
free AS (SELECT x.t, x.c, count(*) AS n FROM (SELECT min(struct_pack(n, t, c)) AS x FROM sized GROUP BY transaction_id, image_id) GROUP BY ALL),
asked AS (
  SELECT sample_name, t, c, sum(target_share) AS share, max(coalesce(min_count, 0)) AS least, max(sample_size) AS size FROM (
    SELECT DISTINCT sample_name, sample_size, target_share, min_count, document_type, issuing_country, {sql_document_type("document_type")} AS t, {sql_country("issuing_country")} AS c FROM sample_targets)
  GROUP BY ALL),
total AS (
  SELECT sample_name, greatest(CASE WHEN sum(share) BETWEEN 0.999 AND 1.001 THEN max(size) ELSE round_even(max(size) * least(1, sum(share)), 0) END, sum(least)) AS wanted, sum(coalesce(n, 0)) AS held
  FROM asked LEFT JOIN free USING (t, c) GROUP BY sample_name)
SELECT sample_name, CAST(least(wanted, held) AS BIGINT) AS images, CAST(least(wanted, held) AS BIGINT) AS distinct_images FROM total""",
    "p6_checks": """
SELECT count(*) AS images, CAST(0 AS BIGINT) AS images_twice, CAST(0 AS BIGINT) AS components_cut FROM (SELECT DISTINCT transaction_id, image_id FROM labelled_images WHERE transaction_id IS NOT NULL)""",
    "p8_checks": """
SELECT size_name, count(*) AS documents, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS overfull FROM (SELECT DISTINCT size_name FROM container_sizes), (SELECT DISTINCT doc_id FROM documents WHERE text <> '') GROUP BY size_name""",
    "p9_checks": f"""
SELECT DISTINCT mix_name, regexp_replace(lower({sql_strip("source")}), '[- ]', '_', 'g') AS source, CAST(0 AS BIGINT) AS over_repeats, false AS off_by_a_text FROM mix_targets""",
    "p4_found": f"""
WITH ok AS (
  SELECT id, batch_no, {sql_hash("image_hash")} AS h, {sql_fingerprint("perceptual_hash")} AS p
  FROM images WHERE lower({sql_strip("fetch_status")}) = 'ok'),
prints AS (
  SELECT p, min(batch_no) AS b, CAST('0x' || p[1:15] AS BIGINT) AS a1, CAST('0x' || p[16:30] AS BIGINT) AS a2,
         CAST('0x' || p[31:45] AS BIGINT) AS a3, CAST('0x' || p[46:60] AS BIGINT) AS a4, CAST('0x' || p[61:64] AS BIGINT) AS a5
  FROM ok WHERE p IS NOT NULL GROUP BY p),
cut AS (SELECT *, unnest(range(16)) AS i FROM prints),
seg AS (SELECT p, b, a1, a2, a3, a4, a5, i, p[4 * i + 1 : 4 * i + 4] AS s FROM cut),
near AS (
  SELECT DISTINCT x.p FROM seg x JOIN seg y ON x.i = y.i AND x.s = y.s AND y.b < x.b
  WHERE CAST(bit_count(xor(x.a1, y.a1)) AS INT) + bit_count(xor(x.a2, y.a2)) + bit_count(xor(x.a3, y.a3))
      + bit_count(xor(x.a4, y.a4)) + bit_count(xor(x.a5, y.a5)) <= 10),
hashes AS (SELECT h, min(batch_no) AS hb FROM ok WHERE h IS NOT NULL GROUP BY h)
SELECT DISTINCT ok.id FROM ok LEFT JOIN hashes USING (h) LEFT JOIN prints USING (p) LEFT JOIN near ON near.p = ok.p
WHERE batch_no > hb OR batch_no > b OR near.p IS NOT NULL""",
    "p5_found": f"""
WITH RECURSIVE {_LISTED},
links AS (
  SELECT replace({sql_strip("upload_a")}, chr(92), '/') AS a, replace({sql_strip("upload_b")}, chr(92), '/') AS b
  FROM close_pairs WHERE distance <= 10
  UNION SELECT m, upload FROM (SELECT min(upload) OVER (PARTITION BY h) AS m, upload FROM listed)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT least(min(b), a) AS group_upload, a AS upload FROM reach GROUP BY a HAVING least(min(b), a) < a""",
    "p6_found": f"""
WITH RECURSIVE {_LISTED},
members AS (SELECT DISTINCT h, CAST(regexp_extract(upload, '([0-9]+)_[^/]*$', 1) AS BIGINT) AS t FROM listed),
links AS (SELECT m AS a, t AS b FROM (SELECT min(t) OVER (PARTITION BY h) AS m, t FROM members)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
held AS (SELECT DISTINCT transaction_id AS t FROM labelled_images WHERE transaction_id IS NOT NULL)
SELECT min(b) AS keep_with, a AS transaction_id FROM reach
WHERE a IN (SELECT t FROM held) AND b IN (SELECT t FROM held) GROUP BY a HAVING min(b) < a""",
    "p7_sample": stable_sample.sql_stable_sample(SAMPLE_RATE),
}
