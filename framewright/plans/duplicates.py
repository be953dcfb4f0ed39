"""Queries over duplicate pictures and fingerprints, from images and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.bits import gradient_bits, with_words
from framewright.functions.normal import (
    fingerprint,
    hash_text,
    key_text,
    sql_fingerprint,
    sql_hash,
    sql_key,
)
from framewright.operators import duplicates as D
from framewright.session import stored
from framewright.tables import table


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads as the duplicate reports take them; a file that could not be fetched has no sha."""
    rows = table(spark, folder, "images").select(
        F.regexp_extract("image_reference", "^.*/([^/]+)/[^/]*$", 1).alias("folder"),
        "transaction_id", "image_id", F.col("image_reference").alias("path"),
        F.when(key_text(F.col("fetch_status")) == "ok", hash_text(F.col("image_hash"))).alias("sha"),
        fingerprint(F.col("perceptual_hash")).alias("_p"),
    ).distinct()
    return with_words(rows, "_p").drop("_p")


def exact_duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    up = uploads(spark, folder)
    return D.group_rows(up, D.file_groups(D.distinct_files(up), None))


def near_duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    up = stored(uploads(spark, folder))
    files = stored(D.distinct_files(up))
    groups = stored(D.file_groups(files))
    return D.group_rows(up, groups, D.group_spread(files, groups))


def duplicate_folder_summary(spark: SparkSession, folder: str) -> DataFrame:
    up = stored(uploads(spark, folder))
    return D.folder_summary(up, D.file_groups(stored(D.distinct_files(up))), up.select("folder"))


def close_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of distinct files at most 10 bits apart."""
    return D.close_pairs(stored(D.distinct_files(uploads(spark, folder))), D.NEAR)


def near_memberships(spark: SparkSession, folder: str) -> DataFrame:
    """The same in reduced form: every file with the smallest file of its group, and no pairs."""
    return D.file_groups(stored(D.distinct_files(uploads(spark, folder))))


def review_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return D.close_pairs(stored(D.distinct_files(uploads(spark, folder))), 40)


def hamming_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return D.distance_histogram(stored(D.distinct_files(uploads(spark, folder))))


def greedy_distinct_sample(spark: SparkSession, folder: str) -> DataFrame:
    """20 pictures a folder, in the order of a hash of their paths that SQL has as well."""
    order = F.conv(F.substring(F.md5(F.concat(F.lit("42"), "path")), 1, 15), 16, 10).cast("long")
    up = uploads(spark, folder).withColumn("position", order)
    return D.greedy_distinct_sample(up, 20, "position").select("folder", "sha", "taken")


def perceptual_bits(spark: SparkSession, folder: str) -> DataFrame:
    """The bit step of the fingerprint on vectors: 63 comparisons of neighbours."""
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", gradient_bits(F.col("embedding"), 63).alias("bits"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_duplicate_groups, near_duplicate_groups, duplicate_folder_summary, close_pairs,
        near_memberships, review_pairs, hamming_histogram, greedy_distinct_sample, perceptual_bits,
    )
}

_FILES = f"""
up AS (
  SELECT DISTINCT regexp_extract(image_reference, '^.*/([^/]+)/[^/]*$', 1) AS folder, transaction_id, image_id, image_reference AS path,
    CASE WHEN {sql_key("fetch_status")} = 'ok' THEN {sql_hash("image_hash")} END AS sha, {sql_fingerprint("perceptual_hash")} AS p FROM images),
firsts AS (
  SELECT sha, arg_min(struct_pack(folder := folder, t := transaction_id, i := image_id), struct_pack(a := folder, b := path, c := transaction_id, d := image_id)) AS f,
    arg_min(p, struct_pack(a := p IS NOT NULL, b := p[1:1] < '8', c := p)) FILTER (p IS NOT NULL) AS p1
  FROM up WHERE sha IS NOT NULL GROUP BY sha),
files AS (
  SELECT sha, f, p1 AS p FROM firsts),
words AS (
  SELECT sha, f, p, CAST('0x' || p[1:15] AS BIGINT) AS a1, CAST('0x' || p[16:30] AS BIGINT) AS a2, CAST('0x' || p[31:45] AS BIGINT) AS a3,
    CAST('0x' || p[46:60] AS BIGINT) AS a4, CAST('0x' || p[61:64] AS BIGINT) AS a5 FROM files WHERE p IS NOT NULL),
pairs AS (
  SELECT x.sha AS a, y.sha AS b, x.f AS fa, y.f AS fb, CAST(bit_count(xor(x.a1, y.a1)) AS INT) + bit_count(xor(x.a2, y.a2))
    + bit_count(xor(x.a3, y.a3)) + bit_count(xor(x.a4, y.a4)) + bit_count(xor(x.a5, y.a5)) AS d
  FROM words x JOIN words y ON x.sha < y.sha)"""

_NAME = "{0}.folder || '/' || CAST({0}.t AS VARCHAR) || '_' || {0}.i"

_GROUPED = f"""WITH RECURSIVE {_FILES},
links AS (SELECT a, b FROM pairs WHERE d <= 10 UNION SELECT b, a FROM pairs WHERE d <= 10),
reach(a, b) AS (SELECT sha, sha FROM files UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS sha, min(b) AS root FROM reach GROUP BY a)"""

_ROWS = """
SELECT min(sha)[1:16] AS image_hash, count(*) AS copies, CASE WHEN count(DISTINCT sha) = 1 THEN 'exact' ELSE 'near' END AS kind,
  coalesce(any_value(spread), 0) AS max_distance, string_agg(DISTINCT folder, ' ' ORDER BY folder) AS folders, count(DISTINCT folder) > 1 AS cross_folder,
  string_agg(folder || '/' || CAST(transaction_id AS VARCHAR) || '_' || image_id, ' ' ORDER BY folder, transaction_id, image_id, path) AS uploads
FROM tied GROUP BY root HAVING count(*) > 1"""

SQL = {
    "exact_duplicate_groups": f"WITH {_FILES}, tied AS (SELECT *, sha AS root, 0 AS spread FROM up WHERE sha IS NOT NULL) {_ROWS}",
    "near_duplicate_groups": f"""{_GROUPED},
widest AS (SELECT x.root, max(d) AS spread FROM pairs JOIN roots x ON x.sha = a JOIN roots y ON y.sha = b AND x.root = y.root GROUP BY x.root),
tied AS (SELECT up.*, root, spread FROM up JOIN roots USING (sha) LEFT JOIN widest USING (root)) {_ROWS}""",
    "duplicate_folder_summary": f"""{_GROUPED}
SELECT folder, count(*) AS zips, count(DISTINCT sha) AS distinct_exact, count(DISTINCT root) AS distinct_near,
  count(*) FILTER (sha IS NULL) AS unreadable FROM up LEFT JOIN roots USING (sha) GROUP BY folder""",
    "close_pairs": f"""WITH {_FILES}
SELECT d AS distance, true AS duplicate, {_NAME.format("fa")} AS upload_a, {_NAME.format("fb")} AS upload_b FROM pairs WHERE d <= 10""",
    "near_memberships": f"{_GROUPED} SELECT sha, root FROM roots",
    "review_pairs": f"""WITH {_FILES}
SELECT d AS distance, d <= 10 AS duplicate, {_NAME.format("fa")} AS upload_a, {_NAME.format("fb")} AS upload_b FROM pairs WHERE d <= 40""",
    "greedy_distinct_sample": f"""WITH RECURSIVE {_FILES},
once AS (
  SELECT folder, sha, min(CAST('0x' || md5('42' || path)[1:15] AS BIGINT)) AS o,
    arg_min(p, struct_pack(b := p[1:1] < '8', c := p)) FILTER (p IS NOT NULL) AS p FROM up WHERE sha IS NOT NULL GROUP BY folder, sha),
ranked AS (
  SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY o, sha) AS rn, struct_pack(sha := sha, a1 := CAST('0x' || p[1:15] AS BIGINT),
    a2 := CAST('0x' || p[16:30] AS BIGINT), a3 := CAST('0x' || p[31:45] AS BIGINT), a4 := CAST('0x' || p[46:60] AS BIGINT), a5 := CAST('0x' || p[61:64] AS BIGINT)) AS f FROM once),
steps AS (
  SELECT folder, rn, [f] AS kept FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.folder, r.rn, CASE WHEN len(s.kept) = 20 OR len(list_filter(s.kept, lambda k: coalesce(CAST(bit_count(xor(k.a1, r.f.a1)) AS INT) + bit_count(xor(k.a2, r.f.a2))
      + bit_count(xor(k.a3, r.f.a3)) + bit_count(xor(k.a4, r.f.a4)) + bit_count(xor(k.a5, r.f.a5)) <= 10, false))) > 0 THEN s.kept ELSE list_append(s.kept, r.f) END
  FROM steps s JOIN ranked r ON r.folder = s.folder AND r.rn = s.rn + 1),
done AS (SELECT folder, arg_max(kept, rn) AS kept FROM steps GROUP BY folder)
SELECT folder, unnest(kept).sha AS sha, generate_subscripts(kept, 1) - 1 AS taken FROM done""",
    "hamming_histogram": f"""WITH {_FILES}
SELECT d AS distance, count(*) FILTER (fa.folder = fb.folder) AS pairs_same_folder, count(*) FILTER (fa.folder <> fb.folder) AS pairs_cross_folder
FROM pairs GROUP BY d""",
    "perceptual_bits": """
SELECT vec_id, CAST(list_reduce(list_transform(range(1, 64), lambda i: CAST(embedding[i] > embedding[i + 1] AS BIGINT)), lambda a, b: a * 2 + b) AS BIGINT) AS bits
FROM embeddings""",
}
