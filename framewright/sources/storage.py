"""Keyed tables on disk (SNK-01..09): Parquet parts under a manifest, or JDBC.

A table is a folder of parts and numbered manifests; the highest names the parts of the current version. A write
adds parts and then publishes the next manifest by one rename that fails if the number is taken, so readers
see the old or the new version and of two writers one is told. A lost job leaves unnamed parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import keyed as K
from framewright.session import stored

# Tables, their keys and columns.
SCHEMAS = {
    "images": "transaction_id long, image_id string, image_reference string, image_hash string, fetch_status string, failure_reason string, ingested_at timestamp",
    "regions": "region_id string, transaction_id long, image_id string, detector_name string, x0 int, y0 int, x1 int, y1 int, detector_confidence double, created_at timestamp",
    "predictions": "run_id string, pipeline_version string, transaction_id long, image_id string, region_id string, model_name string, model_version string, document_type string, issuing_country string, document_side string, confidence double, status string, needs_review boolean, review_reasons string, raw_output string, error string, latency_ms double, created_at timestamp",
    "reviews": "region_id string, transaction_id long, image_id string, document_type string, issuing_country string, document_side string, review_status string, reviewer string, reviewed_at timestamp, exclusion_reason string, created_at timestamp",
}
KEYS = {
    "images": ("transaction_id", "image_id"),
    "regions": ("region_id",),
    "predictions": ("run_id", "region_id", "model_name"),
    "reviews": ("region_id",),
}
REFRESHED = ("image_reference", "image_hash", "fetch_status", "failure_reason")


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
BUCKETS = 64  # parts of an upserted Parquet table, by hash of the key; an upsert rewrites those it touches


class WriteConflict(RuntimeError):
    """Another writer published a version of the table meanwhile; nothing was changed."""


class ParquetTables:
    """Versioned Parquet tables under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _system(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _manifest(self, name: str) -> tuple[int, list[str]]:
        """(version, parts) of the newest version; (0, []) if there is no table."""
        system, folder = self._system(f"{self.path}/{name}")
        if not system.exists(folder):
            return 0, []
        names = (status.getPath().getName() for status in system.listStatus(folder))
        versions = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return 0, []
        version = max(versions)
        stream = system.open(self._system(f"{self.path}/{name}/manifest-{version:09d}.json")[1])
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, json.loads(text)

    def _commit(self, name: str, after: int, parts: list[str]) -> None:
        """Publishes version `after` + 1 by a rename that fails if that version exists."""
        system, new = self._system(f"{self.path}/{name}/draft-{uuid.uuid4().hex}")
        stream = system.create(new, True)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(new, self._system(f"{self.path}/{name}/manifest-{after + 1:09d}.json")[1], plain)
        except Exception as error:
            system.delete(new, False)
            if "FileAlreadyExists" in str(error):
                raise WriteConflict(f"{name}: version {after + 1} was published by another writer") from error
            raise

    def _write_part(self, name: str, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}/{part}")
        return part

    def _load(self, name: str, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}/{p}" for p in parts])

    def create(self, name: str, schema: str, keys: Sequence[str]) -> None:
        """An empty first version, so that readers know the columns; does nothing if the table is there.

        Parquet enforces no key: `keys` hold by how rows are written.
        """
        version, _ = self._manifest(name)
        if version == 0:
            self._commit(name, 0, [self._write_part(name, self.spark.createDataFrame([], schema))])

    def read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """The newest version; an empty table of `schema`, or None, if the table does not exist. Read errors are raised."""
        _, parts = self._manifest(name)
        if parts:
            return self._load(name, parts)
        return None if schema is None else self.spark.createDataFrame([], schema)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows; an empty batch adds nothing."""
        if not df.isEmpty():
            version, parts = self._manifest(name)
            self._commit(name, version, [*parts, self._write_part(name, df)])

    def insert_ignore(self, name: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
        """Rows whose keys are new, one per key, the first by `order`."""
        self.append(name, K.insert_ignore(self.read(name, rows.schema), rows, keys, order))

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], refreshed: Sequence[str], order: Sequence[str]) -> None:
        """Adds new keys and refreshes known ones; only the key buckets that `rows` touch are read and written."""
        version, parts = self._manifest(name)
        bucket = F.pmod(F.hash(*keys), F.lit(BUCKETS))
        batch = stored(rows.dropna(subset=list(keys), how="any").withColumn("_b", bucket))
        touched = {r["_b"] for r in batch.select("_b").distinct().collect()}  # at most BUCKETS
        if not touched:
            return
        mine = [p for p in parts if "/_b=" not in p or int(p.rsplit("=", 1)[1]) in touched]
        old = self._load(name, mine) if mine else self.spark.createDataFrame([], rows.schema)
        new = K.upsert(old, batch.drop("_b"), keys, refreshed, order).withColumn("_b", bucket)
        part = f"part-{uuid.uuid4().hex}"
        new.repartition(F.col("_b")).write.partitionBy("_b").parquet(f"{self.path}/{name}/{part}")
        system, folder = self._system(f"{self.path}/{name}/{part}")
        made = [s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName().startswith("_b=")]
        self._commit(name, version, [*(p for p in parts if p not in mine), *(f"{part}/{m}" for m in sorted(made))])


class JdbcTables:
    """The same over JDBC. Keys are the database's; batches go to a staging table and are merged by one transaction."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def _connect(self):
        if "driver" in self.options:
            self.spark._jvm.java.lang.Class.forName(self.options["driver"])
        given = self.spark._jvm.java.util.Properties()
        for key, value in self.options.items():
            given.setProperty(key, value)
        return self.spark._jvm.java.sql.DriverManager.getConnection(self.url, given)

    def _run(self, *statements: str) -> None:
        """All statements in one transaction."""
        connection = self._connect()
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for text in statements:
                statement.executeUpdate(text)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def exists(self, name: str) -> bool:
        """Whether the database lists the table; raises if it can't be asked."""
        schema, _, bare = name.rpartition(".")
        connection = self._connect()
        try:
            for form in dict.fromkeys((bare, bare.upper(), bare.lower())):
                listed = connection.getMetaData().getTables(None, None, form, None)
                while listed.next():
                    if not schema or (listed.getString("TABLE_SCHEM") or "").lower() == schema.lower():
                        return True
            return False
        finally:
            connection.close()

    def _sql_type(self, kind: str, is_key: bool) -> str:
        if kind in TYPES:
            return TYPES[kind]
        return "VARCHAR(512)" if is_key else "CLOB" if self.url.startswith("jdbc:derby:") else "TEXT"

    def create(self, name: str, schema: str, keys: Sequence[str]) -> None:
        """The table with its unique key, if it is not there."""
        if self.exists(name):
            return
        self._run(f"CREATE TABLE {name} ({self._columns(self.spark.createDataFrame([], schema), keys)}, UNIQUE ({', '.join(keys)}))")

    def _columns(self, like: DataFrame, keys: Sequence[str]) -> str:
        return ", ".join(f"{c} {self._sql_type(kind, c in keys)}{' NOT NULL' if c in keys else ''}" for c, kind in like.dtypes)

    def _reader(self, name: str):
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options)

    def read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """The table; an empty one of `schema`, or None, only if the database has no such table. Errors are raised."""
        if not self.exists(name):
            return None if schema is None else self.spark.createDataFrame([], schema)
        df = self._reader(name).load()
        return df.toDF(*[c.lower() for c in df.columns])

    def append(self, name: str, df: DataFrame) -> None:
        df.write.format("jdbc").options(url=self.url, dbtable=name, **self.options).mode("append").save()

    def _merge(self, name: str, rows: DataFrame, keys: Sequence[str], refreshed: Sequence[str]) -> None:
        """Rows, one per key, into the table: `refreshed` columns of known keys are set, new keys are added."""
        self.create(name, rows.schema.toDDL(), keys)
        stage = f"{name}_in_{uuid.uuid4().hex[:12]}"
        self._run(f"CREATE TABLE {stage} ({self._columns(rows, keys)})")
        match = " AND ".join(f"s.{k} = {name}.{k}" for k in keys)
        columns = ", ".join(rows.columns)
        sets = ", ".join(f"{c} = (SELECT s.{c} FROM {stage} s WHERE {match})" for c in refreshed)
        update = [f"UPDATE {name} SET {sets} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {match})"] if refreshed else []
        insert = f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {name} WHERE {match})"
        try:
            self.append(stage, rows)
            self._run(*update, insert)
        finally:
            self._run(f"DROP TABLE {stage}")

    def insert_ignore(self, name: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
        """Rows whose keys are new, one per key, the first by `order`."""
        self._merge(name, K.first_per_key(rows, keys, order), keys, ())

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], refreshed: Sequence[str], order: Sequence[str]) -> None:
        """Adds new keys and refreshes known ones; of a key twice in the batch the last by `order` counts."""
        self._merge(name, K.last_per_key(rows, keys, order), keys, refreshed)


def tables(spark: SparkSession, target: str, **options: str) -> ParquetTables | JdbcTables:
    """Tables by the target's scheme: `jdbc:` or a path."""
    if target.startswith("jdbc:"):
        return JdbcTables(spark, target, **options)
    scheme = target.split(":", 1)[0] if "://" in target else ""
    if scheme in ("postgresql", "sqlite", "mysql"):
        raise ValueError(f"unsupported target {scheme}: give a jdbc: URL or a path")
    return ParquetTables(spark, target)


class Storage:
    """The four tables of a run. Repeating a write adds nothing."""

    def __init__(self, store: ParquetTables | JdbcTables):
        self.store = store

    def read(self, name: str) -> DataFrame:
        return self.store.read(name, SCHEMAS[name])

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        empty = rows.sparkSession.createDataFrame([], SCHEMAS[name])
        shaped = empty.unionByName(rows, allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType) for f in empty.schema])
        stamp = "ingested_at" if name == "images" else "created_at"
        return shaped.withColumn(stamp, F.coalesce(stamp, F.current_timestamp()))

    def create_tables(self) -> None:
        """All tables with their keys, as far as they are not there."""
        for name, schema in SCHEMAS.items():
            self.store.create(name, schema, KEYS[name])

    def save_images(self, rows: DataFrame, order: Sequence[str] = ("ingested_at",)) -> None:
        """Upsert: fetch fields refreshed, the first ingestion time kept."""
        self.store.upsert("images", self._shaped("images", rows), KEYS["images"], REFRESHED, order)

    def insert_ignore(self, name: str, rows: DataFrame) -> None:
        """Rows whose keys are new, one per key; what is there stays as it is."""
        rows = self._shaped(name, rows)
        self.store.insert_ignore(name, rows, KEYS[name], [c for c in rows.columns if c not in KEYS[name]])

    def save_regions(self, rows: DataFrame) -> None:
        self.insert_ignore("regions", rows)

    def save_predictions(self, rows: DataFrame) -> None:
        self.insert_ignore("predictions", rows)

    def ensure_reviews(self, routed: DataFrame) -> None:
        """A review row for each routed region that has none; people's edits stay."""
        rows = routed.withColumn("review_status", F.when(F.col("needs_review"), "pending").otherwise("auto_accepted"))
        self.insert_ignore("reviews", rows.drop("needs_review", "reasons", "confidence"))

    def count_rows(self, name: str) -> int:
        return self.read(name).count()
