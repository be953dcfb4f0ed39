import datetime as dt

import pytest

from framewright.operators import keyed as K
from framewright.plans import loading
from framewright.sources.storage import JdbcTables, ParquetTables, Storage, WriteConflict, tables
from framewright.streaming import extract as X

SOURCE = "id long, time timestamp, error_codes string, api_version string"


def t(day):
    return dt.datetime(2026, 1, day, tzinfo=dt.UTC)


def source(spark):
    return spark.createDataFrame([(1, t(1), "4201 a", "v1"), (2, t(2), "42015", None), (3, t(2), "5000", "v"), (7, t(3), "4201", "v"), (9, t(4), None, "v")], SOURCE)


@pytest.mark.parametrize("kind", ["parquet", "jdbc"])
def test_extract_runs(spark, tmp_path, kind):
    if kind == "parquet":
        store = ParquetTables(spark, str(tmp_path / "out"))
    else:
        store = JdbcTables(spark, f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")
    name = "loaded"
    run = lambda src, **days: X.run_extract(src, lambda: store.read(name), lambda df: store.append(name, df), "4201", **days)
    src = source(spark)
    try:
        first = run(src.where("id < 7"))
    except Exception as error:
        if kind == "jdbc" and "ClassNotFound" in str(error):
            pytest.skip("no JDBC driver here")
        raise
    assert first == {"extracted": 2, "loaded": 2}
    assert run(src) == {"extracted": 1, "loaded": 1}
    assert run(src) == {"extracted": 0, "loaded": 0}
    rows = store.read(name).orderBy("id").collect()
    assert [(r["id"], r["transaction_id"], r["error_codes"]) for r in rows] == [(1, 1, "4201"), (2, 2, "4201"), (3, 7, "4201")]
    late = src.union(spark.createDataFrame([(5, t(2), "4201", "v")], SOURCE))
    assert run(late)["loaded"] == 0  # below the checkpoint
    assert run(late, first_day="2026-01-02", last_day="2026-01-02") == {"extracted": 2, "loaded": 1}
    with pytest.raises(ValueError):
        run(src, first_day="2026-01-02")


def test_empty_source(spark, tmp_path):
    store = ParquetTables(spark, str(tmp_path))
    empty = spark.createDataFrame([], SOURCE)
    assert X.run_extract(empty, lambda: store.read("x"), lambda df: store.append("x", df), "4") == {"extracted": 0, "loaded": 0}


def test_stream(spark, tmp_path):
    store = ParquetTables(spark, str(tmp_path / "out"))
    where = str(tmp_path / "in")
    source(spark).where("id < 7").write.parquet(where)
    for want in (2, 2, 3):
        if want == 3:
            source(spark).where("id = 7").write.mode("append").parquet(where)
        stream = spark.readStream.schema(SOURCE).parquet(where)
        X.stream_extract(stream, "4201", lambda: store.read("x"), lambda df: store.append("x", df), str(tmp_path / "ck"))
        assert store.read("x").count() == want


def image(n, hash_, reason=None, day=1):
    return (n, "front", "ref", hash_, "ok" if hash_ else "failed", reason, t(day))


IMAGE = "transaction_id long, image_id string, image_reference string, image_hash string, fetch_status string, failure_reason string, ingested_at timestamp"


def test_storage(spark, tmp_path):
    storage = Storage(tables(spark, str(tmp_path)))
    assert storage.count_rows("images") == 0
    storage.save_images(spark.createDataFrame([image(1, None, "read_error: X"), image(2, "h")], IMAGE))
    storage.save_images(spark.createDataFrame([image(1, "new", day=5), image(1, "old", day=4), image(3, "h3")], IMAGE))
    rows = {r["transaction_id"]: r for r in storage.read("images").collect()}
    assert len(rows) == 3 and rows[1]["image_hash"] == "new" and rows[1]["failure_reason"] is None
    assert rows[1]["ingested_at"].day == 1
    said = spark.createDataFrame([("run", "r1", "m", "passport"), ("run", "r1", "m", "passport"), ("run", "r1", "n", None)], "run_id string, region_id string, model_name string, document_type string")
    for _ in range(2):
        storage.save_predictions(said)
    assert storage.count_rows("predictions") == 2
    routed = spark.createDataFrame([("r1", "passport", True), ("r2", "passport", False)], "region_id string, document_type string, needs_review boolean")
    storage.ensure_reviews(routed.where("region_id = 'r1'"))
    storage.ensure_reviews(routed.withColumn("document_type", routed["region_id"]))
    assert {(r["region_id"], r["document_type"], r["review_status"]) for r in storage.read("reviews").collect()} == {("r1", "passport", "pending"), ("r2", "r2", "auto_accepted")}
    with pytest.raises(ValueError):
        tables(spark, "postgresql://host/db")


def test_gapless_and_union(spark):
    batch = spark.createDataFrame([(50,), (7,), (1000,), (8,)], "k long")
    got = {r["k"]: r["id"] for r in K.gapless_ids(spark.createDataFrame([(3,)], "id long"), batch, "k").collect()}
    assert got == {7: 4, 8: 5, 50: 6, 1000: 7}
    assert K.gapless_ids(None, batch.limit(0), "k").count() == 0
    both = K.union_rows(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int"))
    assert {tuple(r) for r in both.collect()} == {(1, None), (None, 2)}


def test_first_load_takes_all_events(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").where("event_type LIKE 'err%' AND event_id > 0")
    ids = [r["id"] for r in loading.full_extract(spark, folder).orderBy("transaction_id").collect()]
    assert ids == list(range(1, events.select("event_id").distinct().count() + 1)) and ids


def test_an_unreadable_target_is_no_empty_table(spark, tmp_path):
    gone = JdbcTables(spark, "jdbc:derby:/nowhere/at/all", driver="org.apache.derby.jdbc.EmbeddedDriver")
    with pytest.raises(Exception, match="nowhere"):
        gone.read("loaded")
    with pytest.raises(Exception, match="nowhere"):
        Storage(gone).save_images(spark.createDataFrame([image(1, "h")], IMAGE))
    kept = []
    with pytest.raises(RuntimeError, match="not in the target"):
        X.run_extract(source(spark), lambda: None, kept.append, "4201")
    assert len(kept) == 1


@pytest.mark.parametrize("kind", ["parquet", "jdbc"])
def test_upsert_and_keys(spark, tmp_path, kind):
    if kind == "parquet":
        store = ParquetTables(spark, str(tmp_path / "out"))
    else:
        store = JdbcTables(spark, f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")
    storage = Storage(store)
    storage.create_tables()
    storage.create_tables()
    assert storage.count_rows("reviews") == 0
    storage.save_images(spark.createDataFrame([image(n, f"h{n}") for n in range(40)], IMAGE))
    before = store._manifest("images")[1] if kind == "parquet" else None
    storage.save_images(spark.createDataFrame([image(3, None, "gone", 9), image(99, "new", day=9)], IMAGE))
    rows = {r["transaction_id"]: r for r in storage.read("images").collect()}
    assert len(rows) == 41 and rows[3]["image_hash"] is None and rows[3]["failure_reason"] == "gone" and rows[3]["ingested_at"].day == 1
    assert rows[99]["image_hash"] == "new" and rows[5]["image_hash"] == "h5"
    if kind == "parquet":  # buckets without a new row are kept as they are
        assert len(set(before) & set(store._manifest("images")[1])) >= len(before) - 2
        with pytest.raises(WriteConflict):
            store._commit("images", 1, [])
    said = spark.createDataFrame([("run", "r1", "m", "passport"), ("run", "r1", "m", "other")], "run_id string, region_id string, model_name string, document_type string")
    for _ in range(2):
        storage.save_predictions(said)
    assert [r["document_type"] for r in storage.read("predictions").collect()] == ["other"]
