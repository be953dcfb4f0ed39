"""References to records that do not exist (problem 1).

One ledger of signed deltas per key and instant serves all views. A reference is +1 when it is written and -1
when its own row is deleted; a record is +1 when it begins to live and -1 when it is deleted.

* `apply_deltas` keeps the counts of every key from deltas as they come in; the keys
  with positive references and no existence are the current orphans.
* `running_counts` gives the counts of every key at every instant of the ledger; `orphans_in_time` tells from them
  for each reference whether any record of its key was alive when the reference was written.

Keys may be hot: deltas are summed per key and instant before anything else, and running sums are carried
from minutes to instants, so that no task holds more of a key than its minutes, or the
instants of one minute. Rows meet the few orphan instants by key and instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = ("relation", "key", "references", "existing")
COUNTS = ("references", "existing", "births", "written")


def apply_deltas(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """Adds signed deltas to the counts of each (relation, key).

    Both sides have the columns of STATE. Rows with a NULL key are dropped, keys whose counts
    are both zero leave the state, NULL counts count as zero. `state` may be None (empty).
    """
    deltas = deltas.select(*STATE).where(F.col("key").isNotNull())
    rows = deltas if state is None else state.select(*STATE).unionByName(deltas)
    zero = F.lit(0).cast("long")
    return (
        rows.groupBy("relation", "key")
        .agg(
            F.coalesce(F.sum("references"), zero).alias("references"),
            F.coalesce(F.sum("existing"), zero).alias("existing"),
        )
        .where("`references` <> 0 OR existing <> 0")
    )


def current_orphans(state: DataFrame) -> DataFrame:
    """The keys that are referred to and of which no record exists."""
    return state.where("`references` > 0 AND existing <= 0")


def references(
    df: DataFrame, relation: str, key: Column, table: str, row_key: Column, at: Column, until: Column | None = None
) -> DataFrame:
    """Reference rows in the form that `ledger` takes; until: when the referring row was deleted."""
    return df.select(
        F.lit(relation).alias("relation"),
        key.cast("string").alias("key"),
        F.lit(table).alias("table_name"),
        row_key.cast("string").alias("row_key"),
        at.cast("timestamp").alias("at"),
        (F.lit(None) if until is None else until).cast("timestamp").alias("until"),
    )


def lives(
    df: DataFrame, relation: str, key: Column, born: Column, died: Column
) -> DataFrame:
    """Lives of records in the form that `ledger` takes."""
    return df.select(
        F.lit(relation).alias("relation"),
        key.cast("string").alias("key"),
        born.cast("timestamp").alias("born"),
        died.cast("timestamp").alias("died"),
    )


def _last() -> Column:
    """A time after all changes."""
    return F.lit("9999-12-31 00:00:00").cast("timestamp")


def distinct_references(refs: DataFrame) -> DataFrame:
    """The references with a key, identical rows once; `at` is never NULL but `_last` instead."""
    known = refs.where(F.col("key").isNotNull()).select(
        "relation", "key", "table_name", "row_key", F.coalesce("at", _last()).alias("at"), "until"
    )
    return known.distinct()


def ledger(refs: DataFrame, records: DataFrame) -> DataFrame:
    """(relation, key, at, references, existing, births, written): the sums of all deltas of a key at an instant.

    refs: as of `distinct_references`. births counts the records that begin, written the references.
    """
    zero, one, minus = (F.lit(x).cast("long") for x in (0, 1, -1))
    records = records.where(F.col("key").isNotNull()).distinct()
    never = F.col("born").isNull() | (F.col("died") <= F.col("born"))
    key = ("relation", "key")
    said = refs.select(*key, "at", one.alias("references"), zero.alias("existing"), zero.alias("births"), one.alias("written"))
    unsaid = refs.where("until IS NOT NULL").select(
        *key, F.greatest("at", "until").alias("at"), minus.alias("references"), zero.alias("existing"), zero.alias("births"), zero.alias("written")
    )
    born = records.select(
        *key, F.coalesce("born", _last() + F.expr("INTERVAL 1 DAY")).alias("at"), zero.alias("references"),
        F.when(never, 0).otherwise(1).cast("long").alias("existing"), one.alias("births"), zero.alias("written"),
    )
    died = records.where(F.col("died").isNotNull() & ~never).select(
        *key, F.col("died").alias("at"), zero.alias("references"), minus.alias("existing"), zero.alias("births"), zero.alias("written")
    )
    both = said.unionByName(unsaid).unionByName(born).unionByName(died)
    return both.groupBy(*key, "at").agg(*[F.sum(c).alias(c) for c in COUNTS])


def running_counts(changes: DataFrame) -> DataFrame:
    """The ledger with running sums: relation, key, at, COUNTS up to and with that instant (but `written` of the instant
    itself), and ever: the births of the key at all times.

    Sums are carried downwards as a first row of each minute.
    """
    key = ["relation", "key"]
    zero = F.lit(0).cast("long")
    timed = changes.withColumn("_slot", F.date_trunc("minute", "at"))
    slots = timed.groupBy(*key, "_slot").agg(*[F.sum(c).alias(c) for c in COUNTS])
    before = Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(
        *key, "_slot", F.lit(None).cast("timestamp").alias("at"),
        *[F.coalesce(F.sum(c).over(before), zero).alias(c) for c in COUNTS],
        F.sum("births").over(Window.partitionBy(*key)).alias("ever"),
    )
    # the carried row has no instant and comes first
    upto = Window.partitionBy(*key, "_slot").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = carried.unionByName(timed.withColumn("ever", zero))
    return rows.select(
        *key, "at", *[F.sum(c).over(upto).alias(c) for c in (*COUNTS[:3], "ever")], "written"
    ).where("at IS NOT NULL")


def orphans_in_time(refs: DataFrame, records: DataFrame) -> DataFrame:
    """(table_name, row_key, at, key, state) of the references without a living record.

    refs: relation, key, table_name, row_key, at, until. records: relation, key, born, died.
    A record lives from `born` up to, not including, `died` (NULL: for ever). state is `missing`
    (no record of the key at all), `late` (none was born by then) or `deleted`.

    Defined cases: references with a NULL key are no orphans; a NULL `at` is judged after all
    changes; a record with a NULL `born` never lives, yet its key is not `missing`; a record
    that died before it was born only counts as born. Repeated rows give one result row. Empty
    tables give an empty result, or only `missing` rows. Whether the referring row was deleted later does not matter.
    """
    said = distinct_references(refs)
    counts = running_counts(ledger(said, records))
    orphaned = counts.where("written > 0 AND existing <= 0").select(
        "relation", "key", "at",
        F.when(F.col("ever") == 0, "missing").when(F.col("births") == 0, "late").otherwise("deleted").alias("state"),
    )
    return said.join(orphaned, ["relation", "key", "at"]).select(
        "table_name", "row_key", F.when(F.col("at") != _last(), F.col("at")).alias("at"), "key", "state"
    ).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, month of writing (UTC) and state."""
    return orphans.groupBy(
        "table_name", F.date_format("at", "yyyy-MM").alias("month"), "state"
    ).agg(F.count("*").alias("orphans"))
