import datetime as dt

from framewright.operators import orphans as O

REF = "relation string, key string, table_name string, row_key string, at timestamp, until timestamp"
LIFE = "relation string, key string, born timestamp, died timestamp"


def t(day, hour=0):
    return dt.datetime(2026, 1, day, hour, tzinfo=dt.UTC)


def found(spark, refs, lives):
    refs = [(*r, None) if len(r) == 5 else r for r in refs]
    rows = O.orphans_in_time(spark.createDataFrame(refs, REF), spark.createDataFrame(lives, LIFE)).collect()
    return {(r["row_key"], r["state"]) for r in rows}


def test_states_and_edges(spark):
    lives = [
        ("r", "a", t(2), t(5)), ("r", "a", t(2), t(5)), ("r", "b", t(3), None),
        ("r", "c", t(1), t(2)), ("r", "c", t(4), t(6)), ("r", "n", None, None), ("r", None, t(1), None), ("r", "x", t(5), t(4)),
    ]
    refs = [
        ("r", "a", "p", "before", t(1)), ("r", "a", "p", "at_birth", t(2)), ("r", "a", "p", "alive", t(4)),
        ("r", "a", "p", "at_death", t(5)), ("r", "zz", "p", "missing", t(3)), ("r", "c", "p", "between", t(3)),
        ("r", "c", "p", "second_life", t(4, 5)), ("r", "b", "p", "no_time", None), ("r", "c", "p", "no_time_dead", None),
        ("r", None, "p", "null", t(3)), ("r", "n", "p", "unborn", t(9)), ("s", "a", "p", "other_relation", t(4)),
        ("r", "x", "p", "never", t(6)), ("r", "zz", "p", "missing", t(3)),
    ]
    assert found(spark, refs, lives) == {
        ("before", "late"), ("at_death", "deleted"), ("missing", "missing"), ("between", "deleted"),
        ("no_time_dead", "deleted"), ("unborn", "late"), ("other_relation", "missing"), ("never", "deleted"),
    }


def test_empty_tables(spark):
    assert found(spark, [], [("r", "a", t(1), None)]) == set()
    assert found(spark, [("r", "a", "p", "1", t(1))], []) == {("1", "missing")}


def test_against_brute_force_with_a_hot_key(spark):
    import random

    r = random.Random(3)
    time = lambda: t(r.randint(1, 28), r.randint(0, 23))
    key = lambda: "hot" if r.random() < 0.4 else f"k{r.randint(0, 40)}"
    lives = []
    for _ in range(300):
        born = time()
        lives.append(("r", key(), born, r.choice([None, born + dt.timedelta(hours=r.randint(0, 200))])))
    refs = [("r", key(), "p", str(i), time()) for i in range(500)]
    want = set()
    for _, k, _, row, at in refs:
        own = [x for x in lives if x[1] == k]
        if not any(b <= at and (d is None or d > at) for _, _, b, d in own):
            want.add((row, "missing" if not own else "late" if all(b > at for _, _, b, _ in own) else "deleted"))
    assert found(spark, refs, lives) == want


def test_counts_from_deltas(spark):
    schema = "relation string, key string, references long, existing long"
    state = O.apply_deltas(None, spark.createDataFrame([("r", "a", 1, 0), ("r", "a", 1, 0), ("r", "b", 1, 1), ("r", None, 1, 0)], schema))
    assert {r["key"] for r in O.current_orphans(state).collect()} == {"a"}
    state = O.apply_deltas(state, spark.createDataFrame([("r", "a", 0, 1), ("r", "b", 0, -1), ("r", "c", None, 1)], schema))
    assert {r["key"] for r in O.current_orphans(state).collect()} == {"b"}
    state = O.apply_deltas(state, spark.createDataFrame([("r", "b", -1, 0)], schema))
    assert {r["key"] for r in state.collect()} == {"a", "c"}


def test_report(spark):
    rows = spark.createDataFrame([("p", "1", t(1), "k", "late"), ("p", "2", t(9), "k", "late"), ("p", "3", None, "k", "late")], "table_name string, row_key string, at timestamp, key string, state string")
    assert {tuple(r) for r in O.orphan_report(rows).collect()} == {("p", "2026-01", "late", 2), ("p", None, "late", 1)}


def test_one_ledger_serves_all_views(spark):
    import random

    r = random.Random(9)
    time = lambda: t(r.randint(1, 28), r.randint(0, 3)) + dt.timedelta(microseconds=r.randint(0, 3))
    until = lambda at: r.choice([None, at + dt.timedelta(hours=r.randint(0, 90))])
    refs = [("r", f"k{r.randint(0, 9)}", "p", str(i), at := time(), until(at)) for i in range(200)]
    lives = [("r", f"k{r.randint(0, 9)}", at := time(), until(at)) for i in range(30)]
    refs += refs[:20]
    lives += lives[:5]
    changes = O.ledger(O.distinct_references(spark.createDataFrame(refs, REF)), spark.createDataFrame(lives, LIFE)).cache()
    state = None
    for a, b in ((1, 8), (8, 20), (20, 99)):  # deltas as they come in
        part = changes.where(f"at >= TIMESTAMP '2026-01-{a:02} 00:00:00'" + (f" AND at < TIMESTAMP '2026-01-{b:02} 00:00:00'" if b < 32 else ""))
        state = O.apply_deltas(state, part)
    want = {}
    for x in set(refs):
        want.setdefault(x[1], [0, 0])[0] += x[5] is None
    for x in set(lives):
        want.setdefault(x[1], [0, 0])[1] += x[3] is None
    assert {x["key"]: [x["references"], x["existing"]] for x in state.collect()} == {k: v for k, v in want.items() if any(v)}
    running = O.running_counts(changes).collect()
    for k, v in want.items():
        last = max((x for x in running if x["key"] == k), key=lambda x: x["at"])
        assert [last["references"], last["existing"]] == v
    assert {x["key"] for x in O.current_orphans(state).collect()} == {k for k, v in want.items() if v[0] > 0 and v[1] <= 0}
    born = {(x[1], x[2], x[3]) for x in lives}
    orphaned = {(x[3], x[1]) for x in refs if not any(k == x[1] and b <= x[4] and (d is None or d > x[4]) for k, b, d in born)}
    assert {row for row, _ in found(spark, refs, lives)} == {row for row, _ in orphaned}
