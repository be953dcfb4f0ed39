import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from framewright.llm import mixing as M

DOC = "doc_id long, text string, source string, tokens string, mix_name string"
TARGET = "mix_name string, source string, target_weight double, max_repeats int"


def test_flight_keeps_both_totals():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        sizes, p = rng.integers(1, 3000, 500).astype(float), rng.random(500)
        out = M.flight(sizes, p, rng, land=False)
        assert sum((out > 0) & (out < 1)) <= 2
        assert out.sum() == pytest.approx(p.sum(), abs=1e-6)
        assert (out * sizes).sum() == pytest.approx((p * sizes).sum(), rel=1e-9)
        landed = M.flight(sizes, out, rng, land=True)
        assert set(landed) <= {0.0, 1.0} and abs((landed * sizes).sum() - (p * sizes).sum()) <= sizes[(out > 0) & (out < 1)].max(initial=0)
    same = M.flight(np.full(100, 7.0), np.full(100, 0.25), np.random.default_rng(1), land=True)
    assert same.sum() == 25
    assert list(M.flight(np.array([]), np.array([]), np.random.default_rng(1), True)) == []


def test_flight_keeps_probabilities():
    sizes, p = np.array([5.0, 9.0, 2.0, 7.0, 3.0, 8.0]), np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3])
    mean = np.mean([M.flight(sizes, p, np.random.default_rng(s), False) for s in range(4000)], axis=0)
    assert mean == pytest.approx(p, abs=0.04)


def row(source, weight, repeats, tokens):
    return {"source": source, "weight": weight, "repeats": repeats, "tokens": tokens}


def test_quotas():
    assert M.quotas([row("a", 0.5, 1, 100), row("b", 0.5, 3, 20), row("gone", 0.2, 5, 0)], None, 0.0) == pytest.approx({"a": 60, "b": 60, "gone": 0})
    tiny = M.quotas([row("a", 0.99, 1, 990), row("b", 0.01, 1, 1)], None, 0.02)
    assert tiny == pytest.approx({"a": 990, "b": 1})
    assert M.quotas([row("a", 0.5, 1, 100), row("b", 0.5, 2, 20)], 130) == pytest.approx({"a": 90, "b": 40})
    assert M.quotas([row("a", 0.5, 1, 100), row("b", 0.5, 2, 20)], 1000) == pytest.approx({"a": 100, "b": 40})
    assert M.quotas([row("a", 0.99, 1, 990), row("b", 0.01, 1, 1)], None) == pytest.approx({"a": 99, "b": 1})
    assert M.quotas([], None) == {}


def docs(n=900, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = r.choice(["big"] * 6 + ["Mid ", "mid", "small-one", None])
        out.append((i, " ".join(["word"] * r.randint(1, 80)) + f" {i}", source, "c", "c"))
    out += [(2000 + i, "one standard text", r.choice(["big", "mid"]), "c", "c") for i in range(400)]
    return out + [(None, "no number", "big", "c", "c"), (5000, None, "big", "c", "c"), (5001, "", "mid", "c", "c")] + out[:30]


def test_mix(spark):
    data = docs()
    df = spark.createDataFrame(data, DOC)
    targets = spark.createDataFrame([("m", "BIG", 0.5, 1), ("m", "mid", 0.3, 3), ("m", "small one", 0.15, 4), ("m", "absent", 0.05, 2), ("n", "big", 1.0, None)], TARGET)
    mixed, report = M.mix(df, targets, block=64)
    rows, shares = mixed.collect(), {(r["mix_name"], r["source"]): r for r in report.collect()}
    cap = {("m", "big"): 1, ("m", "mid"): 3, ("m", "small_one"): 4, ("n", "big"): 1}
    texts = dict((d[0], d[1]) for d in data)
    seen = Counter()
    for r in rows:
        assert 1 <= r["copies"] <= cap[r["mix_name"], r["source"]]
        seen[r["mix_name"], texts[r["doc_id"]]] += 1
    assert max(seen.values()) == 1  # a text belongs to one document
    for key, weight in {"big": 0.5 / 0.95, "mid": 0.3 / 0.95, "small_one": 0.15 / 0.95}.items():
        assert shares["m", key]["reached_weight"] == pytest.approx(weight, abs=0.01)
        assert abs(shares["m", key]["tokens"] - shares["m", key]["quota_tokens"]) < 200
    assert shares["m", "absent"]["reached_weight"] == 0 and shares["n", "big"]["reached_weight"] == 1
    again = M.mix(df.repartition(5), targets, block=64)[0].collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}
    per = defaultdict(int)
    for r in rows:
        per[r["mix_name"], r["source"]] += r["copies"]
    assert per["m", "big"] == shares["m", "big"]["documents"]


def test_budget_and_empty(spark):
    df = spark.createDataFrame(docs(200), DOC)
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.5, 1)], TARGET)
    report = {r["source"]: r for r in M.mix(df, targets, budget=10**9)[1].collect()}
    assert all(r["tokens"] == r["available_tokens"] for r in report.values())
    mixed, report = M.mix(df.limit(0), targets)
    assert mixed.count() == 0 and {r["tokens"] for r in report.collect()} == {0}
    mixed, report = M.mix(df, targets.limit(0))
    assert mixed.count() == 0 and report.count() == 0
