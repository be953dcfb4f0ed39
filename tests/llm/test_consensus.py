import random

from framewright.llm import consensus as C

ROW = "id int, region_id string, model_name string, document_type string, issuing_country string, status string, created_at timestamp_ntz, label string"
KINDS, COUNTRIES = ["national_id", "passport", "residence_permit", "driving_license"], ["TN", "MA", "DZ", "EG", "FR"]
SKILL = {"good-a": 0.95, "good-b": 0.9, "fair": 0.7, "poor-a": 0.35, "poor-b": 0.3}


def rows(n, seed=1):
    r = random.Random(seed)
    import datetime as dt

    out, truth, k = [], {}, 0
    for i in range(n):
        kind, country = r.choices(KINDS, [6, 2, 1, 1])[0], r.choices(COUNTRIES, [5, 3, 2, 1, 1])[0]
        truth[f"r{i}"] = (kind, country)
        copied = None
        for model, skill in [*SKILL.items(), ("copy-of-poor", None)]:
            if r.random() < 0.25:
                continue
            a = kind if r.random() < (skill or 0) else r.choice(KINDS)
            b = country if r.random() < (skill or 0) else r.choice(COUNTRIES)
            if model == "poor-b":
                copied = (a, b)
            if skill is None:
                if copied is None:
                    continue
                a, b = copied
            k += 1
            out.append((k, r.choice([f"R{i}", f" r{i}"]), model, r.choice([a, a.upper(), a.replace("_", "-") + "\t"]), r.choice([b, b.lower()]), r.choice(["ok", "OK"]), dt.datetime(2026, 1, 1) + dt.timedelta(minutes=k), "x"))
    return out, truth


def test_recovers_truth_and_reliability(spark):
    data, truth = rows(1500)
    labels, models = C.consensus(C.answers(spark.createDataFrame(data, ROW)))
    got = {r["region_id"]: (r["document_type"], r["issuing_country"]) for r in labels.collect()}
    right = sum(got[k] == truth[k] for k in got) / len(got)
    votes = {}
    for x in data:
        votes.setdefault(x[1].strip().lower(), []).append((x[3].strip().lower().replace("-", "_"), x[4].upper()))
    plain = sum(tuple(max(sorted({v[f] for v in vs}), key=[v[f] for v in vs].count) for f in (0, 1)) == truth[k] for k, vs in votes.items()) / len(votes)
    assert right > 0.85 and right > plain
    rel = {(r["field"], r["model_name"]): r for r in models.collect()}
    for f in C.FIELDS:
        order = sorted(SKILL, key=lambda m: rel[f, m]["reliability"])
        assert set(order[-2:]) == {"good-a", "good-b"} and order[-3] == "fair"
        assert rel[f, "poor-b"]["copies_of"] == rel[f, "copy-of-poor"]["copies_of"] == "copy-of-poor"
        assert rel[f, "fair"]["copies_of"] is None


def test_latest_answer_nulls_and_failures(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2026, 1, 1, h)
    data = [
        (1, "r1", "m", "passport", "TN", "ok", t(1), ""), (2, "R1 ", "m", "national_id", "unknown", "ok", t(2), ""),
        (2, "R1 ", "m", "national_id", "unknown", "ok", t(2), ""), (3, "r1", "router", "other", "FR", "ok", t(3), ""),
        (4, "r1", "n", None, None, "parse_error", t(3), ""), (5, None, "n", "passport", "TN", "ok", t(3), ""),
        (6, "r2", "n", None, None, "ok", t(3), ""), (7, "r3", "n", "strange", "EGY", "ok", t(3), ""), (8, "r4", None, "passport", "TN", "ok", t(1), ""),
        (9, "r5", "m", "passport", "TN", "ok", t(1), ""), (10, "r5", "n", "passport", None, "ok", t(1), ""),
    ]
    given = C.answers(spark.createDataFrame(data, ROW))
    assert {tuple(r) for r in given.where("region_id = 'r1'").collect()} == {("r1", "m", "national_id", None)}
    labels = {r["region_id"]: r for r in C.consensus(given)[0].collect()}
    assert labels["r1"]["document_type"] == "national_id" and labels["r1"]["issuing_country"] is None
    assert not labels["r5"]["disputed"] and set(labels) == {"r1", "r5"}
    assert C.consensus(given.limit(0))[0].count() == 0


def test_models_that_answer_a_third_of_the_regions(spark):
    import datetime as dt

    r, out = random.Random(3), []
    skill = {f"m{i:02}": s for i, s in enumerate([0.9, 0.9, 0.88, 0.85, 0.7, 0.65, 0.6, 0.55, 0.5, 0.3, 0.2, 0.15])}
    for i in range(6000):
        kind, country = r.choices(KINDS, [6, 2, 1, 1])[0], r.choices(COUNTRIES, [5, 3, 2, 1, 1])[0]
        for model, s in skill.items():
            if r.random() < 0.33:
                a = kind if r.random() < s else r.choices(KINDS, [6, 2, 1, 1])[0]
                b = country if r.random() < s else r.choices(COUNTRIES, [5, 3, 2, 1, 1])[0]
                out.append((len(out), f"r{i}", model, a, b, "ok", dt.datetime(2026, 1, 1), "x"))
    models = C.consensus(C.answers(spark.createDataFrame(out, ROW)))[1].collect()
    assert len(models) == 2 * len(skill)
    for m in models:
        assert abs(m["reliability"] - skill[m["model_name"]]) < 0.1 and m["copies_of"] is None, m
