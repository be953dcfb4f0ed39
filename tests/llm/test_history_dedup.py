import random

import pytest

from framewright.llm import history_dedup as H
from framewright.sources.storage import WriteConflict

IMAGE = "id int, batch_no int, fetch_status string, image_hash string, perceptual_hash string, print_id string"


def brute(rows):
    norm = lambda h: None if h is None or not h.strip() else h.strip().lower().removeprefix("sha256:").removeprefix("0x")
    bits = lambda p: None if norm(p) in (None, "not hex") else int(norm(p), 16)
    ok = [(i, b, norm(h), bits(p)) for i, b, s, h, p, _ in rows if s and s.strip().lower() == "ok" and b is not None]
    out = set()
    for i, b, h, p in ok:
        for _, b2, h2, p2 in ok:
            if b2 < b and ((h and h == h2) or (p is not None and p2 is not None and (p ^ p2).bit_count() <= 10)):
                out.add(i)
                break
    return out


def data(n=500, seed=3, family=0.3):
    """A picture of which re-saved variants fill a third of all rows, among others."""
    r = random.Random(seed)
    base = [r.getrandbits(256) for _ in range(60)]
    rows = []
    for i in range(n):
        x = base[0] if r.random() < family else r.choice(base)
        for _ in range(r.choice([0, 1, 3, 6, 8, 12])):
            x ^= 1 << r.randrange(256)
        text = r.choice([f"{x:x}", f" 0x{x:064X} ", f"{x:064x}", None])
        sha = r.choice([f"{r.randrange(200):064x}", None])
        rows.append((i, r.randint(1, 9), r.choice(["ok", "OK ", "failed"]), sha and r.choice([sha, f"SHA256:{sha.upper()}"]), text, "clash"))
    flat = [(1 << 255) | (r.getrandbits(40) << 20) for _ in range(80)]  # flat pictures: most segments equal
    rows += [(n + k, r.randint(1, 9), "ok", None, f"{x:064x}", "c") for k, x in enumerate(flat)]
    rows += [(9000, 5, "ok", "  ", "not hex", "c"), (9001, None, "ok", "a", None, "c"), (9002, 9, "ok", "a", None, "c"), (9003, 9, None, "a", None, "c")]
    return rows + rows[:20]


@pytest.fixture(autouse=True)
def two_waves(monkeypatch):
    monkeypatch.setattr(H, "WAVES", 2)


def found(df, path, **options):
    return {r["id"] for r in H.seen_before(df, str(path), **options).collect()}


def test_against_brute_force(spark, tmp_path):
    rows = data()
    df = spark.createDataFrame(rows, IMAGE)
    assert found(df, tmp_path / "a") == brute(rows)
    assert found(df.limit(0), tmp_path / "b") == set()


def test_hot_buckets_are_cut_without_loss(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "HOT", 4)  # the size of the blocks of what is still large at the end
    rows = data(300, 8)
    df = spark.createDataFrame(rows, IMAGE)
    assert found(df, tmp_path, hot=4, leader=2) == brute(rows)


def test_loads_one_by_one(spark, tmp_path):
    rows = [(r[0], (r[1] + 2) // 3, *r[2:]) for r in data(260, 5) if r[1] is not None]  # three loads
    index = H.SegmentIndex(spark, str(tmp_path / "index"))
    got = set()
    for batch in sorted({r[1] for r in rows}):
        load = spark.createDataFrame([r for r in rows if r[1] == batch], IMAGE)
        told = {r["id"] for r in index.probe(load).collect()}
        assert {r["id"] for r in index.accept(load).collect()} == told
        got |= told
    assert got == brute(rows)


def test_a_large_side_is_not_broadcast(spark, tmp_path, monkeypatch):
    rows = data(200, 6)
    monkeypatch.setattr(H, "SMALL", 10)
    assert found(spark.createDataFrame(rows, IMAGE), tmp_path) == brute(rows)


def test_only_the_loads_buckets_are_compared(spark, tmp_path, monkeypatch):
    rows = [r for r in data(200, 5) if r[1] is not None]
    index = H.SegmentIndex(spark, str(tmp_path / "index"))
    index.append(spark.createDataFrame(rows[3:], IMAGE))
    load = spark.createDataFrame(rows[:3], IMAGE)
    seen, probe = [], H.probe
    monkeypatch.setattr(H, "probe", lambda fresh, known, *a: seen.append((fresh, known)) or probe(fresh, known, *a))
    index.probe(load).collect()
    fresh, known = ({r["bucket"] for r in x.collect()} for x in seen[0])
    assert known <= fresh


def test_a_load_is_added_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    rows = [r for r in data(120, 4) if r[1] is not None]
    old, new = (spark.createDataFrame([r for r in rows if (r[1] > 5) == late], IMAGE) for late in (False, True))
    index = H.SegmentIndex(spark, str(tmp_path / "index"))
    index.append(old)
    want = {r["id"] for r in index.probe(new).collect()}

    def lost(name, df, write=H.SegmentIndex._write):
        if name == "prints":
            raise OSError("lost")
        return write(index, name, df)

    monkeypatch.setattr(index, "_write", lost)
    with pytest.raises(OSError):
        index.accept(new)
    monkeypatch.undo()
    assert {r["id"] for r in index.accept(new).collect()} == want  # nothing of the lost attempt counts
    assert {r["id"] for r in index.probe(new).collect()} == {r[0] for r in rows if r[1] > 5 and (r[2] or "").strip().lower() == "ok" and (r[3] or r[4])}
    version, parts = index.versions._manifest("index")
    assert version == 2 and len(parts) == 6
    with pytest.raises(WriteConflict):  # a second writer that began from version 1
        index.versions._commit("index", 1, parts)


def test_waves_double_the_index():
    counts = {b: 10 for b in range(1, 41)}
    got = H.waves(counts, 4)
    assert got == [(1, 5), (6, 10), (11, 20), (21, 40)]
    assert H.waves({}, 4) == [] and H.waves({7: 3}, 4) == [(7, 7)]
    assert H.waves({1: 1, 2: 1, 3: 100}, 4) == [(1, 3)]
