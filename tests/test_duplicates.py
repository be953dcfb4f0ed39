import random

from pyspark.sql import functions as F

from framewright.functions.bits import gradient_words, with_words
from framewright.operators import duplicates as D
from framewright.operators import segments as G
from framewright.operators.components import connected_components

UPLOAD = "folder string, transaction_id long, image_id string, path string, sha string, p string"


def hexes(n):
    return f"{n:064x}"


def uploads(spark, rows):
    return with_words(spark.createDataFrame(rows, UPLOAD), "p").drop("p")


def some(spark):
    a, b = 3 << 200, random.Random(1).getrandbits(256)
    return uploads(spark, [
        ("x", 1, "f", "x/1", "s1", hexes(a)), ("x", 2, "f", "x/2", "s1", hexes(a)), ("x", 3, "f", "x/3", "s2", hexes(a ^ 7)),
        ("x", 4, "b", "x/4", "s3", hexes(b)), ("y", 5, "b", "y/5", "s3", hexes(b)), ("y", 6, "f", "y/6", "s4", hexes(~b & (2**256 - 1))),
        ("x", 7, "f", "x/7", None, None),
    ])


def test_reports(spark):
    up = some(spark)
    files = D.distinct_files(up)
    groups = D.file_groups(files)
    folders = spark.createDataFrame([("x",), ("y",), ("empty",)], "folder string")
    assert {tuple(r) for r in D.folder_summary(up, groups, folders).collect()} == {("x", 5, 3, 2, 1), ("y", 2, 2, 2, 0), ("empty", 0, 0, 0, 0)}
    rows = {r["image_hash"]: r.asDict() for r in D.group_rows(up, groups, D.group_spread(files, groups)).collect()}
    assert rows["s1"] == {"image_hash": "s1", "copies": 3, "kind": "near", "max_distance": 3, "folders": "x", "cross_folder": False, "uploads": "x/1_f x/2_f x/3_f"}
    assert rows["s3"]["kind"] == "exact" and rows["s3"]["cross_folder"] and rows["s3"]["folders"] == "x y"
    histogram = {r["distance"]: tuple(r)[1:] for r in D.distance_histogram(files, 2).collect()}
    assert sum(sum(x) for x in histogram.values()) == 6 and histogram[3] == (1, 0) and histogram[256] == (0, 1)


def test_near_pairs_against_brute_force(spark):
    r = random.Random(5)
    base = [r.getrandbits(256) for _ in range(40)]
    looks = []
    for i in range(400):
        x = r.choice(base)
        for _ in range(r.randint(0, 12)):
            x ^= 1 << r.randrange(256)
        looks.append((f"s{i:03}", x))
    files = D.distinct_files(uploads(spark, [("x", i, "f", s, s, hexes(p)) for i, (s, p) in enumerate(looks)]))
    want = {(a, b, (x ^ y).bit_count()) for i, (a, x) in enumerate(looks) for b, y in looks[i + 1 :] if (x ^ y).bit_count() <= 10 and x != y}
    same = {(a, b, 0) for i, (a, x) in enumerate(looks) for b, y in looks[i + 1 :] if x == y}
    got = [tuple(z) for z in D.near_pairs(files).collect()]
    assert len(got) == len(set(got)) and set(got) == want | same
    assert {tuple(z) for z in D.block_pairs(files, 10, False, 130).collect()} == want | same
    whole = {tuple(z) for z in connected_components(spark.createDataFrame(sorted(want | same), "a string, b string, d int")).collect()}
    for leader, block in ((32, 1000), (3, 7)):  # small bounds, so that every bucket is led and cut
        looks_, members = D.looks_of(files)
        tied = G.links(looks_, 10, leader, block).unionByName(members.where("sha <> id").select(F.col("id").alias("a"), F.col("sha").alias("b")))
        assert {tuple(z) for z in connected_components(tied).collect()} == whole
        ids = dict(tuple(r)[::-1] for r in members.collect())
        assert {tuple(z) for z in G.all_pairs(looks_, 10, block).collect()} == {z for z in want if ids[z[0]] == z[0] and ids[z[1]] == z[1]}


def test_the_review_distance_drops_no_pair(spark):
    r = random.Random(11)
    x = r.getrandbits(256)
    rows = [("x", i, "f", str(i), f"s{i:02}", hexes(x ^ (r.choice([0, 1, 7, 1023]) << r.randrange(240)))) for i in range(60)]
    files = D.distinct_files(uploads(spark, rows))
    at = lambda d: {tuple(z) for z in D.close_pairs(files, d).where("distance <= 10").collect()}
    bits = [int(row[5], 16) for row in rows]
    want = sum((p ^ q).bit_count() <= 10 for i, p in enumerate(bits) for q in bits[i + 1 :])
    assert at(10) == at(15) == at(16) == at(40) and len(at(10)) == want


def test_greedy_sample(spark):
    a = 1 << 255
    rows = [("x", i, "f", str(i), f"s{i}", hexes(a ^ (1 << i) if i < 5 else (1 << (20 + i)) * 0xFFFFFF)) for i in range(12)]
    up = uploads(spark, rows).withColumn("o", F.col("transaction_id"))
    got = [r["sha"] for r in D.greedy_distinct_sample(up, 3, "o").orderBy("taken").collect()]
    want, kept = [], []
    for row in rows:
        p = int(row[5], 16)
        if len(want) < 3 and all((p ^ q).bit_count() > 10 for q in kept):
            want.append(row[4]), kept.append(p)
    assert got == want
    assert D.greedy_distinct_sample(up, 0, "o").count() == 0


def test_components_against_union_find(spark):
    r = random.Random(7)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 700)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x["vertex"]: x["root"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gradient_bits(spark):
    r = random.Random(2)
    grid = [[r.randint(0, 255) for _ in range(17)] for _ in range(16)]
    want = int("".join("1" if row[i] > row[i + 1] else "0" for row in grid for i in range(16)), 2)
    df = spark.createDataFrame([([x for row in grid for x in row],)], "g array<int>")
    words = df.select(*gradient_words(F.col("g"))).first()
    assert sum((w % 2**64) << (64 * (3 - i)) for i, w in enumerate(words)) == want


def test_a_copy_without_a_fingerprint_hides_nothing(spark):
    a = 3 << 200
    up = uploads(spark, [("x", 1, "f", "x/1", "s1", None), ("x", 2, "f", "x/2", "s1", hexes(a)), ("x", 3, "f", "x/3", "s2", hexes(a ^ 7)), ("x", 4, "f", "x/4", "s3", None)])
    files = D.distinct_files(up)
    assert {(r["sha"], r["w0"] is None) for r in files.collect()} == {("s1", False), ("s2", False), ("s3", True)}
    assert [tuple(r) for r in D.near_pairs(files).collect()] == [("s1", "s2", 3)]
    taken = D.greedy_distinct_sample(up.withColumn("o", F.col("transaction_id")), 5, "o")
    assert {r["sha"] for r in taken.collect()} == {"s1", "s3"}


def _shuffled(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_blocks_meet_without_shuffling_their_copies(spark):
    r = random.Random(5)
    rows = [(f"{i:04}", ("f" if i % 3 else "g", i), *[r.getrandbits(64) - 2**63 for _ in range(4)]) for i in range(400)]
    files = spark.createDataFrame(rows, "sha string, first struct<folder:string,n:int>, w0 long, w1 long, w2 long, w3 long").cache()
    want = sorted((a[0], b[0], d) for k, a in enumerate(rows) for b in rows[k + 1 :] if (d := sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a[2:], b[2:]))) <= 100)
    before = _shuffled(spark)
    assert sorted(map(tuple, D.block_pairs(files, 100, False, 10).collect())) == want and want
    assert _shuffled(spark) - before < 10 * len(rows)  # of 40 blocks; once per block would be 40 * len(rows)
    assert sum(n for x in D.distance_histogram(files, 10).collect() for n in x[1:]) == 400 * 399 // 2
