import random

from framewright.llm import components as C


def union_find(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {v: root(v) for v in list(parent)}


def got(spark, links, kind="long"):
    df = spark.createDataFrame(links, f"a {kind}, b {kind}, root string, u int").drop("x")
    return {r["vertex"]: r["root"] for r in C.connected_components(df).collect()}


def check(spark, links, kind="long"):
    assert got(spark, [(*x, "clash", 1) for x in links], kind) == union_find(links)


def test_shapes(spark):
    check(spark, [])
    check(spark, [(1, 1), (2, None), (None, None)])
    check(spark, [(i, i + 1) for i in range(200)])  # a chain
    check(spark, [(i + 1, i) for i in range(0, 50)] * 3)
    check(spark, [(1000, i) for i in range(300)])  # a hub that is no minimum
    check(spark, [(0, i) for i in range(1, 300)])
    r = random.Random(4)
    chain = list(range(150))
    r.shuffle(chain)
    check(spark, list(zip(chain, chain[1:], strict=False)))


def test_random(spark):
    r = random.Random(9)
    check(spark, [(r.randint(0, 400), r.randint(0, 400)) for _ in range(350)])
    check(spark, [(f"é{r.randint(0, 90)}", f"z{r.randint(0, 90)}") for _ in range(60)], "string")


def test_shared_ids_and_the_fallback(spark, monkeypatch):
    links = [(r, r + 1) for r in range(0, 60, 2)] + [(3, 4), (8, 9), (59, 1)]
    monkeypatch.setattr(C, "SEEDS", ())  # as if every seed had given two vertices one id
    check(spark, links)
    check(spark, [])


def test_ordered_chain_keeps_few_links(spark, monkeypatch):
    sizes = []
    stored = C.stored
    monkeypatch.setattr(C, "stored", lambda df: (out := stored(df), sizes.append(out.count()))[0])
    check(spark, [(i, i + 1) for i in range(600)])
    assert max(sizes) < 600 * 5


def test_upload_links(spark):
    pairs = spark.createDataFrame(
        [(3, False, " f\\1_a ", "f/2_a"), (11, True, "f/2_a", "f/9_a"), (None, True, "f/2_a", "f/8_a"), (0, None, "f/2_a", "f/2_a"), (1, True, None, "f/7_a")],
        "distance int, duplicate boolean, upload_a string, upload_b string",
    )
    groups = spark.createDataFrame(
        [(" ABC", "f/2_a  f/3_b"), ("abc", "f/4_c\tf/5_c"), (None, "f/6_a f/7_a"), ("d", ""), ("e", None)], "image_hash string, uploads string"
    )
    rows = C.connected_components(C.upload_links(pairs, groups)).collect()
    assert {r["vertex"]: r["root"] for r in rows} == {f"f/{x}": "f/1_a" for x in ("1_a", "2_a", "3_b", "4_c", "5_c")}
    empty = C.upload_links(pairs.limit(0), groups.limit(0))
    assert C.connected_components(empty).count() == 0
