import random
from collections import defaultdict

import pytest

from framewright.llm import packing as P
from framewright.llm import tokens as T

DOC = "doc_id long, text string, slot string, tokens string"


def test_histogram_plan():
    r = random.Random(2)
    for capacity in (1, 7, 64, 512):
        histogram = defaultdict(int)
        for _ in range(800):
            histogram[min(capacity, max(1, int(r.lognormvariate(3, 1))))] += 1
        patterns = P.pack_histogram(dict(histogram), capacity)
        used = defaultdict(int)
        for lengths, packs in patterns:
            assert packs > 0 and sum(lengths) <= capacity and list(lengths) == sorted(lengths, reverse=True)
            for x in lengths:
                used[x] += packs
        assert dict(used) == dict(histogram)
        total = sum(k * n for k, n in histogram.items())
        big = sum(n for k, n in histogram.items() if 2 * k > capacity)
        assert sum(n for _, n in patterns) <= 1.25 * max(-(-total // capacity), big) + 1
    assert P.pack_histogram({}, 5) == []
    # the shortest pack gets the item: 6 | 4 -> 3 goes to the pack of 4
    assert P.pack_histogram({6: 1, 5: 1, 3: 1}, 10) == [((6,), 1), ((5, 3), 1)]
    with pytest.raises(ValueError):
        P.pack_histogram({9: 1}, 8)


def test_containers_hold_every_token_once(spark):
    r = random.Random(4)
    word = lambda: r.choice(["page", "carte", "صورة", "kapı", "Größe", "x", "42", "machine-readable"])
    docs = [(i, " ".join(word() for _ in range(r.randint(1, 60))), "c", "c") for i in range(150)]
    docs += [(200 + i, "the same standard text", "c", "c") for i in range(80)]  # one length holds a third
    docs += [(2**62 + 1, "a page", "c", "c"), (300, None, "c", "c"), (301, "", "c", "c"), (302, "word " * 5000, "c", "c")] + docs[:10]
    df = spark.createDataFrame(docs, DOC)
    sizes = spark.createDataFrame([("s", 32), ("m", 100), ("s", 32), ("bad", 0), ("null", None)], "size_name string, capacity_tokens int")
    encode = T.encoding(T.VOCABULARY).encode_ordinary
    n = {i: len(encode(t)) for i, t, _, _ in docs if t}
    rows = P.containers(df, sizes).collect()
    for name, capacity in (("s", 32), ("m", 100)):
        own = [x for x in rows if x["size_name"] == name]
        fill, pieces = defaultdict(int), defaultdict(list)
        for x in own:
            fill[x["container_id"]] += x["tokens"]
            pieces[x["doc_id"]].append((x["start"], x["tokens"]))
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert len({(x["container_id"], x["slot"]) for x in own}) == len(own)
        assert set(pieces) == set(n)
        for doc, parts in pieces.items():
            at = 0
            for start, count in sorted(parts):
                assert start == at
                at += count
            assert at == n[doc]
            assert len(parts) == -(-n[doc] // capacity)  # only texts over the capacity are cut
        # placing into the emptiest pack, longest first, is within 5/4 of the best
        lengths = [x["tokens"] for x in own]
        least = max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))
        assert len(fill) <= 1.25 * least + 1
    report = {x["size_name"]: x for x in P.fill_report(P.containers(df, sizes), sizes).collect()}
    assert report["s"]["tokens"] == sum(n.values()) and report["s"]["fill"] <= 1
    assert P.containers(df.limit(0), sizes).count() == 0
    assert P.containers(df, sizes.limit(0)).count() == 0
