"""Filling fixed-capacity containers with items (problem 8): shortest-pack-first over the
length histogram.

The plan is made on the histogram alone: lengths are placed longest first, each time into the
packing pattern with the most room (the shortest pack), by moving counts between patterns.
Its size follows the capacity, not the number of documents. Documents then find their pack by
their rank among the documents of their length.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.tokens import VOCABULARY, token_count
from framewright.operators.ranks import bucketed_row_number, hash_bucket
from framewright.session import stored

MAX_CAPACITY = 1_000_000  # histogram entries that the driver takes per capacity


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and how many packs have each.

    histogram: number of items per length from 1 to capacity.
    """
    open_packs: list[tuple[int, int, tuple[int, ...], int]] = []  # a heap by room, largest first
    order = 0
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError("a length outside 1..capacity")
        left = histogram[length]
        while left > 0 and open_packs and -open_packs[0][0] >= length:
            room, _, pattern, packs = heapq.heappop(open_packs)
            used = min(packs, left)
            left -= used
            order += 1
            heapq.heappush(open_packs, (room + length, order, (*pattern, length), used))
            if used < packs:
                order += 1
                heapq.heappush(open_packs, (room, order, pattern, packs - used))
        # nothing has room: a new pack is the shortest one until it is full of this length
        copies = capacity // length
        for each, packs in ((copies, left // copies), (left % copies, 1)):
            if each > 0 and packs > 0:
                order += 1
                heapq.heappush(open_packs, (each * length - capacity, order, (length,) * each, packs))
    counts: dict[tuple[int, ...], int] = defaultdict(int)
    for _, _, pattern, packs in open_packs:
        counts[pattern] += packs
    return sorted(counts.items(), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks per length: length, first rank, first pack, slot in the pack.

    The documents of a length with ranks first..first + packs - 1 go to consecutive packs.
    """
    used: dict[int, int] = defaultdict(int)
    rows, pack = [], 0
    for pattern, packs in patterns:
        for slot, length in enumerate(pattern):
            rows.append((length, used[length], pack, slot))
            used[length] += packs
        pack += packs
    rows.sort()
    return dict(zip(("length", "rank", "pack", "slot"), np.array(rows, dtype="int64").reshape(-1, 4).T, strict=True))


def items(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(size_name, capacity, doc_id, piece, start, tokens): what is to be packed.

    A text within the capacity is one piece; a longer one is cut into full pieces and a rest.
    Repeated rows count once; two texts of one doc_id are both packed. NULL and empty texts
    have no tokens and are left out, as are sizes without a positive capacity.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    lengths = stored(
        texts.select("doc_id", "text_id", token_count(F.col("text"), vocabulary).alias("n"))
        .where("n > 0")
        .distinct()
    )
    wanted = sizes.select(
        "size_name", F.col("capacity_tokens").cast("long").alias("capacity")
    ).where("capacity > 0").distinct()
    # container_sizes has a fixed, small number of rows: read by the driver, not joined
    rows = [(r["size_name"], r["capacity"]) for r in wanted.limit(1001).collect()]
    if len(rows) > 1000:
        raise ValueError("more than 1000 container sizes")
    if not rows:
        rows, lengths = [("", 1)], lengths.limit(0)
    each = lengths.withColumn(
        "size",
        F.explode(F.array(*[F.struct(F.lit(s).alias("size_name"), F.lit(c).cast("long").alias("capacity")) for s, c in rows])),
    )
    cut = each.select(
        "size.size_name", "size.capacity", "doc_id", "text_id", "n",
        F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("size.capacity"))).alias("piece", "start"),
    )
    return cut.select(
        "size_name", "capacity", "doc_id", "text_id", "piece", "start",
        F.least("capacity", F.col("n") - F.col("start")).alias("tokens"),
    )


def containers(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(size_name, container_id, slot, doc_id, piece, start, tokens): the filled containers.

    container_id counts from 0 within a size; the tokens of a container are at most its capacity.
    """
    spark = documents.sparkSession
    pieces = stored(items(documents, sizes, vocabulary))
    histogram = pieces.groupBy("size_name", "capacity", "tokens").agg(F.count("*").alias("n"))
    by_size: dict[tuple, dict[int, int]] = defaultdict(dict)
    for r in histogram.collect():  # at most `capacity` rows per size
        if r["capacity"] > MAX_CAPACITY:
            raise ValueError(f"a capacity above {MAX_CAPACITY}")
        by_size[r["size_name"], r["capacity"]][r["tokens"]] = r["n"]
    plans = {k: places(pack_histogram(h, k[1])) for k, h in by_size.items()}
    sent = spark.sparkContext.broadcast(plans)  # bounded by the capacities

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rank, capacity = (batch.column(c).to_numpy() for c in ("tokens", "rank", "capacity"))
            name = batch.column("size_name").dictionary_encode()
            code = name.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            pack, slot = np.zeros(len(tokens), "int64"), np.zeros(len(tokens), "int64")
            for k, c in set(zip(code.tolist(), capacity.tolist(), strict=True)):
                own = (code == k) & (capacity == c)
                plan = sent.value[None if k < 0 else name.dictionary[k].as_py(), c]
                # one sorted key of (length, rank) finds the interval of each document
                span = int(max(plan["rank"].max(), rank[own].max())) + 1
                keys = plan["length"] * span + plan["rank"]
                at = np.searchsorted(keys, tokens[own] * span + rank[own], side="right") - 1
                pack[own] = plan["pack"][at] + rank[own] - plan["rank"][at]
                slot[own] = plan["slot"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("size_name"), pa.array(pack), pa.array(slot), *(batch.column(c) for c in ("doc_id", "piece", "start", "tokens"))],
                names=["size_name", "container_id", "slot", "doc_id", "piece", "start", "tokens"],
            )

    ordered = pieces.withColumn("_order", F.xxhash64("doc_id", "text_id", "piece"))
    ranked = bucketed_row_number(
        ordered, ["size_name", "capacity", "tokens"], ["_order", "doc_id", "text_id", "piece"],
        hash_bucket(F.col("_order")), "rank",
    )
    return ranked.select(
        "size_name", "capacity", "doc_id", "piece", "start", "tokens", "rank"
    ).mapInArrow(
        place,
        "size_name string, container_id long, slot long, doc_id long, piece int, start long, tokens long",
    )


def fill_report(filled: DataFrame, sizes: DataFrame) -> DataFrame:
    """Containers, tokens and share of used space per size."""
    per = filled.groupBy("size_name").agg(
        (F.max("container_id") + 1).alias("containers"), F.sum("tokens").alias("tokens")
    )
    return per.join(sizes.select("size_name", "capacity_tokens").distinct(), "size_name").withColumn(
        "fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    )
