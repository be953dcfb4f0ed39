"""Mixing sources to target weights (problem 9): cube-method balanced sampling.

Each source of a mix gets a token quota, so each of its texts an expected number of copies. The
whole copies are certain; which texts get one more is drawn by the cube method: inclusion
probabilities move through the null-space of the constraints (tokens, documents) until they
are 0 or 1. The flight runs in blocks of bounded size, in parallel; the up to two undecided
texts of each block fly again with those of other blocks, and what is left of the last block,
two texts a source, lands on the choice nearest to their expected tokens.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.normal import key_text
from framewright.llm.tokens import VOCABULARY, token_count
from framewright.session import stored

BLOCK = 4096
MAX_TARGETS = 100_000  # rows of the targets table that the driver takes
SHORTFALL = 0.0  # weight of the sources that may fall short for the sake of a larger mix; an option, off by default
NEAR = 1e-9


def source_name(c: Column) -> Column:
    """A source whatever its letter case, surrounding blanks, and `-` or blank for `_`."""
    return F.regexp_replace(key_text(c), "[- ]", "_")


def flight(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Cube method for one block: returns p with all but two entries 0 or 1 (all, if `land`: within one text of the tokens).

    Sums of p and of p * sizes stay as they are. Three undecided units always have a direction
    that keeps both sums: the cross product of their sizes with (1, 1, 1).
    """
    p = p.astype(float).tolist()
    n = sizes.astype(float).tolist()
    waiting = [i for i, x in enumerate(p) if NEAR < x < 1 - NEAR]
    waiting = [waiting[i] for i in rng.permutation(len(waiting))]
    draws = iter(rng.random(2 * len(waiting) + 8).tolist())

    def move(active: list[int], along: list[float]) -> list[int]:
        up = down = math.inf
        for i, u in zip(active, along, strict=True):
            if u > 0:
                up, down = min(up, (1 - p[i]) / u), min(down, p[i] / u)
            elif u < 0:
                up, down = min(up, p[i] / -u), min(down, (1 - p[i]) / -u)
        step = up if next(draws) * (up + down) < down else -down
        rest = []
        for i, u in zip(active, along, strict=True):
            x = p[i] + step * u
            p[i] = 0.0 if x <= NEAR else 1.0 if x >= 1 - NEAR else x
            if 0 < p[i] < 1:
                rest.append(i)
        return rest

    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            break
        a, b, c = (n[i] for i in active)
        along = [b - c, c - a, a - b]
        if not any(along):
            along = [1.0, -1.0, 0.0]
        scale = max(map(abs, along))
        active = move(active, [x / scale for x in along])
    if land and active:  # two texts at most: the choice nearest to their tokens, then to their number
        tokens, number = sum(p[i] * n[i] for i in active), sum(p[i] for i in active)
        kept = min(
            product((0.0, 1.0), repeat=len(active)),
            key=lambda c: (abs(sum(x * n[i] for x, i in zip(c, active, strict=True)) - tokens), abs(sum(c) - number), c),
        )
        for x, i in zip(kept, active, strict=True):
            p[i] = x
    return np.array(p)


def quotas(rows: list[dict], budget: float | None, shortfall: float = SHORTFALL) -> dict[str, float]:
    """Tokens per source of one mix.

    rows: source, weight, repeats, tokens (of the texts there are). Without a budget the total
    is the largest at which the present sources that fall short of their weight together have
    at most `shortfall` of it. With one, the shortage of small sources is shared out among the
    others by weight, up to what these can give.
    """
    present = [r for r in rows if r["weight"] > 0 and r["tokens"] * r["repeats"] > 0]
    out = {r["source"]: 0.0 for r in rows}
    if not present:
        return out
    cap = {r["source"]: float(r["tokens"] * r["repeats"]) for r in present}
    weight = {r["source"]: r["weight"] / sum(x["weight"] for x in present) for r in present}
    if budget is None:
        short = 0.0
        for s in sorted(cap, key=lambda s: cap[s] / weight[s]):
            total = cap[s] / weight[s]
            short += weight[s]
            if short > shortfall:
                break
        return out | {s: min(cap[s], weight[s] * total) for s in cap}
    left, open_sources = min(float(budget), sum(cap.values())), set(cap)
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if cap[s] <= weight[s] * level}
        for s in full or open_sources:
            out[s] = cap[s] if full else weight[s] * level
        left -= sum(out[s] for s in full)
        open_sources = open_sources - full if full else set()
    return out


def units(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(mix_name, source, doc_id, tokens): each distinct text once per mix.

    A text that several documents hold, in one source or in several, belongs to the document of
    lowest doc_id among those of the mix. Documents without a doc_id, a text or a source of a mix are left
    out, before any text is tokenized.
    """
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source")).distinct()
    counted = documents.select(
        "doc_id", source_name(F.col("source")).alias("source"), F.md5("text").alias("text_key"), "text"
    ).where("text <> '' AND source IS NOT NULL AND doc_id IS NOT NULL")
    listed = F.broadcast(wanted.select("source").distinct())  # <= MAX_TARGETS
    held = counted.join(listed, "source", "left_semi").select(
        "doc_id", "source", "text_key", token_count(F.col("text"), vocabulary).alias("tokens")
    )
    first = held.join(F.broadcast(wanted), "source").groupBy("mix_name", "text_key").agg(  # <= MAX_TARGETS
        F.min(F.struct("doc_id", "source", "tokens")).alias("d")
    )
    return first.select("mix_name", "d.source", "d.doc_id", "d.tokens").where("tokens > 0")


def _targets(targets: DataFrame) -> list[dict]:
    rows = targets.select(
        "mix_name", source_name(F.col("source")).alias("source"),
        F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r"),
    ).distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} mix targets")
    return [
        {"mix": r["mix_name"], "source": r["source"], "weight": max(0.0, r["w"] or 0.0), "repeats": max(0, 1 if r["r"] is None else r["r"])}
        for r in rows
    ]


def mix(
    documents: DataFrame,
    targets: DataFrame,
    budget: float | None = None,
    seed: int = 9,
    vocabulary: str = VOCABULARY,
    shortfall: float = SHORTFALL,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(the texts of each mix with their copies, the report of shares).

    First: mix_name, source, doc_id, tokens, copies (1 to max_repeats). Second: one row per
    target with target_weight, reached_weight, tokens, documents, available_tokens, quota_tokens.
    A NULL weight is 0, NULL max_repeats is 1; absent sources reach 0.
    """
    spark = documents.sparkSession
    pool = stored(units(documents, targets, vocabulary))
    sums = {
        (r["mix_name"], r["source"]): (r["n"], r["t"])
        for r in pool.groupBy("mix_name", "source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()
    }
    by_mix: dict[str, list[dict]] = defaultdict(list)
    for x in _targets(targets):
        by_mix[x["mix"]].append(x | {"tokens": sums.get((x["mix"], x["source"]), (0, 0))[1]})
    plan, report = [], []
    for name, rows in by_mix.items():
        quota = quotas(rows, budget, shortfall)
        for x in rows:
            n, tokens = sums.get((name, x["source"]), (0, 0))
            copies = min(float(x["repeats"]), quota[x["source"]] / tokens) if tokens else 0.0
            whole = math.floor(copies + NEAR)
            extra = max(0.0, copies - whole)
            plan.append((name, x["source"], whole, extra if extra > NEAR else 0.0, math.ceil(n / block) or 1))
            report.append((name, x["source"], x["weight"], x["repeats"], tokens, quota[x["source"]]))
    planned = spark.createDataFrame(plan, "mix_name string, source string, whole int, p double, blocks int")
    undecided = pool.join(F.broadcast(planned), ["mix_name", "source"]).select(  # <= MAX_TARGETS
        "mix_name", "source", "doc_id", "tokens", "whole", "blocks", "p"
    )

    def fly(land: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id")
            rng = np.random.default_rng([seed, int(land), *pdf["doc_id"].to_numpy()[:2].astype("uint64") % 2**32])
            return pdf.assign(p=flight(pdf["tokens"].to_numpy(), pdf["p"].to_numpy(), rng, land))
        return run

    schema = undecided.schema
    decided: list[DataFrame] = []
    blocks = max([x[4] for x in plan], default=1)
    while True:
        last = blocks == 1
        moved = stored(
            undecided.withColumn("_b", F.pmod(F.xxhash64("doc_id", F.lit(blocks)), F.col("blocks")))
            .groupBy("mix_name", "source", "_b")
            .applyInPandas(_without(fly(last)), schema)
        )
        between = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(moved.where(~between))
        if last:
            break
        # two of each block are left at most
        blocks = math.ceil(2 * blocks / block)
        undecided = moved.where(between).withColumn("blocks", F.ceil(2 * F.col("blocks") / block).cast("int"))
    chosen = decided[0]
    for more in decided[1:]:
        chosen = chosen.unionByName(more)
    mixed = chosen.select(
        "mix_name", "source", "doc_id", "tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies")
    ).where("copies > 0")
    asked = spark.createDataFrame(
        report,
        "mix_name string, source string, target_weight double, max_repeats int, available_tokens long, quota_tokens double",
    )
    got = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents")
    )
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("_all"))
    zero = F.lit(0).cast("long")
    shares = (
        asked.join(got, ["mix_name", "source"], "left")
        .join(whole, "mix_name", "left")
        .select(
            *asked.columns,
            F.coalesce("tokens", zero).alias("tokens"),
            F.coalesce("documents", zero).alias("documents"),
            F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_weight"),
        )
    )
    return mixed, shares


def _without(run):
    """Drops the block column, which the result does not have."""
    return lambda key, pdf: run(key, pdf.drop(columns="_b"))
