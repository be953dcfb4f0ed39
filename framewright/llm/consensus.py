"""Consensus from several annotators' labels (problem 3): spectral reliability.

Annotators are the models of `predictions`. For every pair of models that answered the same
regions the share of equal labels, less what their label frequencies give by chance, fills a
sparse agreement matrix. Under one reliability per model that matrix has rank one; the leading
eigenvector of the matrix, weighted and normalised by the overlap counts and found by power iteration over
sparse joins, gives the reliabilities. They weight the votes for each label.

Copies of one model agree far beyond their reliabilities. Such pairs are found as residuals
of a first fit, left out of the second, and vote once together for a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from framewright.functions.normal import document_type, issuing_country, key_text
from framewright.llm.components import connected_components
from framewright.session import stored

FIELDS = ("document_type", "issuing_country")
COPY_EXCESS = 0.35  # of the possible agreement beyond the fitted one
CERTAIN = 2.0  # standard errors of an agreement by which it must exceed that
TOLERANCE = 5e-4  # change of an entry of the eigenvector at which the iteration has converged
COARSE = 1e-2  # the same for the first fit, which only has to tell copies from others
UNROLLED = 2  # rounds of one plan
MAX_ROUNDS = 200  # an iteration that has not converged by then raises
PACK = 100_000  # rows of the small matrices and vectors per partition


def answers(predictions: DataFrame) -> DataFrame:
    """(region_id, model_name, document_type, issuing_country): the counting answers.

    Status `ok`, a region, another model than `router`; the latest answer of a model to a
    region counts, of equal times the one with the larger id. NULL, `unknown` countries and
    labels outside the taxonomy are no answers. Answers without a model name are left out.
    """
    rows = predictions.select(
        key_text(F.col("region_id")).alias("region_id"),
        F.btrim("model_name").alias("model_name"),
        F.struct(
            "created_at", "id",
            document_type(F.col("document_type")).alias("t"),
            issuing_country(F.col("issuing_country")).alias("c"),
        ).alias("said"),
    ).where(
        (key_text(F.col("status")) == "ok")
        & (F.lower("model_name") != "router")
        & F.col("region_id").isNotNull()
    )
    last = rows.groupBy("region_id", "model_name").agg(F.max("said").alias("said"))
    return last.select(
        "region_id", "model_name",
        F.col("said.t").alias("document_type"),
        F.nullif(F.col("said.c"), F.lit("unknown")).alias("issuing_country"),
    ).where("document_type IS NOT NULL OR issuing_country IS NOT NULL")


def by_region(given: DataFrame) -> DataFrame:
    """(region_id, said): the answers of a region in one array, at most one per model."""
    return given.groupBy("region_id").agg(
        F.array_sort(
            F.collect_list(F.struct("model_name", *FIELDS))
        ).alias("said")
    )


def agreement(regions: DataFrame) -> DataFrame:
    """(field, a, b, n, equal): overlap and equal labels of model pairs a <> b, both ways.

    Pairs are of models inside one region and are summed before any shuffle.
    """
    pairs = regions.select(F.explode("said").alias("x"), "said").select(
        "x", F.explode(F.filter("said", lambda y: y["model_name"] > F.col("x.model_name"))).alias("y")
    )
    sums = pairs.groupBy(F.col("x.model_name").alias("a"), F.col("y.model_name").alias("b")).agg(
        *[F.count(F.when(F.col(f"x.{f}").isNotNull() & F.col(f"y.{f}").isNotNull(), 1)).alias(f"n_{f}") for f in FIELDS],
        *[F.count(F.when(F.col(f"x.{f}") == F.col(f"y.{f}"), 1)).alias(f"e_{f}") for f in FIELDS],
    )
    half = sums.select(
        "a", "b",
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n"), F.col(f"e_{f}").alias("equal"))
            for f in FIELDS
        ])).alias("s"),
    ).select("s.field", "a", "b", "s.n", "s.equal").where("n > 0")
    return half.unionByName(
        half.select("field", F.col("b").alias("a"), F.col("a").alias("b"), "n", "equal")
    )


def label_counts(regions: DataFrame) -> DataFrame:
    """(field, model_name, label, n, p): how often each model gives each label."""
    said = regions.select(F.explode("said").alias("x")).select(
        F.col("x.model_name").alias("model_name"),
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").alias("label")) for f in FIELDS
        ])).alias("s"),
    )
    counts = (
        said.where("s.label IS NOT NULL")
        .groupBy("s.field", "model_name", "s.label")
        .agg(F.count("*").alias("n"))
    )
    whole = counts.groupBy("field", "model_name").agg(F.sum("n").alias("of"))
    return counts.join(whole, ["field", "model_name"]).select(
        "field", "model_name", "label", "n", (F.col("n") / F.col("of")).alias("p")
    )


def centred(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(field, a, b, n, x): agreement less chance; the sparse matrix."""
    one = labels.select("field", F.col("model_name").alias("a"), "label", F.col("p").alias("pa"))
    two = labels.select("field", F.col("model_name").alias("b"), "label", F.col("p").alias("pb"))
    keys = pairs.select("field", "a", "b")
    chance = (
        keys.join(one, ["field", "a"])
        .join(two, ["field", "b", "label"])
        .groupBy("field", "a", "b")
        .agg(F.sum(F.col("pa") * F.col("pb")).alias("chance"))
    )
    return pairs.join(chance, ["field", "a", "b"], "left").select(
        "field", "a", "b", "n",
        (F.col("equal") / F.col("n") - F.coalesce("chance", F.lit(0.0))).alias("x"),
    )


def packed(df: DataFrame) -> DataFrame:
    """Cut from its lineage, in as many partitions as its rows ask for.

    Tables of models and labels mostly fit in one; joins and sums over single partitions need no shuffle, so
    a round is one task. The plan is the same at any size, only the number of partitions follows the rows.
    """
    held = stored(df)
    return held.coalesce(-(-held.count() // PACK) or 1)


def _multiplied(matrix: DataFrame, state: DataFrame, parts: int) -> DataFrame:
    """One round of the power iteration: field, a, v and its change.

    The rows a = b of the matrix bring a model's own entry along, so a round is one join and one sum. Every side
    lies in packed partitions; where that is one, the round needs no shuffle.
    """
    other = state.select("field", F.col("a").alias("b"), F.col("v").alias("_v"))
    sums = matrix.join(other.hint("shuffle_hash"), ["field", "b"]).groupBy("field", "a").agg(
        F.max(F.when(F.col("a") == F.col("b"), F.col("_v"))).alias("_own"),
        F.sum(F.col("n") * F.col("x") * F.col("_v")).alias("_p"), F.sum(F.col("n") * F.col("_v") * F.col("_v")).alias("_d"),
    ).coalesce(parts)
    v = F.least(F.greatest((F.col("_own") + F.col("_p") / F.col("_d")) / 2, F.lit(0.001)), F.lit(1.0))
    return sums.select("field", "a", v.alias("v"), F.abs(v - F.col("_own")).alias("change"))


def leading(matrix: DataFrame, tolerance: float = TOLERANCE, start: DataFrame | None = None) -> DataFrame:
    """(field, a, v) with v_a * v_b near x of each pair, from the leading eigenvector of the agreement matrix.

    matrix: field, a, b, n, x for a <> b, both ways, n > 0. With d_a = sum of n_ab * v_b² over the partners b,
    sqrt(d) * v is the leading eigenvector of the matrix n_ab * x_ab / sqrt(d_a * d_b), of eigenvalue 1: where x_ab is
    v_a * v_b it is so whatever the overlaps n are. The agreement of a model with itself nobody measured: its
    place on the diagonal has the weight of all partners together and the present fit, d_a * v_a², so that it can't pull v
    anywhere. A round multiplies v by the matrix so completed. Rounds end when no entry changes by more than
    `tolerance`; they begin at `start` (a result for another matrix) if there is one.
    """
    own = matrix.select("field", "a").distinct().select("field", "a", F.col("a").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("x"))
    whole = packed(matrix.select("field", "a", "b", "n", "x").unionByName(own))
    begun = whole.where("a = b").select("field", "a", F.lit(0.5).alias("v"), F.lit(1.0).alias("change"))
    if start is not None:
        known = start.select("field", "a", F.col("v").alias("_v"))
        begun = begun.join(known, ["field", "a"], "left").select("field", "a", F.coalesce("_v", "v").alias("v"), "change")
    state = packed(begun)
    parts = state.rdd.getNumPartitions()
    for _ in range(MAX_ROUNDS // UNROLLED):
        for _ in range(UNROLLED):
            state = _multiplied(whole, state, parts)
        seen = Observation()  # read while the round is written
        state = stored(state.observe(seen, F.max("change").alias("change"))).coalesce(parts)
        if (seen.get["change"] or 0.0) <= tolerance:  # None: no models share a region
            return state.select("field", "a", "v")
    raise RuntimeError(f"the reliabilities did not converge in {MAX_ROUNDS} rounds")


def label_shares(labels: DataFrame, vector: DataFrame) -> DataFrame:
    """(field, label, share): how frequent labels are, told by the models that agree most."""
    told = labels.join(vector.select("field", F.col("a").alias("model_name"), "v"), ["field", "model_name"], "left")
    sums = told.groupBy("field", "label").agg(
        F.sum(F.col("n") * F.pow(F.coalesce("v", F.lit(0.1)), F.lit(2.0))).alias("s")
    )
    whole = sums.groupBy("field").agg(F.sum("s").alias("of"))
    return sums.join(whole, "field").select("field", "label", (F.col("s") / F.col("of")).alias("share"))


def reliabilities(regions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(field, model_name, reliability, answers), label frequencies, label shares, copies.

    reliability is the probability of knowing the label; else a model guesses by its own label
    frequencies. copies: (model_name, copies_of), for models that are copies of each other.
    """
    labels = packed(label_counts(regions))
    matrix = packed(centred(agreement(regions), labels))
    first = leading(matrix, COARSE)
    fitted = (
        matrix.join(first.select("field", "a", F.col("v").alias("va")), ["field", "a"])
        .join(first.select("field", F.col("a").alias("b"), F.col("v").alias("vb")), ["field", "b"])
        .withColumn("fit", F.col("va") * F.col("vb"))
    )
    spread = label_shares(labels, first).groupBy("field").agg(
        (1 - F.sum(F.col("share") * F.col("share"))).alias("spread")
    )
    # agreement beyond the fit, less its error, against what it could be at most
    sure = F.col("x") - F.col("fit") - CERTAIN * 0.5 / F.sqrt("n")
    copied = stored(
        fitted.join(spread, "field")
        .where(sure > COPY_EXCESS * F.greatest(F.col("spread") - F.col("fit"), F.lit(0.05)))
        .select("a", "b").distinct()
    )
    copies = packed(connected_components(copied).select(F.col("vertex").alias("model_name"), F.col("root").alias("copies_of")))
    # pairs inside a family say nothing about knowing labels, also those that agree less than others
    of = copies.select(F.col("model_name").alias("a"), F.col("copies_of").alias("_fa"))
    to = copies.select(F.col("model_name").alias("b"), F.col("copies_of").alias("_fb"))
    apart = matrix.join(of, "a", "left").join(to, "b", "left").where(~F.coalesce(F.col("_fa") == F.col("_fb"), F.lit(False)))
    second = leading(packed(apart.select(*matrix.columns)), TOLERANCE, first)
    shares = packed(label_shares(labels, second))
    spread = shares.groupBy("field").agg(
        (1 - F.sum(F.col("share") * F.col("share"))).alias("spread")
    )
    told = labels.groupBy("field", "model_name").agg(F.sum("n").alias("answers"))
    rated = (
        told.join(second.select("field", F.col("a").alias("model_name"), "v"), ["field", "model_name"], "left")
        .join(spread, "field")
        .select(
            "field", "model_name", "answers",
            F.least(
                F.greatest(F.coalesce(F.col("v"), F.lit(0.3)) / F.sqrt(F.greatest("spread", F.lit(0.05))), F.lit(0.02)),
                F.lit(0.98),
            ).alias("reliability"),
        )
    )
    return rated, labels, shares, copies


def consensus(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels per region, reliability per model) of `answers`.

    First: region_id, document_type, issuing_country, models, agreement_type,
    agreement_country (share of a field's answers that equal the consensus), disputed (answers
    differ in a field). A field without answers is NULL. Ties go to the smaller label.
    Second: field, model_name, reliability, answers, copies_of (NULL if no copy).
    """
    regions = stored(by_region(given))
    rated, labels, shares, copies = reliabilities(regions)
    # how much a vote of this model for this label speaks for the label
    weights = packed(
        labels.join(rated.select("field", "model_name", "reliability"), ["field", "model_name"])
        .join(copies, "model_name", "left")
        .select(
            "field", "model_name", "label",
            F.coalesce("copies_of", "model_name").alias("voter"),
            F.log(1 + F.col("reliability") / ((1 - F.col("reliability")) * F.col("p"))).alias("weight"),
        )
    )
    votes = regions.select("region_id", F.explode("said").alias("x")).select(
        "region_id",
        F.col("x.model_name").alias("model_name"),
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").alias("label")) for f in FIELDS
        ])).alias("s"),
    ).where("s.label IS NOT NULL").select("region_id", "model_name", "s.field", "s.label")
    if weights.count() <= PACK:  # models x labels; a broadcast keeps the few models from becoming hot join keys
        weights = F.broadcast(weights)
    weighed = votes.join(weights, ["field", "model_name", "label"]).repartition("region_id")
    once = weighed.groupBy("region_id", "field", "label", "voter").agg(
        F.max("weight").alias("weight"), F.count("*").alias("n")
    )
    prior = shares.select("field", "label", F.log("share").alias("prior"))
    summed = once.groupBy("region_id", "field", "label").agg(
        F.sum("weight").alias("weight"), F.sum("n").alias("n")
    )
    scored = summed.join(F.broadcast(prior), ["field", "label"])  # labels of the taxonomy: 6 types, two-letter countries
    best = scored.groupBy("region_id").agg(
        *[
            F.min(F.when(F.col("field") == f, F.struct(
                (-F.col("weight") - F.col("prior")).alias("s"), "label", "n"
            ))).alias(f"_{f}")
            for f in FIELDS
        ],
        *[F.sum(F.when(F.col("field") == f, F.col("n"))).alias(f"n_{f}") for f in FIELDS],
        *[F.count(F.when(F.col("field") == f, 1)).alias(f"d_{f}") for f in FIELDS],
        F.max("n").alias("_n"),
    )
    out = best.select(
        "region_id",
        F.col("_document_type.label").alias("document_type"),
        F.col("_issuing_country.label").alias("issuing_country"),
        F.greatest("n_document_type", "n_issuing_country").alias("answers"),
        (F.col("_document_type.n") / F.col("n_document_type")).alias("agreement_type"),
        (F.col("_issuing_country.n") / F.col("n_issuing_country")).alias("agreement_country"),
        ((F.col("d_document_type") > 1) | (F.col("d_issuing_country") > 1)).alias("disputed"),
    )
    return out, rated.join(copies, "model_name", "left")
