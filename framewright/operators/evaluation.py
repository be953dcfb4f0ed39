"""Evaluation of predictions against labels (AGG-12..20, AGG-25, JN-05, JN-10, ORD-06, ORD-13, SET-04)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels that occur in confusion matrices only; metrics by direction.
NO_DOC, ERROR = "NO_DOC", "ERROR"
HIGHER_IS_BETTER = (
    "type_accuracy", "country_accuracy", "side_accuracy", "country_accuracy_macro",
    "negative_rejection_rate", "coverage", "accepted_accuracy",
)
MEANINGS = {
    "type_accuracy": "documents whose type is right",
    "country_accuracy": "documents whose country is right",
    "country_accuracy_macro": "mean of the countries' shares of documents with the right country, each country counting the same",
    "side_accuracy": "documents whose side is right",
    "negative_rejection_rate": "images without a document for which none was found",
    "coverage": "documents that need no review",
    "accepted_accuracy": "of the documents that need no review, those with all three labels right",
    "unknown_rate": "documents whose country is given as unknown",
    "review_rate": "images that need a review",
    "parse_error_rate": "classifier calls whose answer could not be read",
    "model_error_rate": "classifier calls that failed",
}
LOWER_IS_BETTER = ("unknown_rate", "review_rate", "parse_error_rate", "model_error_rate", "latency_mean_ms", "latency_std_ms")


@dataclass(frozen=True)
class SelectionRule:
    """How the winning configuration is chosen."""

    min_negative_rejection_rate: float = 0.95
    max_parse_error_rate: float = 0.02
    primary_metric: str = "country_accuracy_macro"
    tie_breaker: str = "latency_mean_ms"

    def __post_init__(self):
        if self.primary_metric not in HIGHER_IS_BETTER:
            raise ValueError(f"primary_metric must be one of {HIGHER_IS_BETTER}")
        if self.tie_breaker not in LOWER_IS_BETTER:
            raise ValueError(f"tie_breaker must be one of {LOWER_IS_BETTER}")

    def describe(self) -> str:
        return (
            f"negative_rejection_rate >= {self.min_negative_rejection_rate} and parse_error_rate <= "
            f"{self.max_parse_error_rate}, then {self.primary_metric} (highest), then {self.tie_breaker} (lowest)"
        )


def rate(hit: Column, among: Column) -> Column:
    """Share of hits (NULL is no hit) among rows; NULL if there are none."""
    return F.count_if(F.coalesce(hit, F.lit(False)) & among) / F.nullif(F.count_if(among), F.lit(0))


def _same(field: str) -> Column:
    return F.col(f"pred_{field}").eqNullSafe(F.col(f"true_{field}"))


def image_metrics(fact: DataFrame) -> DataFrame:
    """Metrics per (config, repeat) over images.

    fact: config, repeat, true_/pred_ document_type, issuing_country, document_side, needs_review.
    """
    document = F.col("true_document_type") != "none"
    accepted = document & ~F.col("needs_review")
    correct = _same("document_type") & _same("issuing_country") & _same("document_side")
    every = F.lit(True)
    per = fact.groupBy("config", "repeat").agg(
        rate(_same("document_type"), document).alias("type_accuracy"),
        rate(_same("issuing_country"), document).alias("country_accuracy"),
        rate(_same("document_side"), document).alias("side_accuracy"),
        rate(F.col("pred_document_type") == "none", ~document).alias("negative_rejection_rate"),
        rate(~F.col("needs_review"), document).alias("coverage"),
        rate(correct, accepted).alias("accepted_accuracy"),
        rate(F.col("pred_issuing_country") == "unknown", document).alias("unknown_rate"),
        rate(F.col("needs_review"), every).alias("review_rate"),
    )
    return per.join(macro_accuracy(fact), ["config", "repeat"], "left")


def per_country(fact: DataFrame) -> DataFrame:
    """n and accuracies per (config, repeat, true country), documents only."""
    every = F.lit(True)
    return (
        fact.where("true_document_type <> 'none'")
        .groupBy("config", "repeat", F.col("true_issuing_country").alias("country"))
        .agg(
            F.count("*").alias("n"),
            rate(_same("document_type"), every).alias("type_accuracy"),
            rate(_same("issuing_country"), every).alias("country_accuracy"),
            rate(_same("document_side"), every).alias("side_accuracy"),
        )
    )


def country_means(fact: DataFrame) -> DataFrame:
    """n and mean accuracies over the repeats per (config, true country); n is that of the first repeat (AGG-19)."""
    each = per_country(fact)
    first = each.groupBy("config", "country").agg(F.min_by("n", "repeat").alias("n"))
    names = ["type_accuracy", "country_accuracy", "side_accuracy"]
    renamed = each.select("config", "repeat", "country", *names).withColumn("config", F.struct("config", "country")).drop("country")
    means = mean_over_repeats(renamed).select("config.config", "config.country", *names)
    return first.join(means, ["config", "country"])


def macro_accuracy(fact: DataFrame) -> DataFrame:
    """Mean of the countries' accuracies per (config, repeat), in the order of countries."""
    by = per_country(fact).groupBy("config", "repeat").agg(
        F.array_sort(F.collect_list(F.struct("country", "country_accuracy"))).alias("_c")
    )
    total = F.aggregate("_c", F.lit(0.0), lambda acc, x: acc + x["country_accuracy"])
    return by.select("config", "repeat", (total / F.size("_c")).alias("country_accuracy_macro"))


def call_metrics(calls: DataFrame) -> DataFrame:
    """Error rates per (config, repeat) over classifier calls. calls: config, repeat, status."""
    every = F.lit(True)
    return calls.groupBy("config", "repeat").agg(
        rate(F.col("status") == "parse_error", every).alias("parse_error_rate"),
        rate(F.col("status") == "model_error", every).alias("model_error_rate"),
    )


def latency(fact: DataFrame, column: str = "latency_ms") -> DataFrame:
    """Mean and population deviation per config over all images and repeats; NULLs are left out.

    Sums are exact decimals, so results do not depend on the partitioning.
    """
    x = F.col(column).cast("decimal(18,6)")
    sums = fact.where(F.col(column).isNotNull()).groupBy("config").agg(
        F.count("*").alias("n"),
        F.sum(x).cast("double").alias("_s"),
        F.sum((x * x).cast("decimal(38,6)")).cast("double").alias("_q"),
    )
    mean = F.col("_s") / F.col("n")
    spread = F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0))
    return sums.select(
        "config", mean.alias("latency_mean_ms"),
        F.when(F.col("n") > 1, F.sqrt(spread)).otherwise(0.0).alias("latency_std_ms"),
    )


def confusion_counts(fact: DataFrame) -> DataFrame:
    """n per (config, true label, predicted label), over all images and repeats."""
    true = F.when(F.col("true_document_type") == "none", NO_DOC).otherwise(F.col("true_issuing_country"))
    pred = F.when(F.col("pred_document_type") == "none", NO_DOC).otherwise(
        F.coalesce(F.nullif("pred_issuing_country", F.lit("")), F.lit(ERROR))
    )
    return fact.groupBy("config", true.alias("true_label"), pred.alias("pred_label")).agg(F.count("*").alias("n"))


def confusion_axis(counts: DataFrame) -> DataFrame:
    """(config, label, position): true and predicted labels, A to Z, then unknown, NO_DOC, ERROR."""
    labels = counts.select("config", F.col("true_label").alias("label")).union(
        counts.select("config", F.col("pred_label").alias("label"))
    ).distinct()
    last = F.when(F.col("label") == ERROR, 3).when(F.col("label") == NO_DOC, 2).when(F.col("label") == "unknown", 1).otherwise(0)
    order = Window.partitionBy("config").orderBy(last, "label")  # labels of a config: the taxonomy
    return labels.withColumn("position", F.row_number().over(order) - 1)


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """Dense square in long form: n for each pair of labels of the axis, 0 where none was counted."""
    axis = confusion_axis(counts)
    rows = axis.select("config", F.col("label").alias("true_label"), F.col("position").alias("true_position"))
    cols = axis.select("config", F.col("label").alias("pred_label"), F.col("position").alias("pred_position"))
    grid = rows.join(cols, "config")
    return grid.join(counts, ["config", "true_label", "pred_label"], "left").na.fill(0, ["n"])


def confusion_pivot(counts: DataFrame, config: str, labels: list[str]) -> DataFrame:
    """The matrix of one config in wide form, a column per label, rows in the order of `labels`."""
    spark = counts.sparkSession
    own = counts.where(F.col("config") == config)
    wide = own.groupBy("true_label").pivot("pred_label", labels).agg(F.sum("n"))
    order = spark.createDataFrame(list(enumerate(labels)), "position int, true_label string")
    return order.join(wide, "true_label", "left").na.fill(0).orderBy("position").drop("position")


def mean_over_repeats(metrics: DataFrame) -> DataFrame:
    """Mean per config of every metric column, NULLs left out, in the order of repeats."""
    names = [c for c in metrics.columns if c not in ("config", "repeat")]
    lists = metrics.groupBy("config").agg(
        *[F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("repeat", F.col(c).alias("v"))))).alias(c) for c in names]
    )
    mean = lambda c: F.when(
        F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x["v"]) / F.size(c)
    )
    return lists.select("config", *[mean(F.col(c)).alias(c) for c in names])


def select_winner(summaries: DataFrame, rule: SelectionRule = SelectionRule(), order: str = "position") -> DataFrame:
    """Adds eligible and winner to one row per config.

    A NULL gate metric passes; of the eligible the highest primary metric (NULL = -1) wins, then
    the lowest tie breaker (NULL last), then the first by `order`.
    """
    passes = F.coalesce(F.col("negative_rejection_rate") >= rule.min_negative_rejection_rate, F.lit(True)) & F.coalesce(
        F.col("parse_error_rate") <= rule.max_parse_error_rate, F.lit(True)
    )
    ranked = Window.partitionBy("eligible").orderBy(  # one row per config
        F.desc(F.coalesce(rule.primary_metric, F.lit(-1.0))),
        F.coalesce(rule.tie_breaker, F.lit(float("inf"))),
        order,
    )
    judged = summaries.withColumn("eligible", passes)
    return judged.withColumn("winner", F.col("eligible") & (F.row_number().over(ranked) == 1))


def selection_notes(judged: list[dict], rule: SelectionRule) -> dict[str, str]:
    """Per config: WINNER, or what its gate metrics fall short of, or `passes` (one row per config, as select_winner gives)."""
    out = {}
    for row in judged:
        found = []
        for metric, bound, below in (
            ("negative_rejection_rate", rule.min_negative_rejection_rate, True), ("parse_error_rate", rule.max_parse_error_rate, False),
        ):
            x = row[metric]
            if x is not None and (x < bound if below else x > bound):
                found.append(f"{metric} {x:.3f} {'<' if below else '>'} {bound}")
        out[row["config"]] = "WINNER" if row["winner"] else "; ".join(found) or "passes"
    return out


def dataset_info(fact: DataFrame) -> DataFrame:
    """One row of the last config's last repeat: images, documents, negatives, fetch_failed.

    fact has position (order of configs) and reasons besides the columns of `image_metrics`.
    """
    last = fact.agg(F.max(F.struct("position", "repeat")).alias("_l")).select("_l.position", "_l.repeat")
    document = F.col("true_document_type") != "none"
    return fact.join(last, ["position", "repeat"], "left_semi").agg(
        F.count("*").alias("images"),
        F.count_if(document).alias("documents"),
        F.count_if(~document).alias("negatives"),
        F.count_if(F.array_contains("reasons", "fetch_failed")).alias("fetch_failed"),
    )
