"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

The statistics are Spark expressions. The fit is one aggregation of their sums and cross products per
class over all labelled rows; two small matrices reach the driver, where the class covariances are shrunk
towards their pooled diagonal and factored once (Cholesky). A score is the logistic of half the difference of the
Mahalanobis distances, plus log-determinants and priors, and is again one Spark expression, made from
the cached inverse factors.

Null and empty texts have statistics too (all counts zero) and are scored like any other. If the fit has
rows of one class or none, every score is that class's prior (0.5 without rows). Ties and repeated rows score alike, and each
repeated row with a label teaches; several labels of an id count as the largest. Texts are measured whole, of any length. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import blank_words, remainder
from plumbline.session import stage

FEATURES = ("length", "word_length", "symbols", "capitals", "exclamations", "neighbours", "variety", "line_words")


def statistics(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and one double per FEATURES: counts and ratios on logarithmic scales, so that tails are short."""
    row = df.select(df[id].alias("id"), F.coalesce(df[text], F.lit("")).alias("text"))
    row = row.withColumn("words", blank_words(F.col("text")))
    n = F.size("words").cast("double")

    def count(pattern: str) -> Column:
        return (F.length("text") - F.length(F.regexp_replace("text", pattern, F.lit("")))).cast("double")

    def log_ratio(part: Column, whole: Column) -> Column:
        return F.log((part + 0.5) / (whole + 1.0))

    row = row.select(
        "id",
        n.alias("n"),
        F.length("text").cast("double").alias("chars"),
        count(r"[#*$%&|<>]+").alias("n_symbols"),
        count(r"\p{Lu}+").alias("n_capitals"),
        count("!+").alias("n_exclamations"),
        count("\n").alias("n_breaks"),
        F.size(F.array_distinct("words")).cast("double").alias("n_distinct"),
        F.when(
            F.size("words") > 1,
            F.size(F.filter(F.zip_with(F.expr("slice(words, 2, size(words) - 1)"), "words", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)),
        ).otherwise(0).cast("double").alias("n_neighbours"),
    )
    n, chars = F.col("n"), F.col("chars")
    return row.select(
        "id",
        F.log1p(n).alias("length"),
        F.log((chars + 1.0) / (n + 1.0)).alias("word_length"),
        log_ratio(F.col("n_symbols"), n).alias("symbols"),
        log_ratio(F.col("n_capitals"), chars).alias("capitals"),
        log_ratio(F.col("n_exclamations"), n).alias("exclamations"),
        log_ratio(F.col("n_neighbours"), n).alias("neighbours"),
        (F.log1p("n_distinct") / F.log1p(n + 1.0)).alias("variety"),
        F.log((n + 1.0) / (F.col("n_breaks") + 1.0)).alias("line_words"),
    )


@dataclass(frozen=True)
class Discriminant:
    """Per class 0 and 1: mean, inverse Cholesky factor of the covariance, and log density at the mean."""

    means: tuple[np.ndarray, ...]
    inverses: tuple[np.ndarray, ...]
    heights: tuple[float, ...]
    prior: float


def fit(rows: DataFrame, label: str = "label", features=FEATURES, shrinkage: float = 0.1) -> Discriminant:
    """One aggregation over the labelled rows; a row per class comes back."""
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    known = rows.where(F.col(label).isin(0, 1))
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(features)]
    products = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"p{i}_{j}") for i, j in pairs]
    by = {r[label]: r for r in known.groupBy(label).agg(F.count("*").alias("n"), *sums, *products).collect()}
    total = sum(r["n"] for r in by.values())
    if len(by) < 2:
        return Discriminant((), (), (), 0.5 if not by else float(next(iter(by))))
    means, scatters = [], []
    for c in (0, 1):
        r = by[c]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        scatter = np.empty((d, d))
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
        means.append(mean)
        scatters.append(scatter)
    pooled = np.diag(np.maximum(sum(by[c]["n"] * np.diag(scatters[c]) for c in (0, 1)) / total, 1e-4))
    inverses, heights = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * scatters[c] + shrinkage * pooled + 1e-6 * np.eye(d))
        inverses.append(np.linalg.inv(factor))
        heights.append(float(np.log(by[c]["n"] / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(inverses), tuple(heights), by[1]["n"] / total)


def probability(model: Discriminant, features=FEATURES) -> Column:
    """The score of class 1 as an expression over the features."""
    if not model.means:
        return F.lit(float(model.prior))
    density = []
    for mean, inverse, height in zip(model.means, model.inverses, model.heights):
        z = [sum(((F.col(features[j]) - float(mean[j])) * float(inverse[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(len(features))]
        density.append(F.lit(height) - 0.5 * sum((x * x for x in z), F.lit(0.0)))
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), density[1] - density[0]))))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, cut: float = 0.3) -> DataFrame:
    """``id, held_out, score, predicted`` for every document; rows whose remainder is 0 teach nothing.

    The statistics are computed once, written to the shared folder, and read by the fit and the scoring.
    """
    measured = stage(statistics(docs, id, text), "statistics")
    truth = labels.where(labels[label].isNotNull()).groupBy(labels[id].alias("labelled")).agg(F.max(label).alias("label"))
    training = measured.where(remainder(F.col("id"), folds) != 0).join(truth, F.col("id") == F.col("labelled"))
    score = probability(fit(training))
    scored = measured.select("id", (remainder(F.col("id"), folds) == 0).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
