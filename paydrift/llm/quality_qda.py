"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are built-in column expressions. Class means and covariances come from one aggregation of
sums and products over all labelled rows; the driver sees one small row per class. Covariances are
shrunk towards their diagonal and the pooled covariance, their inverse Cholesky factors are computed
once and the Mahalanobis log-density difference is a column expression over the cached factors.

Nulls and empty texts count as the empty text and get the score of its statistics. Repeated labels of
one document: the largest counts; null labels and labels of unknown documents are ignored. Without a
label of one class the score is the smoothed share of label 1. Extra columns pass through ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import table, work_table

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
THRESHOLD = 0.3
#: Added to lengths before shares are taken, so that a short text says little.
SMOOTH_CHARS, SMOOTH_PARTS = 60.0, 20.0


def statistics(text: Column) -> dict[str, Column]:
    """Document statistics on scales where a Gaussian is a fair model; all finite for every text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t) + F.lit(SMOOTH_CHARS)

    def share(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))) / n

    parts = F.split(t, "[ \\n]")
    kinds = (F.size(F.array_distinct(parts)) + F.lit(SMOOTH_PARTS)) / (F.size(parts) + F.lit(SMOOTH_PARTS))
    return {
        "f_length": F.log1p(n),
        "f_symbols": F.sqrt(share(SYMBOLS)),
        "f_shout": F.sqrt(share("!")),
        "f_upper": F.sqrt(share(UPPER)),
        "f_digits": F.sqrt(share(DIGITS)),
        "f_stops": F.sqrt(share(".,")),
        "f_lines": F.sqrt(share("\n")),
        "f_spaces": F.sqrt(share(" \t")),
        "f_kinds": kinds,
        "f_kinds_long": kinds * F.log1p(n),
    }


FEATURES = ["f_length", "f_symbols", "f_shout", "f_upper", "f_digits", "f_stops", "f_lines", "f_spaces", "f_kinds", "f_kinds_long"]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumns(statistics(F.col(text)))


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the shrunk covariance, log of prior over volume."""

    features: tuple[str, ...]
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    offsets: tuple[float, ...]
    prior: float


def fit(rows: DataFrame, label: str = "label", features: list[str] | None = None, to_diagonal: float = 0.05, to_pooled: float = 0.05, floor: float = 1e-4) -> Discriminant:
    """Class moments by one aggregation over all labelled rows (label 0 or 1; others are ignored)."""
    names = tuple(features or FEATURES)
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(names)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]
    got = {r[label]: r for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    counts = [got[c]["n"] if c in got else 0 for c in (0, 1)]
    prior = (counts[1] + 1) / (sum(counts) + 2)
    if min(counts) < 2:
        return Discriminant(names, (), (), (), prior)
    means, covs = [], []
    for c in (0, 1):
        mean = np.array([got[c][f"s{i}"] for i in range(k)]) / counts[c]
        second = np.zeros((k, k))
        for i, j in pairs:
            second[i, j] = second[j, i] = got[c][f"p{i}_{j}"] / counts[c]
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
    pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / sum(counts)
    factors, offsets = [], []
    for c in (0, 1):
        shrunk = (1 - to_diagonal - to_pooled) * covs[c] + to_diagonal * np.diag(np.diag(covs[c])) + to_pooled * pooled
        chol = np.linalg.cholesky(shrunk + floor * np.eye(k))
        factors.append(np.linalg.inv(chol))
        offsets.append(float(np.log(prior if c else 1 - prior) - np.log(np.diag(chol)).sum()))
    return Discriminant(names, tuple(means), tuple(factors), tuple(offsets), prior)


def odds(x: Column, model: Discriminant) -> Column:
    """Probability of label 1 from the difference of the two log densities at an array of the model's statistics."""
    if not model.means:
        return F.lit(float(model.prior))

    def density(c: int) -> Column:
        centred = [F.get(x, i) - F.lit(float(m)) for i, m in enumerate(model.means[c])]
        total = F.lit(0.0)
        for i, line in enumerate(model.factors[c]):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + F.lit(float(line[j])) * centred[j]
            total = total + z * z
        return F.lit(model.offsets[c]) - F.lit(0.5) * total

    gap = F.least(F.greatest(density(0) - density(1), F.lit(-700.0)), F.lit(700.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(gap))


def score(rows: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """Adds the probability from columns of the model's statistics."""
    return rows.withColumn(name, F.element_at(F.transform(F.array(F.array(*map(F.col, model.features))), lambda x: odds(x, model)), 1))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def labels_of(labels: DataFrame, value: str = "quality") -> DataFrame:
    return labels.where(F.col(value).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(value).alias("label"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, with all their columns, scored where they are read."""
    rows = with_statistics(docs.select("doc_id", "text")).drop("text").where(F.coalesce(fold(F.col("doc_id")) != 0, F.lit(False)))
    model = fit(rows.join(labels_of(labels), "doc_id"))
    found = statistics(F.col("text"))
    # the last statistic is a product of two others; in an array of expressions its costly factor would be worked out again
    own = F.array(*[found[x] for x in FEATURES[:-1]])
    every = F.transform(F.array(own), lambda x: F.concat(x, F.array(F.get(x, FEATURES.index("f_kinds")) * F.get(x, FEATURES.index("f_length")))))
    return docs.where(F.element_at(F.transform(every, lambda x: odds(x, model)), 1) >= THRESHOLD)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels of held-out rows are not learned from."""
    rows = with_statistics(docs.select("doc_id", "text")).drop("text")
    rows = work_table(rows.withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))), "statistics")
    model = fit(rows.where(~F.col("held_out")).join(labels_of(labels), "doc_id"))
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
