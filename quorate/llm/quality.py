"""Quality classifier: regularised quadratic discriminant over statistics of whole texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import stage
from quorate.llm.stats import COUNTS, SHARES, describe

# Share of the pooled covariance in each class covariance, and of the pooled variances added to its diagonal.
SHRINK, RIDGE = 0.2, 0.1

# Shares pile up near 0; their logarithm above a small floor is closer to a bell shape.
FLOOR = 0.005
LOG_SHARES = ("symbol_share", "upper_share", "mark_share", "bang_share", "dup_line_share", "repeat_share", "marked_words", "long_words",
              "top_word_share", "stops_share", "digit_share", "echo_share")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


FEATURES = (*LOG_SHARES, "length", "distinct", "mean_word", "line_words")


def transform(stats: pd.DataFrame) -> np.ndarray:
    """Transformed statistics that the discriminant works on, a row per text, all finite for any text."""
    out = [np.log(stats[c].to_numpy(float) + FLOOR) for c in LOG_SHARES]
    length = np.log(stats["n_words"].to_numpy(float) + 1.0)
    # A long text repeats more of its words; the slope takes most of that out.
    distinct = np.log(stats["distinct_share"].to_numpy(float) + FLOOR) + 0.1 * length
    more = [length, distinct, np.log(stats["mean_word"].to_numpy(float) + 1.0), np.log(stats["words_per_line"].to_numpy(float) + 1.0)]
    return np.stack([*out, *more], axis=1)


def text_features(text: Column) -> Column:
    """Array of FEATURES of a whole text; null counts as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(transform(pd.DataFrame([describe(t) for t in texts], columns=[*COUNTS, *SHARES]))), dtype=object)

    return F.pandas_udf(run, "array<double>")(text)


def known_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, label) with one label in {0, 1} per id; ids with contradicting labels teach nothing."""
    one = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id"))
    return one.agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").select("doc_id", F.col("label").cast("int"))


@dataclass(frozen=True)
class ClassModel:
    log_weight: float  # log prior minus half the log determinant
    mean: np.ndarray
    whiten: np.ndarray  # inverse of the Cholesky factor of the class covariance

    def log_density(self, x: np.ndarray) -> np.ndarray:
        away = (x - self.mean) @ self.whiten.T
        return self.log_weight - 0.5 * (away * away).sum(axis=1)


@dataclass(frozen=True)
class Discriminant:
    """Two class models, or none where the labels hold fewer than two classes; then every score is `constant`."""

    classes: tuple[ClassModel, ClassModel] | None
    constant: float

    def score(self, x: Column) -> Column:
        """Score in 0..1 of a feature array; 0.5 where both classes are equally likely.

        The log density difference is divided by the number of features before the logistic function. This keeps the
        order and the boundary, and far rows stay distinguishable.
        """
        classes = self.classes
        if classes is None:
            return F.lit(self.constant)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                if len(rows):
                    data = np.stack(rows.to_list())
                    margin = (classes[1].log_density(data) - classes[0].log_density(data)) / data.shape[1]
                    yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(margin, -600, 600))))
                else:
                    yield pd.Series([], dtype=float)

        return F.pandas_udf(run, "double")(x)


def fit(rows: DataFrame, d: int = len(FEATURES), shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """Fit on all rows (label, x) by one aggregation: counts, sums and cross products per class, combined before the
    shuffle. The driver gets two rows of d * d numbers and factors them once."""
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = rows.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    found = {r["label"]: r for r in rows.collect()}
    counts = [found[k]["n"] if k in found else 0 for k in (0, 1)]
    if min(counts) < 2:
        return Discriminant(None, (counts[1] + 1) / (sum(counts) + 2))
    means, scatters = [], []
    for k in (0, 1):
        r = found[k]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        cross = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                cross[i, j] = cross[j, i] = r[f"p{i}_{j}"]
        means.append(mean)
        scatters.append(cross - r["n"] * np.outer(mean, mean))
    pooled = (scatters[0] + scatters[1]) / sum(counts)
    ridge_part = np.diag(ridge * np.maximum(np.diag(pooled), 1e-6))
    models = []
    for k in (0, 1):
        cov = (1 - shrink) * scatters[k] / counts[k] + shrink * pooled + ridge_part
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        log_det = 2 * float(np.log(np.diag(factor)).sum())
        models.append(ClassModel(math.log(counts[k] / sum(counts)) - log_det / 2, means[k], np.linalg.inv(factor)))
    return Discriminant((models[0], models[1]), 0.5)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted).

    Only statistics of the text enter a score. The discriminant learns from labelled rows that are not held out. Null
    and empty texts have all counts 0 and get the score of that point. Rows with a null id are scored and never learned
    from. Without both classes among the labels the score is the smoothed share of label 1, 0.5 without labels.
    Repeated rows are scored each. An empty table gives no rows. Extra columns are left out.
    """
    rows, model = train(docs, labels, doc_id, text, label)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[DataFrame, Discriminant]:
    """(doc_id, x) of all documents, as a written table, and the discriminant learned from those with a label."""
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), text_features(F.col(text)).alias("x")), "features")
    return rows, fit(rows.where(~held_out(F.col("doc_id"))).join(known_labels(labels, doc_id, label), "doc_id"))


def keep_accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents with their columns whose score is 0.5 or more; see `classify`.

    The score is computed again on the row itself, which costs a second pass over the texts and spares a shuffle of them.
    """
    _, model = train(docs, labels, doc_id, text, label)
    return docs.where(model.score(text_features(F.col(text))) >= 0.5)
