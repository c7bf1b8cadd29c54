"""Evaluation against truth and between raters.

Everything is derived from one grouped count of (truth, prediction) pairs, which is combined before its shuffle
and has at most labels x labels rows per group; the metrics themselves are then small jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.values import to_label
from quorate.registry import Registry, local_frame

KEYS = ("indicator",)
BIG = "decimal(38,0)"


def stack_indicators(
    df: DataFrame,
    indicators: Sequence[str],
    id_cols: Sequence[str] = ("row_idx",),
    truth: str = "{}",
    prediction: str = "{}_prediction",
) -> DataFrame:
    """Wide truth and prediction columns to long (ids, indicator, truth, prediction), in one pass."""
    missing = [c for i in indicators for c in (truth.format(i), prediction.format(i)) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("indicator"),
                to_label(F.col(truth.format(i))).alias("truth"),
                to_label(F.col(prediction.format(i))).alias("prediction"),
            )
            for i in indicators
        ]
    )
    return df.select(*id_cols, F.inline(rows))


def join_truth(predictions: DataFrame, truth: DataFrame, keys: Sequence[str] = ("row_idx", "indicator")) -> DataFrame:
    """Attach a separate truth table by key."""
    return predictions.join(truth, list(keys), "left")


def pair_counts(pairs: DataFrame, keys: Sequence[str] = KEYS, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """(keys, truth, prediction, n) over the pairs where both sides are known."""
    known = pairs.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    return known.groupBy(*keys, F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(counts: DataFrame, registry: Registry, indicators: Sequence[str], key: str = "indicator") -> DataFrame:
    """All cells of labels x labels, zeros included; pairs outside the label set are left out.

    The empty grid comes from the registry (bounded) and is added to the counts, so no join is needed.
    """
    cells = [(i, t, p, 0) for i in indicators for t in registry.labels(i) for p in registry.labels(i)]
    kinds = {key: pa.string(), "truth": pa.string(), "prediction": pa.string(), "n": pa.int64()}
    grid = local_frame(counts.sparkSession, kinds, cells)
    labels = registry.subset([i for i in indicators if i in registry]).labels_of(F.col(key))
    inside = counts.where(
        F.col(key).isin(*indicators)
        & F.array_contains(labels, F.col("truth"))
        & F.array_contains(labels, F.col("prediction"))
    )
    return inside.unionByName(grid).groupBy(key, "truth", "prediction").agg(F.sum("n").alias("n"))


def class_counts(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per class: hits, support (in truth), predicted."""
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    return (
        counts.select(*keys, F.inline(sides))
        .groupBy(*keys, "label")
        .agg(F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))


def class_report(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    c = class_counts(counts, keys)
    return c.select(
        *keys,
        "label",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        # 2PR/(P+R) with the counts put in.
        _ratio(F.lit(2) * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "predicted",
        "hits",
    )


def accuracy(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return counts.groupBy(*keys).agg(
        _ratio(
            F.coalesce(F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n"))), F.lit(0)), F.sum("n")
        ).alias("accuracy"),
        F.sum("n").alias("n_samples"),
    )


def summary(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy and all averages in one job.

    Two macro averages are offered by name: `macro_*` over classes with support, `observed_macro_f1` over all
    classes seen on either side. `binary_*` holds for exactly two classes, the last label being the positive one.
    """
    r = class_report(counts, keys)
    seen = F.col("support") > 0
    n = F.sum("support")
    binary = F.count(F.lit(1)) == 2
    return r.groupBy(*keys).agg(
        _ratio(F.sum("hits"), n).alias("accuracy"),
        F.avg(F.when(seen, F.col("precision"))).alias("macro_precision"),
        F.avg(F.when(seen, F.col("recall"))).alias("macro_recall"),
        F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
        F.avg("f1").alias("observed_macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        F.when(binary, F.max_by("f1", "label")).alias("binary_f1"),
        F.when(binary, F.max_by("precision", "label")).alias("binary_precision"),
        F.when(binary, F.max_by("recall", "label")).alias("binary_recall"),
        F.count(F.lit(1)).alias("n_classes"),
        n.alias("n_samples"),
    )


def cohens_kappa(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Agreement of two raters and kappa; where chance agreement is 1, kappa is 1 or 0.

    Chance agreement stays a ratio of whole numbers until the last division.
    """
    c = class_counts(counts, keys).groupBy(*keys).agg(
        F.sum("hits").alias("hits"),
        F.sum("support").alias("n"),
        F.sum(F.col("support").cast("decimal(19,0)") * F.col("predicted").cast("decimal(19,0)")).cast(BIG).alias("chance"),
    )
    n = F.col("n")
    square = (n.cast("decimal(19,0)") * n.cast("decimal(19,0)")).cast(BIG)
    observed = F.col("hits").cast("double") / n
    expected = F.col("chance").cast("double") / square.cast("double")
    kappa = F.when(
        F.col("chance") == square, F.when(F.col("hits") == n, F.lit(1.0)).otherwise(F.lit(0.0))
    ).otherwise((observed - expected) / (F.lit(1.0) - expected))
    return c.select(*keys, observed.alias("agreement"), kappa.alias("kappa"), n.alias("n_samples"))


def first_disagreements(
    pairs: DataFrame, k: int = 100, keys: Sequence[str] = KEYS, order: str = "row_idx", a: str = "truth", b: str = "prediction"
) -> DataFrame:
    """First k differing rows per group. Spark ranks inside each task before the shuffle (row_number <= k)."""
    differing = pairs.where(~F.col(a).eqNullSafe(F.col(b)))
    ranked = differing.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where(F.col("rank") <= k)


def disagreeing_rows(df: DataFrame, columns: Sequence[str], at_least: int = 2) -> DataFrame:
    """Rows whose rater columns hold at least k distinct labels; missing values do not count."""
    labels = F.array(*[F.when(~F.col(c).isin("nan", "None", ""), F.col(c)) for c in columns])
    distinct = F.size(F.array_distinct(F.array_compact(labels)))
    return df.withColumn("n_unique_predictions", distinct).where(F.col("n_unique_predictions") >= at_least)


def row_accuracy(pairs: DataFrame, id_cols: Sequence[str] = ("row_idx",)) -> DataFrame:
    """Correct, total and accuracy of each row over its indicators; no comparable pair gives null."""
    known = F.col("truth").isNotNull() & F.col("prediction").isNotNull()
    right = known & (F.col("truth") == F.col("prediction"))
    return (
        pairs.groupBy(*id_cols)
        .agg(F.count_if(right).alias("correct"), F.count_if(known).alias("total"))
        .withColumn("row_accuracy", F.col("correct").cast("double") / F.nullif(F.col("total"), F.lit(0)))
    )


def row_accuracy_wide(df: DataFrame, indicators: Sequence[str], truth: str = "{}", prediction: str = "{}_prediction") -> DataFrame:
    """The same on a wide table: no shuffle at all."""
    pairs = [(to_label(F.col(truth.format(i))), to_label(F.col(prediction.format(i)))) for i in indicators]
    correct, total = F.lit(0), F.lit(0)
    for t, p in pairs:
        correct = correct + F.coalesce((t == p).cast("int"), F.lit(0))
        total = total + (t.isNotNull() & p.isNotNull()).cast("int")
    return (
        df.withColumn("correct", correct)
        .withColumn("total", total)
        .withColumn("row_accuracy", F.col("correct").cast("double") / F.nullif(F.col("total"), F.lit(0)))
    )


def stack_datasets(datasets: dict[str, DataFrame]) -> DataFrame:
    """One table with a `dataset` column, so that several runs are measured in one grouped job."""
    frames = [df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def label_distribution(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "prediction") -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
