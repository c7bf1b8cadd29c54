"""Whole evaluations of wide prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.operators import metrics as M
from quorate.operators.rows import filter_range
from quorate.registry import DEFAULT_REGISTRY, Registry


def find_columns(columns: Sequence[str], indicator: str, prediction_suffix: str = "", truth_suffix: str = "") -> tuple[str, str] | None:
    """(truth, prediction) columns of an indicator under the names in use; None when either is missing."""
    predictions = [f"{indicator}{e}" for e in (prediction_suffix, "_prediction", "_predicted") if e] + [indicator]
    truths = [f"{indicator}{e}" for e in (truth_suffix, "_truth", "_gt") if e] + [f"gt_{indicator}", indicator]
    prediction = next((c for c in predictions if c in columns), None)
    truth = next((c for c in truths if c in columns and c != prediction), None)
    return (truth, prediction) if truth and prediction else None


def evaluate(df: DataFrame, indicators: Sequence[str], id_cols: Sequence[str] = ("row_idx",), prediction: str = "{}_prediction") -> DataFrame:
    """All measures of all indicators in one grouped job."""
    return M.summary(M.pair_counts(M.stack_indicators(df, indicators, id_cols, prediction=prediction)))


def quick_eval(df: DataFrame, indicators: Sequence[str], ranges: Mapping[str, tuple] = {}, members: Mapping[str, Sequence] = {}) -> dict[str, DataFrame]:
    """Filtered rows with their accuracy, the mean of it, and the measures per indicator."""
    kept = M.row_accuracy_wide(filter_range(df, ranges, members), indicators)
    return {
        "rows": kept,
        "mean": kept.agg(F.avg("row_accuracy").alias("mean_accuracy"), F.count("row_accuracy").alias("n_rows")),
        "indicators": evaluate(kept, indicators),
    }


def compare_runs(runs: Mapping[str, DataFrame], indicators: Sequence[str], registry: Registry = DEFAULT_REGISTRY) -> dict[str, DataFrame]:
    """Several runs measured in one job; two-class and many-class indicators in tables of their own.

    The registry's labels decide which table an indicator is in, whatever classes a run happens to show.
    """
    two = F.col("indicator").isin([i for i in indicators if len(registry.labels(i)) == 2])
    long = {n: M.stack_indicators(df, indicators) for n, df in runs.items()}
    keys = ("dataset", "indicator")
    s = M.summary(M.pair_counts(M.stack_datasets(long), keys), keys)
    base = [*keys, "accuracy", "n_samples"]
    return {
        "binary": s.where(two).select(*base, F.col("binary_f1").alias("f1"), F.col("binary_precision").alias("precision"), F.col("binary_recall").alias("recall")),
        "multiclass": s.where(~two).select(*base, F.col("observed_macro_f1").alias("f1_macro"), F.col("weighted_f1").alias("f1_weighted")),
    }


def compare_models(df: DataFrame, first: str, second: str, indicators: Sequence[str], k: int = 100, order: str = "row_idx") -> dict[str, DataFrame]:
    """Agreement and kappa of two models per indicator, and their first k disagreements.

    `first` and `second` are column patterns such as "{}_a" and "{}_b".
    """
    pairs = M.stack_indicators(df, indicators, (order,), truth=first, prediction=second)
    return {"agreement": M.cohens_kappa(M.pair_counts(pairs)), "disagreements": M.first_disagreements(pairs, k, order=order)}


def analysis_tables(df: DataFrame, registry: Registry, indicators: Sequence[str]) -> dict[str, DataFrame]:
    """The tables an analysis export is made of."""
    counts = M.pair_counts(M.stack_indicators(df, indicators))
    return {
        "summary": M.summary(counts),
        "classes": M.class_report(counts),
        "confusion": M.confusion_matrix(counts, registry, indicators),
    }
