"""Checks over annotated tables.

Each check is one boolean expression; all checks of an indicator are evaluated in the same pass over the table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.values import is_missing, list_parts, number, truncated

# Older column names still accepted.
LEGACY = {
    "confidence": "confidence_score_gemini",
    "prediction": "constitution_gemini",
    "document_name": "constitution_name_gemini",
    "document_year": "constitution_year_gemini",
    "reasoning": "explanation_gemini",
}
# Names that mean there is no single document.
UNCODIFIED = "(?i)customary|uncodified"


def find_columns(columns: Sequence[str], indicator: str) -> dict[str, str | None]:
    """Columns of an indicator, new names first, then older ones."""
    document = indicator == "constitution"
    wanted = {
        "confidence": [f"{indicator}_confidence", LEGACY["confidence"]],
        "prediction": [f"{indicator}_prediction"] + ([LEGACY["prediction"]] if document else []),
        "reasoning": [f"{indicator}_reasoning", LEGACY["reasoning"]],
        "document_name": ["constitution_document_name", LEGACY["document_name"]] if document else [],
        "document_year": ["constitution_year", LEGACY["document_year"]] if document else [],
        "document_types": ["constitution_document_types"] if document else [],
    }
    return {role: next((n for n in names if n in columns), None) for role, names in wanted.items()}


def checks(
    columns: Sequence[str],
    indicator: str,
    min_confidence: float | None = None,
    min_reasoning_length: int | None = None,
    uncodified: bool = False,
    consistency: bool = True,
    found: Mapping[str, str | None] | None = None,
) -> dict[str, Column]:
    """Name -> failed? for the checks that apply to the columns at hand."""
    cols = dict(found or find_columns(columns, indicator))
    col = {role: F.col(name) for role, name in cols.items() if name}
    out: dict[str, Column] = {}
    if "confidence" in col:
        c = col["confidence"].try_cast("double")
        out["confidence_missing"] = c.isNull()
        out["confidence_negative"] = c == -1
        if min_confidence is not None:
            out["confidence_low"] = (c >= 0) & (c < min_confidence)
    if "prediction" in col:
        out["prediction_missing"] = col["prediction"].isNull()
    if min_reasoning_length is not None and "reasoning" in col:
        out["reasoning_short"] = F.length(F.coalesce(col["reasoning"], F.lit(""))) < min_reasoning_length
    if indicator == "constitution":
        name, year, types = (col.get(r) for r in ("document_name", "document_year", "document_types"))
        if uncodified and name is not None:
            out["document_uncodified"] = F.coalesce(name, F.lit("")).rlike(UNCODIFIED)
        if consistency and "prediction" in col:
            label = number(col["prediction"].cast("string"))
            documented = label.isin(1, 2)
            if name is not None:
                out["document_name_missing"] = documented & is_missing(name)
            if year is not None:
                out["document_year_missing"] = documented & is_missing(year)
            if name is not None and year is not None and types is not None:
                n = F.size(list_parts(name))
                out["document_lists_differ"] = documented & (
                    (n != F.size(list_parts(year))) | (n != F.size(list_parts(types)))
                )
            if types is not None:
                codes = F.transform(list_parts(types), lambda p: truncated(p))
                readable = (F.size(codes) > 0) & F.forall(codes, lambda x: x.isNotNull())
                out["document_type_mismatch"] = documented & readable & (F.array_max(codes) != label)
    return out


def flag_rows(
    df: DataFrame,
    indicator: str,
    custom: Mapping[str, Callable[[DataFrame], Column]] | None = None,
    into: str = "failed_checks",
    **options,
) -> DataFrame:
    """Add the names of the failed checks; user conditions are functions from the frame to a boolean column."""
    found = checks(df.columns, indicator, **options)
    for name, make in (custom or {}).items():
        found[name] = make(df)
    if not found:
        return df.withColumn(into, F.array().cast("array<string>"))
    names = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in found.items()]
    return df.withColumn(into, F.array_compact(F.array(*names)))


def failed_rows(df: DataFrame, indicator: str, custom=None, **options) -> DataFrame:
    """Rows where any check failed, with the names of the checks."""
    return flag_rows(df, indicator, custom, **options).where(F.size("failed_checks") > 0)


def failures(df: DataFrame, indicators: Sequence[str], row: str = "row_idx", **options) -> DataFrame:
    """(row, indicator, failed_checks) over several indicators in one pass."""
    lists = []
    for i in indicators:
        own = checks(df.columns, i, **options)
        names = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in own.items()]
        failed = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
        lists.append(F.struct(F.lit(i).alias("indicator"), failed.alias("failed_checks")))
    return df.select(row, F.inline(F.array(*lists))).where(F.size("failed_checks") > 0)


def failures_by_indicator(failed: DataFrame, row: str = "row_idx") -> DataFrame:
    """Failed rows per indicator (one row per indicator and table row, so a count is enough)."""
    return failed.groupBy("indicator").agg(F.count(F.lit(1)).alias("n_failed"))


def failed_row_ids(failed: DataFrame, row: str = "row_idx") -> DataFrame:
    return failed.select(row).distinct()


def null_predictions(answers: DataFrame, row: str = "row_idx", requests: DataFrame | None = None) -> DataFrame:
    """Rows where a requested indicator ended without a label (long table of final labels).

    Without `requests` only answer rows that exist are seen. With them (an array column `indicators` next to the row, as
    `requests.prompts` and `expand_samples` make it) each (row, indicator) asked for counts as null if it has no answer
    row, by sample where both tables have `sc_idx`; answers to what was not asked for do not count.
    """
    if requests is None:
        return answers.groupBy(row).agg(F.count_if(F.col("prediction").isNull()).alias("n_null")).where(F.col("n_null") > 0)
    keys = [row, "indicator", *(["sc_idx"] if "sc_idx" in requests.columns and "sc_idx" in answers.columns else [])]
    asked = requests.select("*", F.explode("indicators").alias("_asked")).drop("indicator").withColumnRenamed("_asked", "indicator")
    # One aggregation in place of a join: null keys meet, and repeated requests count once.
    both = asked.select(*keys, F.lit(True).alias("asked"), F.lit(0).alias("n"), F.lit(0).alias("null")).unionByName(
        answers.select(*keys, F.lit(False).alias("asked"), F.lit(1).alias("n"), F.col("prediction").isNull().cast("int").alias("null"))
    )
    slots = both.groupBy(*keys).agg(F.bool_or("asked").alias("asked"), F.sum("n").alias("n"), F.sum("null").alias("null")).where("asked")
    return slots.groupBy(row).agg(F.sum(F.when(F.col("n") == 0, 1).otherwise(F.col("null"))).alias("n_null")).where(F.col("n_null") > 0)
