"""Labels that depend on other labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.values import number
from quorate.registry import Registry


def gate(labels: Mapping[str, str], column: str = "{}_prediction") -> Column:
    """True where every needed label is there. Apply it before the annotate step: filters do not move past it."""
    out = F.lit(True)
    for name, wanted in labels.items():
        out = out & F.coalesce(number(F.col(column.format(name)).cast("string")) == float(wanted), F.lit(False))
    return out


def split_gate(df: DataFrame, registry: Registry, indicator: str, column: str = "{}_prediction") -> tuple[DataFrame, DataFrame]:
    """(rows to annotate, rows passed through)."""
    needs = registry[indicator].depends_on
    for name in needs:
        if column.format(name) not in df.columns:
            raise ValueError(f"{indicator} needs column {column.format(name)}")
    is_open = gate(needs, column)
    return df.where(is_open), df.where(~is_open)


def dependency_met(registry: Registry, indicator: str, labels: Column) -> Column:
    """The same on a map of earlier labels (map<string,string>); indicators without needs are always met."""
    out = F.lit(True)
    for name, wanted in registry[indicator].depends_on.items():
        out = out & F.coalesce(F.try_element_at(labels, F.lit(name)) == wanted, F.lit(False))
    return out


def fill_dependent(
    df: DataFrame, verdicts: DataFrame, registry: Registry, indicator: str, closed_as: str = "0", row: str = "row_idx"
) -> DataFrame:
    """Verdicts for gated rows, the pass-through label for the others; one left join."""
    v = verdicts.select(row, F.col("prediction").alias("_p"), F.col("agreement").alias("_a"), F.col("uncertainty").alias("_u"))
    is_open = gate(registry[indicator].depends_on)
    joined = df.join(v, row, "left")
    return joined.select(
        *df.columns,
        F.when(is_open, F.col("_p")).otherwise(F.lit(closed_as)).alias(f"{indicator}_prediction"),
        F.when(is_open, F.col("_a")).alias(f"{indicator}_agreement"),
        F.when(is_open, F.col("_u")).alias(f"{indicator}_uncertainty"),
    )
