"""Entity-level labels up to groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.values import row_id, upper_first
from quorate.operators.rows import require_columns

# Columns of the raw table and how they are combined.
REQUIRED = (
    "territorynamehistorical", "region", "name_clean", "entrydateyear", "exitdateyear", "powersharing", "sovereign",
    "assembly_binary", "appointment", "tenure", "exit",
)
ANY_OF = ("assembly_binary", "exit", "powersharing", "sovereign")


def any_of(c: Column) -> Column:
    """1 when any value is at least 1, 0 when none is, null when all are missing."""
    top = F.max(c)
    return F.when(top >= 1, 1).when(top.isNotNull(), 0)


def highest(c: Column) -> Column:
    return F.max(c).cast("int")


def binned_tenure(c: Column) -> Column:
    """Longest tenure: above 10 -> 2, 5 to 10 -> 1, below -> 0."""
    top = F.max(c)
    return F.when(top > 10, 2).when(top >= 5, 1).when(top.isNotNull(), 0)


def first_known(c: Column, order: Column) -> Column:
    """First value that is not null, by an explicit order."""
    return F.min_by(c, F.when(c.isNotNull(), order))


def rollup_polities(df: DataFrame, order: str, key: str = "territorynamehistorical") -> DataFrame:
    """One row per polity in one aggregation; polities without a name form a group of their own."""
    require_columns(df, REQUIRED)
    named = df.withColumn(key, upper_first(F.col(key)))
    out = named.groupBy(key).agg(
        F.count("name_clean").alias("leader_count"),
        first_known(F.col("region"), F.col(order)).alias("region"),
        F.min("entrydateyear").cast("int").alias("start_year"),
        F.max("exitdateyear").cast("int").alias("end_year"),
        *[any_of(F.col(c)).alias(c) for c in ANY_OF],
        highest(F.col("appointment")).alias("appointment"),
        binned_tenure(F.col("tenure")).alias("tenure"),
    )
    return out.withColumn("year_range", F.col("end_year") - F.col("start_year")).withColumn("id", row_id(F.col(key)))


def geo_mean(c: Column) -> Column:
    """exp of the mean log over positive values; others have no logarithm and are left out."""
    return F.exp(F.avg(F.when(c > 0, F.ln(c))))


def geo_means(
    df: DataFrame, key: str, values: Sequence[str], order: str | None = None, region: str | None = None, min_rows: int = 1
) -> DataFrame:
    """Geometric mean of several columns per group, with the number of values that had to be left out."""
    aggs = [F.count(F.lit(1)).alias("n_leaders")]
    if region and order:
        known = F.when(F.col(region) != "", F.col(region))
        aggs.append(first_known(known, F.col(order)).alias("region"))
    for v in values:
        aggs.append(geo_mean(F.col(v)).alias(f"geo_mean_{v}"))
        aggs.append(F.count_if(F.col(v) <= 0).alias(f"n_not_positive_{v}"))
    kept = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return kept.groupBy(key).agg(*aggs).where(F.col("n_leaders") >= min_rows)
