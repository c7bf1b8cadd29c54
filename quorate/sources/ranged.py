"""Result tables stored by ranges of their row key, so that a repair rewrites only the ranges it changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators.repair import upsert
from quorate.operators.votes import last_per_key
from quorate.session import run_folder

# The partition column carries the width of a range in its name, so a stored table says how it is cut.
PREFIX = "range_of_"
ROWS_PER_RANGE = 1_000_000


def save_ranged(df: DataFrame, folder: str, key: str = "row_idx", width: int = ROWS_PER_RANGE, mode: str = "overwrite") -> None:
    """Store a table in ranges of `width` values of a whole-number key, one folder each (rows without a key in one of
    their own). A range is written by one task; give a width that makes a range a few hundred MB."""
    part = f"{PREFIX}{width}"
    cut = df.withColumn(part, F.floor(F.col(key) / F.lit(width)).cast("bigint"))
    cut.repartition(part).sortWithinPartitions(part, key).write.mode(mode).partitionBy(part).parquet(folder)


def range_column(stored: DataFrame) -> tuple[str, int]:
    """Name of the partition column and the width of a range."""
    found = [c for c in stored.columns if c.startswith(PREFIX) and c[len(PREFIX):].isdigit()]
    if len(found) != 1:
        raise ValueError(f"not a table stored in ranges; its columns: {stored.columns}")
    return found[0], int(found[0][len(PREFIX):])


def read_ranged(spark: SparkSession, folder: str) -> DataFrame:
    stored = spark.read.parquet(folder)
    return stored.drop(range_column(stored)[0])


def upsert_stored(
    spark: SparkSession, folder: str, reprocessed: DataFrame, order: str, key: str = "row_idx",
    update: Sequence[str] | None = None, confidence: str | None = None,
) -> list[int]:
    """`upsert` on a stored table in which only the ranges with a good new row are read and written; gives their numbers.

    Files of other ranges are not touched. The new ranges are first written elsewhere, complete, and then moved in range by
    range; a crash in between is mended by running the same upsert again, which gives the same rows. Columns new to the
    table cannot be added range by range and are refused. Null keys match null keys.

    The numbers of the ranges reach the driver, which lists their folders anyway.
    """
    stored = spark.read.parquet(folder)
    part, width = range_column(stored)
    update = [c for c in (update or reprocessed.columns) if c != key and (update or c != order)]
    new = [c for c in update if c not in stored.columns]
    if new:
        raise ValueError(f"columns that the stored table does not have: {new}")
    good = reprocessed
    if confidence and confidence in reprocessed.columns:
        score = F.col(confidence).try_cast("double")
        good = reprocessed.where(score.isNotNull() & (score != -1))
    work = run_folder(spark, "upsert")
    # Written once: the new rows may come from a model, and their ranges are asked for before they are used.
    last_per_key(good.select(key, F.col(order).alias("_order"), *update), [key], "_order").write.parquet(f"{work}/new")
    fresh = spark.read.parquet(f"{work}/new").withColumn(part, F.floor(F.col(key) / F.lit(width)).cast("bigint"))
    touched = [r[0] for r in fresh.select(part).distinct().collect()]
    if not touched:
        return []
    ranges = [t for t in touched if t is not None]
    # Literals, so that the scan is cut down to the folders of these ranges.
    wanted = F.col(part).isin(ranges) if ranges else F.lit(False)
    if len(ranges) < len(touched):
        wanted = wanted | F.col(part).isNull()
    merged = upsert(stored.where(wanted), fresh.drop(part), "_order", [key], update)
    merged.repartition(part).sortWithinPartitions(part, key).write.partitionBy(part).parquet(f"{work}/ranges")
    done = spark.read.schema(stored.schema).parquet(f"{work}/ranges")
    done.repartition(part).sortWithinPartitions(part, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(folder)
    return sorted(ranges)
