"""Row-level preparation of input tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.functions.values import na_to_null
from quorate.session import ensure_checkpoint_dir

# Texts put in for missing row fields.
UNKNOWN_POLITY = "Unknown Polity"
UNKNOWN_LEADER = "Unknown Leader"


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; found: {df.columns}")
    return df


def filter_range(df: DataFrame, ranges: Mapping[str, tuple] = {}, members: Mapping[str, Sequence] = {}) -> DataFrame:
    """Inclusive ranges and membership lists; plain comparisons, so they reach a Parquet scan."""
    for name, (low, high) in ranges.items():
        df = df.where(F.col(name).between(low, high))
    for name, values in members.items():
        df = df.where(F.col(name).isin(list(values)))
    return df


def with_row_index(df: DataFrame, order: Sequence[str], into: str = "row_idx") -> DataFrame:
    """Position 0..n-1 under a total order, without sorting everything in one task.

    Rows are range-partitioned and numbered inside their partition; partition sizes (one number each) give the
    offsets. Range bounds are sampled and would differ between two runs of the plan, so the ranged rows are
    checkpointed before they are used twice.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id())
    tagged = tagged.checkpoint()
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_base"))
    # As many rows as partitions: small enough for one window task and for a broadcast.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(into, F.col("_offset") + F.col("_local") - F.col("_base"))
        .drop("_pid", "_local", "_base", "_offset")
    )


def slice_rows(df: DataFrame, spec: str, index: str = "row_idx") -> DataFrame:
    """"n" keeps the first n rows, "a:b" rows a..b-1, by a stable index column."""
    if ":" in spec:
        low, high = (int(p) for p in spec.split(":", 1))
    else:
        low, high = 0, int(spec)
    return df.where((F.col(index) >= low) & (F.col(index) < high))


def fill_row_fields(
    df: DataFrame, polity: str = "polity_name", leader: str = "leader_name", start: str = "leader_first_year", end: str = "leader_last_year"
) -> DataFrame:
    """Defaults for names; years become ints, an open end stays null."""
    return (
        df.withColumn(polity, F.coalesce(F.col(polity), F.lit(UNKNOWN_POLITY)))
        .withColumn(leader, F.coalesce(F.col(leader), F.lit(UNKNOWN_LEADER)))
        .withColumn(start, F.col(start).try_cast("int"))
        .withColumn(end, F.col(end).try_cast("int"))
    )


def quarantine(df: DataFrame, reasons: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into good rows and rejected rows with the first reason that applies."""
    reason = F.coalesce(*[F.when(c, F.lit(r)) for r, c in reasons.items()])
    marked = df.withColumn("reject_reason", reason)
    return (
        marked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.where(F.col("reject_reason").isNotNull()),
    )


def fix_types(df: DataFrame, indicators: Sequence[str], multi_select: Sequence[str] = ()) -> DataFrame:
    """Predictions, confidences and years to int (bad value -> null); texts to string.

    Year lists ("1789; 1791") stay text.
    """
    ints = {f"{i}_prediction" for i in indicators if i not in multi_select}
    ints |= {f"{i}_confidence" for i in indicators} | {"start_year", "end_year"}
    texts = {"territorynamehistorical", "polity_name", "id", "region"}
    out = []
    for c in df.columns:
        if c in ints:
            # Through double, so that "2.0" from a CSV is 2.
            out.append(F.col(c).try_cast("double").try_cast("int").alias(c))
        elif c in texts or "reasoning" in c or "document_name" in c:
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def probe_fields(df: DataFrame) -> DataFrame:
    """Sentinels to null; tenure from the years where it is missing."""
    cols = {
        "name": "leader_name", "polity": "polity_name", "region": "polity_region",
        "entry_year": "leader_first_year", "exit_year": "leader_last_year", "tenure": "tenure",
    }
    have = {k: na_to_null(F.col(v)) if v in df.columns else F.lit(None).cast("string") for k, v in cols.items()}
    span = (have["exit_year"].try_cast("int") - have["entry_year"].try_cast("int")).cast("string")
    rest = [c for c in df.columns if c not in cols.values()]
    out = [v.alias(k) for k, v in have.items() if k != "tenure"]
    return df.select(*rest, *out, F.coalesce(have["tenure"], span).alias("tenure"))


def error_rows(df: DataFrame, status: str = "status", error: str = "error") -> DataFrame:
    """Rows whose annotation failed; labels are null there, never -1."""
    return df.where(F.col(status) == "error").where(F.col(error).isNotNull())


def drop_private(df: DataFrame, prefix: str = "_") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Named columns in the types of a schema; values that do not fit become null."""
    require_columns(df, schema.names)
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
