"""Writing results, requests and run logs."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.operators.requests import MAX_CHUNK_BYTES, pack_chunks, request_line
from quorate.operators.rows import require_columns
from quorate.registry import local_frame
from quorate.sources.tables import KEEP_BLANKS

FORMATS = ("parquet", "csv", "json")


def save_results(df: DataFrame, folder: str, formats: Sequence[str] = FORMATS, order: str | None = None, mode: str = "overwrite") -> None:
    """Result table in several formats under one folder; JSON is written as lines.

    Parquet is written first and the text formats are made from it, so the plan runs once. List columns become
    "; " texts in CSV. `order` sorts at the sink (range sort, no single task): within a file rows ascend, and so do the
    files of a format by name. Each format is sorted on its own, for a reader packs files into tasks by size.
    """
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown formats {sorted(unknown)}")
    out = df.orderBy(order) if order else df
    out.write.mode(mode).parquet(f"{folder}/parquet")
    stored = df.sparkSession.read.parquet(f"{folder}/parquet")
    ordered = lambda frame: frame.orderBy(order) if order else frame
    if "csv" in formats:
        flat = [
            F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name)
            if f.dataType.typeName() == "array"
            else (F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "map") else F.col(f.name))
            for f in stored.schema.fields
        ]
        ordered(stored).select(*flat).write.mode(mode).options(header=True, escape='"', **KEEP_BLANKS).csv(f"{folder}/csv")
    if "json" in formats:
        ordered(stored).write.mode(mode).option("ignoreNullFields", "false").json(f"{folder}/json")


def save_request_chunks(
    requests: DataFrame, folder: str, cap_bytes: int = MAX_CHUNK_BYTES, n_shards: int | None = None, shard: Column | None = None
) -> None:
    """Requests as JSON Lines in one folder per chunk, each chunk at most `cap_bytes`.

    One shuffle by shard brings the rows of a chunk into one task in order; writing by chunk then needs no other.
    """
    lines = requests.select("row_idx", "sc_idx", request_line(requests).alias("value"))
    sized = lines.withColumn("n_bytes", F.octet_length("value") + 1)
    packed = pack_chunks(sized, cap_bytes, shard=shard, n_shards=n_shards)
    packed.select("value", "chunk").write.mode("overwrite").partitionBy("chunk").text(folder)


def save_requests(requests: DataFrame, folder: str) -> None:
    """Requests as JSON Lines without a size cap (retry requests); no shuffle. Requests read from files are written
    byte for byte as they were."""
    line = F.col("line") if "line" in requests.columns else request_line(requests)
    requests.select(line.alias("value")).write.mode("overwrite").text(folder)


def save_for_reprocessing(failed: DataFrame, folder: str, columns: Sequence[str] | None = None) -> None:
    out = require_columns(failed, columns).select(*columns) if columns else failed.drop("failed_checks")
    out.write.mode("overwrite").options(header=True, escape='"', **KEEP_BLANKS).csv(folder)


def append_new(rows: DataFrame, table_folder: str, key: str = "row_idx") -> None:
    """Append the rows whose key is not in the stored table yet, one per key: the first by its JSON text."""
    spark = rows.sparkSession
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.to_json(F.struct(*rows.columns))))
    rows = rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    if _exists(spark, table_folder):
        rows = rows.join(spark.read.parquet(table_folder).select(key), key, "left_anti")
    rows.write.mode("append").parquet(table_folder)


def _exists(spark: SparkSession, folder: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(folder).schema
        return True
    except AnalysisException as e:
        # Any other fault of the stored table must not look like an absent one.
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def log_run(spark: SparkSession, folder: str, run_id: str, kind: str, facts: dict) -> None:
    """Append one row to the run table (manifest, provenance, cost report); no timestamps from executors."""
    text = pa.string()
    kinds = {"run_id": text, "kind": text, "facts": pa.map_(text, text)}
    row = local_frame(spark, kinds, [(run_id, kind, [(k, str(v)) for k, v in facts.items()])])
    row.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(folder)


def export_analysis(tables: dict[str, DataFrame], folder: str) -> None:
    """Metrics, comparisons and summary side by side, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], n_buckets: int) -> None:
    """Store a long table bucketed by its row key.

    Votes, slot pivots, upserts and joins on that key then run without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(n_buckets, *keys).sortBy(*keys).saveAsTable(table)
