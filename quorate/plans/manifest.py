"""Provenance: digests of tables that do not depend on row order, and stages that are skipped when nothing changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.registry import local_frame

MANIFEST = "stage string, inputs string, settings string, output string, folder string, n_rows bigint, logged_at timestamp"


def row_hash(df: DataFrame) -> Column:
    """60 bits of a row: of its fields in the order of their names, nulls told apart from texts and fields from each other.

    Fields are hashed as Spark writes them as text; structs, lists and maps as JSON (maps in the order of their entries).
    """
    nested = ("struct", "array", "map", "variant")
    text = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if f.dataType.typeName() in nested else F.col(f"`{f.name}`").cast("string")
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    marked = [F.coalesce(F.concat(F.octet_length(text(f)).cast("string"), F.lit(":"), text(f)), F.lit("~")) for f in fields]
    return F.conv(F.substring(F.sha2(F.concat_ws("", *marked), 256), 1, 15), 16, 10).cast("bigint")


def table_digest(df: DataFrame) -> DataFrame:
    """One row (n_rows, hash_sum, hash_xor): the same for the same rows in any order and partitioning, in one pass without
    a sort. Repeated rows count; the sum is exact."""
    hashed = df.select(row_hash(df).alias("_h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("_h").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"),
        F.coalesce(F.bit_xor("_h"), F.lit(0)).cast("bigint").alias("hash_xor"),
    )


def digest_text(df: DataFrame) -> str:
    """The digest and the schema as one short text."""
    d = table_digest(df).first()
    kinds = hashlib.sha256(json.dumps(sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)).encode()).hexdigest()[:16]
    return f"{d['n_rows']}-{d['hash_sum']}-{d['hash_xor']}-{kinds}"


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], MANIFEST)
        raise


def run_stage(
    spark: SparkSession, folder: str, name: str, inputs: Mapping[str, DataFrame], make: Callable[..., DataFrame], settings: Mapping[str, Any] | None = None,
) -> tuple[DataFrame, bool]:
    """(output, whether it was made now) of a stage `make(**inputs, **settings)`.

    The manifest has a row per finished stage: digests of its inputs, its settings, the digest and the folder of its output.
    A stage whose name, inputs and settings are in it is not run again if its output still has the digest it had; a changed
    cell of an input, a changed setting or a damaged output makes it run. The row is written last, so a stage that was cut
    off has none. Reading the inputs for their digests is what a skipped stage costs.
    """
    settings = dict(settings or {})
    seen = json.dumps({k: digest_text(v) for k, v in sorted(inputs.items())})
    given = json.dumps(settings, sort_keys=True, default=str)
    known = read_manifest(spark, folder).where((F.col("stage") == name) & (F.col("inputs") == seen) & (F.col("settings") == given))
    for r in known.orderBy(F.col("logged_at").desc()).limit(1).collect():
        try:
            old = spark.read.parquet(r["folder"])
            if digest_text(old) == r["output"]:
                return old, False
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    out = f"{folder}/{name}-{hashlib.sha256((seen + given).encode()).hexdigest()[:16]}"
    make(**inputs, **settings).write.mode("overwrite").parquet(out)
    made = spark.read.parquet(out)
    digest = digest_text(made)
    text = pa.string()
    kinds = {"stage": text, "inputs": text, "settings": text, "output": text, "folder": text, "n_rows": pa.int64()}
    row = local_frame(spark, kinds, [(name, seen, given, digest, out, int(digest.split("-")[0]))])
    row.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/_manifest")
    return made, True
