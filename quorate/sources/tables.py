"""Reading input tables, requests and responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.values import request_id_parts
from quorate.operators.requests import check_sample_count
from quorate.operators.rows import require_columns

RULERS = (
    "polity_name string, polity_region string, leader_name string, leader_first_year int, leader_last_year int, tenure int"
)
POLITIES = (
    "id string, territorynamehistorical string, leader_count int, region string, start_year int, end_year int, "
    "assembly_binary int, exit int, powersharing int, sovereign int, appointment int, tenure int, year_range int"
)
REQUESTS = (
    "contents array<struct<parts:array<struct<text:string>>,role:string>>, "
    "config struct<system_instruction:struct<parts:array<struct<text:string>>>,temperature:double,max_output_tokens:int,"
    "top_p:double,response_mime_type:string,tools:array<string>>, "
    "metadata struct<custom_id:string,n_samples:string,indicators:string,row_data:string,original_row_idx:string,"
    "search_queries:string,search_urls:string>"
)
RESPONSES = "custom_id string, text string"
CORRUPT = "_corrupt_record"


# Quoted fields may hold line breaks and doubled quotes. Such a file cannot be split; Parquet is the format for scale.
KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def load_table(spark: SparkSession, path: str, schema: str | None = None, infer: bool = True, kind: str | None = None) -> DataFrame:
    """CSV, JSON Lines or Parquet by file ending, or by `kind` (csv, json, parquet) for folders without one; an empty
    table is an error, and so is a malformed CSV row.

    Give a schema where you can: without one Spark reads the file twice to infer it. With infer=False the columns of
    a CSV are text.
    """
    low = f".{kind}" if kind else path.lower().rstrip("/")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if low.endswith(".csv"):
        reader = reader.options(**CSV_OPTIONS).option("mode", "FAILFAST")
        df = (reader if schema is not None else reader.option("inferSchema", infer)).csv(path)
    elif low.endswith((".jsonl", ".json", ".ndjson")):
        # A bad line fails the read; blank lines are skipped by the reader.
        df = reader.option("mode", "FAILFAST").json(path)
    elif low.endswith(".parquet"):
        df = reader.parquet(path)
    else:
        raise ValueError(f"unsupported file type: {path} (use .csv, .jsonl or .parquet)")
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def load_jsonl_split(spark: SparkSession, path: str | Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, unreadable lines) of a JSON Lines source."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    read = lines.select(F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("row")).select("row.*")
    return read.where(F.col(CORRUPT).isNull()).drop(CORRUPT), read.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def load_rulers(spark: SparkSession, path: str) -> DataFrame:
    """Ruler table with its columns checked against the file and its types imposed."""
    df = load_table(spark, path, infer=False)
    require_columns(df, ["polity_name", "leader_name", "leader_first_year"])
    typed = dict(part.split() for part in RULERS.split(", "))
    # "3.5" in an int column reads as 3, as a number would; other texts read as null.
    read = lambda c: F.col(c).try_cast("double").try_cast("int") if typed[c] == "int" else F.col(c).try_cast(typed[c])
    return df.select(*[read(c).alias(c) if c in typed else F.col(c) for c in df.columns])


def load_polities(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Rollup output with nullable ints; the columns stand in the order of POLITIES."""
    return load_table(spark, path, POLITIES, kind=kind)


def load_requests(spark: SparkSession, paths: str | Sequence[str], n_samples: int | None = None) -> DataFrame:
    """Requests of one or many files with their typed key columns; the sample count is checked on all rows.

    `line` is the request as it stands in the file, with fields that the schema does not know.
    """
    lines = spark.read.text(paths).where(F.trim("value") != "")
    df = lines.select("value", F.from_json("value", REQUESTS, {"mode": "FAILFAST"}).alias("read")).select("read.*", F.col("value").alias("line"))
    cid = F.col("metadata.custom_id")
    parts = request_id_parts(cid)
    out = df.select(
        cid.alias("custom_id"),
        parts["row_idx"].alias("row_idx"),
        parts["indicator"].alias("prompt_key"),
        parts["sc_idx"].alias("sc_idx"),
        "contents", "config", "metadata", "line",
    )
    return out if n_samples is None else check_sample_count(out, n_samples)


def answer_text() -> Column:
    """Error and missing text both read as an empty answer."""
    return F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).otherwise("").alias("text")


def arrival(line: Column | None = None) -> Column:
    """Where an answer stands in the files of a source: change time and name of the file, block in it, line of the block.

    A block is read by one task from top to bottom, so a running number in the task orders its lines.
    """
    meta = F.col("_metadata")
    return F.struct(
        F.unix_micros(meta["file_modification_time"]).alias("time"), meta["file_path"].alias("file"),
        meta["file_block_start"].alias("block"), (F.monotonically_increasing_id() if line is None else line).alias("line"),
    )


def load_responses(spark: SparkSession, paths: str | Sequence[str], received: str | None = None) -> DataFrame:
    """(custom_id, text, arrived); of several answers to a request the one that arrived last counts.

    `arrived` comes from the files and the place in them. Where the lines carry a time of their own, name it by
    `received`; it then decides first (column received_at).
    """
    own = f", `{received}` timestamp" if received else ""
    df = spark.read.schema(f"{RESPONSES}, error string{own}").json(paths)
    times = [F.col(received).alias("received_at")] if received else []
    return df.select("custom_id", answer_text(), *times, arrival().alias("arrived"))


def convert_charset(spark: SparkSession, paths: str | Sequence[str], charset: str, out: str) -> None:
    """CSV files in a named charset to UTF-8 CSV; line breaks and quotes inside fields are kept."""
    df = spark.read.options(**CSV_OPTIONS).option("mode", "FAILFAST").option("encoding", charset).csv(paths)
    df.write.mode("overwrite").options(header=True, escape='"', encoding="UTF-8", **KEEP_BLANKS).csv(out)


def csv_to_jsonl(spark: SparkSession, path: str, out: str, schema: str | None = None, kind: str | None = None) -> None:
    """CSV to JSON Lines; null fields are written, not dropped."""
    load_table(spark, path, schema, kind=kind).write.mode("overwrite").option("ignoreNullFields", "false").json(out)
