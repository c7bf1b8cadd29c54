"""Reading response files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quorate.plans.answers import answers_long, latest_answers
from quorate.registry import Registry
from quorate.sources.tables import RESPONSES, answer_text, arrival


def parse_stream(spark: SparkSession, folder: str, registry: Registry, combined: Sequence[str], alone: Sequence[str] | None = None) -> DataFrame:
    """Streaming (row, indicator, sample) labels; stateless, an unreadable answer gives a null label.

    A request that is answered twice gives two rows; see `run_parse_once`.
    """
    arriving = spark.readStream.schema(RESPONSES).json(folder)
    return answers_long(arriving, registry, combined=combined, alone=alone, once=False).drop("answer_order")


def run_parse(
    spark: SparkSession, folder: str, out: str, checkpoint: str, registry: Registry, combined: Sequence[str],
    alone: Sequence[str] | None = None,
) -> StreamingQuery:
    """Work off what is there and stop; the next run takes only new files."""
    return _append(parse_stream(spark, folder, registry, combined, alone), out, checkpoint)


def placed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming (custom_id, text, arrived) of the answers that name an id; the line is numbered in the batch."""
    lines = spark.readStream.schema(f"{RESPONSES}, error string").json(folder)
    return lines.where("custom_id is not null").select("custom_id", answer_text(), arrival(F.lit(0).cast("bigint")).alias("arrived"))


def newer_answers(batch: DataFrame, written: DataFrame | None) -> DataFrame:
    """(custom_id, text, arrived): per request the last answer of a batch, if it arrived after all that are written.

    `written` has (custom_id, answer_order) of earlier answers; only their places are read, not their labels.
    """
    # The running number in a task is not allowed on a stream, but in its batches.
    numbered = batch.withColumn("arrived", F.col("arrived").withField("line", F.monotonically_increasing_id()))
    last = numbered.groupBy("custom_id").agg(F.max(F.struct("arrived", "text")).alias("last")).select("custom_id", "last.*")
    if written is None:
        return last.select("custom_id", "text", "arrived")
    known = written.groupBy("custom_id").agg(F.max("answer_order.arrived").alias("known"))
    return last.join(known, "custom_id", "left").where("known is null or arrived > known").select("custom_id", "text", "arrived")


def run_parse_once(
    spark: SparkSession, folder: str, out: str, checkpoint: str, registry: Registry, combined: Sequence[str],
    alone: Sequence[str] | None = None,
) -> StreamingQuery:
    """Labels with `answer_order`, in which every answer outranks the earlier ones to its request, to the end of what is
    there; read the table by `current_answers`.

    Each batch is reduced to the last answer per request (by file time, file, block, line) and held against the places in
    the table, which is the state: it holds over restarts and over a lost checkpoint, and a batch that Spark repeats after
    a crash adds only what is missing. An answer delivered again, in the same file or by a file that is read late, gives
    no row; a later answer gives new rows, empty ones included. Answers without an id are left out. One stream at a time
    writes a table. Every batch reads the ids and places of the whole table, so give it few large batches.
    """

    def settle(batch: DataFrame, number: int) -> None:
        answers = newer_answers(batch, _written(batch.sparkSession, out))
        answers_long(answers, registry, combined=combined, alone=alone, once=False).write.mode("append").parquet(out)

    return (
        placed_answers(spark, folder)
        .writeStream.foreachBatch(settle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _written(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.parquet(out)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current_answers(spark: SparkSession, out: str) -> DataFrame:
    """One row per request and indicator of the table that `run_parse_once` writes: the latest answer."""
    return latest_answers(spark.read.parquet(out))


def _append(parsed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        parsed.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
