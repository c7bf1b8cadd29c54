"""Annotation of requests as their files arrive, resumable after a crash."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quorate.operators.annotate import RESPONSE_SCHEMA, annotate
from quorate.registry import local_frame

LEDGER = "run string, batch bigint, n bigint"


def read_ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(run, batch, n): one row per finished batch, and one with batch -1 that names the run; empty before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{checkpoint}/ledger")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LEDGER)
        raise


def _note(spark: SparkSession, checkpoint: str, run: str, batch: int, n: int) -> None:
    kinds = {"run": pa.string(), "batch": pa.int64(), "n": pa.int64()}
    local_frame(spark, kinds, [(run, batch, n)]).coalesce(1).write.mode("append").parquet(f"{checkpoint}/ledger")


def annotate_stream(
    requests: DataFrame, open_client: Callable[[], Callable[..., Any]], out: str, checkpoint: str,
    partitions: int | None = None, after_batch: Callable[[int, int], None] | None = None,
) -> StreamingQuery:
    """Answer a stream of requests (custom_id, system_prompt, user_prompt, temperature), each id once, and stop at its end.

    Two things make it once. Keyed state drops ids that came before, in this run or an earlier one. And each batch is a
    folder of its own, entered in a ledger when it is complete: a batch that Spark repeats after a crash is skipped if
    the ledger has it, else written over. What a crash costs is the calls of one unfinished batch; set its size by
    `maxFilesPerTrigger` on the source. The ledger lies with the checkpoint, so losing both starts a new run beside the old.

    `after_batch(batch, n)` is called when a batch is in the ledger, for logging; if it raises, the stream stops and the
    next start goes on behind that batch. Null ids are one id. Read the answers by `streamed_answers`.
    """
    spark = requests.sparkSession
    known = read_ledger(spark, checkpoint).select("run").first()
    run = known["run"] if known else uuid.uuid4().hex
    if known is None:
        _note(spark, checkpoint, run, -1, 0)

    def answer(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if read_ledger(session, checkpoint).where(F.col("batch") == number).head(1):
            # Its rows are read all the same: the keyed state of the batch is only kept if the batch runs.
            batch.write.format("noop").mode("overwrite").save()
            return
        folder = f"{out}/run={run}/batch={number}"
        annotate(batch, open_client, partitions).write.mode("overwrite").parquet(folder)
        n = session.read.schema(RESPONSE_SCHEMA).parquet(folder).count()
        _note(session, checkpoint, run, number, n)
        if after_batch is not None:
            after_batch(number, n)

    return (
        requests.dropDuplicates(["custom_id"])
        .writeStream.foreachBatch(answer)
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .start()
    )


def streamed_answers(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """The answers of all batches in the ledger; a folder that a crash left unfinished is not read."""
    written = spark.read.schema(f"{RESPONSE_SCHEMA}, run string, batch bigint").parquet(out)
    return written.join(read_ledger(spark, checkpoint).select("run", "batch"), ["run", "batch"], "left_semi").drop("run", "batch")
