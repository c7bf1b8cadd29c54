"""One round of check -> re-request -> upsert."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.operators.quality import failures
from quorate.operators.repair import retry_requests, upsert_indicators
from quorate.session import run_folder
from quorate.sources.sinks import log_run


def repair_round(
    table: DataFrame,
    requests: DataFrame,
    reprocess: Callable[[DataFrame], DataFrame],
    indicators: Sequence[str],
    key: str = "row_idx",
    run_table: str | None = None,
    round_no: int = 1,
    **checks,
) -> DataFrame:
    """Table with the failed labels replaced where the new answer is good.

    Only the columns of an indicator that failed on that row are touched. `reprocess` takes the requests to repeat
    and gives wide results by row key; its output is written once, since it may call a model. A round over a
    repaired table changes nothing.
    """
    spark = table.sparkSession
    folder = run_folder(spark, "repair")
    failures(table, indicators, key, **checks).write.parquet(f"{folder}/failed")
    failed = spark.read.parquet(f"{folder}/failed")
    # One row per failed row with the indicators that failed on it (bounded by the indicator list).
    by_row = failed.groupBy(key).agg(
        *[F.max((F.col("indicator") == i).cast("int")).alias(f"_failed_{i}") for i in indicators]
    )
    reprocess(retry_requests(requests, by_row, key)).write.parquet(f"{folder}/reprocessed")
    fresh = spark.read.parquet(f"{folder}/reprocessed").join(by_row, key)
    out = upsert_indicators(table, fresh, indicators, key)
    if run_table:
        n = failed.groupBy("indicator").count().collect()  # one row per indicator
        log_run(spark, run_table, folder.rsplit("/", 1)[-1], "repair", {"round": round_no, **{r["indicator"]: r["count"] for r in n}})
    return out
