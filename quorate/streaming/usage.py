"""Usage totals per day and model, kept up to date."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

TOKENS = ("input_tokens", "output_tokens", "cached_tokens", "thinking_tokens")


def usage_windows(usage: DataFrame, window: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Totals per window and model. On a stream, a window is final once the watermark passes its end; rows that
    come later are dropped (numRowsDroppedByWatermark counts them)."""
    if usage.isStreaming:
        usage = usage.withWatermark(time, late)
    return _window_totals(usage, window, time)


def _window_totals(usage: DataFrame, window: str, time: str) -> DataFrame:
    totals = usage.groupBy(F.window(time, window).alias("w"), "model").agg(
        F.count(F.lit(1)).alias("calls"), *[F.sum(t).alias(t) for t in TOKENS]
    )
    return totals.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "model", "calls", *TOKENS)


def run_usage(usage: DataFrame, out: str, checkpoint: str, window: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    return (
        usage_windows(usage, window, late)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class LateRows(StreamingQueryListener):
    """Counts, batch by batch, the rows of one query that came behind the watermark and were dropped.

    `write(batch, n_late, n_read)` is called once per batch with rows, in order. Spark counts what its state operators
    see, so the count is one of rows only where the first operator sees single rows, as in `counted_usage`.
    """

    def __init__(self, write: Callable[[int, int, int], None]):
        super().__init__()
        self._write, self._id, self._early = write, None, []
        self.ended = threading.Event()

    def follow(self, query: StreamingQuery) -> None:
        """Events reach all listeners of a session, some before the query is known here."""
        self._id, early, self._early = str(query.runId), self._early, []
        for progress in early:
            self._count(progress)

    def _count(self, progress) -> None:
        if str(progress.runId) == self._id and progress.numInputRows > 0:
            late = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
            self._write(progress.batchId, late, progress.numInputRows)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self._id is None:
            self._early.append(event.progress)
        else:
            self._count(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._id is None or str(event.runId) == self._id:
            self.ended.set()


def counted_usage(usage: DataFrame, key: str, window: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """`usage_windows` in which every call counts once: rows with a key seen before within the lateness are dropped, and
    so are rows older than the watermark, row by row, before anything is added up."""
    once = usage.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return _window_totals(once, window, time)


def run_counted_usage(
    usage: DataFrame, key: str, out: str, checkpoint: str, write: Callable[[int, int, int], None], window: str = "1 day", late: str = "1 hour",
    wait_seconds: float = 60,
) -> None:
    """Total what is there into `out` and tell `write` the late rows of each batch; returns when both are done."""
    spark = usage.sparkSession
    listener = LateRows(write)
    spark.streams.addListener(listener)
    try:
        query = (
            counted_usage(usage, key, window, late)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        listener.follow(query)
        query.awaitTermination()
        # Events come after the fact, the end last.
        if not listener.ended.wait(wait_seconds):
            raise TimeoutError("the end of the stream was not reported")
    finally:
        spark.streams.removeListener(listener)


def with_open_windows(final: DataFrame, usage: DataFrame, window: str = "1 day", time: str = "ts") -> DataFrame:
    """What the stream has written plus the windows still open, totalled from the same source as a batch.

    A window is open if it starts at the end of the last written one or later. Open totals are not written to the
    stream's folder: a later run writes these windows when they are final. With nothing written all windows are open.
    """
    last = final.agg(F.unix_micros(F.max("window_end"))).first()[0]
    rest = usage if last is None else usage.where(F.col(time) >= F.timestamp_micros(F.lit(last)))
    return final.unionByName(usage_windows(rest, window, time=time))
