"""Streams, run to the end of what is there and read back."""

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quorate.plans.answers import answers_long, self_consistency
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import RESPONSES, USAGE, Fixture, table, with_ctes
from quorate.plans.catalog.parsing import ANSWERS_CTE, JSON
from quorate.plans.catalog.votes import majority_sql, wide_sql
from quorate.registry import DEFAULT_REGISTRY, local_frame
from quorate.session import run_folder
from quorate.sources.tables import load_responses
from quorate.streaming.annotating import annotate_stream, streamed_answers
from quorate.streaming.responses import current_answers, run_parse, run_parse_once
from quorate.streaming.usage import run_counted_usage, run_usage, with_open_windows


@query("stream_parse", with_ctes([RESPONSES, JSON, ANSWERS_CTE], "select custom_id, indicator, prediction, confidence from ans"))
def stream_parse(spark, sf):
    """Response files parsed as they arrive: a first load, then a later file in a second run."""
    folder = run_folder(spark, "stream-parse")
    source, out, mark = (f"{folder}/{n}" for n in ("in", "out", "checkpoint"))
    r = RESPONSES.df(spark, sf)
    late = F.col("custom_id").endswith("|2")
    for part in (r.where(~late), r.where(late)):
        part.write.mode("append").json(source)
        run_parse(spark, source, out, mark, DEFAULT_REGISTRY, ["sovereign", "assembly"], alone=[]).awaitTermination()
    return spark.read.parquet(out).select("custom_id", "indicator", "prediction", "confidence")


def again(spark, sf):
    """Second answers: a third of the requests anew, some of them empty, and a fifth once more as they were."""
    r = RESPONSES.df(spark, sf).withColumn("doc", F.split_part("custom_id", F.lit("|"), F.lit(1)).cast("bigint"))
    new = F.when(F.col("doc") % 9 == 0, "").otherwise(F.lit('{"sovereign": "0", "assembly": "3", "assembly_confidence": 7}'))
    return r.where("doc % 3 = 0").select("custom_id", new.alias("text")), r.where("doc % 5 = 0").select("custom_id", "text")


AGAIN = """answered as (select custom_id, case when cast(split_part(custom_id, '|', 1) as bigint) % 5 = 0 then text
    when cast(split_part(custom_id, '|', 1) as bigint) % 9 = 0 then '' when cast(split_part(custom_id, '|', 1) as bigint) % 3 = 0
    then '{"sovereign": "0", "assembly": "3", "assembly_confidence": 7}' else text end as text from responses)"""
AGAIN_JSON = JSON.replace("from responses)", "from answered)")


@query("stream_parse_once", with_ctes([RESPONSES, AGAIN, AGAIN_JSON, ANSWERS_CTE], "select custom_id, indicator, prediction, confidence from ans"))
def stream_parse_once(spark, sf):
    """Requests answered again in later files and later runs: the last answer counts, a repeated one adds nothing."""
    folder = run_folder(spark, "stream-once")
    source, out, mark = (f"{folder}/{n}" for n in ("in", "out", "checkpoint"))
    first, (new, same) = RESPONSES.df(spark, sf), again(spark, sf)
    for part in (first, new.unionByName(new), same):
        part.write.mode("append").json(source)
        run_parse_once(spark, source, out, mark, DEFAULT_REGISTRY, ["sovereign", "assembly"], alone=[]).awaitTermination()
    return current_answers(spark, out).select("custom_id", "indicator", "prediction", "confidence")


@query("latest_answers", with_ctes([RESPONSES, AGAIN, AGAIN_JSON, ANSWERS_CTE], "select * from ans"))
def latest_answers(spark, sf):
    """The same from files read as a batch, whatever order they are listed in."""
    folder = run_folder(spark, "answers")
    first, (new, same) = RESPONSES.df(spark, sf), again(spark, sf)
    for part in (first, new, same):
        part.write.mode("append").json(folder)
    long = answers_long(load_responses(spark, folder), DEFAULT_REGISTRY, combined=["sovereign", "assembly"], alone=[])
    return long.select("custom_id", "row_idx", "indicator", "sc_idx", "prediction", "reasoning", "confidence")


@query(
    "self_consistency_again",
    with_ctes(
        [RESPONSES, AGAIN, AGAIN_JSON, ANSWERS_CTE, majority_sql("ans")],
        f"select t.doc_id as row_idx, w.* exclude (row_idx) from documents t left join ({wide_sql('ans')}) w on t.doc_id = w.row_idx",
    ),
)
def self_consistency_again(spark, sf):
    """Votes over requests that were answered several times: the aggregation that pivots the slots takes the last one."""
    folder = run_folder(spark, "answers")
    first, (new, same) = RESPONSES.df(spark, sf), again(spark, sf)
    for part in (first, new, same):
        part.write.mode("append").json(folder)
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"))
    both = ["sovereign", "assembly"]
    return self_consistency(rows, load_responses(spark, folder), DEFAULT_REGISTRY, both, 2, both, alone=[])


_WINDOWS = """w as (select time_bucket(interval '1 day', ts, timestamp '1970-01-01') as window_start, model, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens,
        cast(sum(output_tokens) as bigint) as output_tokens from usage group by 1, 2)"""


def usage_of(events):
    usage = events.selectExpr(*[f"{e} as {a}" for a, e in USAGE.columns.items()])
    # The table's times carry no zone; read as UTC whatever the session's zone is.
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return usage.withColumn("ts", F.timestamp_micros(micros))


def streamed_usage(spark, sf):
    """The windows that the stream has written when it stops."""
    folder = run_folder(spark, "stream-usage")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    run_usage(usage_of(arriving), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def daily(out):
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window_start") / 86_400).cast("int")).cast("string")
    return out.select(day.alias("day"), "model", "calls", "input_tokens", "output_tokens")


@query(
    "stream_usage",
    with_ctes(
        [USAGE, _WINDOWS],
        """select strftime(window_start, '%Y-%m-%d') as day, model, calls, input_tokens, output_tokens from w
        where window_start + interval '1 day' <= (select max(ts) - interval '1 hour' from usage)""",
    ),
)
def stream_usage(spark, sf):
    """Daily totals per model; the last day is still open when the stream stops."""
    return daily(streamed_usage(spark, sf))


@query(
    "stream_usage_to_date",
    with_ctes([USAGE, _WINDOWS], "select strftime(window_start, '%Y-%m-%d') as day, model, calls, input_tokens, output_tokens from w"),
)
def stream_usage_to_date(spark, sf):
    """The same with the days still open: totals of all events."""
    return daily(with_open_windows(streamed_usage(spark, sf), usage_of(table(spark, sf, "events"))))


def shouting():
    """A user function that needs no model."""
    return lambda system, user, temperature: f'{{"label": "{user.upper()}", "t": {temperature:.1f}}}'


ASKED = Fixture(
    "asked", "documents",
    {"custom_id": "cast(doc_id as string) || '|single|' || cast(sc_idx as string)", "system_prompt": "lang", "user_prompt": "source || ' ' || cast(n_chars as string)",
     "temperature": "cast(sc_idx as double)", "doc": "doc_id"},
    samples=2,
)


@query("annotate_stream", with_ctes([ASKED], """select custom_id, '{"label": "' || upper(user_prompt) || '", "t": ' || case when temperature = 0 then '0.0' else '1.0' end || '}' as text, 'ok' as status from asked"""))
def annotate_stream_once(spark, sf):
    """Requests in several files, some of them twice; the stream is stopped between two batches and started again."""
    folder = run_folder(spark, "annotate-stream")
    source, out, mark = (f"{folder}/{n}" for n in ("in", "out", "checkpoint"))
    asked = ASKED.df(spark, sf)
    for part in (asked.where("doc % 3 = 0"), asked.where("doc % 3 < 2"), asked.where("doc % 2 = 0"), asked):
        part.drop("doc").coalesce(1).write.mode("append").parquet(source)
    requests = lambda: spark.readStream.schema(asked.drop("doc").schema).option("maxFilesPerTrigger", 1).parquet(source)

    def stop(batch, n):
        if batch == 1:
            raise InterruptedError("stopped between two batches")

    try:
        annotate_stream(requests(), shouting, out, mark, after_batch=stop).awaitTermination()
    except StreamingQueryException:
        pass
    annotate_stream(requests(), shouting, out, mark).awaitTermination()
    return streamed_answers(spark, out, mark).select("custom_id", "text", "status")


@query(
    "stream_usage_late",
    with_ctes(
        [USAGE],
        """select part, count(*) filter (where not coalesce(ts <= mark, false)) as n_counted, count(*) filter (where coalesce(ts <= mark, false)) as n_late
        from (select u.call_id % 3 as part, u.ts, max(m.top) - interval '1 hour' as mark from usage u
              left join (select call_id % 3 as part, date_trunc('milliseconds', max(ts)) as top from usage group by 1) m on m.part < u.call_id % 3
              group by u.call_id, u.call_id % 3, u.ts) group by part""",
    ),
)
def stream_usage_late(spark, sf):
    """Calls delivered in three parts out of order, some of them twice: rows behind the watermark, by part."""
    folder = run_folder(spark, "stream-late")
    source, out, mark = (f"{folder}/{n}" for n in ("in", "out", "checkpoint"))
    events, counted = usage_of(table(spark, sf, "events")), []
    for part in range(3):
        mine = events.where(F.col("call_id") % 3 == part)
        mine.write.mode("append").parquet(source)
        arriving = spark.readStream.schema(events.schema).parquet(source)
        run_counted_usage(arriving, "call_id", out, mark, lambda batch, late, read: counted.append((part, read - late, late)))
    return local_frame(spark, {"part": pa.int64(), "n_counted": pa.int64(), "n_late": pa.int64()}, counted)
