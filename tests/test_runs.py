"""Answers that arrive again, streams that resume, tables that are repaired in place, exact chunks."""

import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quorate.operators import cost as C
from quorate.operators import repair as P
from quorate.operators import requests as R
from quorate.plans.answers import answers_long, wide_results
from quorate.registry import DEFAULT_REGISTRY
from quorate.sources import ranged, sinks, tables
from quorate.streaming.annotating import annotate_stream, read_ledger, streamed_answers
from quorate.streaming.responses import current_answers, newer_answers, run_parse_once
from quorate.streaming.usage import run_counted_usage


def put_answers(folder, name, rows, at=None):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("".join(json.dumps(dict(custom_id=i, text=t)) + "\n" for i, t in rows))
    if at is not None:
        os.utime(path, (at, at))


def label(n):
    return json.dumps({"sovereign": n})


# answers that arrive again

def test_latest_answer_by_file_and_line(spark, tmp_path, rows_of):
    folder = tmp_path / "in"
    put_answers(folder, "b.json", [("1|sovereign|0", label("1")), ("2|sovereign|0", label("1"))], at=1_000)
    put_answers(folder, "a.json", [("1|sovereign|0", label("0")), ("3|sovereign|0", label("1")), ("3|sovereign|0", label("0"))], at=2_000)
    put_answers(folder, "c.json", [("4|sovereign|0", label("0")), ("4|sovereign|0", "")], at=3_000)
    responses = tables.load_responses(spark, str(folder))
    long = answers_long(responses, DEFAULT_REGISTRY, [], alone=["sovereign"])
    assert rows_of(long, "row_idx", "prediction") == [(1, "0"), (2, "1"), (3, "0"), (4, None)]
    every = answers_long(responses, DEFAULT_REGISTRY, [], alone=["sovereign"], once=False)
    assert every.count() == 7
    assert rows_of(wide_results(every, ["sovereign"], 0), "row_idx", "sovereign_prediction") == [(1, "0"), (2, "1"), (3, "0"), (4, None)]


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path, rows_of):
    """A file read by many tasks, with an answer at its start that a later block corrects."""
    put_answers(tmp_path / "in", "a.json", [("1|sovereign|0", label("1"))] + [(f"{i}|sovereign|0", label("1")) for i in range(10, 3000)] + [("1|sovereign|0", label("0"))])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        responses = tables.load_responses(spark, str(tmp_path / "in"))
        assert responses.rdd.getNumPartitions() > 5
        long = answers_long(responses, DEFAULT_REGISTRY, [], alone=["sovereign"])
        assert rows_of(long.where("row_idx = 1"), "prediction") == [("0",)] and long.count() == 2991
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_time_in_the_lines_decides_first(spark, tmp_path, rows_of):
    (tmp_path / "r.json").write_text(
        '{"custom_id": "1|sovereign|0", "text": "{\\"sovereign\\": 1}", "done": "2024-01-02T00:00:00Z"}\n'
        '{"custom_id": "1|sovereign|0", "text": "{\\"sovereign\\": 0}", "done": "2024-01-01T00:00:00Z"}\n'
    )
    responses = tables.load_responses(spark, str(tmp_path / "r.json"), received="done")
    assert rows_of(answers_long(responses, DEFAULT_REGISTRY, [], alone=["sovereign"]), "prediction") == [("1",)]


def test_answers_without_an_order_come_from_one_answer(spark):
    both = [json.dumps({"sovereign": a, "assembly": b}) for a, b in (("1", "0"), ("0", "3"))]
    frame = spark.createDataFrame([("1|single|0", t) for t in [*both, ""]], tables.RESPONSES)
    got = {r["indicator"]: r["prediction"] for r in answers_long(frame, DEFAULT_REGISTRY, ["sovereign", "assembly"], alone=[]).collect()}
    assert (got["sovereign"], got["assembly"]) in (("1", "0"), ("0", "3"))


def test_stream_keeps_the_last_answer(spark, tmp_path, rows_of):
    where = [str(tmp_path / n) for n in ("in", "out", "ck")]

    def run():
        run_parse_once(spark, *where, DEFAULT_REGISTRY, [], ["sovereign"]).awaitTermination()
        return rows_of(current_answers(spark, where[1]), "row_idx", "prediction")

    put_answers(tmp_path / "in", "a.json", [("1|sovereign|0", label("1")), ("2|sovereign|0", label("1")), ("2|sovereign|0", label("0")), (None, "x")], at=1_000)
    assert run() == [(1, "1"), (2, "0")]
    put_answers(tmp_path / "in", "b.json", [("1|sovereign|0", label("0")), ("3|sovereign|0", label("1"))], at=2_000)
    assert run() == [(1, "0"), (2, "0"), (3, "1")]
    # Delivered late, but written before what is known; and an empty answer that is the last one.
    put_answers(tmp_path / "in", "c.json", [("1|sovereign|0", label("1"))], at=1_500)
    put_answers(tmp_path / "in", "d.json", [("3|sovereign|0", "")], at=3_000)
    assert run() == [(1, "0"), (2, "0"), (3, None)]
    assert spark.read.parquet(where[1]).count() == 5


def test_newer_answers_of_a_batch_without_python(spark, tmp_path, capsys, rows_of):
    put_answers(tmp_path / "in", "a.json", [("1|sovereign|0", label("1")), ("2|sovereign|0", label("1")), ("2|sovereign|0", label("0")), ("3|sovereign|0", "")], at=2_000)
    batch = tables.load_responses(spark, str(tmp_path / "in"))
    arrived = batch.schema["arrived"].dataType.simpleString()
    written = spark.createDataFrame(
        [("1|sovereign|0", ((3_000_000_000, "late", 0, 0),)), ("1|sovereign|0", ((1, "f", 0, 0),)), ("2|sovereign|0", ((1_000, "f", 9, 9),))],
        f"custom_id string, answer_order struct<arrived:{arrived}>",
    )
    newer = newer_answers(batch, written)
    assert rows_of(newer, "custom_id", "text") == [("2|sovereign|0", label("0")), ("3|sovereign|0", "")]
    assert len(rows_of(newer_answers(batch, None), "custom_id")) == 3
    # A call of Python for every request took 0.1 GB over four minutes.
    newer.explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas"))
    # A lost checkpoint: the table knows all answers, so reading them again adds no row.
    for mark in ("ck", "ck-2"):
        run_parse_once(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / mark), DEFAULT_REGISTRY, [], ["sovereign"]).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3


# annotation

def asked(spark, ids):
    return spark.createDataFrame([(i, "s", f"u {i}", 0.0) for i in ids], "custom_id string, system_prompt string, user_prompt string, temperature double").coalesce(1)


def test_annotation_resumes_behind_the_ledger(spark, tmp_path, rows_of):
    source, out, mark, calls = (str(tmp_path / n) for n in ("in", "out", "ck", "calls"))
    os.mkdir(calls)

    def client():
        def call(system, user, temperature):
            open(os.path.join(calls, f"{user} {random.random()}"), "w").close()
            return user.upper()
        return call

    for part in (["a", "b"], ["b", "c"], ["d"], ["a", "e"]):
        asked(spark, part).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(asked(spark, ["a"]).schema).option("maxFilesPerTrigger", 1).parquet(source)

    def crash(batch, n):
        if batch == 1:
            raise InterruptedError

    with pytest.raises(StreamingQueryException):
        annotate_stream(stream(), client, out, mark, after_batch=crash).awaitTermination()
    assert rows_of(streamed_answers(spark, out, mark), "custom_id") == [("a",), ("b",), ("c",)]
    annotate_stream(stream(), client, out, mark).awaitTermination()
    assert rows_of(streamed_answers(spark, out, mark), "custom_id", "text") == [(i, f"U {i.upper()}") for i in "abcde"]
    assert len(os.listdir(calls)) == 5 and read_ledger(spark, mark).select("run").distinct().count() == 1
    asked(spark, ["e", "f"]).write.mode("append").parquet(source)
    annotate_stream(stream(), client, out, mark).awaitTermination()
    assert len(os.listdir(calls)) == 6 and streamed_answers(spark, out, mark).count() == 6


def test_an_unfinished_batch_is_written_over(spark, tmp_path, rows_of):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "ck"))
    asked(spark, ["a"]).write.parquet(source)
    stream = lambda: spark.readStream.schema(asked(spark, ["a"]).schema).parquet(source)
    annotate_stream(stream(), lambda: lambda *a: "x", out, mark).awaitTermination()
    run = read_ledger(spark, mark).first()["run"]
    # A folder as a crash leaves it: there, but not in the ledger.
    spark.read.parquet(f"{out}/run={run}/batch=0").write.parquet(f"{out}/run={run}/batch=1")
    assert streamed_answers(spark, out, mark).count() == 1
    asked(spark, ["b"]).write.mode("append").parquet(source)
    annotate_stream(stream(), lambda: lambda *a: "y", out, mark).awaitTermination()
    assert rows_of(streamed_answers(spark, out, mark), "custom_id", "text") == [("a", "x"), ("b", "y")]


# usage

def test_late_rows_are_counted(spark, tmp_path, rows_of):
    schema = "call_id long, ts timestamp, model string, input_tokens long, output_tokens long, cached_tokens long, thinking_tokens long"
    (tmp_path / "in").mkdir()
    seen = []

    def deliver(name, *calls):
        lines = [json.dumps({"call_id": i, "ts": f"2024-01-{d:02d}T{h:02d}:00:00Z", "model": "m", **dict.fromkeys(C.TOKENS, 1)}) for i, d, h in calls]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        run_counted_usage(stream, "call_id", f"{tmp_path}/out", f"{tmp_path}/ck", lambda batch, late, read: seen.append((late, read)))

    deliver("a.json", (1, 1, 10), (2, 2, 10), (2, 2, 10))
    deliver("b.json", (3, 1, 11), (4, 1, 12), (5, 2, 9), (6, 2, 10), (7, 3, 0))
    deliver("c.json", (8, 5, 0), (9, 2, 22))
    assert seen == [(0, 3), (3, 5), (1, 2)]
    deliver("d.json", (10, 9, 0))
    out = spark.read.parquet(f"{tmp_path}/out").select(F.date_format("window_start", "dd").alias("d"), "calls")
    # Call 2 came twice and counts once; the calls behind the watermark are in no total.
    assert rows_of(out) == [("01", 1), ("02", 2), ("03", 1), ("05", 1)]


def test_progress_is_observed_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ok")] * 3 + [("a", "error"), ("b", "error"), (None, "ok"), ("c", None), ("z", "ok")], "indicator string, status string")
    counted, seen = C.observed_progress(rows, ["a", "b", "c", "none", None])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "")
    counted.write.parquet(f"{tmp_path}/t")
    jobs = tracker.getJobIdsForGroup("observed")
    got = C.progress_of(seen, ["a", "b", "c", "none", None])
    assert got == [("a", 4, 3, 1, 0.75), ("b", 1, 0, 1, 0.0), ("c", 1, 0, 0, None), (None, 1, 1, 0, 1.0)]
    assert seen.get["total"] == 8 and len(jobs) == len(tracker.getJobIdsForGroup("observed")) == 1
    spark.sparkContext._jsc.clearJobGroup()


# repairs

def test_a_good_repair_is_not_lost_beside_a_failed_one(spark, rows_of):
    old = spark.createDataFrame([(1, None, 10), (2, "0", 50), (3, None, 10), (4, None, 10)], "row_idx int, a_prediction string, a_confidence int")
    fresh = spark.createDataFrame(
        [(1, 1, "1", 80, 1), (1, 1, "2", -1, 2), (2, 0, "1", 90, 1), (3, 1, "1", None, 1), (4, 1, "1", 70, 2), (4, 1, "9", 70, 1)],
        "row_idx int, _failed_a int, a_prediction string, a_confidence int, attempt int",
    )
    got = P.upsert_indicators(old, fresh, ["a"], order="attempt")
    assert rows_of(got) == [(1, "1", 80), (2, "0", 50), (3, None, 10), (4, "1", 70)]
    assert rows_of(P.upsert_indicators(old, fresh, ["a"]).where("row_idx < 4")) == [(1, "1", 80), (2, "0", 50), (3, None, 10)]
    assert rows_of(P.upsert_indicators(old, fresh, ["b"])) == rows_of(old)


def test_each_indicator_takes_its_own_repair(spark, rows_of):
    old = spark.createDataFrame([(1, None, 10, None, 10)], "row_idx int, a_prediction string, a_confidence int, b_prediction string, b_confidence int")
    fresh = spark.createDataFrame(
        [(1, 1, 1, 1, "1", 80, "x", -1), (1, 2, 1, 1, "2", -1, "5", 60)],
        "row_idx int, attempt int, _failed_a int, _failed_b int, a_prediction string, a_confidence int, b_prediction string, b_confidence int",
    )
    assert rows_of(P.upsert_indicators(old, fresh, ["a", "b"], order="attempt")) == [(1, "1", 80, "5", 60)]


def files_of(folder):
    return {d: set(f for f in os.listdir(os.path.join(folder, d)) if f.endswith(".parquet")) for d in os.listdir(folder) if "=" in d}


def test_untouched_ranges_keep_their_files(spark, tmp_path, rows_of):
    folder = str(tmp_path / "t")
    rows = spark.range(1000).select(F.col("id").alias("row_idx"), F.lit("old").alias("v"), F.lit(5).alias("confidence"))
    rows = rows.unionByName(spark.createDataFrame([(None, "old", 5), (-1, "old", 5)], "row_idx long, v string, confidence int"))
    ranged.save_ranged(rows, folder, width=100)
    before = files_of(folder)
    assert len(before) == 12
    again = spark.createDataFrame(
        [(150, "new", 9, 1), (150, "bad", -1, 2), (151, "bad", None, 1), (720, "first", 9, 1), (720, "last", 9, 2), (850, "bad", -1, 1), (5000, "stray", 9, 1), (-1, "neg", 9, 1)],
        "row_idx long, v string, confidence int, attempt int",
    )
    assert ranged.upsert_stored(spark, folder, again, "attempt", confidence="confidence") == [-1, 1, 7, 50]
    after = files_of(folder)
    assert {d for d in before if before[d] != after[d]} == {"range_of_100=1", "range_of_100=7", "range_of_100=-1"} and set(after) == set(before)
    got = ranged.read_ranged(spark, folder)
    assert rows_of(got.where("v <> 'old'"), "row_idx", "v") == [(-1, "neg"), (150, "new"), (720, "last")] and got.count() == 1002
    assert ranged.upsert_stored(spark, folder, again.limit(0), "attempt") == []
    null = spark.createDataFrame([(None, "nobody", 9, 1)], again.schema)
    ranged.upsert_stored(spark, folder, null, "attempt")
    assert rows_of(ranged.read_ranged(spark, folder).where("row_idx is null"), "v") == [("nobody",)]
    with pytest.raises(ValueError):
        ranged.upsert_stored(spark, folder, again.withColumn("other", F.lit(1)), "attempt")
    with pytest.raises(ValueError):
        ranged.range_column(rows)


# results and chunks

def test_text_results_are_in_order(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(20_000).select(F.col("id").alias("row_idx"), F.repeat(F.lit("x"), F.when(F.col("id") > 15_000, 40).otherwise(1)).alias("v"))
        sinks.save_results(rows.repartition(7), f"{tmp_path}/out", order="row_idx")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for kind in ("csv", "json"):
        files = sorted(f for f in os.listdir(tmp_path / "out" / kind) if f.startswith("part"))
        lines = [x for f in files for x in (tmp_path / "out" / kind / f).read_text().splitlines()]
        ids = [json.loads(x)["row_idx"] if kind == "json" else int(x.split(",")[0]) for x in lines if not x.startswith("row_idx")]
        assert len(files) >= 4 and ids == list(range(20_000))


def next_fit(sizes, cap):
    out, chunk, fill = [], -1, None
    for s in sizes:
        if fill is None or fill + s > cap:
            chunk, fill = chunk + 1, 0
        fill += s
        out.append(chunk)
    return out


@pytest.mark.parametrize("sizes,cap", [
    ([5] * 20, 10), ([3, 9, 1, 1, 30, 2, 2, 2, 5], 10), ([0, 0, 10, 0, 1], 10), ([40, 40, 40], 10), ([1], 10), ([], 10),
    ([random.Random(4).randint(0, 50) for _ in range(700)], 90), ([100] + [random.Random(5).randint(1, 9) for _ in range(300)] + [500, 1], 60),
])
def test_next_fit_as_one_pass_does_it(spark, monkeypatch, sizes, cap):
    monkeypatch.setattr(R, "ROWS_PER_BLOCK", 50)
    frame = spark.createDataFrame([(i // 3, i % 3, s, "kept") for i, s in enumerate(sizes)], "row_idx long, sc_idx int, n_bytes long, note string")
    got = sorted((r["row_idx"], r["sc_idx"], r["chunk"]) for r in R.next_fit_chunks(frame.repartition(3), cap).collect())
    assert [g[2] for g in got] == next_fit(sizes, cap)
    assert R.next_fit_chunks(frame, cap).columns == [*frame.columns, "chunk"]
