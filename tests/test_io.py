import json
import os

import pytest
from pyspark.sql import functions as F

from quorate.operators import requests as R
from quorate.plans.answers import answers_long, self_consistency
from quorate.registry import DEFAULT_REGISTRY
from quorate.sources import sinks, tables
from quorate.streaming.responses import run_parse
from quorate.streaming.usage import run_usage, usage_windows, with_open_windows


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_load_table(spark, tmp_path, rows_of):
    csv = put(tmp_path / "r.csv", 'polity_name,leader_name,leader_first_year,leader_last_year,note\nP,"N, ""x""",-5,,a\nQ,M,3.5,9,b\n')
    df = tables.load_rulers(spark, csv)
    assert rows_of(df) == [("P", 'N, "x"', -5, None, "a"), ("Q", "M", 3, 9, "b")]
    jl = put(tmp_path / "r.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    assert tables.load_table(spark, jl, "a int").count() == 2
    for name, text, problem in (("e.csv", "a,b\n", "no rows"), ("x.txt", "a", "unsupported")):
        with pytest.raises(ValueError, match=problem):
            tables.load_table(spark, put(tmp_path / name, text))
    with pytest.raises(ValueError, match="missing"):
        tables.load_rulers(spark, put(tmp_path / "m.csv", "polity_name\nx\n"))
    bad = put(tmp_path / "bad.jsonl", '{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        tables.load_table(spark, bad, "a int").collect()
    good, broken = tables.load_jsonl_split(spark, bad, "a int")
    assert rows_of(good) == [(1,)] and rows_of(broken) == [("not json",)]


def test_conversions(spark, tmp_path):
    src = put(tmp_path / "l.csv", "a,b\né,\nü,2\n", "latin-1")
    tables.convert_charset(spark, [src], "ISO-8859-1", f"{tmp_path}/utf8")
    assert {r["a"] for r in spark.read.option("header", True).csv(f"{tmp_path}/utf8").collect()} == {"é", "ü"}
    tables.csv_to_jsonl(spark, put(tmp_path / "u.csv", "a,b\né,\n"), f"{tmp_path}/jl")
    lines = [l for f in os.listdir(tmp_path / "jl") if f.endswith(".json") for l in (tmp_path / "jl" / f).read_text().splitlines()]
    assert json.loads(lines[0]) == {"a": "é", "b": None}


def test_results_and_logs(spark, tmp_path, rows_of):
    df = spark.createDataFrame([(2, ["a", "b"], None), (1, [], {"k": "v"})], "row_idx int, l array<string>, m map<string,string>")
    sinks.save_results(df, f"{tmp_path}/out", order="row_idx")
    assert rows_of(spark.read.option("header", True).csv(f"{tmp_path}/out/csv"), "row_idx", "l") == [("1", None), ("2", "a; b")]
    assert spark.read.json(f"{tmp_path}/out/json").count() == 2 and spark.read.parquet(f"{tmp_path}/out/parquet").count() == 2
    with pytest.raises(ValueError):
        sinks.save_results(df, f"{tmp_path}/out2", ["xml"])
    for n in (1, 2):
        sinks.log_run(spark, f"{tmp_path}/log", f"run{n}", "manifest", {"rows": n})
    assert {r["facts"]["rows"] for r in spark.read.parquet(f"{tmp_path}/log").collect()} == {"1", "2"}
    sinks.save_for_reprocessing(df.drop("l", "m"), f"{tmp_path}/again", ["row_idx"])
    with pytest.raises(ValueError):
        sinks.save_for_reprocessing(df, f"{tmp_path}/again", ["nope"])
    sinks.export_analysis({"a": df, "b": df}, f"{tmp_path}/x")
    assert sorted(os.listdir(tmp_path / "x")) == ["a", "b"]


def test_append_and_resume(spark, tmp_path, rows_of):
    path = f"{tmp_path}/done"
    sinks.append_new(spark.createDataFrame([(1, "a"), (2, "a")], "row_idx int, v string"), path)
    sinks.append_new(spark.createDataFrame([(2, "b"), (3, "b")], "row_idx int, v string"), path)
    assert rows_of(spark.read.parquet(path)) == [(1, "a"), (2, "a"), (3, "b")]


def documents(spark):
    rows = [(i, f"P{i}", "N" * (i * 40), i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "row_idx long, polity_name string, leader_name string, leader_first_year int, leader_last_year int")
    p = R.prompts(df, DEFAULT_REGISTRY, ["sovereign", "assembly", "constitution"])
    return R.request_document(R.expand_samples(p, R.temperatures(1)), ["row_idx", "polity_name"])


def test_request_files(spark, tmp_path):
    docs, cap = documents(spark), 20_000
    sinks.save_request_chunks(docs, f"{tmp_path}/req", cap, n_shards=2)
    sizes = {d: sum(os.path.getsize(tmp_path / "req" / d / f) for f in os.listdir(tmp_path / "req" / d) if f.startswith("part")) for d in os.listdir(tmp_path / "req") if d.startswith("chunk=")}
    assert len(sizes) > 2 and max(sizes.values()) <= cap
    back = tables.load_requests(spark, f"{tmp_path}/req", 1)
    assert back.count() == docs.count() and back.where("row_idx is null or sc_idx is null").count() == 0
    assert R.embedded_rows(back, "polity_name string").count() == 30
    with pytest.raises(ValueError):
        tables.load_requests(spark, f"{tmp_path}/req", 3)


def test_retry_requests_are_whole_lines(spark, tmp_path):
    docs = documents(spark).where("row_idx = 3")
    sinks.save_requests(docs, f"{tmp_path}/retry")
    assert tables.load_requests(spark, f"{tmp_path}/retry", 1).count() == docs.count() == 4


def test_indicator_lists_from_requests(spark):
    """Combined answers whose indicator list comes from the request table, next to prompts of their own."""
    docs = documents(spark).where("row_idx < 3")
    single = json.dumps({"sovereign": "1", "assembly": 3, "sovereign_confidence": 50})
    doc = json.dumps({"constitution": 2, "document_name": "X", "document_types": "2", "constitution_year": "1800"})
    responses = docs.select("custom_id", F.when(F.col("custom_id").contains("single"), single).otherwise(doc).alias("text"))
    long = answers_long(responses, DEFAULT_REGISTRY, requests=docs)
    assert long.count() == 3 * 2 * 3
    rows = docs.select("row_idx").distinct()
    wide = self_consistency(rows, responses, DEFAULT_REGISTRY, ["sovereign", "assembly", "constitution"], 1, requests=docs)
    r = wide.first()
    assert (r["sovereign_prediction"], r["assembly_prediction"], r["constitution_prediction"]) == ("1", "3", "2")
    assert r["constitution_year_SC2"] == "1800" and r["sovereign_confidence_SC1"] == 50 and wide.count() == 3


def test_extra_slot_fields(spark):
    responses = spark.createDataFrame([("1|sovereign|0", '{"sovereign": 1, "sources": "s"}')], tables.RESPONSES)
    out = answers_long(responses, DEFAULT_REGISTRY, alone=["sovereign"], combined=[], extra=lambda m: F.try_element_at(m, F.lit("sources")))
    assert out.first()["extra"] == "s"


def test_unreadable_ids_are_left_out(spark):
    responses = spark.createDataFrame([("x", "{}"), ("1|sovereign|0", None), ("2|sovereign|0", "junk")], tables.RESPONSES)
    got = {r["row_idx"]: r["prediction"] for r in answers_long(responses, DEFAULT_REGISTRY).collect()}
    assert got == {1: None, 2: None}


def test_response_errors(spark, tmp_path, rows_of):
    path = put(tmp_path / "r.jsonl", '{"custom_id": "1|a|0", "text": "t"}\n{"custom_id": "2|a|0", "error": "quota", "text": "x"}\n{"custom_id": "3|a|0"}\n')
    assert rows_of(tables.load_responses(spark, path), "custom_id", "text") == [("1|a|0", "t"), ("2|a|0", ""), ("3|a|0", "")]


def test_stream_parse_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where = [str(tmp_path / n) for n in ("in", "out", "ck")]
    put(tmp_path / "in" / "a.json", '{"custom_id": "1|sovereign|0", "text": "{\\"sovereign\\": 1}"}\n')
    run_parse(spark, *where, DEFAULT_REGISTRY, [], ["sovereign"]).awaitTermination()
    put(tmp_path / "in" / "b.json", '{"custom_id": "2|sovereign|0", "text": "broken {"}\n')
    q = run_parse(spark, *where, DEFAULT_REGISTRY, [], ["sovereign"])
    q.awaitTermination()
    assert sum(p["numInputRows"] for p in q.recentProgress) == 1
    got = {r["row_idx"]: r["prediction"] for r in spark.read.parquet(where[1]).collect()}
    assert got == {1: "1", 2: None}


def test_stream_usage_drops_late_rows(spark, tmp_path, rows_of):
    schema = "ts timestamp, model string, input_tokens long, output_tokens long, cached_tokens long, thinking_tokens long"

    def add(name, *days):
        lines = [json.dumps({"ts": f"2024-01-{d:02d}T10:00:00Z", "model": "m", "input_tokens": 1, "output_tokens": 1, "cached_tokens": 0, "thinking_tokens": 0}) for d in days]
        put(tmp_path / "in" / name, "\n".join(lines) + "\n")

    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = run_usage(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination()
        return q

    add("a.json", 1, 1, 2, 4)
    run()
    add("b.json", 1, 5)
    q = run()
    late = sum(o.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for o in p["stateOperators"])
    out = spark.read.parquet(f"{tmp_path}/out").select(F.date_format("window_start", "dd").alias("d"), "calls")
    assert rows_of(out) == [("01", 2), ("02", 1), ("04", 1)] and late == 1
    batch = usage_windows(spark.read.schema(schema).json(str(tmp_path / "in")))
    assert batch.count() == 4


def test_shared_folder_follows_the_session(spark):
    from quorate import session

    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = session.run_folder(spark, "x")
    assert folder.startswith((named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/"))


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path, rows_of):
    src = put(tmp_path / "latin.csv", 'a,b\n"x\ny","say ""hé"", ok"\n', "ISO-8859-1")
    tables.convert_charset(spark, [src], "ISO-8859-1", f"{tmp_path}/utf8.csv")
    assert rows_of(tables.load_table(spark, f"{tmp_path}/utf8.csv")) == [("x\ny", 'say "hé", ok')]


def test_append_takes_one_row_per_key(spark, tmp_path):
    frame = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "row_idx int, v string")
    sinks.append_new(frame, f"{tmp_path}/t")
    sinks.append_new(frame, f"{tmp_path}/t")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == [(1, "a"), (2, "c")]


def test_stream_usage_keeps_open_windows(spark, tmp_path, rows_of):
    schema = "ts timestamp, model string, input_tokens long, output_tokens long, cached_tokens long, thinking_tokens long"
    (tmp_path / "in").mkdir()

    def seen(name, *days):
        lines = [json.dumps({"ts": f"2024-01-{d:02d}T{h}:00:00Z", "model": m, "input_tokens": 1, "output_tokens": 1, "cached_tokens": 0, "thinking_tokens": 0}) for d, h, m in days]
        put(tmp_path / "in" / name, "\n".join(lines) + "\n")
        run_usage(spark.readStream.schema(schema).json(str(tmp_path / "in")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        usage = spark.read.schema(schema).json(str(tmp_path / "in"))
        both = with_open_windows(spark.read.schema(usage_windows(usage).schema).parquet(f"{tmp_path}/out"), usage)
        assert both.columns == usage_windows(usage).columns
        return rows_of(both.select(F.date_format("window_start", "dd").alias("d"), "model", "calls"))

    assert seen("a.json", (1, 10, "m")) == [("01", "m", 1)]
    assert seen("b.json", (2, 10, "m"), (2, 11, "n"), (4, 10, "m")) == [("01", "m", 1), ("02", "m", 1), ("02", "n", 1), ("04", "m", 1)]
    # The late row of day 2 stays dropped; day 4 is written once it is final, not twice.
    assert seen("c.json", (2, 12, "m"), (4, 12, "m"), (5, 10, "n")) == [("01", "m", 1), ("02", "m", 1), ("02", "n", 1), ("04", "m", 2), ("05", "n", 1)]
