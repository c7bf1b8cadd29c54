"""VARIANT answers, answers read in their row, table functions, digests and skipped stages, jobs on a model function."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quorate.functions import variants as V
from quorate.operators import probe as B
from quorate.operators import requests as R
from quorate.plans import jobs as J
from quorate.plans.answers import answers_long, wide_answers, wide_results
from quorate.plans.manifest import digest_text, read_manifest, run_stage, table_digest
from quorate.plans.sql_functions import register_sql
from quorate.plans.variants import answer_shape, labels_from_variants
from quorate.registry import DEFAULT_REGISTRY, Indicator, Registry
from quorate.sources.tables import RESPONSES

BOTH = ["sovereign", "assembly"]
TEXTS = [
    '{"sovereign": 1, "assembly": "3"}', '{"sovereign": "true", "assembly": true}', '{"sovereign": true, "assembly": false, "sovereign_confidence": true}',
    'x {"sovereign": 1.9, "sovereign_confidence": 85.5, "assembly": null} y {z}', '{"sovereign": "1.0", "sovereign_confidence": "85.5", "assembly_confidence": "60"}',
    '{"sovereign_prediction": "0", "reasoning": null, "sovereign_reasoning": "own", "confidence_score": 250}', '{"sovereign": "1 (sure)", "assembly": " 2 "}',
    '{"sovereign": 0, "sovereign": 1}', "{'sovereign': 1}", '{"sovereign": 1', "nothing", "", None, '{"sovereign": {"a": 1}, "assembly": [1]}',
    '{"sovereign": -1, "assembly": 1e0, "assembly_confidence": 1e1}', '{"sovereign": "b}", "sovereign_reasoning": "brace { in text", "assembly": "9"}',
    '```json\n{"sovereign": "0", "assembly": 2, "assembly_reasoning": ["a", "b"]}\n```', '{"sovereign_confidence": 0, "assembly_confidence": -5}',
]


def answers_of(spark):
    return spark.createDataFrame([(f"{i}|single|0", t) for i, t in enumerate(TEXTS)], RESPONSES)


def test_variants_give_the_same_labels(spark, rows_of):
    cols = ("row_idx", "indicator", "prediction", "confidence")
    long = answers_long(answers_of(spark), DEFAULT_REGISTRY, BOTH, alone=[])
    assert rows_of(labels_from_variants(answers_of(spark), DEFAULT_REGISTRY, BOTH), *cols) == rows_of(long, *cols)
    texts = {(r["row_idx"], r["indicator"]): r["reasoning"] for r in labels_from_variants(answers_of(spark), DEFAULT_REGISTRY, BOTH).collect()}
    assert texts[(5, "sovereign")] is None and texts[(15, "sovereign")] == "brace { in text" and texts[(0, "assembly")] == ""


def test_variant_fields(spark):
    frame = spark.createDataFrame([('{"it\'s": 1, "a.b": "x", "l": [1, "2"], "n": null}',), ("[]",)], "t string").select(V.parse_variant(F.col("t")).alias("v"))
    r = frame.select(
        V.field(F.col("v"), "it's").alias("a"), V.field(F.col("v"), "a.b").alias("b"), V.field(F.col("v"), "l", "array<string>").alias("c"),
        V.has_field(F.col("v"), "n").alias("d"), V.has_field(F.col("v"), "m").alias("e"), V.simple_kind(V.kind_of(F.col("v"), "n")).alias("f"),
    ).collect()
    assert tuple(r[0]) == ("1", "x", ["1", "2"], True, False, "null") and r[1]["a"] is None
    shape = answer_shape(answers_of(spark)).first()
    assert shape["n_answers"] == len(TEXTS) and shape["shape"].startswith("OBJECT<") and "sovereign" in shape["shape"]


def test_multi_select_as_variant(spark):
    reg = Registry([Indicator("kinds", ("1", "2", "10"), multi_select=True)])
    rows = [(f"{i}|single|0", json.dumps({"kinds": v})) for i, v in enumerate((["10", 2, "2", "x"], [], ["x"], "1", None))]
    got = {r["row_idx"]: r["prediction"] for r in labels_from_variants(spark.createDataFrame(rows, RESPONSES), reg, ["kinds"]).collect()}
    assert got == {0: "[2, 10]", 1: None, 2: None, 3: "1", 4: None}


@pytest.mark.parametrize("n_samples", [0, 2])
def test_answers_read_in_their_row(spark, rows_of, n_samples):
    rows = [(f"{i // 3}|single|{i % 3}", t) for i, t in enumerate(TEXTS)] + [("0|single|0", '{"sovereign": 0}'), ("4|sovereign|0", '{"sovereign": 1}'), ("bad", "{}")]
    responses = spark.createDataFrame(rows, RESPONSES).withColumn("received_at", F.monotonically_increasing_id())
    wide = wide_answers(responses, DEFAULT_REGISTRY, BOTH, n_samples)
    long = answers_long(responses, DEFAULT_REGISTRY, BOTH, alone=[], once=False).where(~F.col("custom_id").contains("|sovereign|"))
    other = wide_results(long, BOTH, n_samples)
    assert wide.columns == other.columns and rows_of(wide) == rows_of(other)
    assert "reasoning" not in " ".join(wide_answers(responses, DEFAULT_REGISTRY, BOTH, n_samples, reasoning=False).columns)


# table functions

def test_prompts_from_sql(spark):
    register_sql(spark, DEFAULT_REGISTRY, templates={"assembly": "{name} {{x}} {period}"}, prefix="t_")
    ask = lambda names, end: spark.sql(f"select * from t_prompts({names}, 'P', 'N', 5, {end})").collect()
    got = ask("'assembly, sovereign'", "null")
    assert [r["indicator"] for r in got] == ["assembly", "sovereign"] and got[0]["user_prompt"] == "N {x} 5-present"
    assert spark.sql("select * from t_prompts('assembly', 'P', null, 5, 6)").first()["user_prompt"] is None
    for bad in ("'nobody'", "''", "cast(null as string)"):
        with pytest.raises(AnalysisException):
            ask(bad, "6")


def test_annotate_from_sql(spark):
    def client():
        def call(system, user, temperature):
            if user == "down":
                raise RuntimeError("busy")
            return {"text": user}
        return call

    reg = Registry([Indicator("a", ("0", "1")), Indicator("m", ("1", "2"), multi_select=True)])
    register_sql(spark, reg, client, prefix="s_")
    frame = spark.createDataFrame([(1, 'x {"a": 1, "m": ["2", 1], "a_confidence": 7.5, "m_reasoning": "r"} y'), (2, "down"), (3, "no json"), (4, '{"a": null, "m": "1"}')], "i int, u string")
    frame.createOrReplaceTempView("asked")
    rows = spark.sql("select i, r.* from asked, lateral s_annotate('a,m', 's', u, 0.5D) r order by i").collect()
    assert [f.simpleString() for f in spark.sql("select r.* from asked, lateral s_annotate('m', 's', u, 0.5D) r").schema][3] == "m:array<string>"
    assert (rows[0]["a"], rows[0]["m"], rows[0]["a_confidence"], rows[0]["m_reasoning"]) == ("1", ["2", "1"], 7, "r")
    assert rows[1]["status"] == "error" and rows[1]["error"] == "RuntimeError: busy" and rows[1]["a"] is None
    assert rows[2]["status"] == "ok" and rows[2]["a"] is None and (rows[3]["a"], rows[3]["m"]) == (None, ["1"])


# digests and stages

def test_digest_sees_cells_not_order(spark):
    frame = spark.createDataFrame([(1, "a", [1]), (2, None, None), (2, None, None), (3, "", [])], "i int, s string, l array<int>")
    base = digest_text(frame)
    assert digest_text(frame.repartition(3, "i").select("l", "s", "i")) == base
    assert digest_text(frame.dropDuplicates()) != base and digest_text(frame.withColumn("i", F.col("i").cast("long"))) != base
    for change in ("case when i = 3 then null else s end as s", "case when i = 1 then 'b' else s end as s"):
        assert digest_text(frame.selectExpr("i", change, "l")) != base
    # Values that move between neighbouring fields change it, too.
    two = lambda a, b: digest_text(spark.createDataFrame([(a, b)], "x string, y string"))
    assert two("ab", "c") != two("a", "bc") and two("a", None) != two(None, "a") != two("~", None)
    empty = table_digest(frame.limit(0)).first()
    assert tuple(empty) == (0, 0, 0)


def test_stages_are_skipped_while_nothing_changes(spark, tmp_path):
    folder, calls = str(tmp_path), []
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")

    def make(rows, by=1):
        calls.append(by)
        return rows.withColumn("n", F.col("i") * by)

    def run(rows, **settings):
        out, new = run_stage(spark, folder, "times", {"rows": rows}, make, settings)
        return sorted(r["n"] for r in out.collect()), new

    assert run(frame) == ([1, 2], True) and run(frame.repartition(2)) == ([1, 2], False)
    assert run(frame, by=3) == ([3, 6], True) and run(frame.where("i = 1")) == ([1], True) and run(frame) == ([1, 2], False)
    assert calls == [1, 3, 1] and read_manifest(spark, folder).count() == 3
    # A damaged output is made again.
    hurt = read_manifest(spark, folder).where("settings = '{\"by\": 3}'").first()["folder"]
    frame.withColumn("n", F.lit(0)).write.mode("overwrite").parquet(hurt)
    assert run(frame, by=3) == ([3, 6], True) and len(calls) == 4


# jobs

def test_failed_calls_are_asked_again(spark, tmp_path, rows_of):
    """A service that fails on the first call of every prompt."""
    seen = str(tmp_path)

    def client():
        import os

        def call(system, user, temperature):
            mark = os.path.join(seen, user)
            if not os.path.exists(mark) and user != "c":
                open(mark, "w").close()
                raise RuntimeError("busy")
            return '{"sovereign": 1}' if user != "b" else ""
        return call

    asked = spark.createDataFrame([(f"{i}|sovereign|0", "s", u, 0.0) for i, u in enumerate("abc")], "custom_id string, system_prompt string, user_prompt string, temperature double")
    given = J.answer_rounds(asked, client, rounds=3)
    assert rows_of(given, "custom_id", "status", "received_at") == [
        ("0|sovereign|0", "error", 1), ("0|sovereign|0", "ok", 2), ("1|sovereign|0", "error", 1), ("1|sovereign|0", "ok", 2), ("1|sovereign|0", "ok", 3), ("2|sovereign|0", "ok", 1)]
    long = answers_long(given, DEFAULT_REGISTRY, [], alone=["sovereign"])
    assert rows_of(long, "row_idx", "prediction") == [(0, "1"), (1, None), (2, "1")]
    with pytest.raises(ValueError):
        J.answer_rounds(asked, client, rounds=0)


def test_repair_goes_on_while_it_helps(spark, tmp_path, rows_of):
    """Row 2 gets a good answer in the second round only, row 3 never."""
    log = str(tmp_path)

    def client():
        import os

        def call(system, user, temperature):
            mark = os.path.join(log, user)
            first = not os.path.exists(mark)
            open(mark, "w").close()
            bad = user == "3" or (user == "2" and first)
            return '{"sovereign": "1", "sovereign_confidence": %s}' % ("null" if bad else "90")
        return call

    table = spark.createDataFrame([(1, None, 5), (2, None, 5), (3, None, 5), (4, "0", 5)], "row_idx int, sovereign_prediction string, sovereign_confidence int")
    requests = spark.createDataFrame([(i, f"{i}|single|0", "s", str(i), 0.0) for i in range(1, 5)], "row_idx int, custom_id string, system_prompt string, user_prompt string, temperature double")
    fixed = J.repair_job(table, requests, DEFAULT_REGISTRY, client, ["sovereign"], max_rounds=5, run_table=f"{tmp_path}/runs")
    assert rows_of(fixed, *table.columns) == [(1, "1", 90), (2, "1", 90), (3, None, 5), (4, "0", 5)]
    runs = spark.read.parquet(f"{tmp_path}/runs")
    assert sorted((int(r["facts"]["round"]), r["facts"].get("sovereign")) for r in runs.collect())[:3] == [(1, "3"), (2, "2"), (3, "1")]


def test_jobs_leave_earlier_results_behind(spark):
    rows = spark.createDataFrame([(1, "P", "N", 1, 2, "9")], "row_idx int, polity_name string, leader_name string, leader_first_year int, leader_last_year int, sovereign_prediction string")
    out = J.annotation_job(rows, DEFAULT_REGISTRY, ["sovereign", "constitution"], lambda: lambda *a: '{"sovereign": 1, "constitution": 2}')
    assert out.count() == 1 and out.columns.count("sovereign_prediction") == 1
    assert (out.first()["sovereign_prediction"], out.first()["constitution_prediction"]) == ("1", "2")
    assert J.split_indicators(["a", "constitution"], "single") == (["a"], ["constitution"]) and J.split_indicators(["a"], "multiple") == ([], ["a"])


def test_answers_of_one_large_task_lie_in_files_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "FILE_ROWS", 10)
    requests = spark.range(95).coalesce(1).selectExpr("cast(id as string) as custom_id", "'s' as system_prompt", "'u' as user_prompt", "0.0D as temperature")
    given = J.answer_rounds(requests, lambda: lambda s, u, t: "x", rounds=1)
    per_file = [r["count"] for r in given.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == 95 and max(per_file) <= 10


def test_dependent_and_probe_jobs_with_failures(spark, rows_of):
    table = spark.createDataFrame([(1, "P", "N", 1, 2, "2"), (2, "P", "N", 1, 2, "0"), (3, "P", "M", 1, 2, "2")], "row_idx int, polity_name string, leader_name string, leader_first_year int, leader_last_year int, assembly_prediction string")

    def client():
        def call(system, user, temperature):
            if "M" in user:
                raise RuntimeError("down")
            return '{"elections": "%d"}' % (1 if temperature else 2)
        return call

    out = J.dependent_job(table, DEFAULT_REGISTRY, "elections", client, user_template="{name}")
    assert rows_of(out, "row_idx", "elections_prediction") == [(1, "1"), (2, "0"), (3, None)]
    probed = J.probe_job(table, lambda: lambda s, u, t: '{"year": 1, "years": 1, "name": "N", "polity": "x"}')
    assert {r["question"] for r in probed["questions"].collect()} == {q.label for q in B.QUESTIONS} | {"overall"}
    assert probed["rows"].count() == 3 and probed["scored"].where("question = 'leader_name' and correct = 1").count() >= 2
