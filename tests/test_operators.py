import json
import math

import pytest
from pyspark.sql import functions as F

from quorate.functions.answers import parse_answer
from quorate.operators import context as C
from quorate.operators import cost as K
from quorate.operators import dependent as D
from quorate.operators import logprobs as L
from quorate.operators import metrics as M
from quorate.operators import probe as B
from quorate.operators import quality as Q
from quorate.operators import repair as P
from quorate.operators import requests as R
from quorate.operators import rollup as U
from quorate.operators import rows as W
from quorate.operators import verify as V
from quorate.operators.annotate import annotate
from quorate.registry import DEFAULT_REGISTRY, Indicator, Registry, local_frame, prices_df

c = F.col


# metrics

def pairs(spark, rows):
    return spark.createDataFrame([("i", t, p) for t, p in rows], "indicator string, truth string, prediction string")


def test_confusion_matrix(spark):
    counts = M.pair_counts(pairs(spark, [("0", "0"), ("0", "1"), ("1", "1"), ("1", None), (None, "1"), ("5", "0")]))
    reg = Registry([Indicator("i", ("0", "1"))])
    cells = {(r["truth"], r["prediction"]): r["n"] for r in M.confusion_matrix(counts, reg, ["i"]).collect()}
    assert cells == {("0", "0"): 1, ("0", "1"): 1, ("1", "0"): 0, ("1", "1"): 1}


def test_two_macro_averages(spark):
    """A class seen only in predictions counts in one of them."""
    s = M.summary(M.pair_counts(pairs(spark, [("0", "0"), ("0", "0"), ("1", "2")]))).first()
    assert math.isclose(s["macro_f1"], 0.5) and math.isclose(s["observed_macro_f1"], 1 / 3)
    assert s["n_classes"] == 3 and s["binary_f1"] is None and math.isclose(s["weighted_f1"], 2 / 3)


def test_binary_positive_is_last_label(spark):
    s = M.summary(M.pair_counts(pairs(spark, [("0", "0"), ("1", "1"), ("1", "0"), ("0", "0")]))).first()
    assert (s["binary_precision"], s["binary_recall"]) == (1.0, 0.5) and math.isclose(s["binary_f1"], 2 / 3)


def test_kappa_edges(spark):
    def kappa(rows):
        return M.cohens_kappa(M.pair_counts(pairs(spark, rows))).first()["kappa"]

    assert kappa([("1", "1")] * 3) == 1.0
    assert kappa([("0", "0"), ("1", "1"), ("2", "2")]) == 1.0
    assert math.isclose(kappa([("0", "0"), ("0", "1"), ("1", "0"), ("1", "1")]), 0.0)


def test_row_accuracy_without_pairs_is_null(spark):
    df = spark.createDataFrame([(1, "1.0", "1", None, "0"), (2, None, "1", None, None)], "row_idx int, a string, a_prediction string, b string, b_prediction string")
    got = {r["row_idx"]: (r["correct"], r["total"], r["row_accuracy"]) for r in M.row_accuracy_wide(df, ["a", "b"]).collect()}
    assert got == {1: (1, 1, 1.0), 2: (0, 0, None)}
    long = {r["row_idx"]: (r["correct"], r["total"], r["row_accuracy"]) for r in M.row_accuracy(M.stack_indicators(df, ["a", "b"])).collect()}
    assert long == got


# checks and repair

def test_quality_flags(spark):
    rows = [(1, "1", 50, "A; B", "1; 2", "1200", "long enough"), (2, "2", 50, "A", "1", "<NA>", "x"), (3, None, None, "", "", "", None), (4, "0", -1, None, None, None, "fine text"), (5, "1", 5, "customary LAW", "1; y", "1; 2", "fine text")]
    df = spark.createDataFrame(rows, "row_idx int, constitution_prediction string, constitution_confidence int, constitution_document_name string, constitution_document_types string, constitution_year string, constitution_reasoning string")
    out = Q.failed_rows(df, "constitution", min_confidence=30, min_reasoning_length=5, uncodified=True)
    got = {r["row_idx"]: set(r["failed_checks"]) for r in out.collect()}
    assert got == {
        1: {"document_lists_differ", "document_type_mismatch"},
        2: {"document_year_missing", "document_lists_differ", "document_type_mismatch", "reasoning_short"},
        3: {"confidence_missing", "prediction_missing", "reasoning_short"},
        4: {"confidence_negative"},
        5: {"confidence_low", "document_uncodified", "document_lists_differ"},
    }


def test_quality_legacy_columns():
    found = Q.find_columns(["confidence_score_gemini", "constitution_gemini", "constitution_year"], "constitution")
    assert found["confidence"] == "confidence_score_gemini" and found["prediction"] == "constitution_gemini" and found["reasoning"] is None


def upsert_frames(spark):
    old = spark.createDataFrame([(1, "a", "old", 10), (None, "b", "old", 20), (3, "c", "old", 30), (4, "d", "old", 40)], "k int, name string, v string, conf int")
    new = spark.createDataFrame(
        [(1, "x1", 90, 0, "n"), (1, "x2", 91, 1, "n"), (1, "x3", -1, 2, "n"), (None, "y", 80, 0, "n"), (3, "z", None, 0, "n"), (9, "q", 99, 0, "n")],
        "k int, v string, conf int, attempt int, extra string",
    )
    return old, new


def test_upsert(spark, rows_of):
    old, new = upsert_frames(spark)
    out = P.upsert(old, new, "attempt", ["k"], ["v", "conf", "extra"], "conf")
    assert out.columns == ["k", "name", "v", "conf", "extra"]
    want = [(1, "a", "x2", 91, "n"), (3, "c", "old", 30, None), (4, "d", "old", 40, None), (None, "b", "y", 80, "n")]
    assert rows_of(out) == sorted(want, key=str)
    again = P.upsert(out, new, "attempt", ["k"], ["v", "conf", "extra"], "conf")
    assert rows_of(again) == rows_of(out)
    kept = P.upsert(old, new, "attempt", ["k"], ["v", "conf"], "conf", keep_failed=False)
    assert ("3" not in [r[2] for r in rows_of(kept)]) and {r[0]: r[2] for r in rows_of(kept)}[3] == "z"


def test_upsert_keys():
    assert P.find_keys(["polity_name", "leader_first_year", "leader_last_year"], ["leader_last_year", "polity_name", "leader_first_year"]) == ["polity_name", "leader_first_year", "leader_last_year"]
    with pytest.raises(ValueError):
        P.find_keys(["a"], ["a"])


def test_indicator_columns():
    cols = ["checks_prediction", "checks_local_prediction", "checks_SC1", "checks_reasoning_SC2", "checks_local_SC1", "row_idx"]
    assert P.indicator_columns(cols, "checks") == ["checks_prediction", "checks_SC1", "checks_reasoning_SC2"]


def test_later_part_wins(spark, rows_of):
    a = spark.createDataFrame([("1", "x"), ("2", "x")], "custom_id string, text string")
    b = spark.createDataFrame([("2", "y"), ("3", "y")], "custom_id string, text string")
    assert rows_of(P.later_wins([a, b])) == [("1", "x"), ("2", "y"), ("3", "y")]


def test_repair_round(spark, rows_of, tmp_path):
    from quorate.plans.repair_loop import repair_round

    table = spark.createDataFrame(
        [(1, "1", 80, "0", 70), (2, None, 80, "0", 70), (3, None, 80, "0", -1), (4, None, 10, "1", 70)],
        "row_idx int, sovereign_prediction string, sovereign_confidence int, assembly_prediction string, assembly_confidence int",
    )
    requests = spark.createDataFrame([(i, f"{i}|single|{s}") for i in range(1, 5) for s in range(2)], "row_idx int, custom_id string")
    seen = []

    def reprocess(again):
        seen.append({r["custom_id"] for r in again.collect()})
        return again.select("row_idx").distinct().select(
            "row_idx", F.lit("1").alias("sovereign_prediction"), F.when(c("row_idx") == 4, -1).otherwise(95).alias("sovereign_confidence"),
            F.lit("3").alias("assembly_prediction"), F.lit(96).alias("assembly_confidence"),
        )

    fixed = repair_round(table, requests, reprocess, ["sovereign", "assembly"], run_table=f"{tmp_path}/runs")
    assert seen[0] == {f"{i}|single|{s}" for i in (2, 3, 4) for s in range(2)}
    want = [(1, "1", 80, "0", 70), (2, "1", 95, "0", 70), (3, "1", 95, "3", 96), (4, None, 10, "1", 70)]
    assert rows_of(fixed) == want
    assert spark.read.parquet(f"{tmp_path}/runs").first()["facts"]["sovereign"] == "3"


# requests

RULERS = "row_idx long, polity_name string, leader_name string, leader_first_year int, leader_last_year int"


def rulers(spark):
    return spark.createDataFrame([(0, "P", "N {x}", -5, None), (1, "Q", "M", 10, 20)], RULERS)


def test_prompt_modes(spark):
    df = rulers(spark)
    inds = ["sovereign", "constitution", "assembly"]
    single = R.prompts(df, DEFAULT_REGISTRY, inds, "single").collect()
    assert {(r["row_idx"], r["prompt_key"], tuple(r["indicators"])) for r in single} == {(i, k, n) for i in (0, 1) for k, n in (("constitution", ("constitution",)), ("single", ("sovereign", "assembly")))}
    assert "N {x}" in single[0]["user_prompt"] and "-5-present" in single[0]["user_prompt"]
    assert R.prompts(df, DEFAULT_REGISTRY, inds, "multiple").count() == 6
    seq = R.prompts(df, DEFAULT_REGISTRY, inds, "sequential").first()
    assert seq["indicators"] == ["constitution", "sovereign", "assembly"]
    with pytest.raises(ValueError):
        R.prompts(df, DEFAULT_REGISTRY, inds, "other")
    with pytest.raises(ValueError):
        R.ordered_indicators(inds, ["sovereign"])
    assert sorted(R.ordered_indicators(inds, shuffle_seed=3)) == sorted(inds)
    plain = R.combined_system_prompt(DEFAULT_REGISTRY, ["sovereign"], reasoning=False)
    assert "_reasoning" not in plain and R.combined_system_prompt(DEFAULT_REGISTRY, ["sovereign"], version="v3") != plain


def test_no_shuffle_in_expansion(spark):
    out = R.expand_samples(R.prompts(rulers(spark), DEFAULT_REGISTRY, ["sovereign"]), R.temperatures(2))
    assert out.count() == 6 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert R.temperatures(2, [0.7, 0.8, 0.9]) == [1.0, 0.7, 0.8]


def test_request_round_trip(spark, rows_of):
    p = R.prompts(rulers(spark), DEFAULT_REGISTRY, ["sovereign", "assembly"])
    docs = R.request_document(R.expand_samples(p, R.temperatures(1)), ["row_idx", "polity_name", "leader_last_year"])
    line = json.loads(docs.orderBy("custom_id").select(R.request_line(docs)).first()[0])
    assert line["metadata"]["custom_id"] == "0|single|0" and line["metadata"]["n_samples"] == "1"
    assert json.loads(line["metadata"]["row_data"]) == {"row_idx": 0, "polity_name": "P", "leader_last_year": None}
    assert rows_of(R.embedded_rows(docs, "polity_name string, leader_last_year int")) == [(0, "P", None), (1, "Q", 20)]
    assert R.check_sample_count(docs, 1) is docs
    with pytest.raises(ValueError):
        R.check_sample_count(docs, 2)
    searching = R.request_document(R.expand_samples(p, R.temperatures(0)), search=True)
    assert R.uses_search(searching).first()[0] is True and R.uses_search(docs).first()[0] is False


@pytest.mark.parametrize("cap", [50, 1000, 100_000])
def test_chunks_keep_the_cap(spark, cap):
    df = spark.range(3000).select(c("id").alias("row_idx"), F.lit(0).alias("sc_idx"), F.when(c("id") == 7, 500).otherwise(c("id") % 40 + 1).alias("n_bytes"))
    packed = R.pack_chunks(df, cap, n_shards=3 if cap < 100_000 else None)
    assert packed.count() == 3000
    sizes = packed.groupBy("chunk").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.max("row_idx").alias("r")).collect()
    assert all(s["b"] <= cap or s["n"] == 1 for s in sizes)
    total = sum(s["b"] for s in sizes)
    if cap >= 1000:
        assert len(sizes) <= total / (cap - 500) + 2 * 3


def test_gate_and_fill(spark, rows_of):
    df = spark.createDataFrame([(1, "2"), (2, "2.0"), (3, "1"), (4, None), (5, "2")], "row_idx int, assembly_prediction string")
    todo, rest = D.split_gate(df, DEFAULT_REGISTRY, "elections")
    assert rows_of(todo, "row_idx") == [(1,), (2,), (5,)] and rows_of(rest, "row_idx") == [(3,), (4,)]
    v = spark.createDataFrame([(1, "1", 1.0, "none"), (2, None, 0.0, "high"), (3, "2", 1.0, "none")], "row_idx int, prediction string, agreement double, uncertainty string")
    got = {r["row_idx"]: r["elections_prediction"] for r in D.fill_dependent(df, v, DEFAULT_REGISTRY, "elections").collect()}
    assert got == {1: "1", 2: None, 3: "0", 4: "0", 5: None}
    with pytest.raises(ValueError):
        D.split_gate(df.drop("assembly_prediction"), DEFAULT_REGISTRY, "elections")


def test_annotate(spark):
    opened = "client"

    def open_client():
        state = {"opened": opened}

        def call(system_prompt, user_prompt, temperature):
            if "bad" in user_prompt:
                raise ValueError("refused")
            return f"{state['opened']}:{user_prompt}:{temperature}" if "text" in user_prompt else {"text": "t", "input_tokens": 3}

        return call

    df = spark.createDataFrame([("1", "s", "text", 0.5), ("2", "s", "bad", 1.0), ("3", "s", "other", 1.0)], "custom_id string, system_prompt string, user_prompt string, temperature double")
    got = {r["custom_id"]: r for r in annotate(df, open_client, 2).collect()}
    assert got["1"]["text"] == "client:text:0.5" and got["1"]["status"] == "ok" and got["1"]["input_tokens"] is None
    assert got["2"]["status"] == "error" and got["2"]["error"] == "ValueError: refused" and got["2"]["text"] is None
    assert got["3"]["input_tokens"] == 3


# rollup, rows, probe

def test_rollup_edges(spark):
    cols = "row_idx int, territorynamehistorical string, region string, name_clean string, entrydateyear int, exitdateyear int, powersharing int, sovereign int, assembly_binary int, appointment int, tenure int, exit int"
    rows = [(2, "ur", "late", "a", -50, -40, None, 0, 1, 2, 5, 0), (1, "Ur", None, None, -60, None, None, 0, 0, 1, None, 0), (3, None, "x", "b", 1, 2, 1, 1, 0, None, 11, 1)]
    out = {r["territorynamehistorical"]: r for r in U.rollup_polities(spark.createDataFrame(rows, cols), "row_idx").collect()}
    ur = out["Ur"]
    assert (ur["leader_count"], ur["region"], ur["start_year"], ur["end_year"], ur["year_range"]) == (1, "late", -60, -40, 20)
    assert (ur["powersharing"], ur["sovereign"], ur["assembly_binary"], ur["appointment"], ur["tenure"]) == (None, 0, 1, 2, 1)
    assert out[None]["tenure"] == 2 and out[None]["appointment"] is None
    with pytest.raises(ValueError):
        U.rollup_polities(spark.createDataFrame(rows, cols).drop("exit"), "row_idx")


def test_geo_mean(spark):
    df = spark.createDataFrame([("a", 2.0, 1, ""), ("a", 8.0, 2, "R"), ("a", 0.0, 3, "S"), ("b", 1.0, 4, "T"), ("", 1.0, 5, "T")], "k string, v double, o int, region string")
    got = {r["k"]: r for r in U.geo_means(df, "k", ["v"], "o", "region").collect()}
    assert math.isclose(got["a"]["geo_mean_v"], 4.0) and got["a"]["n_not_positive_v"] == 1 and got["a"]["region"] == "R" and "" not in got
    assert [r["k"] for r in U.geo_means(df, "k", ["v"], min_rows=2).collect()] == ["a"]


def test_row_index(spark):
    df = spark.range(1000).select((c("id") * 7919 % 1000).alias("id")).repartition(5)
    out = W.with_row_index(df, ["id"]).collect()
    assert sorted((r["id"], r["row_idx"]) for r in out) == [(i, i) for i in range(1000)]


def test_row_helpers(spark, rows_of):
    df = spark.createDataFrame([(0, "2.0", "x", "1789; 1791", "bad"), (1, "n/a", "7", None, "3")], "row_idx int, a_prediction string, a_confidence string, constitution_year string, start_year string")
    assert rows_of(W.fix_types(df, ["a"])) == [(0, 2, None, "1789; 1791", None), (1, None, 7, None, 3)]
    assert rows_of(W.slice_rows(df, "1"), "row_idx") == [(0,)] and rows_of(W.slice_rows(df, "1:9"), "row_idx") == [(1,)]
    assert W.drop_private(df.withColumn("_x", F.lit(1))).columns == df.columns
    with pytest.raises(ValueError):
        W.require_columns(df, ["zzz"])
    status = spark.createDataFrame([("ok", None), ("error", "e")], "status string, error string")
    assert rows_of(W.error_rows(status)) == [("error", "e")]
    assert "row_idx" in W.filter_range(df, {"row_idx": (1, 5)}, {"a_prediction": ["n/a"]}).columns


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = W.filter_range(df, {"o_orderkey": (10, 20)}, {"o_orderstatus": ["F", "O"]}).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan, plan
    assert "In(o_o" in plan and "o_totalprice" not in plan


def test_probe_never_leaks():
    years = {"entry_year", "exit_year", "tenure"}
    for q in B.QUESTIONS:
        if q.truth in years:
            assert len(years & set(q.requires)) == 1 and q.truth not in q.requires


def test_probe_fields(spark):
    df = spark.createDataFrame([(1, "P", "R", "N", "-10", "5", "NA"), (2, "na", "R", " ", "x", "5", None)], "row_idx int, polity_name string, polity_region string, leader_name string, leader_first_year string, leader_last_year string, tenure string")
    got = {r["row_idx"]: r for r in W.probe_fields(df).collect()}
    assert got[1]["tenure"] == "15" and got[2]["polity"] is None and got[2]["name"] is None and got[2]["tenure"] is None
    asked = {(r["row_idx"], r["question"]) for r in B.probe_questions(W.probe_fields(df)).collect()}
    assert len([a for a in asked if a[0] == 1]) == 6 and not [a for a in asked if a[0] == 2]


# cost, context, log-probabilities, verification

MODELS = [
    ("gpt-4o-2024", "gpt-4o"), ("GPT-4O-MINI", "gpt-4o-mini"), ("gpt-4", "gpt-4"), ("gpt-5", None), ("o1-mini-x", "o1-mini"), ("", None),
    ("arn:aws:bedrock:r:a:p/global.anthropic.claude-opus-4-5-20250514-v1:0", "global.anthropic.claude-opus-4-5-20250514-v1:0"),
]


@pytest.mark.parametrize("as_table", [False, True])
def test_prices(spark, as_table):
    df = spark.createDataFrame([(m,) for m, _ in MODELS], "model string")
    prices = prices_df(spark) if as_table else K.PRICES
    got = {r["model"]: r for r in K.price_models(df, prices).collect()}
    assert {m: r["model_prefix"] for m, r in got.items()} == dict(MODELS)
    assert float(got["gpt-5"]["input_price"]) == 5.0 and float(got["gpt-4o-2024"]["cached_price"]) == 1.25


def usage(spark):
    rows = [("gpt-4o", "a", 1_000_000, 100_000, 200_000, 50_000), ("gpt-4o", None, 1_000_000, 0, 0, 0), ("what", "b", 2_000_000, 0, None, 0)]
    return spark.createDataFrame(rows, "model string, indicator string, input_tokens long, output_tokens long, cached_tokens long, thinking_tokens long")


@pytest.mark.parametrize("as_table", [False, True])
def test_costs(spark, as_table):
    prices = prices_df(spark) if as_table else K.PRICES
    first = 2.5 + 1.0 + 0.25 + 0.5
    got = sorted(r["cost_usd"] for r in K.price_usage(usage(spark), prices).collect())
    assert all(math.isclose(a, b) for a, b in zip(got, [2.5, first, 10.0]))
    totals = {r["model"]: r for r in K.usage_totals(usage(spark), prices, batch_discount=0.5).collect()}
    assert math.isclose(totals[None]["cost_usd"], (first + 2.5 + 10) / 2) and totals[None]["calls"] == 3
    assert {r["indicator"]: round(r["cost_usd"], 6) for r in K.indicator_costs(usage(spark), prices).collect()} == {"a": round(first, 6), "b": 10.0}


def test_usage_totals_read_the_table_once(spark):
    plan = K.usage_totals(usage(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan


def test_split_cost_and_progress(spark, rows_of):
    df = spark.createDataFrame([(["a", "b", "c"], 10, 3.0)], "indicators array<string>, input_tokens long, cost_usd double")
    assert rows_of(K.split_prompt_cost(df), "indicator", "input_tokens", "cost_usd") == [("a", 3, 1.0), ("b", 3, 1.0), ("c", 3, 1.0)]
    st = spark.createDataFrame([("ok",), ("ok",), ("error",), ("open",)], "status string")
    assert tuple(K.progress(st).first()) == (4, 2, 1, 2 / 3)


def test_context_tiers(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "row_idx int")
    kind = "row_idx int, context string, urls array<string>"
    one = spark.createDataFrame([(0, "x" * 250, ["a"]), (1, "short", ["b"]), (3, "", ["z"])], kind)
    two = spark.createDataFrame([(0, "never", ["c"]), (1, "y" * 200, ["d"]), (2, "few", None)], kind)
    three = spark.createDataFrame([(1, "never", ["e"]), (2, "more", ["f"])], kind)
    got = {r["row_idx"]: tuple(r)[1:] for r in C.tiered_context(rows, [("w", one), ("d", two), ("s", three)]).collect()}
    assert got == {0: ("x" * 250, "w", "a"), 1: ("short\n" + "y" * 200, "w | d", "b | d"), 2: ("few\nmore", "d | s", "f"), 3: ("", None, None)}


def test_enrich(spark):
    got = [r[0] for r in spark.createDataFrame([("c",), ("",), (None,)], "x string").coalesce(1).select(C.enrich(F.lit("P"), c("x"), "pre ")).collect()]
    assert got == ["pre <<< notes from the context tables\nc\nnotes end >>>\n\nP", "P", "P"]


def tokens_of(text, size):
    return [(text[i : i + size], -i / 10) for i in range(0, len(text), size)]


def spot(text, indicator, labels):
    """The rule, restated with Python patterns."""
    import re

    for label in labels:
        for quote, tail in (('"', '"'), ("", r"(?!\d)")):
            m = re.search(rf'"{indicator}"\s*:\s*{quote}({label}){tail}', text)
            if m:
                return m.start(1)
    return None


def test_label_logprobs(spark):
    labels = [str(i) for i in range(11)]
    texts = ['{"s": "1", "t": 2}', '{"s": 10}', '{"s" :  "10", "x": "s"}', '{"s": "5", "n": {"s": "2"}}', '{"s": 77}', '{"s": true}', "", '{"x": "s", "s": 3}']
    rows = [(str(i), t, tokens_of(t, 3)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "custom_id string, text string, tokens array<struct<token:string,logprob:double>>")
    reg = Registry([Indicator("s", tuple(labels)), Indicator("t", ("1", "2"))])
    got = {(r["custom_id"], r["indicator"]): r["logprob"] for r in L.label_logprobs(df, reg, ["s", "t"]).collect()}
    want = {}
    for i, t in enumerate(texts):
        for ind, labs in (("s", labels), ("t", ["1", "2"])):
            p = spot(t, ind, labs)
            if p is not None:
                want[(str(i), ind)] = -(p // 3 * 3) / 10
    assert got == want and want[("3", "s")] == -(texts[3].index('"2"') + 1) // 3 * 3 / 10 * 1.0 or got == want


def test_label_beyond_the_stream(spark):
    text = '{"s": "1"}'
    at = text.index("1")
    rows = [("q", text, [(text[:at], -0.5)]), ("none", text, [(text[: at - 1], -0.5)])]
    df = spark.createDataFrame(rows, "custom_id string, text string, tokens array<struct<token:string,logprob:double>>")
    reg = Registry([Indicator("s", ("0", "1"))])
    assert [tuple(r) for r in L.label_logprobs(df, reg, ["s"]).collect()] == [("q", "s", -0.5)]


def test_alternatives(spark):
    text = '{"s": "1"}'
    toks = tokens_of(text, 2)
    cands = [[(f"c{i}", -1.0)] for i in range(len(toks))]
    df = spark.createDataFrame([("a", text, toks, cands), ("b", '{"s": "9"}', toks, cands), ("c", text, toks, cands[:2])], "custom_id string, text string, tokens array<struct<token:string,logprob:double>>, candidates array<array<struct<token:string,logprob:double>>>")
    got = [(r["custom_id"], r["alternatives"][0]["token"]) for r in L.top_alternatives(df, "s", ["0", "1"]).collect()]
    assert got == [("a", f"c{text.index(chr(34) + '1') // 2}")]


def test_decision_rules(spark):
    initial = spark.createDataFrame([(i, "sovereign", "1" if i != 6 else None, None) for i in range(7)], "row_idx int, indicator string, prediction string, reasoning string")
    texts = {0: {"decision": "CONTRADICTED", "final_prediction": "0", "confidence": 0.9}, 1: {"final_prediction": "7", "confidence": 0.9}, 2: {"final_prediction": "7", "confidence": 0.4}, 3: {}, 4: {"final_prediction": None}, 6: {"final_prediction": "0"}}
    syn = spark.createDataFrame([(i, "sovereign", json.dumps(t)) for i, t in texts.items()], "row_idx int, indicator string, t string")
    out = V.decide(initial, syn.select("row_idx", "indicator", parse_answer(c("t")).alias("parsed")), DEFAULT_REGISTRY)
    got = {r["row_idx"]: (r["prediction"], round(r["confidence"], 6), r["decision"], r["was_revised"]) for r in out.collect()}
    assert got == {
        0: ("0", 0.9, "CONTRADICTED", True), 1: ("1", 0.7, "SUPPORTED", False), 2: ("1", 0.3, "SUPPORTED", False), 3: ("1", 0.5, "SUPPORTED", False),
        4: ("1", 0.3, "SUPPORTED", False), 5: ("1", 0.3, "ERROR", False), 6: (None, 0.0, "NO_INITIAL", False),
    }


def test_synthesis_prompts(spark):
    df = spark.createDataFrame([(1, "sovereign", "1", "why")], "row_idx int, indicator string, prediction string, reasoning string")
    ev = spark.createDataFrame([(1, "sovereign", "Q: a\nA: b")], "row_idx int, indicator string, evidence string")
    text = V.synthesis_prompts(df, ev, DEFAULT_REGISTRY).first()["user_prompt"]
    assert "Q: a" in text and "0, 1" in text and "Label: 1" in text


def test_local_frame_stays_small(spark):
    df = prices_df(spark)
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString() and df.count() == len(K.PRICES)
    import pyarrow as pa

    assert local_frame(spark, {"a": pa.string()}, []).count() == 0


def test_evaluation_columns():
    from quorate.plans.evaluate import find_columns

    assert find_columns(["a", "a_prediction"], "a") == ("a", "a_prediction")
    assert find_columns(["a", "a_truth"], "a") == ("a_truth", "a")
    assert find_columns(["a_m1", "gt_a", "a_prediction"], "a", "_m1") == ("gt_a", "a_m1")
    assert find_columns(["a"], "a") is None


def test_chained_verifiers(spark, rows_of):
    from quorate.plans import verification as P

    votes = spark.createDataFrame([(1, "sovereign", i, v, "r", 50) for i, v in enumerate(["0", "1", "1"])], "row_idx long, indicator string, sc_idx int, prediction string, reasoning string, confidence int")
    assert rows_of(P.none(votes), "prediction") == [("0",)] and rows_of(P.by_vote(votes), "prediction") == [("1",)]
    rows = spark.createDataFrame([(1, "P", "N", 1, None)], RULERS)
    seen = {}

    def ask(q):
        seen["columns"] = q.columns
        return q.withColumn("answer", F.lit("fact"))

    def silent(asked):
        return asked.withColumn("text", F.lit(None).cast("string"))

    checked = P.chain(P.by_vote, P.by_questions(rows, DEFAULT_REGISTRY, ["sovereign"], R.row_slots(), ask, silent))(votes)
    assert rows_of(checked, "prediction", "confidence", "decision") == [("1", 0.3, "ERROR")]
    assert "prediction" not in seen["columns"]
    wide = P.wide_verified(checked, votes, ["sovereign"]).first()
    assert wide["sovereign_prediction"] == "1" and wide["sovereign_confidence"] == 50 and "ERROR" in wide["sovereign_verification"]


def test_analysis_tables(spark):
    from quorate.plans.evaluate import analysis_tables

    df = spark.createDataFrame([(1, "1", "0"), (2, "1", "1")], "row_idx int, sovereign string, sovereign_prediction string")
    out = analysis_tables(df, DEFAULT_REGISTRY, ["sovereign"])
    assert out["confusion"].count() == 4 and out["summary"].first()["accuracy"] == 0.5 and out["classes"].count() == 2


def test_large_registry_and_price_list():
    from quorate.registry import Indicator, Registry

    many = Registry([Indicator("country", tuple(str(i) for i in range(300)))])
    assert len(many.labels("country")) == 300


def test_duplicate_answers_vote_once(spark):
    from quorate.plans.answers import latest_responses, unreadable_ids

    frame = spark.createDataFrame([("1|single|0", "a", 2), ("1|single|0", "b", 1), ("nonsense", "c", 1)], "custom_id string, text string, received_at int")
    assert {tuple(r) for r in latest_responses(frame).collect()} == {("1|single|0", "a"), ("nonsense", "c")}
    assert {tuple(r) for r in latest_responses(frame.drop("received_at")).collect()} == {("1|single|0", "b"), ("nonsense", "c")}
    assert [r["custom_id"] for r in unreadable_ids(frame).collect()] == ["nonsense"]


def test_context_tier_with_two_rows_per_key(spark):
    from quorate.operators.context import tiered_context

    rows = spark.createDataFrame([(1,), (2,)], "row_idx int")
    tier = spark.createDataFrame([(1, "b", ["u"]), (1, "a", ["v"]), (1, "", None)], "row_idx int, context string, urls array<string>")
    got = sorted(tuple(r) for r in tiered_context(rows, [("w", tier)]).collect())
    assert len(got) == 2 and got[0][1] == "a"


def test_null_predictions_sees_missing_answers(spark, rows_of):
    asked = spark.createDataFrame([(r, s, ["a", "b"]) for r in (1, 2, 3, None) for s in (0, 1)] + [(1, 0, ["a"])], "row_idx int, sc_idx int, indicators array<string>")
    full = [(1, s, i, "0") for s in (0, 1) for i in "ab"]
    rows = full + [(2, 0, "a", "1"), (2, 0, "b", None), (2, 1, "a", "1"), (4, 0, "a", None), (None, 0, "a", "1"), (None, 0, "b", "1"), (None, 1, "b", "1")]
    answers = spark.createDataFrame(rows, "row_idx int, sc_idx int, indicator string, prediction string")
    assert rows_of(Q.null_predictions(answers)) == [(2, 1), (4, 1)]
    assert rows_of(Q.null_predictions(answers, requests=asked)) == [(2, 2), (3, 4), (None, 1)]
    assert rows_of(Q.null_predictions(answers.drop("sc_idx"), requests=asked)) == [(2, 1), (3, 2)]
