import json

import pytest
from pyspark.sql import functions as F

from quorate.functions import answers as A
from quorate.functions import scoring as S
from quorate.functions import templates as T
from quorate.functions import values as X
from quorate.registry import DEFAULT_REGISTRY, Indicator, Registry, string_array

c = F.col


def one(spark, schema, rows, *cols):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [tuple(r) for r in df.select(*cols).collect()]


def test_extract_json(spark):
    cases = [
        ('{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": {"b": 1}}\n```', '{"a": {"b": 1}}'),
        ('before {"a": {"b": 1}, "c": 2} after {x}', '{"a": {"b": 1}, "c": 2}'),
        ('{"a": {"b": 1}, "c": "cut', '{"a": {"b": 1}'),
        ("no object", "no object"),
        ("{ never closed", "{ never closed"),
        ("", ""),
        (None, None),
        ("{}{}", "{}"),
        ("}{", "}{"),
    ]
    got = one(spark, "t string", [(t,) for t, _ in cases], A.extract_json_text(c("t")))
    assert [g[0] for g in got] == [w for _, w in cases]


def test_parse_answer(spark):
    texts = [
        'x {"a": "b{r", "n": null, "l": [1, "2"], "d": {"k": 1}} y {z}',
        '{"a": 1, "a": 2}',
        "{'a': 1}",
        '{"a": 1',
        "[1, 2]",
        "",
    ]
    got = [r[0] for r in one(spark, "t string", [(t,) for t in texts], A.last_key_wins(A.parse_answer(c("t"))))]
    assert got[0] == {"a": "b{r", "n": None, "l": '[1,"2"]', "d": '{"k":1}'}
    assert got[1] == {"a": "2"}
    assert got[2:] == [None, None, None, None]


def read(spark, objects, indicator, labels):
    texts = [(o if isinstance(o, str) else json.dumps(o),) for o in objects]
    ind = F.lit(indicator)
    df = spark.createDataFrame(texts, "t string").coalesce(1).select("t", A.last_key_wins(A.parse_answer(c("t"))).alias("m"))
    df = df.select("t", "m", A.label_key(c("m"), ind).alias("k"), A.confidence_key(c("m"), ind).alias("ck"))
    df = df.select(
        A.read_label(A.get_key(c("m"), c("k")), string_array(labels), c("t"), c("k")),
        A.read_reasoning(c("m"), ind),
        A.read_score(A.get_key(c("m"), c("ck")), c("t"), c("ck")),
    )
    return [tuple(r) for r in df.collect()]


def test_labels(spark):
    values = [
        ("1", "1"), (1, "1"), (1.0, "1"), ("1.7", "1"), (1.7, "1"), ("2 (by election)", None), ("1 (by election)", "1"), (True, "1"), (False, "0"),
        ("true", None), ("yes", None), (None, None), (5, None), (1e20, "1"), (5e20, None), ("-0.5", "0"), (" 1", "1"), ("1d", "1"), ("0x1p3", "0"), ("inf", None), ("", None),
        ([1], "[1]"), (["1", "7"], "[1]"), ([7], None), ('["0", "1"]', "[0, 1]"), ({"x": 1}, None),
    ]
    got = read(spark, [{"s": v} for v, _ in values], "s", ["0", "1"])
    assert [g[0] for g in got] == [w for _, w in values]


def test_label_under_other_key(spark):
    got = read(spark, [{"s_prediction": "1"}, {"s": None, "s_prediction": 0}, {"s": "9", "s_prediction": "1"}], "s", ["0", "1"])
    assert [g[0] for g in got] == ["1", "0", None]


def test_multi_select_sorts_by_number(spark):
    got = read(spark, [{"s": ["10", 2, "2", "77"]}, {"s": []}], "s", [str(i) for i in range(11)])
    assert [g[0] for g in got] == ["[2, 10]", None]


def test_reasoning_first_present_key(spark):
    got = read(spark, [{"reasoning": "a", "s_reasoning": "b"}, {"s_reasoning": "b"}, {"reasoning": None, "s_reasoning": "b"}, {}], "s", ["0"])
    assert [g[1] for g in got] == ["a", "b", None, ""]


def test_confidence(spark):
    objects = [
        ({"confidence_score": 85}, 85), ({"confidence_score": "85"}, 85), ({"confidence_score": 85.5}, 85), ({"confidence_score": "85.5"}, None),
        ({"confidence_score": 0}, 1), ({"confidence_score": 250}, 100), ({"confidence_score": -3}, 1), ({"confidence_score": True}, 1),
        ({"confidence_score": "high"}, None), ({"confidence_score": None, "s_confidence": 9}, None), ({"s_confidence": 9}, 9),
        ({"s_confidence_score": 8}, 8), ({}, None), ({"confidence_score": 10**30}, 100), ({"confidence_score": "true"}, None),
    ]
    got = read(spark, [o for o, _ in objects], "s", ["0"])
    assert [g[2] for g in got] == [w for _, w in objects]


def test_documents(spark):
    base = {"constitution": 1, "document_name": "A; B", "document_types": "1; 2", "constitution_year": "c. 1240; 1291", "reasoning": "r", "confidence_score": 70}
    changes = [
        {}, {"constitution": None}, {"constitution": "yes"}, {"constitution": False}, {"constitution": "1.9"}, {"constitution": "maybe", "document_types": "x"},
        {"document_name": None}, {"document_name": "  "}, {"document_types": "1; 5"}, {"document_types": "N/A"}, {"constitution_year": "n/a"}, {"confidence_score": 0},
        {"confidence_score": "0"}, {"confidence_score": 0, "constitution_confidence_score": 55},
    ]
    texts = [(json.dumps({**base, **ch}),) for ch in changes]
    df = spark.createDataFrame(texts, "t string").coalesce(1).select("t", A.parse_answer(c("t")).alias("m"))
    got = [r[0] for r in df.select(A.read_documents(c("m"), c("t"))).collect()]
    assert [g["prediction"] for g in got[:6]] == ["1", "2", "2", "0", "1", None]
    assert (got[0]["document_name"], got[0]["document_types"], got[0]["document_years"], got[0]["confidence"]) == ("A; B", "1; 2", "1240; 1291", 70)
    assert got[6]["document_name"] == "N/A" and got[7]["document_name"] == "N/A"
    assert got[8]["document_types"] is None and got[9]["document_types"] is None
    assert got[10]["document_years"] is None
    assert [g["confidence"] for g in got[11:]] == [None, 1, 55]


def test_years(spark):
    t = "c. 1240; circa 1215;~1100; N/A ;-509; approx. 1300"
    got = one(spark, "t string", [(t,), (" ; ",), ("none known",), (None,)], X.clean_years(c("t")))
    assert [g[0] for g in got] == ["1240; 1215; 1100; N/A; -509; 1300", " ; ", "none known", None]


def test_values(spark):
    assert one(spark, "t string", [("1.0",), ("2",), ("x",), ("1e20",), (None,)], X.to_label(c("t"))) == [("1",), ("2",), ("x",), ("1e20",), (None,)]
    assert one(spark, "t string", [("élan vital",), ("",), (None,)], X.upper_first(c("t"))) == [("Élan vital",), ("",), (None,)]
    assert one(spark, "t string", [(" NA ",), ("na",), ("",), (" x\n",)], X.na_to_null(c("t"))) == [(None,), (None,), (None,), ("x",)]
    assert one(spark, "x double", [(0.0625,), (0.1235,), (0.1236,)], X.round3(c("x")))[0] == (0.062,)
    ids = X.request_id_parts(c("t"))
    assert one(spark, "t string", [("7|single|2",), ("7|a",), ("x|a|1",)], *[ids[k] for k in ("row_idx", "indicator", "sc_idx")]) == [(7, "single", 2), (None, None, None), (None, None, None)]
    assert one(spark, "a string, b string", [("x", None), ("x", ""), ("x", None)], X.row_id(c("a"), c("b")))[0] != one(spark, "a string, b string", [("x", "")], X.row_id(c("a"), c("b")))[0]


def test_provider(spark):
    models = [("gpt-4o", "openai"), ("claude-3", "anthropic"), ("US.anthropic.claude-3", "bedrock"), ("arn:aws:bedrock:x/y", "bedrock"), ("models/gemini-2", "gemini"), ("eu.meta.l", "bedrock"), ("llama", "openai"), (None, None)]
    assert [g[0] for g in one(spark, "m string", [(m,) for m, _ in models], X.provider_of(c("m")))] == [p for _, p in models]


def test_templates(spark):
    got = one(spark, "n string", [("{polity}",)], T.render('{name} {{"a"}} {name}', {"name": c("n")}))
    assert got == [('{polity} {"a"} {polity}',)]
    with pytest.raises(ValueError):
        T.render("{other}", {"name": c("n")})
    assert one(spark, "s int, e int", [(-5, None), (1, 2)], T.period_text(c("s"), c("e"))) == [("-5-unknown",), ("1-2",)]
    assert T.without_reasoning('{"a": 1, "reasoning": "why", "confidence_score": 1}') == '{"a": 1, "confidence_score": 1}'
    s = one(spark, "p string, n string, s int, e int", [("P", " N ", 1, 2), ("P", None, 1, None), ("P", "N", None, 2), ("P", "", None, None)], T.search_text(c("p"), c("n"), c("s"), c("e")))
    assert [g[0] for g in s] == ["N of P during 1-2", "P from 1", "N of P reign ended in 2", "P"]


def test_scoring(spark):
    near = [("10", "12.5", True), ("10", "13.5", False), ("10", "x", False), ("2", "2.5", True)]
    assert [g[0] for g in one(spark, "t string, a string", [n[:2] for n in near], S.near(c("t"), c("a"), 2))] == [n[2] for n in near]
    names = [("Julius Caesar", "caesar", 1), ("Ur", "Uruk", 1), ("Li Po", "nobody", 0), ("Rome", "", None), (None, "x", None)]
    assert [g[0] for g in one(spark, "t string, a string", [n[:2] for n in names], S.correctness(c("t"), c("a"), "name"))] == [n[2] for n in names]
    assert S.correctness and pytest.raises(ValueError, S.correctness, c("t"), c("a"), "other")


def test_short_answers(spark):
    texts = [('```json\n{"year": 5}\n```', "5"), ('well {"year": "7"} ok', "7"), ('{"year": null}', None), ("none", None), ("", None)]
    assert [g[0] for g in one(spark, "t string", [(t,) for t, _ in texts], A.read_field(c("t"), "year"))] == [w for _, w in texts]


def test_registry(spark, rows_of):
    assert DEFAULT_REGISTRY.dependent == {"elections": {"assembly": "2"}}
    assert "elections" not in DEFAULT_REGISTRY.independent and len(DEFAULT_REGISTRY.names) == 19
    assert DEFAULT_REGISTRY.labels("unheard") == ("0", "1")
    with pytest.raises(ValueError):
        DEFAULT_REGISTRY["unheard"]
    assert len(Indicator("x", tuple(str(i) for i in range(500))).labels) == 500  # no cap on labels
    reg = Registry([Indicator("it's", ("a'b", "c\\d"), multi_select=True)])
    assert one(spark, "i string", [("it's",), ("z",)], reg.labels_of(c("i"))) == [(["a'b", "c\\d"],), (["0", "1"],)]
    assert reg.to_df(spark).first()["labels"] == ["a'b", "c\\d"]
    assert reg.answer_schema(["it's"]).startswith("`it's` array<string>")
    spark.createDataFrame([], reg.subset([]).answer_schema([]) or "x int")
