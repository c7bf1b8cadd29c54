import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorate.operators import votes as V

SCHEMA = "row_idx long, indicator string, sc_idx int, prediction string"


def expected(votes):
    """The rule, restated: earliest vote among those with the highest count."""
    votes = [v for v in votes if v]
    if not votes:
        return None, 0.0, "high"
    label, top = Counter(votes).most_common(1)[0]
    if top == len(votes):
        return label, 1.0, "none"
    return (label, top / len(votes), "low") if top >= 2 else (votes[0], 1 / len(votes), "high")


CASES = {
    1: ["1", "1", "1"],
    2: ["1", "0", "0"],
    3: ["2", "1", "0"],
    4: [None, "1", "0"],
    5: [None, None, None],
    6: ["1", None, None],
    7: ["0", "1", "1", "0"],
    8: ["", "3", "3"],
    9: ["[2, 4]", "[2, 4]", "[2]"],
}


def frame(spark, cases):
    rows = [(k, "a", i, v) for k, votes in cases.items() for i, v in enumerate(votes)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    return {r["row_idx"]: (r["prediction"], r["agreement"], r["uncertainty"]) for r in df.collect()}


def test_rule(spark):
    want = {k: expected(v) for k, v in CASES.items()}
    assert got(V.majority_vote(frame(spark, CASES))) == want
    assert got(V.slot_vote(frame(spark, CASES), 4)) == want
    assert got(V.slot_vote(frame(spark, CASES), 12)) == want
    lettered = {k: v for k, v in CASES.items() if k != 9}
    assert got(V.slot_vote(frame(spark, lettered), 4, ["0", "1", "2", "3"])) == {k: expected(v) for k, v in lettered.items()}


def test_lone_vote_is_unanimous(spark):
    assert got(V.majority_vote(frame(spark, {1: ["4"]})))[1] == ("4", 1.0, "none")


def test_vote_outside_labels_is_a_failed_vote(spark):
    assert got(V.slot_vote(frame(spark, {1: ["9", "1", "9"]}), 3, ["0", "1"]))[1] == ("1", 1.0, "none")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["0", "1", "2", None]), min_size=1, max_size=6), min_size=1, max_size=40), st.integers(1, 9))
def test_any_votes_any_partitioning(spark, groups, parts):
    cases = dict(enumerate(groups))
    votes = frame(spark, cases).repartition(parts)
    want = {k: expected(v) for k, v in cases.items()}
    assert got(V.majority_vote(votes)) == want
    assert got(V.slot_vote(votes, 6)) == want


def test_hot_key(spark):
    """One key with a third of all votes."""
    cold = spark.range(20_000).select((F.col("id") % 5000).alias("row_idx"), F.lit("a").alias("indicator"), (F.col("id") / 5000).cast("int").alias("sc_idx"), (F.col("id") % 3).cast("string").alias("prediction"))
    hot = spark.range(10_000).select(F.lit(-1).cast("long").alias("row_idx"), F.lit("a").alias("indicator"), F.col("id").cast("int").alias("sc_idx"), F.when(F.col("id") % 3 == 0, "7").otherwise((F.col("id") % 2).cast("string")).alias("prediction"))
    out = got(V.majority_vote(cold.unionByName(hot)))
    assert len(out) == 5001
    assert out[-1] == ("7", 3334 / 10_000, "low")


def test_pivot_and_back(spark, rows_of):
    votes = frame(spark, {k: (v + [None] * 4)[:4] for k, v in CASES.items()})
    wide = V.slot_pivot(votes, 4)
    assert wide.columns == ["row_idx", "indicator", *[f"prediction_SC{i}" for i in range(1, 5)]]
    assert rows_of(V.unpivot_slots(wide, 4)) == rows_of(votes, "row_idx", "indicator", "sc_idx", "prediction")


def test_distribution(spark):
    d = {r["row_idx"]: r["distribution"] for r in V.vote_distribution(frame(spark, CASES)).collect()}
    assert d[7] == {"0": 2, "1": 2} and d[4] == {"0": 1, "1": 1} and 5 not in d


def test_reasons_of_agreeing_votes(spark, rows_of):
    rows = [(1, "a", 0, "0", "x"), (1, "a", 1, "1", "first"), (1, "a", 2, "1", ""), (1, "a", 3, "1", "second"), (1, "a", 4, "1", "third")]
    votes = spark.createDataFrame(rows, SCHEMA + ", reasoning string")
    out = V.agreeing_reasons(votes, V.majority_vote(votes), k=2)
    assert rows_of(out, "rank", "reasoning") == [(1, "first"), (2, "second")]


def test_bucketed_votes_need_no_shuffle(spark):
    from quorate.sources.sinks import save_bucketed

    spark.sql("drop table if exists votes_bucketed")
    save_bucketed(frame(spark, CASES), "votes_bucketed", ["row_idx", "indicator"], 4)
    plan = V.slot_vote(spark.table("votes_bucketed"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = V.majority_vote(spark.table("votes_bucketed"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("drop table votes_bucketed")


@pytest.mark.parametrize("n", [1, 2, 3])
def test_wide_results_columns(spark, n):
    from quorate.plans.answers import wide_results

    rows = [(1, i, s, "1", "r", 50, None, None, None) for i in ("sovereign", "constitution") for s in range(n)]
    long = spark.createDataFrame(
        rows, "row_idx long, indicator string, sc_idx int, prediction string, reasoning string, confidence int, document_name string, constitution_year string, document_types string"
    )
    cols = wide_results(long, ["sovereign", "constitution"], n - 1).columns
    if n == 1:
        assert cols[:4] == ["row_idx", "sovereign_prediction", "sovereign_reasoning", "sovereign_confidence"]
        assert cols[-3:] == ["constitution_document_name", "constitution_year", "constitution_document_types"]
    else:
        assert cols[1] == "sovereign_prediction" and f"sovereign_confidence_SC{n}" in cols
        assert f"constitution_year_SC{n}" in cols and f"constitution_reasoning_SC{n}" not in cols
        assert cols[-2:] == ["constitution_agreement", "constitution_uncertainty"]
