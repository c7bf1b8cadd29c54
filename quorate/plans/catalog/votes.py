"""Votes."""

from pyspark.sql import functions as F

from quorate.operators import votes as V
from quorate.plans.answers import attach_results, self_consistency, wide_results
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import EVENT_VOTES, INDICATORS, RESPONSES, VOTES, table, with_ctes
from quorate.plans.catalog.parsing import ANSWERS_CTE, JSON
from quorate.registry import DEFAULT_REGISTRY


def majority_sql(src: str) -> str:
    """CTEs that end in `verdict`."""
    return f"""c as (select row_idx, indicator, prediction, count(*) n, min(sc_idx) f from {src}
       where prediction is not null and prediction <> '' group by 1, 2, 3),
r as (select *, row_number() over (partition by row_idx, indicator order by n desc, f) rn,
       sum(n) over (partition by row_idx, indicator) tot from c),
g as (select distinct row_idx, indicator from {src}),
verdict as (select g.row_idx, g.indicator, r.prediction,
       coalesce(cast(n as double) / tot, 0.0) as agreement,
       case when n is null then 'high' when n = tot then 'none' when n >= 2 then 'low' else 'high' end as uncertainty,
       cast(coalesce(tot, 0) as bigint) as n_votes
       from g left join r on g.row_idx = r.row_idx and g.indicator = r.indicator and r.rn = 1)"""


@query("majority_vote", with_ctes([VOTES, majority_sql("votes3")], "select * from verdict"))
def majority_vote(spark, sf):
    return V.majority_vote(VOTES.df(spark, sf))


@query("majority_vote_slots", with_ctes([VOTES, majority_sql("votes3")], "select row_idx, indicator, prediction, agreement, uncertainty from verdict"))
def majority_vote_slots(spark, sf):
    labels = [str(i) for i in range(11)]
    return V.slot_vote(VOTES.df(spark, sf), 3, labels)


@query("majority_vote_many", with_ctes([EVENT_VOTES, majority_sql("event_votes")], "select * from verdict"))
def majority_vote_many(spark, sf):
    """Many ordered votes per key."""
    return V.majority_vote(EVENT_VOTES.df(spark, sf))


@query(
    "vote_distribution",
    with_ctes(
        [VOTES],
        """select row_idx, indicator, string_agg(prediction || ':' || n, '; ' order by prediction) as distribution
        from (select row_idx, indicator, prediction, cast(count(*) as varchar) n from votes3 where prediction is not null group by 1, 2, 3)
        group by 1, 2""",
    ),
)
def vote_distribution(spark, sf):
    d = V.vote_distribution(VOTES.df(spark, sf))
    text = F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return d.select("row_idx", "indicator", F.array_join(text, "; ").alias("distribution"))


_SLOTS = ", ".join(
    f"max(case when sc_idx = {i} then {f} end) as {f}_SC{i + 1}" for f in ("prediction", "reasoning", "confidence") for i in range(3)
)


@query("sc_slot_pivot", with_ctes([VOTES], f"select row_idx, indicator, {_SLOTS} from votes3 group by 1, 2"))
def sc_slot_pivot(spark, sf):
    return V.slot_pivot(VOTES.df(spark, sf), 3, fields=("prediction", "reasoning", "confidence"))


@query(
    "agreeing_reasons",
    with_ctes(
        [VOTES, majority_sql("votes3")],
        """select row_idx, indicator, cast(rn as int) as rank, reasoning from (
        select v.row_idx, v.indicator, v.reasoning, row_number() over (partition by v.row_idx, v.indicator order by v.sc_idx) rn
        from votes3 v join verdict d on v.row_idx = d.row_idx and v.indicator = d.indicator and v.prediction = d.prediction
        where v.reasoning <> '') where rn <= 2""",
    ),
)
def agreeing_reasons(spark, sf):
    votes = VOTES.df(spark, sf)
    return V.agreeing_reasons(votes, V.majority_vote(votes), k=2)


@query(
    "single_sample",
    with_ctes([VOTES], "select row_idx, indicator, prediction, reasoning, confidence from votes3 where sc_idx = 0"),
)
def single_sample(spark, sf):
    from quorate.operators.verify import no_verification

    return no_verification(VOTES.df(spark, sf)).drop("sc_idx")


def wide_sql(votes: str, names=("sovereign", "assembly")) -> str:
    """Wide columns of some indicators over `votes` v and `verdict` d."""
    cols = [f"max(case when v.indicator = '{i}' then d.prediction end) as {i}_prediction" for i in names]
    for i in names:
        for f, n in (("prediction", ""), ("reasoning", "_reasoning"), ("confidence", "_confidence")):
            cols += [f"max(case when v.indicator = '{i}' and v.sc_idx = {k} then v.{f} end) as {i}{n}_SC{k + 1}" for k in range(3)]
        cols += [f"max(case when v.indicator = '{i}' then d.{f} end) as {i}_{f}" for f in ("agreement", "uncertainty")]
    return f"select v.row_idx, {', '.join(cols)} from {votes} v join verdict d on v.row_idx = d.row_idx and v.indicator = d.indicator group by 1"


@query(
    "wide_results",
    with_ctes(
        [VOTES, majority_sql("votes3")],
        f"select t.doc_id as row_idx, t.lang, w.* exclude (row_idx) from documents t left join ({wide_sql('votes3')}) w on t.doc_id = w.row_idx",
    ),
)
def wide_result_table(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), "lang")
    return attach_results(rows, wide_results(VOTES.df(spark, sf), ["sovereign", "assembly"], 2))


ALL = [i for i, _ in INDICATORS]


@query(
    "wide_results_all",
    with_ctes(
        [VOTES, majority_sql("votes3")],
        f"select t.doc_id as row_idx, t.lang, w.* exclude (row_idx) from documents t left join ({wide_sql('votes3', ALL)}) w on t.doc_id = w.row_idx",
    ),
)
def wide_results_all(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), "lang")
    return attach_results(rows, wide_results(VOTES.df(spark, sf), ALL, 2))


@query(
    "self_consistency",
    with_ctes(
        [RESPONSES, JSON, ANSWERS_CTE, majority_sql("ans")],
        f"select t.doc_id as row_idx, t.source, w.* exclude (row_idx) from documents t left join ({wide_sql('ans')}) w on t.doc_id = w.row_idx",
    ),
)
def self_consistency_job(spark, sf):
    """Answer texts to wide voted labels, next to the input."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), "source")
    return self_consistency(rows, RESPONSES.df(spark, sf), DEFAULT_REGISTRY, ["sovereign", "assembly"], 2, ["sovereign", "assembly"], alone=[])


@query(
    "wide_plain",
    with_ctes(
        [VOTES],
        "select row_idx, " + ", ".join(f"max({f}) filter (where indicator = '{i}') as {i}_{f}" for i in ("sovereign", "assembly") for f in ("prediction", "reasoning", "confidence"))
        + " from votes3 where sc_idx = 0 group by 1",
    ),
)
def wide_plain(spark, sf):
    """One call per row, no vote."""
    return wide_results(VOTES.df(spark, sf), ["sovereign", "assembly"], 0)


@query(
    "wide_plain_all",
    with_ctes(
        [VOTES],
        "select row_idx, " + ", ".join(f"max({f}) filter (where indicator = '{i}') as {i}_{f}" for i in ALL for f in ("prediction", "reasoning", "confidence"))
        + " from votes3 where sc_idx = 0 group by 1",
    ),
)
def wide_plain_all(spark, sf):
    """One call per row and indicator, no vote."""
    return wide_results(VOTES.df(spark, sf), ALL, 0)
