"""Rollups, the knowledge probe and row preparation."""

from pyspark.sql import functions as F

from quorate.functions.templates import search_text
from quorate.operators import probe as B
from quorate.operators import rollup as U
from quorate.operators import rows as R
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import DOCUMENTS_WIDE, PROBE_RESPONSES, PROBE_ROWS, RAW_RULERS, RULERS, table, with_ctes


def _any(c: str) -> str:
    return f"case when max({c}) >= 1 then 1 when max({c}) is not null then 0 end as {c}"


ROLLUP = f"""select * , end_year - start_year as year_range,
    sha256(case when territorynamehistorical is null then '~' else '=' || territorynamehistorical end) as id from (
    select upper(substr(territorynamehistorical, 1, 1)) || substr(territorynamehistorical, 2) as territorynamehistorical,
    count(name_clean) as leader_count, arg_min(region, row_idx) filter (where region is not null) as region,
    min(entrydateyear) as start_year, max(exitdateyear) as end_year,
    {', '.join(_any(c) for c in U.ANY_OF)}, max(appointment) as appointment,
    case when max(tenure) > 10 then 2 when max(tenure) >= 5 then 1 when max(tenure) is not null then 0 end as tenure
    from raw_rulers group by 1)"""


@query("polity_rollup", with_ctes([RAW_RULERS], ROLLUP))
def polity_rollup(spark, sf):
    return U.rollup_polities(RAW_RULERS.df(spark, sf), "row_idx")


@query(
    "geo_mean_having",
    """select l_suppkey, count(*) as n_leaders, round(exp(avg(ln(case when l_extendedprice > 0 then l_extendedprice end))), 4) as geo_mean_l_extendedprice,
    round(exp(avg(ln(case when l_discount > 0 then l_discount end))), 4) as geo_mean_l_discount,
    count(*) filter (where l_discount <= 0) as n_not_positive_l_discount from lineitem group by 1 having count(*) >= 600""",
)
def geo_mean_having(spark, sf):
    out = U.geo_means(table(spark, sf, "lineitem"), "l_suppkey", ["l_extendedprice", "l_discount"], min_rows=600)
    return out.select(
        "l_suppkey", "n_leaders", F.round("geo_mean_l_extendedprice", 4).alias("geo_mean_l_extendedprice"),
        F.round("geo_mean_l_discount", 4).alias("geo_mean_l_discount"), "n_not_positive_l_discount",
    )


_B = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _na(c: str) -> str:
    return f"(case when upper(trim({c}, {_B})) in ('NA', '') then null else trim({c}, {_B}) end)"


FIELDS = f"""pf as (select row_idx, {_na('leader_name')} as name, {_na('polity_name')} as polity, {_na('polity_region')} as region,
    {_na('leader_first_year')} as entry_year, {_na('leader_last_year')} as exit_year,
    coalesce({_na('tenure')}, cast(try_cast({_na('leader_last_year')} as int) - try_cast({_na('leader_first_year')} as int) as varchar)) as tenure from probe_rows)"""


@query("probe_fields", with_ctes([PROBE_ROWS, FIELDS], "select * from pf"))
def probe_fields(spark, sf):
    return R.probe_fields(PROBE_ROWS.df(spark, sf))


def _question(q: B.Question) -> str:
    import string

    parts = []
    for text, slot, _, _ in string.Formatter().parse(q.template):
        if text:
            parts.append("'" + text.replace("'", "''") + "'")
        if slot:
            parts.append(slot)
    cond = " and ".join(f"{f} is not null" for f in q.requires)
    return f"select row_idx, '{q.label}' as question, {' || '.join(parts)} as prompt from pf where {cond}"


@query("probe_questions", with_ctes([PROBE_ROWS, FIELDS], " union all ".join(_question(q) for q in B.QUESTIONS)))
def probe_questions(spark, sf):
    return B.probe_questions(R.probe_fields(PROBE_ROWS.df(spark, sf)))


_ANS = r"""pa as (select row_idx, run, question, json_extract_string(coalesce(try_cast(case when b like '{%' and b like '%}' then b end as json),
      try_cast(nullif(regexp_extract(b, '\{[^}]+\}'), '') as json)),
      case question when 'entry_year' then '$.year' when 'tenure_from_exit' then '$.years' else '$.name' end) as answer
    from (select *, trim(regexp_replace(text, '```(?:json)?\s*', '', 'g'), ' ' || chr(10)) b from probe_responses))"""
_NEAR = "coalesce(abs(round_even(try_cast(answer as double), 0) - round_even(try_cast({t} as double), 0)) <= {w}, false)"
_SCORED = f"""sc as (select a.row_idx, a.run, a.question, a.answer,
    case when answer is null or trim(answer) = '' then null
      when question = 'entry_year' then case when entry_year is not null then cast({_NEAR.format(t='entry_year', w=3)} as int) end
      when question = 'tenure_from_exit' then case when tenure is not null then cast({_NEAR.format(t='tenure', w=5)} as int) end
      when name is not null then cast(contains(lower(answer), lower(name)) or
        len(list_filter(string_split(lower(name), ' '), lambda w: length(w) > 3 and contains(lower(answer), w))) > 0 as int) end as correct
    from pa a join pf using (row_idx))"""
PROBE = [PROBE_ROWS, FIELDS, PROBE_RESPONSES, _ANS, _SCORED]


def scored(spark, sf):
    answers = B.read_answers(PROBE_RESPONSES.df(spark, sf))
    return B.score_answers(answers, R.probe_fields(PROBE_ROWS.df(spark, sf)), by=("run",))


@query("probe_scores", with_ctes(PROBE, "select run, row_idx, question, answer, correct from sc"))
def probe_scores(spark, sf):
    return scored(spark, sf)


_ACC = """acc as (select run, question, cast(sum(correct) as bigint) n_correct, count(*) n_total, cast(sum(correct) as double) / count(*) accuracy
    from (select run, question, correct from sc union all select run, 'overall', correct from sc) where correct is not null group by 1, 2)"""


@query("probe_accuracy", with_ctes([*PROBE, _ACC], "select * from acc"))
def probe_accuracy(spark, sf):
    return B.question_accuracy(scored(spark, sf), ("run",))


@query(
    "probe_row_accuracy",
    with_ctes(PROBE, "select run, row_idx, cast(sum(correct) as double) / nullif(count(correct), 0) as avg_accuracy, count(correct) as n_scored from sc group by 1, 2"),
)
def probe_row_accuracy(spark, sf):
    return B.row_probe_accuracy(scored(spark, sf), by=("run",))


@query(
    "probe_side_by_side",
    with_ctes(
        [*PROBE, _ACC],
        """select question, max(accuracy) filter (where run = 'one') as accuracy_one, max(accuracy) filter (where run = 'two') as accuracy_two,
        max(n_total) filter (where run = 'one') as n_one, max(n_total) filter (where run = 'two') as n_two from acc group by 1""",
    ),
)
def probe_side_by_side(spark, sf):
    return B.side_by_side(B.question_accuracy(scored(spark, sf), ("run",)), ["one", "two"])


@query(
    "row_fields",
    with_ctes(
        [RULERS],
        """select row_idx, coalesce(polity_name, 'Unknown Polity') as polity_name, coalesce(leader_name, 'Unknown Leader') as leader_name,
        leader_first_year, leader_last_year from rulers where leader_first_year is not null""",
    ),
)
def row_fields(spark, sf):
    """Defaults put in, rows without a start year set aside."""
    filled = R.fill_row_fields(RULERS.df(spark, sf))
    good, _ = R.quarantine(filled, {"no start year": F.col("leader_first_year").isNull()})
    return good.select("row_idx", "polity_name", "leader_name", "leader_first_year", "leader_last_year")


@query("rejected_rows", with_ctes([RULERS], "select row_idx, 'no start year' as reject_reason from rulers where leader_first_year is null"))
def rejected_rows(spark, sf):
    _, bad = R.quarantine(R.fill_row_fields(RULERS.df(spark, sf)), {"no start year": F.col("leader_first_year").isNull()})
    return bad.select("row_idx", "reject_reason")


@query(
    "typed_columns",
    with_ctes(
        [DOCUMENTS_WIDE],
        """select row_idx, cast(trunc(try_cast(constitution_prediction as double)) as int) as constitution_prediction, constitution_confidence,
        constitution_year, constitution_document_name from documents_wide""",
    ),
)
def typed_columns(spark, sf):
    out = R.fix_types(DOCUMENTS_WIDE.df(spark, sf), ["constitution", "sovereign"])
    return out.select("row_idx", "constitution_prediction", "constitution_confidence", "constitution_year", "constitution_document_name")


@query("row_index", "select o_orderkey, o_custkey, row_number() over (order by o_custkey, o_orderkey) - 1 as row_idx from orders")
def row_index(spark, sf):
    """Positions under a total order, numbered in parallel."""
    return R.with_row_index(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@query("row_slice", with_ctes([RULERS], "select row_idx, polity_name from rulers where row_idx >= 10 and row_idx < 40"))
def row_slice(spark, sf):
    return R.slice_rows(RULERS.df(spark, sf), "10:40").select("row_idx", "polity_name")


@query(
    "search_phrases",
    with_ctes(
        [RULERS],
        """select row_idx, case when coalesce(trim(leader_name), '') <> '' then
          case when leader_first_year is not null and leader_last_year is not null then leader_name || ' of ' || polity_name || ' during ' || leader_first_year || '-' || leader_last_year
          when leader_first_year is not null then leader_name || ' of ' || polity_name || ' reign started in ' || leader_first_year
          when leader_last_year is not null then leader_name || ' of ' || polity_name || ' reign ended in ' || leader_last_year
          else leader_name || ' of ' || polity_name end
        else case when leader_first_year is not null and leader_last_year is not null then polity_name || ' during ' || leader_first_year || '-' || leader_last_year
          when leader_first_year is not null then polity_name || ' from ' || leader_first_year
          when leader_last_year is not null then polity_name || ' until ' || leader_last_year else polity_name end end as phrase from rulers""",
    ),
)
def search_phrases(spark, sf):
    c = F.col
    return RULERS.df(spark, sf).select(
        "row_idx", search_text(c("polity_name"), c("leader_name"), c("leader_first_year"), c("leader_last_year")).alias("phrase")
    )
