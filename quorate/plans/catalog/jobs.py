"""Whole jobs with stand-ins for a model: the same prompt gets the same answer, so SQL can tell the outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.operators import requests as Q
from quorate.operators.probe import QUESTIONS
from quorate.plans import jobs as J
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import INDICATORS, PROBE_ROWS, RULERS, VOTES, Fixture, table, with_ctes
from quorate.plans.catalog.requests import FILLED, good_rows
from quorate.plans.catalog.rollups import FIELDS, _question
from quorate.plans.catalog.votes import majority_sql
from quorate.registry import DEFAULT_REGISTRY

BOTH = ["sovereign", "assembly"]


def labeller():
    """Labels from the length of the prompt; for some prompts it is always down."""

    def call(system, user, temperature):
        n = len(user) + int(temperature * 10)
        if n % 10 == 3:
            raise RuntimeError("always down")
        return '{"sovereign": "%d", "sovereign_confidence": %d, "assembly": %d, "assembly_confidence": 50}' % (n % 2, n % 100 + 1, n % 5)

    return call


_PROMPT = "'Label ' || name || ' of ' || polity"
_N = f"length({_PROMPT}) + case sc when 0 then 10 when 1 then 7 else 9 end"
_JOB = f"""jn as (select row_idx, sc as sc_idx, {_N} as n from fr cross join (select unnest(range(0, 3)) as sc)),
ja as (select row_idx, indicator, sc_idx, case when n % 10 = 3 then null when indicator = 'sovereign' then cast(n % 2 as varchar) when n % 5 < 4 then cast(n % 5 as varchar) end as prediction,
  case when n % 10 = 3 then null when indicator = 'sovereign' then n % 100 + 1 else 50 end as confidence from jn cross join (values ('sovereign'), ('assembly')) p(indicator))"""


@query(
    "annotation_job",
    with_ctes(
        [RULERS, FILLED, _JOB, majority_sql("ja")],
        "select row_idx, " + ", ".join(
            [f"max(prediction) filter (where indicator = '{i}') as {i}_prediction" for i in BOTH]
            + [f"max(agreement) filter (where indicator = '{i}') as {i}_agreement" for i in BOTH]
            + [f"max(uncertainty) filter (where indicator = '{i}') as {i}_uncertainty" for i in BOTH]
        ) + ", max(c) as sovereign_confidence_SC1 from (select v.*, a.confidence as c from verdict v left join ja a on a.row_idx = v.row_idx and a.indicator = 'sovereign' and a.sc_idx = 0) group by 1",
    ),
)
def annotation_job(spark, sf):
    """Prompts, three samples, calls, a second round for the failed ones, votes, one wide table."""
    out = J.annotation_job(good_rows(spark, sf), DEFAULT_REGISTRY, BOTH, labeller, 2, sampled=[0.7, 0.9], user_template="Label {name} of {polity}")
    return out.select("row_idx", *[f"{i}_{f}" for f in ("prediction", "agreement", "uncertainty") for i in BOTH], "sovereign_confidence_SC1")


def answerer():
    return lambda system, user, temperature: "on " + user


def judge():
    """Contradicts a label where the evidence has reached the prompt and is long; fails now and then."""

    def call(system, user, temperature):
        if len(user) % 7 == 0:
            raise RuntimeError("no judge")
        seen = user.count("A: on ") == 2
        return '{"decision": "%s", "final_prediction": "%s", "confidence": 0.9}' % ("CONTRADICTED", "1") if seen and len(user) % 2 else '{"decision": "SUPPORTED"}'

    return call


CASES = Fixture(
    "cases", "documents",
    {"row_idx": "doc_id", "polity_name": "coalesce(source, '')", "leader_name": "coalesce(lang, '')", "leader_first_year": "1", "leader_last_year": "2"},
)


def _evidence(indicator: str) -> str:
    from quorate.registry import GENERIC_QUESTIONS

    lines = []
    for t in GENERIC_QUESTIONS[:2]:
        t = t.replace("'", "''")
        for slot, sql in (("indicator", f"'{indicator}'"), ("polity", "polity_name"), ("name", "leader_name"), ("start_year", "'1'"), ("end_year", "'2'")):
            t = t.replace("{" + slot + "}", f"' || {sql} || '")
        lines.append(f"'Q: ' || '{t}' || chr(10) || 'A: on ' || '{t}' || chr(10)")
    return " || chr(10) || ".join(lines)


def _judged(indicator: str) -> str:
    labels = ", ".join(DEFAULT_REGISTRY.labels(indicator))
    rest = "Is the label SUPPORTED, CONTRADICTED or is the evidence INSUFFICIENT? Valid labels: " + labels
    tail = 'Answer {"decision": text, "final_prediction": label, "confidence": 0.0-1.0, "reasoning": text}'
    return f"""select c.row_idx, '{indicator}' as indicator, v.prediction as p, length('Indicator: {indicator}' || chr(10) || 'Label: ' || v.prediction || chr(10) || 'Reason: ' || chr(10) || chr(10)
        || {_evidence(indicator)} || chr(10) || '{rest}' || chr(10) || '{tail}') as n from cases c join verdict v on v.row_idx = c.row_idx and v.indicator = '{indicator}'"""


@query(
    "verified_job",
    with_ctes(
        [VOTES, CASES, majority_sql("votes3"), "jd as (" + " union all ".join(_judged(i) for i, _ in INDICATORS) + ")"],
        """select row_idx, indicator, p as original_prediction, case when p is null then null when n % 7 <> 0 and n % 2 = 1 then '1' else p end as prediction,
        case when p is null then 'NO_INITIAL' when n % 7 = 0 then 'ERROR' when n % 2 = 1 then 'CONTRADICTED' else 'SUPPORTED' end as decision,
        case when p is null then 0.0 when n % 7 = 0 then 0.3 when n % 2 = 1 then 0.9 else 0.5 end as confidence from jd""",
    ),
)
def verified_job(spark, sf):
    """Voted labels checked by questions and a judge, both called through `annotate`."""
    out = J.verified_job(CASES.df(spark, sf), VOTES.df(spark, sf), DEFAULT_REGISTRY, [i for i, _ in INDICATORS], Q.row_slots(), answerer, judge, per_indicator=2)
    return out.select("row_idx", "indicator", "original_prediction", "prediction", "decision", "confidence")


def elector():
    return lambda system, user, temperature: '{"elections": "%d"}' % ((len(user) + int(temperature * 10)) % 4)


_DEP = """dn as (select row_idx, 'elections' as indicator, sc as sc_idx, (length('Elections under ' || name) + case sc when 0 then 0 else 7 end) % 4 as k
    from fr cross join (select unnest(range(0, 3)) as sc)),
de as (select row_idx, indicator, sc_idx, case when k < 3 then cast(k as varchar) end as prediction from dn where row_idx in (select row_idx from rulers where try_cast(assembly_prediction as double) = 2))"""


@query(
    "dependent_job",
    with_ctes(
        [RULERS, FILLED, _DEP, majority_sql("de")],
        """select f.row_idx, case when coalesce(try_cast(r.assembly_prediction as double) = 2, false) then v.prediction else '0' end as elections_prediction,
        v.agreement as elections_agreement, v.uncertainty as elections_uncertainty from fr f join rulers r on r.row_idx = f.row_idx left join verdict v on v.row_idx = f.row_idx""",
    ),
)
def dependent_job(spark, sf):
    """Gate, calls for the open rows, vote, pass-through for the others."""
    out = J.dependent_job(good_rows(spark, sf), DEFAULT_REGISTRY, "elections", elector, user_template="Elections under {name}")
    return out.select("row_idx", "elections_prediction", "elections_agreement", "elections_uncertainty")


def knower():
    """Knows years by heart from the length of the question, and names nobody."""

    def call(system, user, temperature):
        if "year" in user and len(user) % 3 == 0:
            return "I do not know"
        return '{"year": %d, "years": %d, "name": "King", "polity": "Old Kingdom"}' % (len(user), len(user) % 30)

    return call


_ASKED = "aq as (" + " union all ".join(_question(q) for q in QUESTIONS) + ")"
_KNOWN = """kn as (select *, length(prompt) as n, not (contains(prompt, 'year') and length(prompt) % 3 = 0) as told from aq),
ks as (select k.row_idx, k.question, case when not told then null
    when question in ('entry_year', 'exit_year') then case when coalesce(case question when 'entry_year' then entry_year else exit_year end, '') <> '' then
      cast(coalesce(abs(n - round_even(try_cast(case question when 'entry_year' then entry_year else exit_year end as double), 0)) <= 3, false) as int) end
    when question like 'tenure%' then case when tenure is not null then cast(coalesce(abs(n % 30 - round_even(try_cast(tenure as double), 0)) <= 5, false) as int) end
    when question = 'leader_name' then case when name is not null then cast(contains('king', lower(name)) or len(list_filter(string_split(lower(name), ' '), lambda w: length(w) > 3 and contains('king', w))) > 0 as int) end
    else case when polity is not null then cast(contains('old kingdom', lower(polity)) or len(list_filter(string_split(lower(polity), ' '), lambda w: length(w) > 3 and contains('old kingdom', w))) > 0 as int) end end as correct
    from kn k join pf using (row_idx))"""


@query(
    "probe_job",
    with_ctes(
        [PROBE_ROWS, FIELDS, _ASKED, _KNOWN],
        """select question, cast(sum(correct) as bigint) as n_correct, count(*) as n_total, cast(sum(correct) as double) / count(*) as accuracy
        from (select question, correct from ks union all select 'overall', correct from ks) where correct is not null group by 1""",
    ),
)
def probe_job(spark, sf):
    """Six questions per row asked through `annotate`, read and scored."""
    return J.probe_job(PROBE_ROWS.df(spark, sf), knower)["questions"]


def reader():
    return lambda system, user, temperature: '{"sovereign": "%d", "assembly": "%d"}' % ("about " in user, len(user) % 4)


_WRAP = """ep as (select row_idx, region, name, case when region <> 'BUILDING' then 'about ' || row_idx else '' end as note, 'Label ' || name || '.' as base from fr)"""


def _preamble() -> str:
    from quorate.operators import context as C

    text = lambda t: t.replace("'", "''").replace(chr(10), "' || chr(10) || '")
    return f"'{text(C.PREAMBLE)}' || '{text(C.OPENING)}' || note || '{text(C.CLOSING)}' || base"


@query(
    "enriched_job",
    with_ctes(
        [RULERS, FILLED, _WRAP],
        f"""select row_idx, case when note <> '' then '1' else '0' end as sovereign_prediction, cast(length(case when note <> '' then {_preamble()} else base end) % 4 as varchar) as assembly_prediction,
        case when note <> '' then 'u1 | u2' end as urls_used, nullif(note, '') as web_information, 'who is ' || name as search_queries from ep""",
    ),
)
def enriched_job(spark, sf):
    """Context tables into prompts, labels out, with the search columns of the wide layout."""
    rows = good_rows(spark, sf)
    notes = rows.where("polity_region <> 'BUILDING'").select("row_idx", F.concat(F.lit("about "), F.col("row_idx").cast("string")).alias("context"), F.array(F.lit("u1"), F.lit("u2")).alias("urls"))
    asked = rows.select("row_idx", F.concat(F.lit("who is "), "leader_name").alias("search_queries"))
    out = J.enriched_job(rows, [("notes", notes)], DEFAULT_REGISTRY, BOTH, reader, queries=asked, user_template="Label {name}.")
    return out.select("row_idx", "sovereign_prediction", "assembly_prediction", "urls_used", "web_information", "search_queries")


BROKEN = Fixture(
    "broken", "customer",
    {
        "row_idx": "c_custkey",
        "sovereign_prediction": "case when c_custkey % 3 = 0 then null else '0' end",
        "sovereign_confidence": "case when c_custkey % 5 = 0 then -1 else 60 end",
        "assembly_prediction": "'1'",
        "assembly_confidence": "case when c_custkey % 7 = 0 then null else 40 end",
    },
)


def mender():
    """Good answers for most prompts; where the prompt ends in 9 no good confidence."""

    def call(system, user, temperature):
        return '{"sovereign": "1", "sovereign_confidence": %s, "assembly": "2", "assembly_confidence": 80}' % ("null" if user.endswith("9") else "90")

    return call


@query(
    "repair_job",
    with_ctes(
        [BROKEN, """bf as (select *, (sovereign_prediction is null or sovereign_confidence = -1) as fs, assembly_confidence is null as fa, row_idx % 10 <> 9 as good from broken)"""],
        """select row_idx, case when fs and good then '1' else sovereign_prediction end as sovereign_prediction, case when fs and good then 90 else sovereign_confidence end as sovereign_confidence,
        case when fa then '2' else assembly_prediction end as assembly_prediction, case when fa then 80 else assembly_confidence end as assembly_confidence from bf""",
    ),
)
def repair_job(spark, sf):
    """Check, ask again, put in, until nothing more can be mended."""
    broken = BROKEN.df(spark, sf)
    made = Q.prompts(broken.withColumn("who", F.col("row_idx").cast("string")), DEFAULT_REGISTRY, BOTH, slots={"who": F.col("who")}, user_template="Again {who}")
    requests = Q.expand_samples(made, [1.0]).select("row_idx", "custom_id", "system_prompt", "user_prompt", "temperature")
    return J.repair_job(broken, requests, DEFAULT_REGISTRY, mender, BOTH, max_rounds=2).select(broken.columns)
