"""Context, token log-probabilities and verification."""

from pyspark.sql import functions as F

from quorate.functions.answers import parse_answer
from quorate.functions.scoring import probability
from quorate.functions.templates import pipe_list, source_entries
from quorate.operators import context as C
from quorate.operators import logprobs as L
from quorate.operators import verify as V
from quorate.operators.requests import prompts, row_slots
from quorate.plans import verification as P
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import INDICATORS, RESPONSES, TIERS, VOTES, table, with_ctes
from quorate.plans.catalog.requests import FILLED, RULERS, good_rows
from quorate.registry import DEFAULT_REGISTRY, GENERIC_QUESTIONS

_B = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_STEPS = """t1 as (select *, case when coalesce(one, '') <> '' then one else '' end as c1, coalesce(one, '') <> '' as h1 from tier_rows),
t2 as (select *, length(c1) < 200 and coalesce(two, '') <> '' as h2 from t1),
t2b as (select *, case when h2 then case when h1 then c1 || chr(10) || two else two end else c1 end as c2 from t2),
t3 as (select *, length(c2) < 200 and coalesce(three, '') <> '' as h3 from t2b),
ctx as (select row_idx, case when h3 then case when h1 or h2 then c2 || chr(10) || three else three end else c2 end as c3, h1, h2, h3 from t3)"""
_CTX = f"""select row_idx, trim(c3, {_B}) as context,
    nullif(array_to_string(list_filter([case when h1 then 'first' end, case when h2 then 'second' end, case when h3 then 'third' end], lambda x: x is not null), ' | '), '') as context_sources from ctx"""


@query("tiered_context", with_ctes([TIERS, _STEPS], _CTX))
def tiered_context(spark, sf):
    t = TIERS.df(spark, sf)
    urls = F.array(F.lit("u"))
    tiers = [(n, t.select("row_idx", F.col(c).alias("context"), urls.alias("urls")).where("context is not null")) for n, c in (("first", "one"), ("second", "two"), ("third", "three"))]
    return C.tiered_context(t, tiers).select("row_idx", "context", "context_sources")


@query("tiered_context_columns", with_ctes([TIERS, _STEPS], _CTX))
def tiered_context_columns(spark, sf):
    got = C.tiered_context_columns([("first", F.col("one")), ("second", F.col("two")), ("third", F.col("three"))])
    return TIERS.df(spark, sf).select("row_idx", *[c.alias(n) for n, c in got.items()])


@query(
    "enriched_prompts",
    with_ctes(
        [TIERS],
        f"""select row_idx, case when coalesce(one, '') = '' then 'Label it.' else '{C.PREAMBLE.replace(chr(10), "' || chr(10) || '")}' || '<<< notes from the context tables' || chr(10) || one
        || chr(10) || 'notes end >>>' || chr(10) || chr(10) || 'Label it.' end as user_prompt from tier_rows""",
    ),
)
def enriched_prompts(spark, sf):
    return TIERS.df(spark, sf).select("row_idx", C.enrich(F.lit("Label it."), F.col("one")).alias("user_prompt"))


@query(
    "source_lists",
    """select page_id, case when page_id % 3 = 0 then url else 'page ' || page_id || ' (' || url || ')' end || ' | ' || url as sources,
    case when page_id % 2 = 0 then 'q' || page_id end as queries from pages""",
)
def source_lists(spark, sf):
    p = table(spark, sf, "pages")
    title = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("page "), F.col("page_id").cast("string")))
    chunks = F.array(F.struct(title.alias("title"), F.col("url").alias("uri")), F.struct(F.lit(None).cast("string").alias("title"), F.col("url").alias("uri")))
    asked = F.when(F.col("page_id") % 2 == 0, F.array(F.concat(F.lit("q"), F.col("page_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    return p.select("page_id", pipe_list(source_entries(chunks)).alias("sources"), pipe_list(asked).alias("queries"))


def token_rows(spark, sf):
    r = RESPONSES.df(spark, sf)
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / 3).cast("int") - 1))
    tokens = F.transform(
        places,
        lambda i: F.struct(F.substring(F.col("text"), i * 3 + 1, F.lit(3)).alias("token"), (-(i % 17).cast("double") / F.lit(10.0)).alias("logprob")),
    )
    return r.withColumn("tokens", tokens)


def _spot(ind: str, labels: str) -> str:
    q = f"regexp_extract(text, '\"{ind}\"\\s*:\\s*\"([0-9]+)\"', 1)"
    b = f"regexp_extract(text, '\"{ind}\"\\s*:\\s*([0-9]+)', 1)"
    head_q = f"regexp_extract(text, '\"{ind}\"\\s*:\\s*\"', 0)"
    head_b = f"regexp_extract(text, '\"{ind}\"\\s*:\\s*', 0)"
    return f"case when {q} in {labels} then strpos(text, {head_q}) - 1 + length({head_q}) when {b} in {labels} then strpos(text, {head_b}) - 1 + length({head_b}) end"


_LP = f"""lp as (select custom_id, 'sovereign' as indicator, {_spot('sovereign', "('0','1')")} as pos from responses
    union all select custom_id, 'assembly', {_spot('assembly', "('0','1','2','3')")} from responses)"""


@query(
    "label_logprob",
    with_ctes([RESPONSES, _LP], "select custom_id, indicator, -cast((pos // 3) % 17 as double) / 10.0 as logprob, round(exp(-cast((pos // 3) % 17 as double) / 10.0), 9) as probability from lp where pos is not null"),
)
def label_logprob(spark, sf):
    out = L.label_logprobs(token_rows(spark, sf), DEFAULT_REGISTRY, ["sovereign", "assembly"])
    return out.withColumn("probability", F.round(probability(F.col("logprob")), 9))


@query(
    "label_alternatives",
    with_ctes(
        [RESPONSES, _LP],
        """select lp.custom_id, 'alt' || ((strpos(text, regexp_extract(text, '"assembly"\\s*:\\s*', 0)) - 1 + length(regexp_extract(text, '"assembly"\\s*:\\s*', 0))) // 3) as first_alternative
        from lp join responses using (custom_id) where lp.indicator = 'assembly' and pos is not null""",
    ),
)
def label_alternatives(spark, sf):
    rows = token_rows(spark, sf)
    alts = F.transform("tokens", lambda t, i: F.array(F.struct(F.concat(F.lit("alt"), i.cast("string")).alias("token"), t["logprob"].alias("logprob"))))
    out = L.top_alternatives(rows.withColumn("candidates", alts), "assembly", DEFAULT_REGISTRY.labels("assembly"))
    return out.select("custom_id", F.col("alternatives")[0]["token"].alias("first_alternative"))


def _q_sql(n: int) -> str:
    t = GENERIC_QUESTIONS[n].replace("'", "''")
    for slot, sql in (("indicator", "k"), ("polity", "polity"), ("name", "name"), ("start_year", "s"), ("end_year", "e")):
        t = t.replace("{" + slot + "}", f"' || {sql} || '")
    return f"'{t}'"


@query(
    "check_questions",
    with_ctes(
        [RULERS, FILLED],
        f"""select row_idx, k as indicator, cast(q as int) as q_idx, case q when 0 then {_q_sql(0)} else {_q_sql(1)} end as question
        from fr cross join (values ('sovereign'), ('assembly')) p(k) cross join (select unnest(range(0, 2)) as q)""",
    ),
)
def check_questions(spark, sf):
    return V.question_rows(good_rows(spark, sf), DEFAULT_REGISTRY, ["sovereign", "assembly"], row_slots(), 2)


_LINES = "'Q: ' || row_idx || ' on ' || source || ' ' || {0} || chr(10) || 'A: ' || {1} || chr(10)"


@query(
    "check_evidence",
    """select row_idx, 'sovereign' as indicator, """
    + _LINES.format("0", "'yes ' || lang").replace("row_idx", "doc_id")
    + " || chr(10) || "
    + _LINES.format("1", "case when lang = 'de' then 'Error: no answer' else 'no' end").replace("row_idx", "doc_id")
    + " as evidence from (select doc_id as row_idx, * from documents)",
)
def check_evidence(spark, sf):
    """Answers gathered per label in question order, one of them missing now and then."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), "source", "lang", F.explode(F.array(F.lit(0), F.lit(1))).alias("q_idx"))
    d = d.withColumn("indicator", F.lit("sovereign"))
    questions = d.select("row_idx", "indicator", "q_idx", F.concat(F.col("row_idx").cast("string"), F.lit(" on "), "source", F.lit(" "), F.col("q_idx").cast("string")).alias("question"))
    answers = d.where((F.col("q_idx") == 0) | (F.col("lang") != "de")).select(
        "row_idx", "indicator", "q_idx", F.when(F.col("q_idx") == 0, F.concat(F.lit("yes "), "lang")).otherwise(F.lit("no")).alias("answer")
    )
    return V.gather_answers(questions, answers, 2)


_SYN = """case when row_idx % 8 = 7 then null when row_idx % 8 = 6 then 'sorry' when row_idx % 8 = 5 then '{"final_prediction": "42", "confidence": 0.4}'
    when row_idx % 8 = 4 then '{"decision": "CONTRADICTED", "final_prediction": "9"}'
    else '{"decision": "CONTRADICTED", "final_prediction": "' || cast(row_idx % 2 as string) || '", "confidence": 0.9}' end"""


@query(
    "check_decision",
    with_ctes(
        [VOTES, f"s as (select row_idx, indicator, prediction as p, {_SYN} as t, case indicator when 'sovereign' then 2 when 'assembly' then 4 else 11 end as n from votes3 where sc_idx = 0)",
         """d as (select *, t is not null as called, try_cast(t as json) as j from s)""",
         """e as (select *, coalesce(json_extract_string(j, '$.final_prediction'), p) as fp, coalesce(try_cast(json_extract_string(j, '$.confidence') as double), 0.5) as cf from d)""",
         """g as (select *, coalesce(try_cast(fp as int) < n or (indicator = 'entry' and fp in ('10', '99')), false) as valid from e)"""],
        """select row_idx, indicator, p as original_prediction, case when p is null then null when not called or not valid then p else fp end as prediction,
        case when p is null then 0.0 when not called then 0.3 when valid then cf else greatest(0.3, cf - 0.2) end as confidence,
        case when p is null then 'NO_INITIAL' when not called then 'ERROR' else coalesce(json_extract_string(j, '$.decision'), 'SUPPORTED') end as decision,
        coalesce(called and valid and fp <> p, false) as was_revised from g""",
    ),
)
def check_decision(spark, sf):
    first = VOTES.df(spark, sf).where("sc_idx = 0")
    texts = first.selectExpr("row_idx", "indicator", f"{_SYN} as t").where("t is not null")
    synthesis = texts.select("row_idx", "indicator", parse_answer(F.col("t")).alias("parsed"))
    return V.decide(first.select("row_idx", "indicator", "prediction"), synthesis, DEFAULT_REGISTRY)


@query(
    "enriched_requests",
    with_ctes(
        [RULERS, FILLED],
        f"""select row_idx, case when region = 'BUILDING' then 'Label ' || name || '.' else '{C.PREAMBLE.replace(chr(10), "' || chr(10) || '")}' || '<<< notes from the context tables' || chr(10)
        || 'about ' || row_idx || chr(10) || 'notes end >>>' || chr(10) || chr(10) || 'Label ' || name || '.' end as user_prompt,
        case when region <> 'BUILDING' then 'notes' end as search_sources, case when region <> 'BUILDING' then 'u1 | u2' end as search_urls from fr""",
    ),
)
def enriched_requests(spark, sf):
    """Context joined to rows and put into their prompts."""
    rows = good_rows(spark, sf)
    notes = rows.where("polity_region <> 'BUILDING'").select("row_idx", F.concat(F.lit("about "), F.col("row_idx").cast("string")).alias("context"), F.array(F.lit("u1"), F.lit("u2")).alias("urls"))
    made = prompts(rows, DEFAULT_REGISTRY, ["sovereign"], "multiple", user_template="Label {name}.")
    out = C.enrich_prompts(made, C.tiered_context(rows, [("notes", notes)]))
    return out.select("row_idx", "user_prompt", "search_sources", "search_urls")


_CHECKED = """iv as (select row_idx, indicator, max(case when sc_idx = 0 then prediction end) as p, max(case when sc_idx = 0 then reasoning end) as reasoning,
    max(case when sc_idx = 0 then confidence end) as confidence from votes3 where indicator in ('sovereign', 'assembly') and row_idx in (select row_idx from fr) group by 1, 2)"""


@query(
    "checked_labels",
    with_ctes(
        [VOTES, RULERS, FILLED, _CHECKED,
         """dd as (select *, case when p is null then null when row_idx % 3 = 0 then '1' else p end as final from iv)"""],
        """select row_idx, max(final) filter (where indicator = 'sovereign') as sovereign_prediction, max(reasoning) filter (where indicator = 'sovereign') as sovereign_reasoning,
        max(confidence) filter (where indicator = 'sovereign') as sovereign_confidence, max(final) filter (where indicator = 'assembly') as assembly_prediction,
        max(reasoning) filter (where indicator = 'assembly') as assembly_reasoning, max(confidence) filter (where indicator = 'assembly') as assembly_confidence from dd group by 1""",
    ),
)
def checked_labels(spark, sf):
    """Questions asked, answers weighed, labels revised: the whole check with stand-in answers."""
    rows = good_rows(spark, sf)
    votes = VOTES.df(spark, sf).where("indicator in ('sovereign', 'assembly')").join(rows.select("row_idx"), "row_idx", "left_semi")
    return checked(rows, votes, ["sovereign", "assembly"])


@query(
    "checked_labels_all",
    with_ctes(
        [VOTES],
        "select row_idx, " + ", ".join(
            f"max({e}) filter (where indicator = '{i}' and sc_idx = 0) as {i}_{f}" for i, _ in INDICATORS
            for f, e in (("prediction", "case when prediction is null then null when row_idx % 3 = 0 then '1' else prediction end"), ("reasoning", "reasoning"), ("confidence", "confidence"))
        ) + " from votes3 group by 1",
    ),
)
def checked_labels_all(spark, sf):
    """The same for all indicators and all rows of the votes."""
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id as row_idx", "coalesce(source, '') as polity_name", "coalesce(lang, '') as leader_name", "1 as leader_first_year", "2 as leader_last_year"
    )
    return checked(rows, VOTES.df(spark, sf), [i for i, _ in INDICATORS])


def checked(rows, votes, names):
    def ask(questions):
        return questions.withColumn("answer", F.concat(F.lit("on "), "indicator"))

    def synthesise(asked):
        # The evidence must have reached the prompt for the revision to happen.
        seen = F.contains("user_prompt", F.concat(F.lit("A: on "), F.col("indicator")))
        revised = F.when(seen & (F.col("row_idx") % 3 == 0), F.lit("1")).otherwise(F.col("prediction"))
        return asked.withColumn("text", F.concat(F.lit('{"decision": "CONTRADICTED", "final_prediction": "'), revised, F.lit('"}')))

    verify = P.chain(P.none, P.by_questions(rows, DEFAULT_REGISTRY, names, row_slots(), ask, synthesise))
    out = P.wide_verified(verify(votes), votes, names)
    return out.select("row_idx", *[f"{i}_{f}" for i in names for f in ("prediction", "reasoning", "confidence")])
