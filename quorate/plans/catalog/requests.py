"""Requests, gates and the user function."""

from pyspark.sql import functions as F

from quorate.operators import dependent as D
from quorate.operators import requests as Q
from quorate.operators import rows as R
from quorate.operators.annotate import annotate
from quorate.operators.votes import slot_vote
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import RULERS, VOTES, table, with_ctes
from quorate.plans.catalog.votes import majority_sql
from quorate.registry import DEFAULT_REGISTRY

IND = ["constitution", "sovereign", "assembly"]
FILLED = """fr as (select row_idx, coalesce(polity_name, 'Unknown Polity') as polity, coalesce(leader_name, 'Unknown Leader') as name,
    leader_first_year as s, coalesce(cast(leader_last_year as varchar), 'present') as e, polity_region as region from rulers where leader_first_year is not null)"""
TEMPLATE = "Label {indicator} for {name} of {polity}, {period}. Write {{}} only."
_TEXT = "'Label ' || {0} || ' for ' || name || ' of ' || polity || ', ' || s || '-' || e || '. Write {{}} only.'"


def good_rows(spark, sf):
    filled = R.fill_row_fields(RULERS.df(spark, sf))
    return R.quarantine(filled, {"no start year": F.col("leader_first_year").isNull()})[0]


def made(spark, sf, mode, **options):
    return Q.prompts(good_rows(spark, sf), DEFAULT_REGISTRY, IND, mode, user_template=TEMPLATE, **options)


@query(
    "expand_requests",
    with_ctes(
        [RULERS, FILLED],
        """select row_idx || '|' || k || '|' || sc as custom_id, row_idx, k as prompt_key, cast(sc as int) as sc_idx,
        case sc when 0 then 1.0 when 1 then 0.7 else 0.9 end as temperature, n as n_indicators
        from fr cross join (values ('constitution', 1), ('single', 2)) p(k, n) cross join (select unnest(range(0, 3)) as sc)""",
    ),
)
def expand_requests(spark, sf):
    out = Q.expand_samples(made(spark, sf, "single"), Q.temperatures(2, [0.7, 0.9]))
    return out.select("custom_id", "row_idx", "prompt_key", "sc_idx", "temperature", F.size("indicators").alias("n_indicators"))


@query(
    "render_prompts",
    with_ctes([RULERS, FILLED], f"select row_idx, k as prompt_key, {_TEXT.format('k')} as user_prompt from fr cross join (values ('constitution'), ('sovereign'), ('assembly')) p(k)"),
)
def render_prompts(spark, sf):
    """One prompt per indicator."""
    return made(spark, sf, "multiple").select("row_idx", "prompt_key", "user_prompt")


_SEQ = " || ".join(f"'### {k}/3 {n}' || chr(10) || {_TEXT.format(chr(39) + n + chr(39))} || chr(10)" for k, n in enumerate(["assembly", "constitution", "sovereign"], 1))


@query("sequential_prompts", with_ctes([RULERS, FILLED], f"select row_idx, {_SEQ} as user_prompt, 'assembly,constitution,sovereign' as sections from fr"))
def sequential_prompts(spark, sf):
    out = made(spark, sf, "sequential", sequence=["assembly", "constitution", "sovereign"])
    return out.select("row_idx", "user_prompt", F.array_join("indicators", ",").alias("sections"))


def documents_requests(spark, sf):
    rows = good_rows(spark, sf)
    p = Q.prompts(rows, DEFAULT_REGISTRY, ["sovereign", "assembly"], user_template=TEMPLATE)
    return Q.request_document(Q.expand_samples(p, Q.temperatures(1)), ["row_idx", "polity_name", "leader_first_year", "leader_last_year"])


@query(
    "request_documents",
    with_ctes(
        [RULERS, FILLED],
        f"""select row_idx || '|single|' || sc as custom_id, {_TEXT.format("'single'")} as user_text, 'user' as role, 1.0 as temperature,
        '["sovereign","assembly"]' as indicators, '1' as n_samples, sc = 0 as has_row from fr cross join (select unnest(range(0, 2)) as sc)""",
    ),
)
def request_documents(spark, sf):
    r = documents_requests(spark, sf)
    return r.select(
        F.col("metadata.custom_id").alias("custom_id"), F.col("contents")[0]["parts"][0]["text"].alias("user_text"), F.col("contents")[0]["role"].alias("role"),
        F.col("config.temperature").alias("temperature"), F.col("metadata.indicators").alias("indicators"), F.col("metadata.n_samples").alias("n_samples"),
        F.col("metadata.row_data").isNotNull().alias("has_row"),
    )


@query("embedded_rows", with_ctes([RULERS, FILLED], "select row_idx, polity as polity_name, s as leader_first_year, try_cast(e as int) as leader_last_year from fr"))
def embedded_rows(spark, sf):
    """Input rows rebuilt from the requests that carry them."""
    schema = "polity_name string, leader_first_year int, leader_last_year int"
    return Q.embedded_rows(documents_requests(spark, sf), schema)


@query("request_facts", with_ctes([RULERS, FILLED], "select 1 as min_n, 1 as max_n, count(*) * 2 as n_requests, false as uses_search from fr"))
def request_facts(spark, sf):
    r = documents_requests(spark, sf)
    # Two one-row tables side by side.
    a = Q.sample_counts(r).withColumn("one", F.lit(1))
    return a.join(Q.uses_search(r).withColumn("one", F.lit(1)), "one").drop("one")


CAP = 200_000
_PACK = f"""z as (select doc_id as row_idx, 0 as sc_idx, strlen(text) + 1 as n_bytes, cast(doc_id % 4 as int) as shard from documents),
y as (select *, case when n_bytes > {CAP} / 2 then 0 else n_bytes end as sm from z),
x as (select *, coalesce(sum(sm) over (partition by shard order by row_idx, sc_idx rows between unbounded preceding and 1 preceding), 0) as bef,
    {CAP} - (select max(sm) from y) as stride,
    sum(case when n_bytes > {CAP} / 2 then 1 else 0 end) over (partition by shard order by row_idx, sc_idx rows between unbounded preceding and current row) as al from y),
pk as (select row_idx, n_bytes, case when n_bytes > {CAP} / 2 then shard || '-x-' || cast(al as bigint) else shard || '-c-' || cast(floor(bef / stride) as bigint) end as chunk from x)"""


def packed(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.lit(0).alias("sc_idx"), (F.octet_length("text") + 1).cast("bigint").alias("n_bytes"))
    return Q.pack_chunks(d, CAP, shard=F.col("row_idx") % 4, n_shards=4)


@query("request_chunks", with_ctes([_PACK], "select row_idx, n_bytes, chunk from pk"))
def request_chunks(spark, sf):
    return packed(spark, sf).select("row_idx", "n_bytes", "chunk")


@query("chunk_sizes", with_ctes([_PACK], f"select chunk, cast(sum(n_bytes) as bigint) as n_bytes, count(*) as n_requests, sum(n_bytes) <= {CAP} as fits from pk group by 1"))
def chunk_sizes(spark, sf):
    return packed(spark, sf).groupBy("chunk").agg(
        F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_requests"), (F.sum("n_bytes") <= CAP).alias("fits")
    )


@query(
    "chunks_by_size",
    f"""select count(*) as n_requests, cast(sum(n_bytes) as bigint) as n_bytes, true as fits, greatest(1, cast(ceil(sum(n_bytes) / {4 * CAP}.0) as bigint)) as n_shards
    from (select strlen(text) + 1 as n_bytes from documents)""",
)
def chunks_by_size(spark, sf):
    """Shards as many as the total size asks for: all requests are in a chunk, none over the cap unless it is one request."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.lit(0).alias("sc_idx"), (F.octet_length("text") + 1).cast("bigint").alias("n_bytes"))
    chunks = Q.pack_chunks(d, CAP).groupBy("chunk", "shard").agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
    fits = (F.col("n_bytes") <= CAP) | (F.col("n") == 1)
    return chunks.agg(F.sum("n").alias("n_requests"), F.sum("n_bytes").alias("n_bytes"), F.bool_and(fits).alias("fits"), F.countDistinct("shard").alias("n_shards"))


_OPEN = "coalesce(try_cast(assembly_prediction as double) = 2, false)"


@query("dependent_gate", with_ctes([RULERS], f"select row_idx, {_OPEN} as is_open from rulers"))
def dependent_gate(spark, sf):
    return RULERS.df(spark, sf).select("row_idx", D.gate(DEFAULT_REGISTRY["elections"].depends_on).alias("is_open"))


@query(
    "dependent_label",
    with_ctes(
        [RULERS, VOTES, "ev as (select row_idx, 'elections' as indicator, sc_idx, case when prediction in ('0', '1', '2') then prediction end as prediction from votes3 where indicator = 'assembly')",
         majority_sql("ev")],
        f"""select r.row_idx, r.assembly_prediction, case when {_OPEN} then v.prediction else '0' end as elections_prediction,
        case when {_OPEN} then v.agreement end as elections_agreement, case when {_OPEN} then v.uncertainty end as elections_uncertainty
        from rulers r left join verdict v on r.row_idx = v.row_idx""",
    ),
)
def dependent_label(spark, sf):
    """Gated rows get the voted label, the others the pass-through label."""
    votes = VOTES.df(spark, sf).where("indicator = 'assembly'").withColumn("indicator", F.lit("elections"))
    verdicts = slot_vote(votes, 3, DEFAULT_REGISTRY.labels("elections"))
    rows = RULERS.df(spark, sf).select("row_idx", "assembly_prediction")
    return D.fill_dependent(rows, verdicts, DEFAULT_REGISTRY, "elections")


@query(
    "dependency_met",
    with_ctes([VOTES], "select row_idx, coalesce(max(case when indicator = 'assembly' then prediction end) = '2', false) as met from votes3 where sc_idx = 0 group by 1"),
)
def dependency_met(spark, sf):
    """Needs checked on a map of earlier labels."""
    first = VOTES.df(spark, sf).where("sc_idx = 0")
    side = first.groupBy("row_idx").agg(*[F.max(F.when(F.col("indicator") == i, F.col("prediction"))).alias(i) for i in ("sovereign", "assembly")])
    labels = F.create_map(F.lit("sovereign"), F.col("sovereign"), F.lit("assembly"), F.col("assembly"))
    return side.select("row_idx", D.dependency_met(DEFAULT_REGISTRY, "elections", labels).alias("met"))


def open_stub():
    """A stand-in for a model: same prompt, same answer."""

    def call(system_prompt, user_prompt, temperature):
        if len(user_prompt) % 10 == 0:
            raise RuntimeError("no answer")
        return {"text": '{"sovereign": "%d"}' % (len(user_prompt) % 2), "input_tokens": len(user_prompt), "output_tokens": 1}

    return call


@query(
    "annotate_user_fn",
    with_ctes(
        [RULERS, FILLED, f"pr as (select row_idx || '|sovereign|0' as custom_id, length({_TEXT.format(chr(39) + 'sovereign' + chr(39))}) as n from fr)"],
        """select custom_id, case when n % 10 <> 0 then '{"sovereign": "' || (n % 2) || '"}' end as text, case when n % 10 = 0 then 'error' else 'ok' end as status,
        case when n % 10 = 0 then 'RuntimeError: no answer' end as error, case when n % 10 <> 0 then n end as input_tokens from pr""",
    ),
)
def annotate_user_fn(spark, sf):
    p = Q.prompts(good_rows(spark, sf), DEFAULT_REGISTRY, ["sovereign"], "multiple", user_template=TEMPLATE)
    return annotate(Q.expand_samples(p, [1.0]), open_stub).select("custom_id", "text", "status", "error", "input_tokens")


@query(
    "next_fit_chunks",
    f"""with recursive s as (select doc_id as row_idx, strlen(text) + 1 as n_bytes, row_number() over (order by doc_id) - 1 as i,
      sum(strlen(text) + 1) over (order by doc_id) as upto from documents),
    nxt as materialized (select a.i, greatest(a.i, coalesce(b.i, -1)) + 1 as to_i from (select i, upto - n_bytes + {CAP} as reach from s) a asof left join s b on a.reach >= b.upto),
    path as (select 0::bigint as i union all select n.to_i from path p join nxt n on n.i = p.i where n.to_i < (select count(*) from s)),
    c as (select i, row_number() over (order by i) - 1 as chunk from path)
    select s.row_idx, s.n_bytes::bigint as n_bytes, c.chunk::bigint as chunk from s asof join c on s.i >= c.i""",
)
def next_fit_chunks(spark, sf):
    """Chunks as one pass in order would cut them."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.lit(0).alias("sc_idx"), (F.octet_length("text") + 1).cast("bigint").alias("n_bytes"))
    return Q.next_fit_chunks(d, CAP).select("row_idx", "n_bytes", "chunk")
