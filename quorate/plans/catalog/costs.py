"""Prices and costs."""

import pyarrow as pa
from pyspark.sql import functions as F

from quorate.functions.values import provider_of
from quorate.operators import cost as C
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import USAGE, table, with_ctes
from quorate.registry import DEFAULT_PRICE, PRICES, local_frame, prices_df
from quorate.session import run_folder

_PRICES = "prices(prefix, i, o, c) as (values " + ", ".join(
    f"('{p}', cast('{a}' as decimal(10,4)), cast('{b}' as decimal(10,4)), cast('{c}' as decimal(10,4)))" for p, (a, b, c) in PRICES.items()
) + ")"
_D = [f"cast('{v}' as decimal(10,4))" for v in DEFAULT_PRICE]
_KEYED = """mk as (select distinct model, case when model like 'arn:aws:bedrock%' then split_part(model, '/', -1) else model end as id from usage where model is not null)"""
_PRICED = f"""pm as (select mk.model, p.prefix as model_prefix, coalesce(p.i, {_D[0]}) as input_price, coalesce(p.o, {_D[1]}) as output_price,
    coalesce(p.c, {_D[2]}) as cached_price from mk left join lateral (
    select * from prices where starts_with(lower(mk.id), lower(prefix)) order by length(prefix) desc, (prefix = mk.id) desc limit 1) p on true)"""
BASE = [USAGE, _PRICES, _KEYED, _PRICED]

def micro(s: str = "") -> str:
    f = "sum" if s else ""
    return f"({f}(input_tokens) * input_price + {f}(output_tokens) * output_price + {f}(thinking_tokens) * output_price + {f}(cached_tokens) * cached_price)"


@query("price_lookup", with_ctes(BASE, "select * from pm"))
def price_lookup(spark, sf):
    return C.price_models(USAGE.df(spark, sf))


@query("price_table_lookup", with_ctes(BASE, "select * from pm"))
def price_table_lookup(spark, sf):
    """The same with prices as a table."""
    return C.price_models(USAGE.df(spark, sf), prices_df(spark))


@query("usage_cost", with_ctes(BASE, f"select call_id, usage.model, cast({micro()} as double) * 0.5 / 1000000 as cost_usd from usage join pm using (model)"))
def usage_cost(spark, sf):
    out = C.price_usage(USAGE.df(spark, sf), batch_discount=0.5)
    return out.select("call_id", "model", "cost_usd")


_PER_MODEL = f"""um as (select usage.model, count(*) calls, cast(sum(input_tokens) as bigint) input_tokens, cast(sum(output_tokens) as bigint) output_tokens,
    cast(sum(cached_tokens) as bigint) cached_tokens, cast(sum(thinking_tokens) as bigint) thinking_tokens,
    {micro('sum')} as micro from usage join pm using (model) group by usage.model, input_price, output_price, cached_price)"""


@query(
    "usage_rollup",
    with_ctes(
        [*BASE, _PER_MODEL],
        """select model, cast(sum(calls) as bigint) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens,
        cast(sum(cached_tokens) as bigint) as cached_tokens, cast(sum(thinking_tokens) as bigint) as thinking_tokens, cast(sum(micro) as double) * 1.0 / 1000000 as cost_usd
        from um group by rollup (model)""",
    ),
)
def usage_rollup(spark, sf):
    return C.usage_totals(USAGE.df(spark, sf))


@query(
    "cost_per_indicator",
    with_ctes(
        BASE,
        f"""select indicator, cast(sum({micro()}) as double) * 1.0 / 1000000 as cost_usd, count(*) as calls
        from usage join pm using (model) where indicator is not null group by 1""",
    ),
)
def cost_per_indicator(spark, sf):
    return C.indicator_costs(USAGE.df(spark, sf))


@query(
    "split_prompt_cost",
    with_ctes(
        [*BASE, f"""pu as (select call_id, input_tokens, output_tokens, cast({micro()} as double) / 1000000 as cost_usd,
        case call_id % 3 when 0 then ['sovereign'] when 1 then ['sovereign', 'assembly'] else ['sovereign', 'assembly', 'entry'] end as inds from usage join pm using (model))"""],
        """select indicator, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, round(sum(cost_usd), 6) as cost_usd from (
        select unnest(inds) as indicator, input_tokens // len(inds) as input_tokens, output_tokens // len(inds) as output_tokens, cost_usd / len(inds) as cost_usd from pu) group by 1""",
    ),
)
def split_prompt_cost(spark, sf):
    lists = [["sovereign"], ["sovereign", "assembly"], ["sovereign", "assembly", "entry"]]
    arrays = [F.array(*[F.lit(x) for x in l]) for l in lists]
    k = F.col("call_id") % 3
    usage = C.price_usage(USAGE.df(spark, sf)).withColumn("indicators", F.when(k == 0, arrays[0]).when(k == 1, arrays[1]).otherwise(arrays[2]))
    parts = C.split_prompt_cost(usage)
    return parts.groupBy("indicator").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")
    )


@query(
    "run_cost_estimate",
    with_ctes(
        [_PRICES.replace("prices(", "prices(")],
        """select 'gpt-4o' as model, count(*) as calls, cast(sum(ceil((length(text) + 10) / 4)) as bigint) as input_tokens, count(*) * 500 as output_tokens,
        round((sum(ceil((length(text) + 10) / 4)) * 2.5 + count(*) * 500 * 10.0) * 0.5 / 1000000, 6) as cost_usd from documents""",
    ),
)
def run_cost_estimate(spark, sf):
    plan = table(spark, sf, "documents").select(
        F.lit("gpt-4o").alias("model"), F.lit("0123456789").alias("system_prompt"), F.col("text").alias("user_prompt")
    )
    return C.estimate_run(plan, batch_discount=0.5).withColumn("cost_usd", F.round("cost_usd", 6))


@query(
    "run_progress",
    with_ctes(
        [USAGE],
        """select indicator, count(*) as total, count(*) filter (where status = 'ok') as completed, count(*) filter (where status = 'error') as failed,
        cast(count(*) filter (where status = 'ok') as double) / count(*) as success_rate from usage group by 1""",
    ),
)
def run_progress(spark, sf):
    return C.progress(USAGE.df(spark, sf), by=("indicator",))


@query(
    "model_providers",
    with_ctes(
        [USAGE],
        """select provider, count(*) as calls from (select case when model like 'arn:aws:bedrock%' then 'bedrock' when lower(model) like '%claude-%' then 'anthropic'
        when lower(model) like '%gemini-%' then 'gemini' else 'openai' end as provider from usage) group by 1""",
    ),
)
def model_providers(spark, sf):
    return USAGE.df(spark, sf).groupBy(provider_of(F.col("model")).alias("provider")).agg(F.count(F.lit(1)).alias("calls"))


@query(
    "observed_progress",
    with_ctes(
        [USAGE],
        """select indicator, count(*) as total, count(*) filter (where status = 'ok') as completed, count(*) filter (where status = 'error') as failed,
        cast(count(*) filter (where status = 'ok') as double) / count(*) as success_rate from usage group by 1""",
    ),
)
def observed_progress(spark, sf):
    """The same counts, gathered while the table is written."""
    groups = [None, "sovereign", "assembly", "entry"]
    counted, seen = C.observed_progress(USAGE.df(spark, sf), groups)
    counted.write.parquet(run_folder(spark, "usage"))
    kinds = {"indicator": pa.string(), "total": pa.int64(), "completed": pa.int64(), "failed": pa.int64(), "success_rate": pa.float64()}
    return local_frame(spark, kinds, C.progress_of(seen, groups))
