"""Token prices and cost totals.

Cost is linear in tokens, so totals are summed first and priced after: the usage table is read once, combined
before its shuffle, and prices meet one row per model instead of one per call.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quorate.functions.values import HOSTED_ARN
from quorate.registry import DEFAULT_PRICE, PRICES, quoted

TOKENS = ("input_tokens", "output_tokens", "cached_tokens", "thinking_tokens")
MONEY = "decimal(10,4)"


def model_key(model: Column) -> Column:
    """Model id; of a hosted ARN its last path part."""
    return F.when(model.startswith(HOSTED_ARN), F.element_at(F.split(model, "/"), -1)).otherwise(model)


Prices = Mapping[str, tuple[float, float, float]] | DataFrame
PRICE_COLUMNS = ("input_price", "output_price", "cached_price")


def _default_struct(default: tuple) -> Column:
    d = [F.lit(str(v)).cast(MONEY).alias(n) for v, n in zip(default, PRICE_COLUMNS)]
    return F.struct(F.lit(None).cast("string").alias("model_prefix"), *d)


def price_of(key: str, prices: Mapping[str, tuple] = PRICES, default: tuple = DEFAULT_PRICE) -> Column:
    """struct<model_prefix, input, output, cached> from a price list: the longest known prefix, else the default.

    `key` names a column with lower-case model ids. A price list is short, so this is a plain CASE on the row and
    needs no join. An exact id is its own longest prefix.
    """
    def row(prefix: str | None, values: tuple) -> str:
        money = ", ".join(f"'{n}', cast({v!r} as {MONEY})" for n, v in zip(PRICE_COLUMNS, map(str, values)))
        return f"named_struct('model_prefix', {'cast(null as string)' if prefix is None else quoted(prefix)}, {money})"

    longest_first = sorted(prices, key=lambda p: (-len(p), p))
    cases = " ".join(f"when startswith({key}, {quoted(p.lower())}) then {row(p, prices[p])}" for p in longest_first)
    return F.expr(f"case {cases} else {row(None, default)} end" if cases else row(None, default))


def price_models(models: DataFrame, prices: Prices = PRICES, default: tuple = DEFAULT_PRICE) -> DataFrame:
    """Prices per distinct model.

    With a price table the prefix match is turned into an equi-join: a model is split into all its prefixes, so
    the join hashes instead of comparing every model with every price.
    """
    distinct = models.select("model").where(F.col("model").isNotNull()).distinct()
    if not isinstance(prices, DataFrame):
        keyed = distinct.select("model", F.lower(model_key(F.col("model"))).alias("_key"))
        return keyed.select("model", price_of("_key", prices, default).alias("_p")).select("model", "_p.*")
    known = prices.select(F.lower("model_prefix").alias("_prefix"), "model_prefix", *PRICE_COLUMNS)
    length = F.length(model_key(F.col("model")))
    tried = distinct.select(
        "model", model_key(F.col("model")).alias("_id"), F.explode_outer(F.when(length > 0, F.sequence(F.lit(1), length))).alias("_len")
    ).withColumn("_prefix", F.lower(F.substring(F.col("_id"), F.lit(1), F.col("_len"))))
    # An exact id beats a prefix of the same length that differs in case; a prefix without a price has no rank.
    rank = F.when(F.col("model_prefix").isNotNull(), F.struct(F.col("_len"), (F.col("_id") == F.col("model_prefix")).cast("int")))
    best = tried.join(known, "_prefix", "left").groupBy("model").agg(F.max_by(F.struct("model_prefix", *PRICE_COLUMNS), rank).alias("_p"))
    return best.select("model", F.coalesce("_p", _default_struct(default)).alias("_p")).select("model", "_p.*")


def with_prices(df: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """Add the price columns to rows that have a model."""
    if isinstance(prices, DataFrame):
        return df.join(price_models(df, prices), "model", "left")
    keyed = df.select("*", F.lower(model_key(F.col("model"))).alias("_key"))
    return keyed.select(*df.columns, price_of("_key", prices).alias("_p")).select(*df.columns, "_p.*")


def micro_usd() -> Column:
    """Cost in millionths of a dollar from token and price columns; thinking tokens are billed at the output rate.

    Tokens x price is exact in decimals, and so are sums of it; the one division comes last (`dollars`).
    """
    t = {k: F.coalesce(F.col(k), F.lit(0)).cast("decimal(19,0)") for k in TOKENS}
    rate = {"input_tokens": "input_price", "output_tokens": "output_price", "thinking_tokens": "output_price", "cached_tokens": "cached_price"}
    parts = [(t[k] * F.col(p)).cast("decimal(32,4)") for k, p in rate.items()]
    return (parts[0] + parts[1] + parts[2] + parts[3]).cast("decimal(34,4)")


def dollars(micro: Column, batch_discount: float = 1.0) -> Column:
    return micro.cast("double") * batch_discount / 1_000_000


def price_usage(usage: DataFrame, prices: Prices = PRICES, batch_discount: float = 1.0) -> DataFrame:
    """Cost per call; map-only with a price list. With a price table it is looked up for distinct models only."""
    return (
        with_prices(usage, prices)
        .withColumn("cost_usd", dollars(micro_usd(), batch_discount))
        .drop("model_prefix", "input_price", "output_price", "cached_price")
    )


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("calls")] + [F.sum(F.coalesce(F.col(t), F.lit(0))).alias(t) for t in TOKENS]


def usage_totals(usage: DataFrame, prices: Prices = PRICES, batch_discount: float = 1.0) -> DataFrame:
    """Totals per model, and one overall row whose model is null."""
    per_model = usage.groupBy("model").agg(*_sums())
    priced = with_prices(per_model, prices).withColumn("_micro", micro_usd())
    return priced.rollup("model").agg(
        F.sum("calls").alias("calls"), *[F.sum(t).alias(t) for t in TOKENS], dollars(F.sum("_micro"), batch_discount).alias("cost_usd")
    )


def indicator_costs(usage: DataFrame, prices: Prices = PRICES, batch_discount: float = 1.0) -> DataFrame:
    """Cost per indicator; calls without an indicator are left out."""
    named = usage.where(F.col("indicator").isNotNull()).groupBy("indicator", "model").agg(*_sums())
    priced = with_prices(named, prices).withColumn("_micro", micro_usd())
    return priced.groupBy("indicator").agg(dollars(F.sum("_micro"), batch_discount).alias("cost_usd"), F.sum("calls").alias("calls"))


def split_prompt_cost(usage: DataFrame, indicators: str = "indicators") -> DataFrame:
    """A combined prompt's cost over its indicators: cost / n, tokens // n."""
    n = F.size(indicators)
    share = [F.floor(F.col(t) / n).cast("bigint").alias(t) for t in TOKENS if t in usage.columns]
    rest = [c for c in usage.columns if c not in TOKENS and c not in (indicators, "cost_usd", "indicator")]
    return usage.where(n > 0).select(
        *rest, F.explode(indicators).alias("indicator"), *share, (F.col("cost_usd") / n).alias("cost_usd")
    )


def estimate_run(
    requests: DataFrame, prices: Prices = PRICES, batch_discount: float = 1.0, chars_per_token: int = 4,
    output_tokens: int = 500,
) -> DataFrame:
    """Cost of a planned run per model, from the real prompt sizes."""
    size = F.length(F.concat("system_prompt", "user_prompt"))
    planned = requests.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.ceil(size / chars_per_token)).alias("input_tokens"),
        (F.count(F.lit(1)) * F.lit(output_tokens)).alias("output_tokens"),
        F.lit(0).cast("bigint").alias("cached_tokens"),
        F.lit(0).cast("bigint").alias("thinking_tokens"),
    )
    priced = with_prices(planned, prices)
    return priced.select("model", "calls", "input_tokens", "output_tokens", dollars(micro_usd(), batch_discount).alias("cost_usd"))


def observed_progress(df: DataFrame, groups: Sequence[str | None], status: str = "status", by: str = "indicator") -> tuple[DataFrame, Observation]:
    """The frame, to be written in place of `df`, and an observation of its progress.

    While the one write runs, every task counts its rows per group; no second pass, no shuffle. The groups have to be
    known (a registry's indicators, and None for null); rows of others are counted in the total alone. Read it with
    `progress_of` after the write.
    """
    seen = Observation()
    metrics = []
    for n, g in enumerate(groups):
        mine = F.col(by).isNull() if g is None else F.coalesce(F.col(by) == g, F.lit(False))
        metrics += [F.count_if(mine).alias(f"total_{n}"), F.count_if(mine & (F.col(status) == "ok")).alias(f"completed_{n}"),
                    F.count_if(mine & (F.col(status) == "error")).alias(f"failed_{n}")]
    return df.observe(seen, F.count(F.lit(1)).alias("total"), *metrics), seen


def progress_of(seen: Observation, groups: Sequence[str | None]) -> list[tuple]:
    """(group, total, completed, failed, success rate) per group that had rows, as `progress` gives them."""
    got = seen.get
    out = []
    for n, g in enumerate(groups):
        total, done, failed = (got[f"{k}_{n}"] for k in ("total", "completed", "failed"))
        if total:
            out.append((g, total, done, failed, done / (done + failed) if done + failed else None))
    return out


def progress(df: DataFrame, status: str = "status", by: Sequence[str] = ()) -> DataFrame:
    """Completed, failed and success rate."""
    done, failed = F.count_if(F.col(status) == "ok"), F.count_if(F.col(status) == "error")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        done.alias("completed"),
        failed.alias("failed"),
        (done.cast("double") / F.nullif(done + failed, F.lit(0))).alias("success_rate"),
    )

