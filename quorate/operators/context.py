"""Reference text for prompts, from up to three tiers of context tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.templates import pipe_list
from quorate.functions.values import strip

# A tier is asked only while the text so far is shorter than this.
MIN_CONTEXT_CHARS = 200

PREAMBLE = "Background found for this case; it may be incomplete or wrong.\n\n"
OPENING = "<<< notes from the context tables\n"
CLOSING = "\nnotes end >>>\n\n"


def tiered_context(
    rows: DataFrame, tiers: Sequence[tuple[str, DataFrame]], key: str = "row_idx", min_chars: int = MIN_CONTEXT_CHARS
) -> DataFrame:
    """(key, context, context_sources, context_urls) for every row.

    Each tier is a table (key, context, urls). Of several rows of a key the first in the order of (context, urls) among
    those with a context counts, so a row never multiplies. A tier is joined on the key and on "text so far
    is short", so it only counts for rows that still need it. All joins use the same key: the rows are shuffled
    once and each tier once.
    """
    empty = F.array().cast("array<string>")
    out = rows.select(key, empty.alias("_texts"), empty.alias("_names"), empty.alias("_urls"))
    for name, table in tiers:
        one = F.min(F.struct(F.col("context").alias("_c"), F.col("urls").alias("_u"))).alias("_one")
        tier = table.where("context <> ''").groupBy(F.col(key).alias("_k")).agg(one).select("_k", "_one.*")
        short = F.length(F.array_join("_texts", "\n")) < min_chars
        hit = F.coalesce(F.col("_c") != "", F.lit(False))
        out = out.join(tier, (F.col(key) == F.col("_k")) & short, "left").select(
            key,
            F.when(hit, F.concat("_texts", F.array("_c"))).otherwise(F.col("_texts")).alias("_texts"),
            F.when(hit, F.concat("_names", F.array(F.lit(name)))).otherwise(F.col("_names")).alias("_names"),
            F.when(hit, F.concat("_urls", F.coalesce("_u", empty))).otherwise(F.col("_urls")).alias("_urls"),
        )
    return out.select(
        key,
        strip(F.array_join("_texts", "\n")).alias("context"),
        pipe_list(F.col("_names")).alias("context_sources"),
        pipe_list(F.col("_urls")).alias("context_urls"),
    )


def tiered_context_columns(contexts: Sequence[tuple[str, Column]], min_chars: int = MIN_CONTEXT_CHARS) -> dict[str, Column]:
    """The same rule where all tiers already stand in the row."""
    text, names = F.lit(""), F.array().cast("array<string>")
    for name, c in contexts:
        use = (F.length(text) < min_chars) & F.coalesce(c != "", F.lit(False))
        joined = F.when(text == "", c).otherwise(F.concat(text, F.lit("\n"), c))
        names = F.when(use, F.concat(names, F.array(F.lit(name)))).otherwise(names)
        text = F.when(use, joined).otherwise(text)
    return {"context": strip(text), "context_sources": pipe_list(names)}


def enrich(prompt: Column, context: Column, preamble: str = PREAMBLE) -> Column:
    """Put the context before the prompt; without context the prompt stays as it is."""
    wrapped = F.concat(F.lit(preamble), F.lit(OPENING), context, F.lit(CLOSING), prompt)
    return F.when(F.coalesce(context, F.lit("")) == "", prompt).otherwise(wrapped)


def enrich_prompts(prompts: DataFrame, contexts: DataFrame, key: str = "row_idx", preamble: str = PREAMBLE) -> DataFrame:
    """Put each row's context into its prompts and keep where it came from (search_urls, search_sources)."""
    c = contexts.select(key, F.col("context").alias("_c"), F.col("context_sources").alias("search_sources"), F.col("context_urls").alias("search_urls"))
    joined = prompts.join(c, key, "left").withColumn("user_prompt", enrich(F.col("user_prompt"), F.col("_c"), preamble))
    return joined.drop("_c")
