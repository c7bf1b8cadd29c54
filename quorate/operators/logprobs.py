"""Log-probability of the token that carries a label.

A token stream is an array on its response row, so the running offset is a fold over that array: no explode, no
window, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.registry import Registry


def _escape(text: str) -> str:
    import re

    return re.escape(text)


def _key(indicator: str) -> str:
    return f'"{_escape(indicator)}"\\s*:\\s*'


def _spot(text: Column, indicator: str, tail: str, lead: str) -> Column:
    """0-based place right after key + lead where key + lead + tail first matches; null if nowhere."""
    pattern = f"({_key(indicator)}{lead})({tail})"
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, at - 1 + F.length(F.regexp_extract(text, pattern, 1)))


def label_spots(text: Column, indicator: str, labels: Sequence[str]) -> Column:
    """struct<pos, quoted> of the label value; labels are tried in their order, quoted before bare."""
    tries = []
    for label in labels:
        quoted = _spot(text, indicator, _escape(label) + '"', '"')
        bare = _spot(text, indicator, _escape(label) + r"(?!\d)", "")
        tries.append(F.when(quoted.isNotNull(), F.struct(quoted.alias("pos"), F.lit(True).alias("quoted"))))
        tries.append(F.when(bare.isNotNull(), F.struct(bare.alias("pos"), F.lit(False).alias("quoted"))))
    return F.coalesce(*tries)


def quick_spot(text: Column, indicator: str, labels: Sequence[str]) -> Column:
    """Text of key (and opening quote) in front of a valid label, "" where there is none. One pattern, one pass."""
    any_label = "|".join(_escape(x) for x in labels)
    return F.regexp_extract(text, f'({_key(indicator)}(?:"(?=(?:{any_label})")|(?=(?:{any_label})(?!\\d))))', 1)


def token_at(tokens: Column, pos: Column) -> Column:
    """0-based index of the token that covers a character position; null beyond the stream.

    The fold carries one bigint: tokens passed x 2^32 + characters passed, or -(index + 1) once found.
    """
    turn = F.lit(1 << 32)

    def step(acc: Column, t: Column) -> Column:
        end = (acc % turn) + F.length(t["token"])
        return F.when(acc < 0, acc).when(pos < end, -F.shiftright(acc, 32) - 1).otherwise(acc + turn + F.length(t["token"]))

    def finish(acc: Column) -> Column:
        return F.when((acc < 0) & (pos >= 0), (-acc - 1).cast("int"))

    return F.aggregate(tokens, F.lit(0).cast("bigint"), step, finish)


def label_logprobs(responses: DataFrame, registry: Registry, indicators: Sequence[str], keys: Sequence[str] = ("custom_id",)) -> DataFrame:
    """(keys, indicator, logprob) from (keys, text, tokens array<struct<token,logprob>>)."""
    heads = [F.struct(F.lit(i).alias("indicator"), quick_spot(F.col("text"), i, registry.labels(i)).alias("_head")) for i in indicators]
    found = responses.select(*keys, "tokens", "text", F.inline(F.array(*heads))).where(F.col("_head") != "")
    # A key that stands once has one place. Where it stands again, labels are tried one by one in their order.
    text, name = F.col("text"), F.concat(F.lit('"'), F.col("indicator"), F.lit('"'))
    start = F.instr(text, F.col("_head"))
    once = F.length(text) - F.length(F.replace(text, name, F.lit(""))) == F.length(name)
    quick = F.struct((start - 1 + F.length("_head")).alias("pos"), F.col("_head").endswith('"').alias("quoted"))
    slow = F.lit(None).cast("struct<pos:int,quoted:boolean>")
    for i in indicators:
        slow = F.when(F.col("indicator") == i, label_spots(text, i, registry.labels(i))).otherwise(slow)
    found = found.select(*keys, "tokens", "indicator", F.explode(F.array(F.when(once, quick).otherwise(slow))).alias("spot"))
    at = token_at(F.col("tokens"), F.col("spot.pos"))
    # Where the label lies beyond the stream, its opening quote may still be in it.
    quote = F.when(F.col("spot.quoted"), token_at(F.col("tokens"), F.col("spot.pos") - 1))
    # Exploding the one index keeps the fold out of the filter, where it would be run a second time.
    return (
        found.select(*keys, "indicator", "tokens", F.explode(F.array(F.coalesce(at, quote))).alias("_idx"))
        .where(F.col("_idx").isNotNull())
        .select(*keys, "indicator", F.get(F.col("tokens"), F.col("_idx"))["logprob"].alias("logprob"))
    )


def top_alternatives(
    responses: DataFrame, indicator: str, labels: Sequence[str], keys: Sequence[str] = ("custom_id",), scan: int = 10
) -> DataFrame:
    """Alternatives at the label token: (keys, alternatives array<struct<token,logprob>>).

    `candidates` is an array parallel to `tokens`. The value is the first quote or digit within `scan` characters
    after the key; where that lies beyond the stream, so does everything after it.
    """
    text = F.col("text")
    pattern = f"({_key(indicator)})"
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.when(at > 0, at - 1 + F.length(F.regexp_extract(text, pattern, 1)))
    step = F.regexp_instr(F.substring(text, start + 1, F.lit(scan)), F.lit('["0-9]'))
    pos = F.when((quick_spot(text, indicator, labels) != "") & (step > 0), start + step - 1)
    found = responses.select(*keys, "tokens", "candidates", F.explode(F.array(pos)).alias("_pos")).where(F.col("_pos").isNotNull())
    return (
        found.select(*keys, "candidates", F.explode(F.array(token_at(F.col("tokens"), F.col("_pos")))).alias("_idx"))
        .where(F.col("_idx") < F.size("candidates"))
        .select(*keys, F.get(F.col("candidates"), F.col("_idx")).alias("alternatives"))
    )
