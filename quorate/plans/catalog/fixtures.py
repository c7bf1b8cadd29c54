"""Annotation tables derived from the given tables.

The given tables hold no votes, answers or failures, so these are computed from their columns. Each fixture is
one projection whose expressions read the same in Spark SQL and in DuckDB, so both sides start from equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


INDICATORS = (("sovereign", 2), ("assembly", 4), ("entry", 11))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@dataclass(frozen=True)
class Fixture:
    """A projection of a table, optionally repeated per indicator and per sample."""

    name: str
    source: str
    columns: dict[str, str]
    indicators: bool = False
    samples: int = 0

    def df(self, spark: SparkSession, sf: str) -> DataFrame:
        out = table(spark, sf, self.source)
        if self.indicators:
            pairs = F.array(*[F.struct(F.lit(i).alias("indicator"), F.lit(n).alias("n")) for i, n in INDICATORS])
            out = out.select("*", F.inline(pairs))
        if self.samples:
            out = out.select("*", F.explode(F.array(*[F.lit(i) for i in range(self.samples)])).alias("sc_idx"))
        return out.selectExpr(*[f"{e} as {a}" for a, e in self.columns.items()])

    @property
    def cte(self) -> str:
        dims = ""
        if self.indicators:
            rows = ", ".join(f"('{i}', {n})" for i, n in INDICATORS)
            dims += f" cross join (values {rows}) ind(indicator, n)"
        if self.samples:
            dims += f" cross join (select unnest(range(0, {self.samples})) as sc_idx) smp"
        cols = ", ".join(f"{e} as {a}" for a, e in self.columns.items())
        return f"{self.name} as (select {cols} from {self.source}{dims})"


def with_ctes(fixtures, body: str) -> str:
    return "with " + ",\n".join(f if isinstance(f, str) else f.cte for f in fixtures) + "\n" + body


VOTES = Fixture(
    "votes3", "documents",
    {
        "row_idx": "doc_id",
        "indicator": "indicator",
        "sc_idx": "sc_idx",
        "prediction": "case when (doc_id*3 + sc_idx*7 + n) % 13 = 0 or (doc_id % 97 = 0 and indicator = 'assembly') then null "
        "else cast((doc_id*31 + sc_idx*(doc_id % 5)*17 + n) % n as string) end",
        "reasoning": "case when (doc_id + sc_idx) % 11 = 0 then '' else source || ' ' || cast(sc_idx as string) end",
        "confidence": "case when (doc_id + sc_idx) % 17 = 0 then null else cast((doc_id + sc_idx*7) % 100 + 1 as int) end",
    },
    indicators=True, samples=3,
)
EVENT_VOTES = Fixture(
    "event_votes", "events",
    {"row_idx": "user_id", "indicator": "'event'", "sc_idx": "event_id", "prediction": "event_type"},
)
PAIRS = Fixture(
    "pairs", "documents",
    {
        "row_idx": "doc_id",
        "indicator": "indicator",
        "dataset": "case when n_chars % 2 = 0 then 'base' else 'checked' end",
        "truth": "case when doc_id % 19 = 0 then null else cast((doc_id*7 + n_chars) % n as string) end",
        "prediction": "case when doc_id % 23 = 0 then null when doc_id % 3 = 0 then cast((doc_id*11 + n_chars*5) % n as string) "
        "when doc_id % 41 = 0 then '77' else cast((doc_id*7 + n_chars) % n as string) end",
    },
    indicators=True,
)
RATERS = Fixture(
    "raters", "lineitem",
    {
        "indicator": "l_linestatus",
        "truth": "l_returnflag",
        "prediction": "case when (l_orderkey + l_linenumber) % 4 = 0 then 'A' when (l_partkey % 9) = 0 then 'R' else l_returnflag end",
    },
)
LABEL_RATERS = Fixture(
    "label_raters", "labels",
    {"row_idx": "doc_id", "indicator": "'quality'", "truth": "cast(quality as string)", "prediction": "cast(1 - toxic as string)"},
)
WIDE = Fixture(
    "wide_eval", "documents",
    {
        "row_idx": "doc_id",
        "start_year": "cast(doc_id % 2000 - 500 as int)",
        "end_year": "cast(doc_id % 2000 - 500 + n_chars % 60 as int)",
        "region_v1": "lang",
        "sovereign": "case when doc_id % 13 = 0 then null else cast(doc_id % 2 as double) end",
        "sovereign_prediction": "case when doc_id % 17 = 0 then null else cast((doc_id*3 + n_chars) % 2 as string) end",
        "collegiality": "cast(n_chars % 2 as int)",
        "collegiality_prediction": "cast((doc_id + n_chars) % 2 as string) || '.0'",
        "assembly": "cast(doc_id % 4 as double)",
        "assembly_prediction": "case when doc_id % 5 = 0 then cast(n_chars % 4 as string) else cast(doc_id % 4 as string) end",
        "sovereign_b": "case n_chars % 4 when 0 then 'nan' when 1 then '' when 2 then '1' else '0' end",
        "sovereign_c": "case when n_chars % 3 = 0 then '1' else '0' end",
    },
)

# Answer texts: labels and scores in the shapes models give them, in several wrappings.
_SOV = (
    "case (doc_id*7 + sc_idx) % 9 when 0 then '\"1\"' when 1 then '1' when 2 then '0.0' when 3 then '\"1 (likely)\"' "
    "when 4 then 'true' when 5 then '\"yes\"' when 6 then 'null' when 7 then '\"5\"' else '\"true\"' end"
)
_CONF = (
    "case (doc_id*5 + sc_idx) % 7 when 0 then '85' when 1 then '\"60\"' when 2 then '85.5' when 3 then '\"85.5\"' "
    "when 4 then '250' when 5 then '-3' else 'null' end"
)
_BODY = (
    "'{\"sovereign\": ' || " + _SOV + " || ', \"sovereign_reasoning\": \"' || source || ' ' || cast(n_chars as string) || "
    "'\", \"sovereign_confidence\": ' || " + _CONF + " || ', \"assembly\": \"' || cast((doc_id + sc_idx*(doc_id % 3)) % 5 as string) || "
    "'\", \"assembly_confidence\": ' || cast(doc_id % 120 as string) || ', \"more\": {\"k\": ' || cast(sc_idx as string) || '}}'"
)
_WRAPPED = (
    "case (doc_id + sc_idx) % 9 when 0 then " + _BODY
    + " when 1 then '```json' || chr(10) || " + _BODY + " || chr(10) || '```'"
    + " when 2 then 'Here is the answer: ' || " + _BODY + " || ' I hope {this} helps.'"
    + " when 3 then substr(" + _BODY + ", 1, length(" + _BODY + ") - 9)"
    + " when 4 then ''"
    + " else " + _BODY + " end"
)
RESPONSES = Fixture(
    "responses", "documents",
    {
        "custom_id": "cast(doc_id as string) || '|single|' || cast(sc_idx as string)",
        "text": _WRAPPED,
    },
    samples=3,
)
RESPONSE_INDICATORS = ("sovereign", "assembly")

_TYPES = "case doc_id % 6 when 0 then '1; 2' when 1 then '2' when 2 then 'N/A' when 3 then '1; x' when 4 then '0;1;1' else '3' end"
_NAMES = "case doc_id % 5 when 0 then 'Charter; Edict' when 1 then ' Code ' when 2 then 'N/A' when 3 then '' else 'Uncodified customary law' end"
_YEARS = (
    "case doc_id % 7 when 0 then 'c. 1240; circa 1215;~1100' when 1 then 'N/A' when 2 then '-509' when 3 then 'approx. 1300; unknown' "
    "when 4 then ' ; ' when 5 then 'ca. ' || cast(n_chars as string) else cast(doc_id as string) || '; ' || cast(n_chars as string) end"
)
YEARS = Fixture("year_lists", "documents", {"row_idx": "doc_id", "years": _YEARS})
_LABEL = "case doc_id % 8 when 0 then '2' when 1 then '\"yes\"' when 2 then 'false' when 3 then '\" 1 \"' when 4 then 'null' when 5 then '1.9' when 6 then '\"maybe\"' else '0' end"
DOCUMENT_RESPONSES = Fixture(
    "document_responses", "documents",
    {
        "row_idx": "doc_id",
        "label_json": _LABEL,
        "names": _NAMES,
        "types": _TYPES,
        "years": _YEARS,
        "text": "'{\"constitution\": ' || " + _LABEL + " || ', \"document_name\": \"' || " + _NAMES
        + " || '\", \"document_types\": \"' || " + _TYPES + " || '\", \"constitution_year\": \"' || " + _YEARS
        + " || '\", \"reasoning\": \"' || source || '\", \"confidence_score\": ' || cast(doc_id % 130 as string) || '}'",
        "source": "source",
        "score": "doc_id % 130",
    },
)
DOCUMENTS_WIDE = Fixture(
    "documents_wide", "documents",
    {
        "row_idx": "doc_id",
        "constitution_prediction": "case doc_id % 5 when 0 then '0' when 1 then '1' when 2 then '2.0' when 3 then null else '2' end",
        "constitution_confidence": "case doc_id % 11 when 0 then null when 1 then -1 when 2 then 20 else cast(doc_id % 100 as int) end",
        "constitution_reasoning": "case when doc_id % 13 = 0 then null when n_chars % 3 = 0 then lang else source || ' ' || lang end",
        "constitution_document_name": _NAMES,
        "constitution_year": _YEARS,
        "constitution_document_types": _TYPES,
        "sovereign_prediction": "case when doc_id % 9 = 0 then null else cast(doc_id % 2 as string) end",
        "sovereign_confidence": "case when doc_id % 10 = 0 then -1 else cast(n_chars % 100 as int) end",
        "sovereign_reasoning": "source",
    },
)
REPROCESSED = Fixture(
    "reprocessed", "documents",
    {
        "row_idx": "doc_id",
        "attempt": "sc_idx",
        "sovereign_prediction": "cast((doc_id + sc_idx) % 2 as string)",
        "sovereign_confidence": "case when doc_id % 5 = 0 or (doc_id + sc_idx) % 3 = 0 then -1 when n_chars % 7 = 0 then null else cast(90 + sc_idx as int) end",
        "sovereign_note": "source || ' again ' || cast(sc_idx as string)",
    },
    samples=2,
)
RULERS = Fixture(
    "rulers", "customer",
    {
        "row_idx": "c_custkey",
        "polity_name": "case when c_custkey % 29 = 0 then null else 'polity ' || cast(c_nationkey as string) end",
        "polity_region": "c_mktsegment",
        "leader_name": "case when c_custkey % 31 = 0 then null else c_name end",
        "leader_first_year": "case when c_custkey % 37 = 0 then null else cast(c_custkey % 1900 - 400 as int) end",
        "leader_last_year": "case when c_custkey % 9 = 0 then null else cast(c_custkey % 1900 - 400 + c_custkey % 30 as int) end",
        "assembly_prediction": "case c_custkey % 5 when 0 then '2' when 1 then '2.0' when 2 then '1' when 3 then null else '3' end",
    },
)
RAW_RULERS = Fixture(
    "raw_rulers", "orders",
    {
        "row_idx": "o_orderkey",
        "territorynamehistorical": "case when o_custkey % 50 = 7 then null else 'éland ' || cast(o_custkey % 1000 as string) end",
        "region": "case when o_orderkey % 3 = 0 then null else o_orderpriority end",
        "name_clean": "case when o_orderkey % 11 = 0 then null else 'ruler ' || cast(o_orderkey as string) end",
        "entrydateyear": "cast(o_orderkey % 1800 - 300 as int)",
        "exitdateyear": "case when o_orderkey % 7 = 0 then null else cast(o_orderkey % 1800 - 300 + o_orderkey % 25 as int) end",
        "powersharing": "case when o_orderkey % 4 = 0 then null else cast(case when o_orderkey % 97 = 96 then 1 else 0 end as int) end",
        "sovereign": "case when o_custkey % 13 = 0 then null else cast(o_orderkey % 2 as int) end",
        "assembly_binary": "cast(case when o_orderkey % 53 = 0 then 1 else 0 end as int)",
        "appointment": "case when o_orderkey % 6 = 0 then null else cast(o_orderkey % 3 as int) end",
        "tenure": "case when o_orderkey % 5 = 0 then null else cast(o_custkey % 13 as int) end",
        "exit": "cast(case when o_orderstatus = 'F' then 1 else 0 end as int)",
    },
)
USAGE = Fixture(
    "usage", "events",
    {
        "call_id": "event_id",
        "ts": "ts",
        "model": "case user_id % 7 when 0 then 'gpt-4o-mini-2024-07-18' when 1 then 'GPT-4o' when 2 then 'claude-3-opus-20240229' "
        "when 3 then 'arn:aws:bedrock:us-east-1:1:inference-profile/us.anthropic.claude-opus-4-5-20250514-v1:0' "
        "when 4 then 'mystery-model' when 5 then 'gemini-2.5-pro-exp' else 'o1-preview' end",
        "input_tokens": "cast(floor(value * 100) as bigint)",
        "output_tokens": "event_id % 700",
        "cached_tokens": "event_id % 50",
        "thinking_tokens": "user_id % 90",
        "indicator": "case event_id % 4 when 0 then null when 1 then 'sovereign' when 2 then 'assembly' else 'entry' end",
        "status": "case when event_type = 'error' then 'error' else 'ok' end",
    },
)
PROBE_ROWS = Fixture(
    "probe_rows", "customer",
    {
        "row_idx": "c_custkey",
        "polity_name": "case when c_custkey % 23 = 0 then 'NA' else 'Old Kingdom ' || cast(c_nationkey as string) end",
        "leader_name": "case when c_custkey % 19 = 0 then ' ' else 'King ' || c_name end",
        "polity_region": "c_mktsegment",
        "leader_first_year": "case when c_custkey % 17 = 0 then 'na' else cast(c_custkey % 1900 - 400 as string) end",
        "leader_last_year": "case when c_custkey % 13 = 0 then '' else cast(c_custkey % 1900 - 400 + c_custkey % 30 as string) end",
        "tenure": "case when c_custkey % 3 = 0 then cast(c_custkey % 30 as string) else 'NA' end",
    },
)
PROBE_RESPONSES = Fixture(
    "probe_responses", "customer",
    {
        "row_idx": "c_custkey",
        "run": "case when sc_idx < 3 then 'one' else 'two' end",
        "question": "case sc_idx % 3 when 0 then 'entry_year' when 1 then 'tenure_from_exit' else 'leader_name' end",
        "text": "case sc_idx % 3 when 0 then case c_custkey % 4 when 0 then '```json' || chr(10) || '{\"year\": ' || cast(c_custkey % 1900 - 400 + c_custkey % 7 as string) || '}```' "
        "when 1 then 'It is {\"year\": \"' || cast(c_custkey % 1900 - 400 + sc_idx as string) || '.5\"} I think' when 2 then 'no idea' else '' end "
        "when 1 then '{\"years\": ' || cast(c_custkey % 36 as string) || '}' "
        "else '{\"name\": \"' || case when c_custkey % 2 = 0 then lower(c_name) else 'someone' end || '\"}' end",
    },
    samples=6,
)
TIERS = Fixture(
    "tier_rows", "documents",
    {
        "row_idx": "doc_id",
        "one": "case doc_id % 3 when 0 then null when 1 then source || ' ' || lang else text end",
        "two": "case doc_id % 4 when 0 then '' when 1 then lang else text end",
        "three": "text",
    },
)
