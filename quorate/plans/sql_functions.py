"""Hooks for SQL: prompt building and model calls as table functions, for use with LATERAL."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quorate.operators.requests import USER_TEMPLATE, combined_system_prompt
from quorate.registry import Registry


def register_sql(
    spark: SparkSession, registry: Registry, open_client: Callable[[], Callable[..., Any]] | None = None,
    templates: Mapping[str, str] | None = None, prefix: str = "",
) -> None:
    """Register `prompts(indicators, polity, name, start, end)` and, with a client, `annotate(indicators, system, user, temperature)`.

    `prompts` gives a row (indicator, system_prompt, user_prompt) for each of the comma-separated indicators; `templates`
    has user prompts by indicator, others take the default. `annotate` calls the model and gives one row: status, error, and a
    typed column set per indicator. Both check the indicators and derive their columns when the query is analysed, so
    `indicators` has to be a literal. What they know of the registry is a few texts, sent along with the function.
    """
    wanted = {n: (templates or {}).get(n, USER_TEMPLATE) for n in registry.names}
    systems = {n: combined_system_prompt(registry, [n]) for n in registry.names}
    many = {n: registry[n].multi_select for n in registry.names}

    def names_of(argument: AnalyzeArgument) -> list[str]:
        if not argument.isConstantExpression or not isinstance(argument.value, str):
            raise ValueError("the indicators have to be a literal text such as 'sovereign,assembly'")
        names = [n.strip() for n in argument.value.split(",") if n.strip()]
        unknown = [n for n in names if n not in wanted]
        if unknown or not names:
            raise ValueError(f"unknown indicators {unknown}; known: {sorted(wanted)}")
        return names

    class Prompts:
        @staticmethod
        def analyze(indicators: AnalyzeArgument, polity: AnalyzeArgument, name: AnalyzeArgument, start: AnalyzeArgument, end: AnalyzeArgument) -> AnalyzeResult:
            names_of(indicators)
            return AnalyzeResult(StructType().add("indicator", StringType()).add("system_prompt", StringType()).add("user_prompt", StringType()))

        def eval(self, indicators, polity, name, start, end):
            last = "present" if end is None else end
            for n in (x.strip() for x in indicators.split(",")):
                if not n:
                    continue
                # As in a concat, a missing value leaves no prompt.
                values = {"polity": polity, "name": name, "start_year": start, "end_year": last, "period": None if start is None else f"{start}-{last}", "indicator": n}
                used = [k for k in values if "{" + k + "}" in wanted[n]]
                yield n, systems[n], None if any(values[k] is None for k in used) else wanted[n].format(**values)

    class Annotate:
        @staticmethod
        def analyze(indicators: AnalyzeArgument, system: AnalyzeArgument, user: AnalyzeArgument, temperature: AnalyzeArgument) -> AnalyzeResult:
            schema = StructType().add("status", StringType()).add("error", StringType()).add("text", StringType())
            for n in names_of(indicators):
                schema = schema.add(n, ArrayType(StringType()) if many[n] else StringType()).add(f"{n}_reasoning", StringType()).add(f"{n}_confidence", IntegerType())
            return AnalyzeResult(schema)

        def __init__(self):
            self.call = open_client()

        def eval(self, indicators, system, user, temperature):
            import json

            names = [x.strip() for x in indicators.split(",") if x.strip()]
            nothing = [None] * (3 * len(names))
            try:
                answer = self.call(system, user, temperature)
            except Exception as e:  # a failed call is a row
                yield ("error", f"{type(e).__name__}: {e}", None, *nothing)
                return
            text = answer.get("text") if isinstance(answer, dict) else answer
            try:
                found = json.JSONDecoder().raw_decode(text[text.index("{"):])[0]
            except (ValueError, AttributeError, TypeError):
                yield ("ok", None, text, *nothing)
                return
            out = []
            for n in names:
                value, score = found.get(n, found.get(f"{n}_prediction")), found.get(f"{n}_confidence")
                plain = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
                listed = [plain(x) for x in (value if isinstance(value, list) else [value])] if value is not None else None
                whole = int(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else None
                out += [listed if many[n] else plain(value), plain(found.get(f"{n}_reasoning", "")), whole]
            yield ("ok", None, text, *out)

    spark.udtf.register(f"{prefix}prompts", udtf(Prompts))
    if open_client is not None:
        spark.udtf.register(f"{prefix}annotate", udtf(Annotate))
