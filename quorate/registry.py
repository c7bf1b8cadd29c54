"""Indicators, their labels, question texts and model prices.

A registry is small driver-side data, written by hand. What is derived from it (literal arrays, exploded rows, small
frames) is as large as the registry, whatever the data; there is no cap on labels, indicators or prices.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Label sets per indicator.
INDICATOR_LABELS = {
    "sovereign": ("0", "1"),
    "federalism": ("0", "1"),
    "checks_local": ("0", "1"),
    "checks_military": ("0", "1"),
    "checks_clergy": ("0", "1"),
    "checks_aristocracy": ("0", "1"),
    "checks_bourgeoisie": ("0", "1"),
    "checks_bureaucracy": ("0", "1"),
    "checks_judiciary": ("0", "1"),
    "checks_assembly": ("0", "1"),
    "checks_council": ("0", "1"),
    "collegiality": ("0", "1"),
    "petition": ("0", "1"),
    "assembly": ("0", "1", "2", "3"),
    "entry": ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "99"),
    "exit": ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14", "99"),
    "symbolism": ("0", "1", "2", "3"),
    "elections": ("0", "1", "2"),
    "constitution": ("0", "1", "2"),
}

# Which label of which indicator opens a dependent indicator.
DEPENDS_ON = {"elections": {"assembly": "2"}}

# Order of sections in a sequential prompt.
DEFAULT_SEQUENCE = (
    "constitution", "sovereign", "federalism", "checks_local", "checks_military", "checks_clergy",
    "checks_aristocracy", "checks_bourgeoisie", "checks_bureaucracy", "checks_judiciary", "checks_assembly",
    "checks_council", "collegiality", "petition", "assembly", "entry", "exit", "symbolism",
)

# Label assumed for indicators the registry does not know.
UNKNOWN_LABELS = ("0", "1")

# USD per million tokens by model prefix (input, output, cached input).
PRICES = {
    "gpt-4o": (2.50, 10.00, 1.25),
    "gpt-4o-mini": (0.15, 0.60, 0.075),
    "gpt-4-turbo": (10.00, 30.00, 5.00),
    "gpt-4": (30.00, 60.00, 15.00),
    "gpt-3.5-turbo": (0.50, 1.50, 0.25),
    "o1": (15.00, 60.00, 7.50),
    "o1-mini": (3.00, 12.00, 1.50),
    "o3-mini": (1.10, 4.40, 0.55),
    "claude-3-5-sonnet-20241022": (3.00, 15.00, 0.30),
    "claude-3-5-haiku-20241022": (0.80, 4.00, 0.08),
    "claude-3-opus-20240229": (15.00, 75.00, 1.50),
    "claude-3-sonnet-20240229": (3.00, 15.00, 0.30),
    "claude-3-haiku-20240307": (0.25, 1.25, 0.025),
    "gemini-3.1-pro-preview": (2.00, 12.00, 0.20),
    "gemini-3.1-pro": (2.00, 12.00, 0.20),
    "gemini-3.5-flash": (1.50, 9.00, 0.15),
    "gemini-2.5-pro": (1.25, 10.00, 0.125),
    "gemini-2.5-flash": (0.15, 3.50, 0.015),
    "gemini-2.0-flash": (0.10, 0.40, 0.01),
    "gemini-1.5-pro": (1.25, 5.00, 0.125),
    "gemini-1.5-flash": (0.075, 0.30, 0.0075),
    "anthropic.claude-3-5-sonnet-20241022-v2:0": (3.00, 15.00, 0.30),
    "anthropic.claude-3-5-haiku-20241022-v1:0": (1.00, 5.00, 0.10),
    "anthropic.claude-3-opus-20240229-v1:0": (15.00, 75.00, 1.50),
    "anthropic.claude-3-sonnet-20240229-v1:0": (3.00, 15.00, 0.30),
    "anthropic.claude-3-haiku-20240307-v1:0": (0.25, 1.25, 0.025),
    "anthropic.claude-sonnet-4-5-20250929-v1:0": (3.00, 15.00, 0.30),
    "anthropic.claude-opus-4-5-20250514-v1:0": (15.00, 75.00, 1.50),
    "global.anthropic.claude-sonnet-4-5-20250929-v1:0": (3.00, 15.00, 0.30),
    "global.anthropic.claude-opus-4-5-20250514-v1:0": (15.00, 75.00, 1.50),
    "us.anthropic.claude-sonnet-4-5-20250929-v1:0": (3.00, 15.00, 0.30),
    "us.anthropic.claude-opus-4-5-20250514-v1:0": (15.00, 75.00, 1.50),
}

# Price of a model no prefix fits.
DEFAULT_PRICE = (5.00, 15.00, 0.50)

# Check questions asked when an indicator brings none of its own.
GENERIC_QUESTIONS = (
    "Which sources describe the {indicator} of {polity} under {name} ({start_year}-{end_year})?",
    "What did {indicator} look like in {polity} while {name} held power, and how certain is that?",
)


@dataclass(frozen=True)
class Indicator:
    """One label column to be produced."""

    name: str
    labels: tuple[str, ...]
    definition: str = ""
    depends_on: Mapping[str, str] = field(default_factory=dict)
    multi_select: bool = False
    questions: tuple[str, ...] = GENERIC_QUESTIONS


class Registry:
    """An ordered set of indicators."""

    def __init__(self, indicators: Iterable[Indicator]):
        self._by_name = {i.name: i for i in indicators}

    def __getitem__(self, name: str) -> Indicator:
        if name not in self._by_name:
            raise ValueError(f"unknown indicator {name!r}; known: {sorted(self._by_name)}")
        return self._by_name[name]

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    @property
    def names(self) -> list[str]:
        return list(self._by_name)

    @property
    def independent(self) -> list[str]:
        return [i.name for i in self._by_name.values() if not i.depends_on]

    @property
    def dependent(self) -> dict[str, dict[str, str]]:
        return {i.name: dict(i.depends_on) for i in self._by_name.values() if i.depends_on}

    def subset(self, names: Iterable[str]) -> "Registry":
        return Registry(self[n] for n in names)

    def labels(self, name: str) -> tuple[str, ...]:
        return self._by_name[name].labels if name in self._by_name else UNKNOWN_LABELS

    def labels_of(self, indicator: Column) -> Column:
        """Label array of the indicator named by a column."""
        if not self._by_name:
            return string_array(UNKNOWN_LABELS)
        pairs = ", ".join(f"{quoted(i.name)}, {_array_sql(i.labels)}" for i in self._by_name.values())
        return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), indicator), string_array(UNKNOWN_LABELS))

    def answer_schema(self, names: Iterable[str], reasoning: bool = True) -> str:
        """DDL of the JSON object expected for these indicators."""
        fields = []
        for name in names:
            kind = "array<string>" if self[name].multi_select else "string"
            fields.append(f"`{name}` {kind}")
            if reasoning:
                fields.append(f"`{name}_reasoning` string")
            fields.append(f"`{name}_confidence` int")
        return ", ".join(fields)

    def to_df(self, spark: SparkSession) -> DataFrame:
        text, texts = pa.string(), pa.list_(pa.string())
        rows = [
            (i.name, list(i.labels), list(i.depends_on.items()), i.multi_select, i.definition, list(i.questions))
            for i in self._by_name.values()
        ]
        kinds = {
            "indicator": text, "labels": texts, "depends_on": pa.map_(text, text), "multi_select": pa.bool_(),
            "definition": text, "questions": texts,
        }
        return local_frame(spark, kinds, rows)


def local_frame(spark: SparkSession, kinds: Mapping[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """A small driver-made table as a local relation.

    Through Arrow it keeps its size in the plan, so Spark itself sees that it is small enough to broadcast.
    """
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    arrays = [pa.array(list(c), type=t) for c, t in zip(columns, kinds.values())]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(kinds)))


def quoted(text: str) -> str:
    """A text as a SQL literal. Literal tables are handed over as one expression instead of one call per value."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array_sql(values: Iterable[str]) -> str:
    items = ", ".join(quoted(v) for v in values)
    return f"array({items})" if items else "cast(array() as array<string>)"


def string_array(values: Iterable[str]) -> Column:
    return F.expr(_array_sql(values))


def prices_df(spark: SparkSession, prices: Mapping[str, tuple[float, float, float]] = PRICES) -> DataFrame:
    money = pa.decimal128(10, 4)
    rows = [(p, *(Decimal(str(x)) for x in v)) for p, v in prices.items()]
    kinds = {"model_prefix": pa.string(), "input_price": money, "output_price": money, "cached_price": money}
    return local_frame(spark, kinds, rows)


DEFAULT_REGISTRY = Registry(
    Indicator(name, labels, depends_on=DEPENDS_ON.get(name, {})) for name, labels in INDICATOR_LABELS.items()
)
