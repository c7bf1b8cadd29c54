"""Answers as VARIANT: parsed once, JSON types kept, so that "1" and 1 are told apart without a look at the raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions.answers import STRICT_JSON, last_key_wins, parse_answer, pick_label, pick_labels
from quorate.functions.values import NUMBER, WHOLE


def parse_variant(text: Column) -> Column:
    """First JSON object in the text as VARIANT; null when there is none.

    The parse starts at the first "{" and stops at the brace that closes it. An object that names a key twice is no
    VARIANT; it is read as a map with the last value of each key, and its values count as quoted texts.
    """
    at = F.instr(text, "{")
    body = F.when(at > 0, F.substr(text, at))
    # A repeated key is rare, so the second parse is too.
    again = F.from_json(F.to_json(last_key_wins(parse_answer(text))), "variant")
    return F.coalesce(F.from_json(body, "variant", STRICT_JSON), F.when(at > 0, again))


def _path(key: str) -> str:
    quote = '"' if "'" in key else "'"
    return f"$[{quote}{key}{quote}]"


def field(answer: Column, key: str, kind: str = "string") -> Column:
    """Value of a key in a type; null when absent, JSON null or of no such form."""
    return F.try_variant_get(answer, _path(key), kind)


def kind_of(answer: Column, key: str) -> Column:
    """JSON type of a key's value as SQL names it (STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID, ARRAY<..>, OBJECT<..>)."""
    return F.schema_of_variant(F.try_variant_get(answer, _path(key), "variant"))


def simple_kind(kind: Column) -> Column:
    """string, number, boolean, null, list or object; null where the key is absent."""
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.isNotNull(), "number")
    )


def has_field(answer: Column, key: str) -> Column:
    """Whether the key is there, be its value null or not."""
    return kind_of(answer, key).isNotNull()


def label_name(answer: Column, indicator: str) -> Column:
    """Whether the label stands under the indicator's own name (else under name + "_prediction")."""
    return field(answer, indicator, "string").isNotNull()


def read_label(answer: Column, indicator: str, labels: Column) -> Column:
    """Label of an indicator; the rules of `answers.pick_label` and `pick_labels`, decided by the JSON type."""

    def of(key: str) -> Column:
        kind, value = kind_of(answer, key), field(answer, key)
        return F.when(kind.startswith("ARRAY"), pick_labels(value, labels)).otherwise(pick_label(value, labels, kind == "STRING"))

    return F.when(label_name(answer, indicator), of(indicator)).otherwise(of(f"{indicator}_prediction"))


def read_reasoning(answer: Column, indicator: str) -> Column:
    """Reasoning text; the first key that is present wins, even when its value is null."""
    own = f"{indicator}_reasoning"
    return F.when(has_field(answer, "reasoning"), field(answer, "reasoning")).when(has_field(answer, own), field(answer, own)).otherwise(F.lit(""))


def read_score(answer: Column, indicator: str) -> Column:
    """Whole number 1..100 from the first confidence key present. A text must be whole; a bare decimal is cut."""

    def of(key: str) -> Column:
        kind, value = kind_of(answer, key), field(answer, key)
        return (
            F.when(kind == "BOOLEAN", (value == "true").cast("double"))
            .when(value.rlike(WHOLE), value.try_cast("double"))
            .when((kind != "STRING") & value.rlike(NUMBER), value.try_cast("double"))
        )

    own = f"{indicator}_confidence"
    score = F.when(has_field(answer, "confidence_score"), of("confidence_score")).when(has_field(answer, own), of(own)).otherwise(of(f"{own}_score"))
    return F.when(score < 1, 1).when(score > 100, 100).otherwise(score.cast("int"))
