"""Labels and type reports from answers read as VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions import variants as V
from quorate.functions.values import request_id_parts
from quorate.plans.answers import answer_order
from quorate.registry import Registry, string_array


def parsed(responses: DataFrame) -> DataFrame:
    """(custom_id, row_idx, sc_idx, answer_order, answer variant) of the answers whose id names a row."""
    parts = request_id_parts(F.col("custom_id"))
    keyed = responses.select(
        "custom_id", parts["row_idx"].alias("row_idx"), parts["sc_idx"].alias("sc_idx"), answer_order(responses.columns).alias("answer_order"),
        V.parse_variant(F.col("text")).alias("answer"),
    )
    return keyed.where(F.col("row_idx").isNotNull())


def labels_from_variants(responses: DataFrame, registry: Registry, combined: Sequence[str]) -> DataFrame:
    """(custom_id, row_idx, indicator, sc_idx, prediction, reasoning, confidence) of combined answers; each answer is parsed
    once and every indicator is read from it in the same row. Ids answered twice keep both rows."""
    a = F.col("answer")
    read = [
        F.struct(
            F.lit(i).alias("indicator"), V.read_label(a, i, string_array(registry.labels(i))).alias("prediction"),
            V.read_reasoning(a, i).alias("reasoning"), V.read_score(a, i).alias("confidence"),
        )
        for i in combined
    ]
    return parsed(responses).select("custom_id", "row_idx", "sc_idx", F.inline(F.array(*read)))


def answer_types(responses: DataFrame, combined: Sequence[str]) -> DataFrame:
    """(indicator, field, json_type, n): which JSON types the label and the confidence came in; absent keys are null."""
    a = F.col("answer")
    seen = [
        F.struct(F.lit(i).alias("indicator"), F.lit(f).alias("field"), V.simple_kind(V.kind_of(a, key)).alias("json_type"))
        for i in combined for f, key in (("label", i), ("confidence", f"{i}_confidence"))
    ]
    return parsed(responses).select(F.inline(F.array(*seen))).groupBy("indicator", "field", "json_type").agg(F.count(F.lit(1)).alias("n"))


def answer_shape(responses: DataFrame) -> DataFrame:
    """One row: the schema that holds all answers, merged while they are read."""
    return parsed(responses).agg(F.schema_of_variant_agg("answer").alias("shape"), F.count("answer").alias("n_objects"), F.count(F.lit(1)).alias("n_answers"))
