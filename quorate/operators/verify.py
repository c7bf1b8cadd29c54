"""Checking a label by independent questions.

questions fan out -> answered without sight of the label -> gathered per label -> one synthesis answer -> rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.answers import get_key, has_key
from quorate.functions.templates import render
from quorate.functions.values import number
from quorate.operators.votes import last_per_key
from quorate.registry import Registry

KEYS = ("row_idx", "indicator")
ANSWER_SYSTEM = "Answer from verifiable facts only and say when you are unsure."
SYNTHESIS_SYSTEM = "Weigh the evidence for a label."


def question_rows(rows: DataFrame, registry: Registry, indicators: Sequence[str], slots: Mapping[str, Column], per_indicator: int | None = None, row: str = "row_idx") -> DataFrame:
    """(row, indicator, q_idx, question); at most the first k questions of an indicator."""
    made = []
    for i in indicators:
        for n, template in enumerate(registry[i].questions[:per_indicator]):
            text = render(template, {**slots, "indicator": F.lit(i)})
            made.append(F.struct(F.lit(i).alias("indicator"), F.lit(n).alias("q_idx"), text.alias("question")))
    return rows.select(row, F.inline(F.array(*made)))


def gather_answers(questions: DataFrame, answers: DataFrame, n_questions: int) -> DataFrame:
    """Evidence text per (row, indicator), questions in order; a missing answer reads as an error.

    Question places are few and fixed by the registry, so they are brought side by side by an aggregation with a
    bounded buffer instead of gathering lists.
    """
    keys = [*KEYS, "q_idx"]
    qa = questions.join(answers.select(*keys, "answer"), keys, "left")
    line = F.concat(
        F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.coalesce(F.col("answer"), F.lit("Error: no answer")), F.lit("\n")
    )
    side = qa.groupBy(*KEYS).agg(*[F.max(F.when(F.col("q_idx") == n, line)).alias(f"_q{n}") for n in range(n_questions)])
    return side.select(*KEYS, F.array_join(F.array_compact(F.array(*[f"_q{n}" for n in range(n_questions)])), "\n").alias("evidence"))


def synthesis_prompts(initial: DataFrame, evidence: DataFrame, registry: Registry) -> DataFrame:
    labels = registry.labels_of(F.col("indicator"))
    prompt = F.concat(
        F.lit("Indicator: "), F.col("indicator"), F.lit("\nLabel: "), F.col("prediction"),
        F.lit("\nReason: "), F.coalesce(F.col("reasoning"), F.lit("")), F.lit("\n\n"), F.coalesce(F.col("evidence"), F.lit("")),
        F.lit("\nIs the label SUPPORTED, CONTRADICTED or is the evidence INSUFFICIENT? Valid labels: "),
        F.array_join(labels, ", "),
        F.lit('\nAnswer {"decision": text, "final_prediction": label, "confidence": 0.0-1.0, "reasoning": text}'),
    )
    return initial.join(evidence, list(KEYS), "left").withColumn("user_prompt", prompt).withColumn("system_prompt", F.lit(SYNTHESIS_SYSTEM))


def decide(initial: DataFrame, synthesis: DataFrame, registry: Registry) -> DataFrame:
    """Final label per (row, indicator).

    `synthesis` is (row_idx, indicator, parsed); a row without one counts as a failed call. Rules:
    no initial label -> empty result, 0.0; failed call -> initial label, 0.3, ERROR; label not valid -> initial
    label and confidence lowered by 0.2 but not below 0.3; missing decision -> SUPPORTED; missing confidence -> 0.5.
    """
    labels = registry.labels_of(F.col("indicator"))
    j = initial.join(synthesis.select(*KEYS, F.col("parsed").alias("_s"), F.lit(True).alias("_called")), list(KEYS), "left")
    s, first = F.col("_s"), F.col("prediction")
    called = F.coalesce(F.col("_called"), F.lit(False))

    def field(name: str, default: Column) -> Column:
        return F.when(F.coalesce(has_key(s, name), F.lit(False)), get_key(s, name)).otherwise(default)

    proposed = field("final_prediction", first)
    valid = F.coalesce(F.array_contains(labels, proposed), F.lit(False))
    stated = F.when(F.coalesce(has_key(s, "confidence"), F.lit(False)), number(get_key(s, "confidence"))).otherwise(F.lit(0.5))
    final = F.when(~called | ~valid, first).otherwise(proposed)
    confidence = F.when(first.isNull(), F.lit(0.0)).when(~called, F.lit(0.3)).when(valid, stated).otherwise(
        F.greatest(F.lit(0.3), stated - 0.2)
    )
    decision = F.when(first.isNull(), F.lit("NO_INITIAL")).when(~called, F.lit("ERROR")).otherwise(
        field("decision", F.lit("SUPPORTED"))
    )
    return j.select(
        *KEYS,
        first.alias("original_prediction"),
        F.when(first.isNotNull(), final).alias("prediction"),
        confidence.alias("confidence"),
        decision.alias("decision"),
        F.coalesce(final != first, F.lit(False)).alias("was_revised"),
    )


def no_verification(votes: DataFrame) -> DataFrame:
    """Take the first sample as it is."""
    return last_per_key(votes.where(F.col("sc_idx") == 0), KEYS, "sc_idx")
