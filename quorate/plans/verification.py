"""Votes and checked labels put together.

A verifier is a function from long votes to (row_idx, indicator, prediction, ...); `none`, `by_vote` and
`by_questions` are such functions, and so is whatever a user passes in.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.answers import last_key_wins, parse_answer
from quorate.operators import verify as V
from quorate.operators.votes import majority_vote
from quorate.registry import Registry

Verifier = Callable[[DataFrame], DataFrame]
Ask = Callable[[DataFrame], DataFrame]


def none(votes: DataFrame) -> DataFrame:
    return V.no_verification(votes)


def by_vote(votes: DataFrame) -> DataFrame:
    return majority_vote(votes)


def by_questions(
    rows: DataFrame, registry: Registry, indicators: Sequence[str], slots: Mapping[str, Column], ask: Ask, synthesise: Ask,
    per_indicator: int | None = None,
) -> Verifier:
    """Check a label by questions that are answered without sight of it.

    `ask` takes (row_idx, indicator, q_idx, question, ...) and adds `answer`; `synthesise` takes prompts by
    (row_idx, indicator) and adds `text`. Both may call a model through `annotate`: write their results before
    they are used twice.
    """
    n_questions = max(len(registry[i].questions[:per_indicator]) for i in indicators)

    def verify(initial: DataFrame) -> DataFrame:
        first = initial.select("row_idx", "indicator", "prediction", *[c for c in ("reasoning",) if c in initial.columns])
        if "reasoning" not in first.columns:
            first = first.withColumn("reasoning", F.lit(""))
        questions = V.question_rows(rows, registry, indicators, slots, per_indicator)
        evidence = V.gather_answers(questions, ask(questions), n_questions)
        asked = V.synthesis_prompts(first.where(F.col("prediction").isNotNull()), evidence, registry)
        answers = synthesise(asked).where(F.col("text").isNotNull())
        parsed = answers.select("row_idx", "indicator", parse_answer(F.col("text")).alias("_raw"))
        return V.decide(first, parsed.select("row_idx", "indicator", last_key_wins(F.col("_raw")).alias("parsed")), registry)

    return verify


def chain(first: Verifier, then: Verifier) -> Verifier:
    """Vote first, then check the voted label."""
    return lambda votes: then(first(votes))


def wide_verified(decisions: DataFrame, votes: DataFrame, indicators: Sequence[str], reasoning: bool = True) -> DataFrame:
    """Checked labels in the wide layout: prediction, verification, and the first call's reasoning and confidence."""
    first = votes.where(F.col("sc_idx") == 0).select("row_idx", "indicator", "reasoning", F.col("confidence").alias("first_confidence"))
    details = F.to_json(F.struct("decision", "original_prediction", "was_revised", "confidence"))
    j = decisions.select("row_idx", "indicator", "prediction", details.alias("verification")).join(first, ["row_idx", "indicator"], "left")
    fields = [("prediction", "prediction"), ("verification", "verification")] + ([("reasoning", "reasoning")] if reasoning else []) + [("first_confidence", "confidence")]
    return j.groupBy("row_idx").agg(
        *[F.max(F.when(F.col("indicator") == i, F.col(f))).alias(f"{i}_{n}") for i in indicators for f, n in fields]
    )
