"""Whole jobs on a user's model function: annotation with retries, verification, dependent labels, probe, context, repair.

Every step that calls a model is written to the shared folder before it is used, so no call is repeated by a plan that
reads its answers twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.operators import context as C
from quorate.operators import dependent as D
from quorate.operators import probe as B
from quorate.operators import quality as Q
from quorate.operators import requests as R
from quorate.operators import verify as V
from quorate.operators.annotate import RESPONSE_SCHEMA, annotate
from quorate.operators.repair import indicator_columns
from quorate.operators.rows import probe_fields
from quorate.operators.votes import slot_vote
from quorate.plans import verification
from quorate.plans.answers import DOCUMENTS, answers_long, attach_results, self_consistency, wide_results
from quorate.plans.repair_loop import repair_round
from quorate.registry import Registry
from quorate.session import run_folder

OpenClient = Callable[[], Callable[..., Any]]

# Rows of a written file. Prompts and answers compress so well that files sized by bytes alone give one task millions of rows.
FILE_ROWS = 50_000


def answer_rounds(requests: DataFrame, open_client: OpenClient, rounds: int = 2, partitions: int | None = None) -> DataFrame:
    """Answers to all requests, written, with `received_at` = round; what failed or came back empty is asked again.

    One row per request and round it was asked in. The later round counts, so `answers_long` and `self_consistency`
    take the good repeat of a failed call. A round without anything to ask ends the job. Files hold FILE_ROWS rows at
    most, so the rows of a task do not follow the layout of the source.
    """
    spark = requests.sparkSession
    folder = run_folder(spark, "answers")
    requests.select("custom_id", "system_prompt", "user_prompt", "temperature").write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/requests")
    todo = spark.read.parquet(f"{folder}/requests")
    for n in range(1, rounds + 1):
        answered = annotate(todo, open_client, partitions).withColumn("received_at", F.lit(n))
        answered.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/responses")
        given = spark.read.schema(f"{RESPONSE_SCHEMA}, received_at int").parquet(f"{folder}/responses")
        failed = given.where((F.col("received_at") == n) & (F.coalesce("text", F.lit("")) == ""))
        todo = todo.join(failed.select("custom_id"), "custom_id", "left_semi")
        if n == rounds or not failed.head(1):
            return given
    raise ValueError("at least one round is needed")


def split_indicators(indicators: Sequence[str], mode: str) -> tuple[list[str], list[str]]:
    """(indicators of the combined prompt, indicators with prompts of their own) for a prompt mode."""
    if mode == "multiple":
        return [], list(indicators)
    if mode == "sequential":
        return list(indicators), []
    return [i for i in indicators if i != DOCUMENTS], [i for i in indicators if i == DOCUMENTS]


def without_results(rows: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """The rows without the result columns of an earlier run for these indicators; the job's own take their place."""
    return rows.drop(*[c for i in indicators for c in indicator_columns(rows.columns, i)])


def annotation_job(
    rows: DataFrame, registry: Registry, indicators: Sequence[str], open_client: OpenClient, n_samples: int = 0, rounds: int = 2,
    mode: str = "single", sampled: Sequence[float] | None = None, first: float = 1.0, **prompt_options,
) -> DataFrame:
    """Rows with voted labels: prompts, samples, calls, a second round for failed calls, parse, vote, wide."""
    made = R.prompts(rows, registry, indicators, mode, **prompt_options)
    requests = R.expand_samples(made, R.temperatures(n_samples, sampled, first))
    combined, alone = split_indicators(indicators, mode)
    responses = answer_rounds(requests, open_client, rounds)
    return self_consistency(without_results(rows, indicators), responses, registry, indicators, n_samples, combined, alone=alone)


def asked_by(open_client: OpenClient, keys: Sequence[str], prompt: str, system: str, into: str, rounds: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the model's text for column `prompt` as column `into`; a failed call gives null.

    Rows are told apart by `keys`, which come back with the text.
    """

    def ask(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("custom_id", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
        requests = keyed.select("custom_id", F.lit(system).alias("system_prompt"), F.col(prompt).alias("user_prompt"), F.lit(0.0).alias("temperature"))
        given = answer_rounds(requests, open_client, rounds)
        last = given.groupBy("custom_id").agg(F.max_by("text", "received_at").alias(into))
        kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
        return last.select(F.from_json("custom_id", kinds).alias("k"), into).select("k.*", into)

    return ask


def verified_job(
    rows: DataFrame, votes: DataFrame, registry: Registry, indicators: Sequence[str], slots: Mapping[str, Column], ask: OpenClient,
    judge: OpenClient, per_indicator: int | None = None, first: verification.Verifier = verification.by_vote, rounds: int = 1,
) -> DataFrame:
    """Voted labels checked by a model: questions answered without sight of the label, a judge over the answers, a rule.

    Gives `verify.decide`'s rows; a question that fails reads as an error, a judge that fails leaves the label.
    """
    keys = ("row_idx", "indicator")
    asker = asked_by(ask, [*keys, "q_idx"], "question", V.ANSWER_SYSTEM, "answer", rounds)
    judged = asked_by(judge, keys, "user_prompt", V.SYNTHESIS_SYSTEM, "text", rounds)
    check = verification.by_questions(rows, registry, indicators, slots, asker, judged, per_indicator)
    return verification.chain(first, check)(votes)


def dependent_job(
    table: DataFrame, registry: Registry, indicator: str, open_client: OpenClient, n_samples: int = 2, sampled: Sequence[float] | None = None,
    closed_as: str = "0", rounds: int = 2, **prompt_options,
) -> DataFrame:
    """A wide table with a dependent label: rows whose needs are met are asked and voted on, the others pass through.

    The first call is cold and the samples are warm, unless `sampled` says otherwise.
    """
    open_rows, _ = D.split_gate(table, registry, indicator)
    made = R.prompts(open_rows, registry, [indicator], "multiple", **prompt_options)
    warm = list(sampled) if sampled is not None else [0.7] * n_samples
    requests = R.expand_samples(made, R.temperatures(n_samples, warm, first=0.0))
    long = answers_long(answer_rounds(requests, open_client, rounds), registry, [], alone=[indicator])
    verdicts = slot_vote(long, n_samples + 1, registry.labels(indicator))
    return D.fill_dependent(without_results(table, [indicator]), verdicts, registry, indicator, closed_as)


def probe_job(
    table: DataFrame, open_client: OpenClient, questions: Sequence[B.Question] = B.QUESTIONS, row: str = "row_idx",
    system: str = "Answer with one JSON object only.", rounds: int = 2,
) -> dict[str, DataFrame]:
    """Every question a row's known fields allow, asked, read and scored: `scored` per answer, `questions`, `rows`."""
    fields = probe_fields(table)
    asked = B.probe_questions(fields, questions, row)
    answers = asked_by(open_client, [row, "question"], "prompt", system, "text", rounds)(asked)
    scored = B.score_answers(B.read_answers(answers, questions), fields, questions, row)
    return {"scored": scored, "questions": B.question_accuracy(scored), "rows": B.row_probe_accuracy(scored, row)}


def enriched_job(
    rows: DataFrame, tiers: Sequence[tuple[str, DataFrame]], registry: Registry, indicators: Sequence[str], open_client: OpenClient,
    mode: str = "single", rounds: int = 2, queries: DataFrame | None = None, **prompt_options,
) -> DataFrame:
    """Rows labelled with context in their prompts, in the search layout: label columns of every indicator, then
    search_queries, urls_used and, for prompts over several indicators, web_information.

    `queries` (row_idx, search_queries) says what was asked to find the context, where that is known.
    """
    found = C.tiered_context(rows, tiers)
    made = C.enrich_prompts(R.prompts(rows, registry, indicators, mode, **prompt_options), found)
    combined, alone = split_indicators(indicators, mode)
    responses = answer_rounds(R.expand_samples(made, R.temperatures(0)), open_client, rounds)
    wide = wide_results(answers_long(responses, registry, combined, alone=alone, once=False), indicators, 0)
    searched = found.select("row_idx", F.col("context_urls").alias("urls_used"), *([F.nullif("context", F.lit("")).alias("web_information")] if mode != "multiple" else []))
    asked = queries if queries is not None else rows.select("row_idx", F.lit(None).cast("string").alias("search_queries")).limit(0)
    return attach_results(attach_results(attach_results(without_results(rows, indicators), wide), asked.select("row_idx", "search_queries")), searched)


def repair_job(
    table: DataFrame, requests: DataFrame, registry: Registry, open_client: OpenClient, indicators: Sequence[str], mode: str = "single",
    max_rounds: int = 3, run_table: str | None = None, **checks,
) -> DataFrame:
    """Check, ask the failed rows again, put good answers in; round by round until nothing fails or `max_rounds` are done.

    `requests` are the first samples of the run (row_idx, custom_id, prompts). A row that still fails after the last
    round keeps what it had. Each round writes the table and one row of `run_table`; one count per round reaches the driver.
    """
    spark = table.sparkSession
    folder = run_folder(spark, "repair-job")
    combined, alone = split_indicators(indicators, mode)

    def reprocess(again: DataFrame) -> DataFrame:
        responses = answer_rounds(again, open_client, rounds=1)
        return wide_results(answers_long(responses, registry, combined, alone=alone, once=False), indicators, 0)

    current = table
    for n in range(1, max_rounds + 1):
        if n > 1 and not Q.failures(current, indicators, "row_idx", **checks).head(1):
            break
        repair_round(current, requests, reprocess, indicators, run_table=run_table, round_no=n, **checks).write.parquet(f"{folder}/round-{n}")
        current = spark.read.parquet(f"{folder}/round-{n}")
    return current
