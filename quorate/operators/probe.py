"""Knowledge probe: short factual questions per row and their scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions.answers import get_key, parse_short
from quorate.functions.scoring import correctness
from quorate.functions.templates import render


@dataclass(frozen=True)
class Question:
    """A question never shows two of entry year, exit year and tenure when the third is asked."""

    label: str
    requires: tuple[str, ...]
    template: str
    answer_field: str
    truth: str
    kind: str


# Labels, needed fields, answer keys and truth columns of the six questions.
QUESTIONS = (
    Question("entry_year", ("name", "polity", "exit_year"), "{name} of {polity} left power in {exit_year}. In which year did the rule begin? Answer {{\"year\": n}}, negative for BCE.", "year", "entry_year", "year"),
    Question("exit_year", ("name", "polity", "entry_year"), "{name} of {polity} took power in {entry_year}. In which year did the rule end? Answer {{\"year\": n}}, negative for BCE.", "year", "exit_year", "year"),
    Question("tenure_from_entry", ("name", "polity", "entry_year"), "{name} of {polity} took power in {entry_year}. For how many years? Answer {{\"years\": n}}.", "years", "tenure", "tenure"),
    Question("tenure_from_exit", ("name", "polity", "exit_year"), "{name} of {polity} left power in {exit_year}. After how many years? Answer {{\"years\": n}}.", "years", "tenure", "tenure"),
    Question("leader_name", ("polity", "entry_year", "exit_year"), "Who ruled {polity} from {entry_year} to {exit_year}? Answer {{\"name\": text}}.", "name", "name", "name"),
    Question("polity_name", ("name", "entry_year", "exit_year"), "Which polity did {name} rule from {entry_year} to {exit_year}? Answer {{\"polity\": text}}.", "polity", "polity", "name"),
)
FIELDS = ("name", "polity", "entry_year", "exit_year", "tenure")


def askable(q: Question):
    out = F.lit(True)
    for f in q.requires:
        out = out & F.col(f).isNotNull()
    return out


def probe_questions(fields: DataFrame, questions: Sequence[Question] = QUESTIONS, row: str = "row_idx") -> DataFrame:
    """(row, question, prompt) for every question whose fields are known; map-only."""
    made = [
        F.when(askable(q), F.struct(F.lit(q.label).alias("question"), render(q.template, {f: F.col(f) for f in FIELDS}).alias("prompt")))
        for q in questions
    ]
    return fields.select(row, F.inline(F.array_compact(F.array(*made))))


def read_answers(responses: DataFrame, questions: Sequence[Question] = QUESTIONS) -> DataFrame:
    """(row, question, text) to (row, question, answer)."""
    field = F.lit(None).cast("string")
    for q in questions:
        field = F.when(F.col("question") == q.label, F.lit(q.answer_field)).otherwise(field)
    return responses.withColumn("answer", get_key(parse_short(F.col("text")), field))


def score_answers(
    answers: DataFrame, truth: DataFrame, questions: Sequence[Question] = QUESTIONS, row: str = "row_idx",
    year_window: int = 3, tenure_window: int = 5, by: Sequence[str] = (),
) -> DataFrame:
    """(by, row, question, correct) with correct 1, 0 or null; truth is joined by row key."""
    joined = answers.join(truth.select(row, *[F.col(f).alias(f"_t_{f}") for f in FIELDS]), row)
    correct = F.lit(None).cast("int")
    for q in questions:
        own = correctness(F.col(f"_t_{q.truth}"), F.col("answer"), q.kind, year_window, tenure_window)
        correct = F.when(F.col("question") == q.label, own).otherwise(correct)
    return joined.select(*by, row, "question", "answer", correct.alias("correct"))


def question_accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy per question plus the overall row (micro average)."""
    # One scan: each row counts for its question and for the total.
    both = scored.where(F.col("correct").isNotNull()).select(
        *by, "correct", F.explode(F.array(F.col("question"), F.lit("overall"))).alias("question")
    )
    return both.groupBy(*by, "question").agg(
        F.sum("correct").alias("n_correct"),
        F.count(F.lit(1)).alias("n_total"),
        (F.sum("correct").cast("double") / F.count(F.lit(1))).alias("accuracy"),
    )


def row_probe_accuracy(scored: DataFrame, row: str = "row_idx", by: Sequence[str] = ()) -> DataFrame:
    """Mean over the answered questions of a row; null when none could be scored."""
    return scored.groupBy(*by, row).agg(
        (F.sum("correct").cast("double") / F.nullif(F.count("correct"), F.lit(0))).alias("avg_accuracy"),
        F.count("correct").alias("n_scored"),
    )


def side_by_side(accuracies: DataFrame, runs: Sequence[str], run: str = "run") -> DataFrame:
    """Accuracy of several runs next to each other; runs are named, so no job looks them up."""
    return accuracies.groupBy("question").agg(
        *[F.max(F.when(F.col(run) == r, F.col("accuracy"))).alias(f"accuracy_{r}") for r in runs],
        *[F.max(F.when(F.col(run) == r, F.col("n_total"))).alias(f"n_{r}") for r in runs],
    )
