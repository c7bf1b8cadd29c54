"""From responses to long labels to votes to a wide result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions import answers as A
from quorate.functions.values import request_id_parts
from quorate.operators.requests import COMBINED
from quorate.operators.votes import slot_verdict
from quorate.registry import Registry, quoted, string_array

DOCUMENTS = "constitution"
DOCUMENT_FIELDS = ("document_name", "constitution_year", "document_types")


# What decides between two answers to one request, as far as the table has it.
ARRIVAL = ("received_at", "arrived")
ANSWER_KEYS = ("custom_id", "row_idx", "indicator", "sc_idx")


def answer_order(columns: Sequence[str]) -> Column:
    """Order of the answers to one request, narrow enough to travel with a label: the latest by `received_at`, then by
    `arrived`, each where the table has it. Without them, and among ties, an answer with a text beats an empty one, and a
    hash of the text decides the rest, so that all labels of a request come from one answer."""
    known = [F.col(c).alias(c) for c in ARRIVAL if c in columns]
    has_text = F.coalesce(F.col("text") != "", F.lit(False))
    return F.struct(*known, has_text.alias("has_text"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash"))


def latest_answers(long: DataFrame) -> DataFrame:
    """One row per request and indicator from a table with `answer_order`: the label that the latest answer gives, which
    may be null. Labels are shuffled, not answer texts."""
    rest = [c for c in long.columns if c not in (*ANSWER_KEYS, "answer_order")]
    last = F.max_by(F.struct(*rest), F.col("answer_order")).alias("_last")
    return long.groupBy(*ANSWER_KEYS).agg(last).select(*ANSWER_KEYS, "_last.*")


def latest_responses(responses: DataFrame, order: str = "received_at") -> DataFrame:
    """(custom_id, text) with one answer per request id: the latest by `order` where the table has that column; ties,
    and tables without it, go to the greatest text. Ids answered twice must not vote twice."""
    by = [order] if order in responses.columns else []
    last = F.max(F.struct(*by, F.coalesce("text", F.lit("")).alias("text"))).alias("_last")
    return responses.groupBy("custom_id").agg(last).select("custom_id", F.col("_last.text").alias("text"))


def unreadable_ids(responses: DataFrame) -> DataFrame:
    """The answers whose request id names no row; `answers_long` cannot place them, and they are not lost silently."""
    return responses.where(request_id_parts(F.col("custom_id"))["row_idx"].isNull())


def answers_long(
    responses: DataFrame,
    registry: Registry,
    combined: Sequence[str] | None = None,
    requests: DataFrame | None = None,
    alone: Sequence[str] | None = None,
    dependent_invalid_as: str | None = None,
    extra: Callable[[Column], Column] | None = None,
    once: bool = True,
) -> DataFrame:
    """(custom_id, row_idx, indicator, sc_idx, prediction, reasoning, confidence, document fields).

    A combined answer is parsed once and then read once per indicator. Its indicator list is `combined` where one
    list holds for the run (no join), else it comes from the request table by request id. `alone` names the
    indicators that have prompts of their own; with it and `combined` the plan holds only the reading rules that
    are needed. `extra` builds one more column from the parsed map.

    A request that was answered several times counts once, by `answer_order`. With once=False all answers stay, each with
    its `answer_order`, and the next step decides: `wide_results` does so in the aggregation it has anyway. Use it too
    where no request is answered twice. On a stream, which is appended to, once=False is the only way.

    Values that several rules look at are columns of an earlier step, so they are computed once.
    """
    parts = request_id_parts(F.col("custom_id"))
    keyed = responses.select(
        "custom_id",
        parts["row_idx"].alias("row_idx"),
        parts["indicator"].alias("prompt_key"),
        parts["sc_idx"].alias("sc_idx"),
        F.when(F.col("text") != "", F.col("text")).alias("text"),
        answer_order(responses.columns).alias("answer_order"),
    ).where(F.col("row_idx").isNotNull())
    if combined is not None:
        names = F.when(F.col("prompt_key") == COMBINED, string_array(combined)).otherwise(F.array("prompt_key"))
    elif requests is not None:
        meta = requests.select("custom_id", F.col("metadata.indicators").alias("_inds"))
        keyed = keyed.join(meta, "custom_id", "left")
        listed = F.coalesce(F.from_json("_inds", "array<string>"), F.array().cast("array<string>"))
        names = F.when(F.col("prompt_key") == COMBINED, listed).otherwise(F.array("prompt_key"))
    else:
        names = F.array("prompt_key")

    # The indicators that can occur, where the caller has said so.
    possible = None if alone is None or (combined is None and requests is not None) else {*alone, *(combined or ())}
    known = registry if possible is None else registry.subset([n for n in registry.names if n in possible])
    documents = possible is None or DOCUMENTS in possible
    dependents = list(known.dependent)

    m, text, ind = F.col("_m"), F.col("text"), F.col("indicator")
    read = (
        keyed.select("custom_id", "row_idx", "sc_idx", "answer_order", "text", A.parse_answer(text).alias("_raw"), F.explode(names).alias("indicator"))
        .select("custom_id", "row_idx", "sc_idx", "answer_order", "text", "indicator", A.last_key_wins(F.col("_raw")).alias("_m"))
        .select("*", A.label_key(m, ind).alias("_key"), A.confidence_key(m, ind).alias("_ckey"), known.labels_of(ind).alias("_labels"))
        .select("*", A.get_key(m, F.col("_key")).alias("_value"), A.get_key(m, F.col("_ckey")).alias("_conf"))
    )
    prediction = A.read_label(F.col("_value"), F.col("_labels"), text, F.col("_key"))
    for d in dependents:
        own = A.read_dependent(m, d, string_array(registry.labels(d)), dependent_invalid_as)
        prediction = F.when(ind == d, F.when(text.isNotNull(), own)).otherwise(prediction)
    reasoning, confidence = A.read_reasoning(m, ind), A.read_score(F.col("_conf"), text, F.col("_ckey"))
    doc = F.col("_doc")
    kind = "struct<prediction:string,document_name:string,document_types:string,document_years:string,reasoning:string,confidence:int>"
    if documents:
        is_doc = ind == DOCUMENTS
        read = read.select("*", F.when(is_doc, A.read_documents(m, text)).alias("_doc"))
        prediction = F.when(is_doc, doc["prediction"]).otherwise(prediction)
        reasoning = F.when(is_doc, doc["reasoning"]).otherwise(reasoning)
        confidence = F.when(is_doc, doc["confidence"]).otherwise(confidence)
    else:
        doc = F.lit(None).cast(kind)
    cols = [
        prediction.alias("prediction"),
        reasoning.alias("reasoning"),
        confidence.alias("confidence"),
        doc["document_name"].alias("document_name"),
        doc["document_years"].alias("constitution_year"),
        doc["document_types"].alias("document_types"),
    ]
    if extra is not None:
        cols.append(extra(m).alias("extra"))
    out = read.select(*ANSWER_KEYS, *cols, "answer_order")
    return latest_answers(out) if once and not responses.isStreaming else out


def wide_answers(responses: DataFrame, registry: Registry, indicators: Sequence[str], n_samples: int, reasoning: bool = True) -> DataFrame:
    """`wide_results` straight from combined answers: all indicators of an answer are read in its row and travel together.

    One row per answer reaches the exchange in place of one per answer and indicator, and one buffer per sample takes the
    latest answer. For plain label indicators; documents and dependent labels go through `answers_long`.
    """
    parts = request_id_parts(F.col("custom_id"))
    keyed = responses.select(
        parts["row_idx"].alias("row_idx"), parts["indicator"].alias("prompt_key"), parts["sc_idx"].alias("sc_idx"),
        F.when(F.col("text") != "", F.col("text")).alias("text"), answer_order(responses.columns).alias("answer_order"),
    ).where((F.col("prompt_key") == COMBINED) & F.col("row_idx").isNotNull())
    m, text = F.col("_m"), F.col("text")
    fields = ["reasoning", "confidence"] if reasoning else ["confidence"]
    read = keyed.select("row_idx", "sc_idx", "answer_order", "text", A.parse_answer(text).alias("_raw"))
    read = read.select("row_idx", "sc_idx", "answer_order", "text", A.last_key_wins(F.col("_raw")).alias("_m"))
    names = list(enumerate(indicators))
    keys = [c for n, i in names for c in (A.label_key(m, F.lit(i)).alias(f"_k{n}"), A.confidence_key(m, F.lit(i)).alias(f"_c{n}"))]
    read = read.select("*", *keys)
    values = [A.get_key(m, F.col(f"_{k}{n}")).alias(f"_{k}v{n}") for n, _ in names for k in "kc"]
    read = read.select("*", *values)
    packed = []
    for n, i in names:
        cols = [A.read_label(F.col(f"_kv{n}"), string_array(registry.labels(i)), text, F.col(f"_k{n}")).alias("prediction")]
        cols += [A.read_reasoning(m, F.lit(i)).alias("reasoning")] if reasoning else []
        cols.append(A.read_score(F.col(f"_cv{n}"), text, F.col(f"_c{n}")).alias("confidence"))
        packed.append(F.struct(*cols).alias(f"s{n}"))
    slim = read.select("row_idx", "sc_idx", F.struct("answer_order", *packed).alias("_s"))
    sides = [F.max(F.when(F.col("sc_idx") == i, F.col("_s"))).alias(f"_slot{i}") for i in range(n_samples + 1)]
    wide = slim.groupBy("row_idx").agg(*sides)
    wide = wide.select("row_idx", *[F.col(f"_slot{i}")[f"s{n}"].alias(f"_{n}_{i}") for n, _ in names for i in range(n_samples + 1)])
    outs = [F.col("row_idx")]
    for n, i in names:
        outs += _wide_columns(n, i, fields, {f: f"{i}_{f}" for f in fields}, n_samples)
    return wide.select(*outs)


def _wide_columns(n: int, indicator: str, fields: Sequence[str], names: Mapping[str, str], n_samples: int) -> list[Column]:
    """Output columns of the n-th indicator from its slot structs _n_0, _n_1, .."""
    slots = n_samples + 1
    if n_samples == 0:
        return [F.expr(f"_{n}_0.prediction as `{indicator}_prediction`"), *[F.expr(f"_{n}_0.{f} as `{names[f]}`") for f in fields]]
    verdict = slot_verdict([f"_{n}_{i}.prediction" for i in range(slots)])
    return [
        verdict["prediction"].alias(f"{indicator}_prediction"),
        *[F.expr(f"_{n}_{i}.prediction as `{indicator}_SC{i + 1}`") for i in range(slots)],
        *[F.expr(f"_{n}_{i}.{f} as `{names[f]}_SC{i + 1}`") for f in fields for i in range(slots)],
        verdict["agreement"].alias(f"{indicator}_agreement"),
        verdict["uncertainty"].alias(f"{indicator}_uncertainty"),
    ]


def wide_results(long: DataFrame, indicators: Sequence[str], n_samples: int, reasoning: bool = True) -> DataFrame:
    """One row per input row with the columns of every indicator, in one aggregation by row.

    Where the table has `answer_order`, the latest answer of a slot counts. n_samples = 0 gives plain columns, otherwise _SC1.._SCn slots with the vote over them. All slots of a row meet
    in one bounded buffer and the vote is arithmetic on the row, so vote and pivot share a single shuffle.
    """
    slots = n_samples + 1
    title = {"document_name": "constitution_document_name", "constitution_year": "constitution_year", "document_types": "constitution_document_types"}
    text_fields = ["reasoning"] if reasoning else []
    lead = "answer_order, " if "answer_order" in long.columns else ""
    aggs, outs = [], [F.col("row_idx")]
    for n, ind in enumerate(indicators):
        documents = list(DOCUMENT_FIELDS) if ind == DOCUMENTS else []
        if n_samples == 0:
            fields = [*text_fields, "confidence", *documents]
        else:
            fields = documents or [*text_fields, "confidence"]
        # Fields of a slot travel together, so that they stem from one answer and there is one buffer per slot.
        # SQL text keeps the many columns cheap to build.
        for i in range(slots):
            mine = f"indicator = {quoted(ind)} and sc_idx = {i}"
            aggs.append(F.expr(f"max(case when {mine} then struct({lead}prediction, {', '.join(fields)}) end) as _{n}_{i}"))
        names = {f: title.get(f, f"{ind}_{f}") for f in fields}
        outs += _wide_columns(n, ind, fields, names, n_samples)
    return long.groupBy("row_idx").agg(*aggs).select(*outs)


def attach_results(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """Results next to the input; every input row is kept."""
    return rows.join(wide, "row_idx", "left")


def self_consistency(
    rows: DataFrame, responses: DataFrame, registry: Registry, indicators: Sequence[str], n_samples: int,
    combined: Sequence[str] | None = None, requests: DataFrame | None = None, alone: Sequence[str] | None = None,
) -> DataFrame:
    """responses -> labels -> vote -> wide, attached to the input.

    Where all indicators share one prompt (`combined` names them, `alone` is empty), they are read in the answer's row.
    """
    together = combined is not None and requests is None and alone is not None and not alone and set(indicators) <= set(combined)
    if together and DOCUMENTS not in indicators and not set(indicators) & set(registry.dependent):
        return attach_results(rows, wide_answers(responses, registry, indicators, n_samples))
    long = answers_long(responses, registry, combined, requests, alone, once=False)
    return attach_results(rows, wide_results(long, indicators, n_samples))
