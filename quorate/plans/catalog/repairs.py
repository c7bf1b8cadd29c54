"""Checks, re-requests and upserts."""

from pyspark.sql import functions as F

from quorate.operators import quality as Q
from quorate.operators import repair as P
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import DOCUMENTS_WIDE, INDICATORS, REPROCESSED, RESPONSES, VOTES, table, with_ctes

MISSING = "('', 'nan', 'none', 'n/a', 'na', 'null', '<na>')"


def _missing(c: str) -> str:
    return f"({c} is null or lower(trim({c})) in {MISSING})"


def _parts(c: str) -> str:
    return f"(case when {_missing(c)} then [] else list_filter(list_transform(string_split({c}, ';'), lambda x: trim(x)), lambda x: x <> '') end)"


_N, _Y, _T = (_parts(f"constitution_{c}") for c in ("document_name", "year", "document_types"))
_DOC = "coalesce(try_cast(constitution_prediction as double) in (1, 2), false)"
_CODES = f"list_transform({_T}, lambda x: trunc(try_cast(x as double)))"
DOC_CHECKS = {
    "confidence_missing": "constitution_confidence is null",
    "confidence_negative": "constitution_confidence = -1",
    "confidence_low": "constitution_confidence >= 0 and constitution_confidence < 30",
    "prediction_missing": "constitution_prediction is null",
    "reasoning_short": "length(coalesce(constitution_reasoning, '')) < 5",
    "document_uncodified": "regexp_matches(coalesce(constitution_document_name, ''), '(?i)customary|uncodified')",
    "document_name_missing": f"{_DOC} and {_missing('constitution_document_name')}",
    "document_year_missing": f"{_DOC} and {_missing('constitution_year')}",
    "document_lists_differ": f"{_DOC} and (len({_N}) <> len({_Y}) or len({_N}) <> len({_T}))",
    "document_type_mismatch": f"{_DOC} and len({_T}) > 0 and len(list_filter({_CODES}, lambda x: x is null)) = 0 and list_max({_CODES}) <> try_cast(constitution_prediction as double)",
    "late_row": "row_idx % 50 = 49",
}
SOV_CHECKS = {
    "confidence_missing": "sovereign_confidence is null",
    "confidence_negative": "sovereign_confidence = -1",
    "confidence_low": "sovereign_confidence >= 0 and sovereign_confidence < 30",
    "prediction_missing": "sovereign_prediction is null",
    "reasoning_short": "length(coalesce(sovereign_reasoning, '')) < 5",
}


def names_sql(checks: dict[str, str]) -> str:
    items = ", ".join(f"case when coalesce({c}, false) then '{n}' end" for n, c in checks.items())
    return f"array_to_string(list_filter([{items}], lambda x: x is not null), ',')"


OPTIONS = {"min_confidence": 30, "min_reasoning_length": 5}


@query("failed_rows", with_ctes([DOCUMENTS_WIDE], f"select * from (select row_idx, {names_sql(DOC_CHECKS)} as failed from documents_wide) where failed <> ''"))
def failed_rows(spark, sf):
    """All checks of a document indicator with one condition of the user's."""
    out = Q.failed_rows(
        DOCUMENTS_WIDE.df(spark, sf), "constitution", custom={"late_row": lambda d: F.col("row_idx") % 50 == 49}, uncodified=True, **OPTIONS
    )
    return out.select("row_idx", F.array_join("failed_checks", ",").alias("failed"))


_BOTH = {k: v for k, v in DOC_CHECKS.items() if k not in ("late_row", "document_uncodified")}
FAILURES = f"""fl as (select * from (
    select row_idx, 'constitution' as indicator, {names_sql(_BOTH)} as failed from documents_wide
    union all select row_idx, 'sovereign', {names_sql(SOV_CHECKS)} from documents_wide) where failed <> '')"""


@query("failures_by_indicator", with_ctes([DOCUMENTS_WIDE, FAILURES], "select indicator, count(*) as n_failed from fl group by 1"))
def failures_by_indicator(spark, sf):
    return Q.failures_by_indicator(Q.failures(DOCUMENTS_WIDE.df(spark, sf), ["constitution", "sovereign"], **OPTIONS))


@query("failed_row_ids", with_ctes([DOCUMENTS_WIDE, FAILURES], "select distinct row_idx from fl"))
def failed_row_ids(spark, sf):
    return Q.failed_row_ids(Q.failures(DOCUMENTS_WIDE.df(spark, sf), ["constitution", "sovereign"], **OPTIONS))


@query("null_predictions", with_ctes([VOTES], "select row_idx, count(*) as n_null from votes3 where prediction is null group by 1"))
def null_predictions(spark, sf):
    return Q.null_predictions(VOTES.df(spark, sf))


_LOST = "row_idx % 50 = 7 or (row_idx + sc_idx) % 10 = 3 or (indicator = 'entry' and row_idx % 20 = 11)"


@query("null_requested", with_ctes([VOTES], f"select row_idx, count(*) as n_null from votes3 where prediction is null or {_LOST} group by 1"))
def null_requested(spark, sf):
    """Some requests have no answer row: whole rows, samples and single indicators."""
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.array(*[F.lit(i) for i, _ in INDICATORS]).alias("indicators"))
    requests = asked.select("*", F.explode(F.array(*[F.lit(i) for i in range(VOTES.samples)])).alias("sc_idx"))
    return Q.null_predictions(VOTES.df(spark, sf).where(f"not ({_LOST})"), requests=requests)


@query("missing_responses", with_ctes([RESPONSES], "select custom_id from responses where text = ''"))
def missing_responses(spark, sf):
    r = RESPONSES.df(spark, sf)
    return P.unanswered(r.select("custom_id"), r)


@query(
    "retry_requests",
    with_ctes([RESPONSES], "select custom_id from responses where split_part(custom_id, '|', 1) in (select split_part(custom_id, '|', 1) from responses where text = '')"),
)
def retry_requests(spark, sf):
    r = RESPONSES.df(spark, sf).withColumn("row_idx", F.split_part("custom_id", F.lit("|"), F.lit(1)).cast("bigint"))
    failed = P.unanswered(r, r.select("custom_id", "text")).select("row_idx")
    return P.retry_requests(r, failed).select("custom_id")


@query("resume_pending", "select d.doc_id as row_idx from documents d where d.doc_id not in (select doc_id from labels)")
def resume_pending(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("row_idx"))
    return P.pending(table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx")), done)


@query(
    "upsert_reprocessed",
    with_ctes(
        [DOCUMENTS_WIDE, REPROCESSED,
         "best as (select * from (select *, row_number() over (partition by row_idx order by attempt desc) rn from reprocessed where sovereign_confidence <> -1) where rn = 1)"],
        """select w.row_idx, w.constitution_prediction, case when b.row_idx is not null then b.sovereign_prediction else w.sovereign_prediction end as sovereign_prediction,
        case when b.row_idx is not null then b.sovereign_confidence else w.sovereign_confidence end as sovereign_confidence, b.sovereign_note
        from documents_wide w left join best b on w.row_idx = b.row_idx""",
    ),
)
def upsert_reprocessed(spark, sf):
    """Failed second tries keep the old values, the last good one wins, a new column is null elsewhere."""
    old = DOCUMENTS_WIDE.df(spark, sf).select("row_idx", "constitution_prediction", "sovereign_prediction", "sovereign_confidence")
    cols = ["sovereign_prediction", "sovereign_confidence", "sovereign_note"]
    return P.upsert(old, REPROCESSED.df(spark, sf), "attempt", ["row_idx"], cols, "sovereign_confidence")


@query(
    "selective_upsert",
    with_ctes(
        [VOTES],
        """select row_idx, indicator, case when prediction is null and row_idx % 5 <> 0 then '9' else prediction end as prediction,
        case when prediction is null and row_idx % 5 <> 0 then 77 else confidence end as confidence from votes3 where sc_idx = 0""",
    ),
)
def selective_upsert(spark, sf):
    """Only (row, indicator) pairs that failed are overwritten, and only by good answers."""
    labels = VOTES.df(spark, sf).where("sc_idx = 0").select("row_idx", "indicator", "prediction", "confidence")
    failed = labels.where(F.col("prediction").isNull()).select("row_idx", "indicator")
    again = labels.select(
        "row_idx", "indicator", F.lit("9").alias("prediction"),
        F.when(F.col("row_idx") % 5 == 0, -1).otherwise(77).alias("confidence"), F.lit(1).alias("attempt"),
    )
    return P.upsert_long(labels, again, failed, "attempt")


@query(
    "selective_upsert_all",
    with_ctes(
        [VOTES],
        """select row_idx, indicator, sc_idx, case when prediction is null and row_idx % 5 <> 0 then '9' else prediction end as prediction,
        case when prediction is null and row_idx % 5 <> 0 then 77 else confidence end as confidence from votes3""",
    ),
)
def selective_upsert_all(spark, sf):
    """The same by sample: only the samples that failed are overwritten."""
    keys = ["row_idx", "indicator", "sc_idx"]
    votes = VOTES.df(spark, sf).select(*keys, "prediction", "confidence")
    again = votes.select(*keys, F.lit("9").alias("prediction"), F.when(F.col("row_idx") % 5 == 0, -1).otherwise(77).alias("confidence"), F.lit(1).alias("attempt"))
    return P.upsert_long(votes, again, votes.where(F.col("prediction").isNull()), "attempt", keys)


@query(
    "combined_results",
    with_ctes([RESPONSES], "select custom_id, case when split_part(custom_id, '|', 3) = '1' then 'later' else text end as text from responses"),
)
def combined_results(spark, sf):
    """Result parts put together, the later part winning."""
    r = RESPONSES.df(spark, sf)
    later = r.where(F.col("custom_id").endswith("|1")).select("custom_id", F.lit("later").alias("text"))
    return P.later_wins([r, later])


_AGAIN = """ag as (select row_idx, case when sovereign_prediction is null or sovereign_confidence = -1 then 1 else 0 end as fs,
    case when constitution_prediction is null or constitution_confidence is null then 1 else 0 end as fc,
    row_idx % 6 <> 0 as first_good, row_idx % 4 >= 2 as second_good from documents_wide)"""


@query(
    "indicator_upsert",
    with_ctes(
        [DOCUMENTS_WIDE, _AGAIN],
        """select w.row_idx, case when fs = 1 and second_good then '0' when fs = 1 and first_good then '1' else sovereign_prediction end as sovereign_prediction,
        case when fs = 1 and second_good then 91 when fs = 1 and first_good then 88 else sovereign_confidence end as sovereign_confidence,
        case when fc = 1 then '1' else constitution_prediction end as constitution_prediction from documents_wide w join ag on w.row_idx = ag.row_idx""",
    ),
)
def indicator_upsert(spark, sf):
    """Wide table repaired for several indicators in one join, each only where it had failed. Every row is repaired twice,
    and either repair may itself have failed: the later good one counts."""
    old = DOCUMENTS_WIDE.df(spark, sf).select("row_idx", "sovereign_prediction", "sovereign_confidence", "constitution_prediction", "constitution_confidence")
    row, second = F.col("row_idx"), F.col("attempt") == 2
    good = F.when(second, row % 4 >= 2).otherwise(row % 6 != 0)
    fresh = old.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")).select(
        "row_idx", "attempt",
        (F.col("sovereign_prediction").isNull() | (F.col("sovereign_confidence") == -1)).cast("int").alias("_failed_sovereign"),
        (F.col("constitution_prediction").isNull() | F.col("constitution_confidence").isNull()).cast("int").alias("_failed_constitution"),
        F.when(second, "0").otherwise("1").alias("sovereign_prediction"),
        F.when(~good, -1).when(second, 91).otherwise(88).alias("sovereign_confidence"),
        F.when(second, "1").otherwise("2").alias("constitution_prediction"),
    )
    return P.upsert_indicators(old, fresh, ["sovereign", "constitution"], order="attempt").drop("constitution_confidence")
