"""Reading answers."""

from pyspark.sql import functions as F

from quorate.functions import answers as A
from quorate.functions import values as X
from quorate.plans.answers import answers_long
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import DOCUMENT_RESPONSES, RESPONSES, VOTES, WIDE, YEARS, table, with_ctes
from quorate.plans.variants import answer_types, labels_from_variants
from quorate.registry import DEFAULT_REGISTRY, string_array

OBJECT = r"\{([^{}]|\{[^{}]*\})*\}"
NUM = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
JSON = f"js as (select *, try_cast(nullif(regexp_extract(text, '{OBJECT}'), '') as json) as j from responses)"


def label_sql(v: str, kind: str, labels: str) -> str:
    """Label rule on a JSON text value and its JSON type."""
    whole = f"cast(cast(trunc(case when regexp_matches({v}, '{NUM}') then try_cast({v} as double) end) as bigint) as varchar)"
    return f"""case when {v} in {labels} then {v}
      when {v} in ('true', 'false') then case when {kind} = 'BOOLEAN' then case when {v} = 'true' then '1' else '0' end end
      when {whole} in {labels} then {whole}
      when regexp_extract({v}, '^\\s*([0-9]+)', 1) in {labels} then regexp_extract({v}, '^\\s*([0-9]+)', 1) end"""


def score_sql(v: str, kind: str) -> str:
    n = f"""case when regexp_matches({v}, '^\\s*[+-]?\\d+\\s*$') then cast(trim({v}) as double)
      when {kind} in ('DOUBLE', 'UBIGINT', 'BIGINT') then trunc(cast({v} as double)) end"""
    return f"(case when ({n}) < 1 then 1 when ({n}) > 100 then 100 else cast(({n}) as int) end)"


def _field(name: str) -> tuple[str, str]:
    return f"json_extract_string(j, '$.{name}')", f"json_type(j, '$.{name}')"


def _answers() -> str:
    parts = []
    for ind, labels in (("sovereign", "('0', '1')"), ("assembly", "('0', '1', '2', '3')")):
        v, k = _field(ind)
        c, ck = _field(f"{ind}_confidence")
        reason = f"case when j is null then null else coalesce(json_extract_string(j, '$.{ind}_reasoning'), '') end"
        parts.append(
            f"""select custom_id, cast(split_part(custom_id, '|', 1) as bigint) as row_idx, '{ind}' as indicator,
            cast(split_part(custom_id, '|', 3) as int) as sc_idx, {label_sql(v, k, labels)} as prediction,
            coalesce({reason}, '') as reasoning, case when {c} is not null then {score_sql(c, ck)} end as confidence from js"""
        )
    return " union all ".join(parts)


ANSWERS_CTE = f"ans as ({_answers()})"


@query("parse_responses", with_ctes([RESPONSES, JSON, ANSWERS_CTE], "select * from ans"))
def parse_responses(spark, sf):
    """Fenced, wrapped, cut-off and empty answers to labels, reasoning and confidence; no request is answered twice."""
    long = answers_long(RESPONSES.df(spark, sf), DEFAULT_REGISTRY, combined=["sovereign", "assembly"], alone=[], once=False)
    return long.select("custom_id", "row_idx", "indicator", "sc_idx", "prediction", "reasoning", "confidence")


@query("parse_variant", with_ctes([RESPONSES, JSON, ANSWERS_CTE], "select * from ans"))
def parse_variant(spark, sf):
    """The same labels read from VARIANT answers, each parsed once."""
    return labels_from_variants(RESPONSES.df(spark, sf), DEFAULT_REGISTRY, ["sovereign", "assembly"])


def _type_sql(i: str, field: str, key: str) -> str:
    kind = f"json_type(j, '$.{key}')"
    return f"""select '{i}' as indicator, '{field}' as field, case when {kind} = 'VARCHAR' then 'string' when {kind} = 'BOOLEAN' then 'boolean' when {kind} = 'NULL' then 'null'
        when {kind} = 'ARRAY' then 'list' when {kind} = 'OBJECT' then 'object' when {kind} is not null then 'number' end as json_type from js"""


@query(
    "answer_types",
    with_ctes(
        [RESPONSES, JSON],
        "select indicator, field, json_type, count(*) as n from (" + " union all ".join(
            _type_sql(i, f, k) for i in ("sovereign", "assembly") for f, k in (("label", i), ("confidence", f"{i}_confidence"))
        ) + ") group by 1, 2, 3",
    ),
)
def answer_type_report(spark, sf):
    """JSON types per indicator: models that quote labels, or leave them out."""
    return answer_types(RESPONSES.df(spark, sf), ["sovereign", "assembly"])


@query("extract_json", with_ctes([RESPONSES], f"select custom_id, coalesce(nullif(regexp_extract(text, '{OBJECT}'), ''), nullif(regexp_extract(text, '(?s)\\{{.*\\}}'), ''), text) as json_text from responses"))
def extract_json(spark, sf):
    return RESPONSES.df(spark, sf).select("custom_id", A.extract_json_text(F.col("text")).alias("json_text"))


@query(
    "validate_labels",
    with_ctes(
        [WIDE],
        f"select row_idx, {label_sql('collegiality_prediction', chr(39) + 'VARCHAR' + chr(39), chr(40) + chr(39) + '0' + chr(39) + ',' + chr(39) + '1' + chr(39) + chr(41))} as label, "
        "coalesce(cast(cast(trunc(try_cast(assembly as double)) as bigint) as varchar), cast(assembly as varchar)) as normal from wide_eval",
    ),
)
def validate_labels(spark, sf):
    df = WIDE.df(spark, sf)
    return df.select(
        "row_idx",
        A.pick_label(F.col("collegiality_prediction"), string_array(("0", "1")), F.lit(True)).alias("label"),
        X.to_label(F.col("assembly")).alias("normal"),
    )


_MULTI = "'[\"' || cast(n_chars % 11 as string) || '\", ' || cast(doc_id % 12 as string) || ', \"' || cast(n_chars % 3 as string) || '\", 2.0, \"77\"]'"


@query(
    "multi_select_labels",
    f"""with m as (select doc_id as row_idx, from_json({_MULTI}, '["varchar"]') as items from documents),
    u as (select row_idx, cast(x as int) as v from (select row_idx, unnest(items) as x from m)
      where x in ('0','1','2','3','4','5','6','7','8','9','10'))
    select m.row_idx, '[' || string_agg(cast(v as varchar), ', ' order by v) || ']' as labels
    from m left join (select distinct row_idx, v from u) d on m.row_idx = d.row_idx group by 1""",
)
def multi_select_labels(spark, sf):
    df = table(spark, sf, "documents").selectExpr("doc_id as row_idx", f"{_MULTI} as v")
    return df.select("row_idx", A.pick_labels(F.col("v"), string_array([str(i) for i in range(11)])).alias("labels"))


def years_sql(col: str) -> str:
    """Cleaned year list of a text column, by list functions."""
    parts = f"list_filter(list_transform(string_split({col}, ';'), lambda x: trim(x)), lambda x: x <> '')"
    year = "case when regexp_extract(x, '(-?\\d+)', 1) <> '' then regexp_extract(x, '(-?\\d+)', 1) else x end"
    return f"case when len({parts}) > 0 then array_to_string(list_transform({parts}, lambda x: {year}), '; ') else {col} end"


@query("clean_years", with_ctes([YEARS], f"select row_idx, {years_sql('years')} as years from year_lists"))
def clean_years(spark, sf):
    return YEARS.df(spark, sf).select("row_idx", X.clean_years(F.col("years")).alias("years"))


_T = "list_filter(list_transform(string_split(types, ';'), lambda x: trim(x)), lambda x: x <> '')"


@query(
    "document_answers",
    with_ctes(
        [
            DOCUMENT_RESPONSES,
            f"""t as (select *, {_T} as parts,
            case when lower(trim(types)) not in ('n/a', 'none', '', 'null') and len({_T}) > 0
              and len(list_filter({_T}, lambda x: x in ('0', '1', '2'))) = len({_T}) then {_T} end as good,
            json_extract_string(text::json, '$.constitution') as raw from document_responses)""",
        ],
        f"""select row_idx,
        coalesce(case when lower(trim(raw)) in ('0', '1', '2') then lower(trim(raw)) when lower(trim(raw)) in ('yes', 'true') then '2'
          when lower(trim(raw)) in ('no', 'false') then '0'
          when trunc(try_cast(raw as double)) in (0, 1, 2) then cast(cast(trunc(try_cast(raw as double)) as int) as varchar) end,
          list_max(good)) as prediction,
        coalesce(nullif(trim(names), ''), 'N/A') as document_name, array_to_string(good, '; ') as document_types,
        case when lower(trim(years)) in ('null', 'none', '', 'n/a') then null else {years_sql('trim(years)')} end as document_years,
        source as reasoning, case when score = 0 then null else greatest(1, least(100, cast(score as int))) end as confidence from t""",
    ),
)
def document_answers(spark, sf):
    df = DOCUMENT_RESPONSES.df(spark, sf)
    parsed = df.select("row_idx", "text", A.parse_answer(F.col("text")).alias("m"))
    return parsed.select("row_idx", A.read_documents(F.col("m"), F.col("text")).alias("d")).select("row_idx", "d.*")


@query(
    "answer_fields",
    with_ctes(
        [RESPONSES],
        """select custom_id, json_extract_string(coalesce(try_cast(case when b like '{%' and b like '%}' then b end as json),
          try_cast(nullif(regexp_extract(b, '\\{[^}]+\\}'), '') as json)), '$.assembly') as assembly
        from (select custom_id, trim(regexp_replace(text, '```(?:json)?\\s*', '', 'g'), ' ' || chr(10)) b from responses)""",
    ),
)
def answer_fields(spark, sf):
    return RESPONSES.df(spark, sf).select("custom_id", A.read_field(F.col("text"), "assembly").alias("assembly"))


@query(
    "elections_labels",
    with_ctes(
        [VOTES],
        """select row_idx, sc_idx, case when prediction in ('0', '1', '2') then prediction end as label,
        case when prediction in ('0', '1', '2') then prediction else '0' end as label_or_zero from votes3 where indicator = 'assembly'""",
    ),
)
def elections_labels(spark, sf):
    """Dependent labels take exact values only; what becomes of others is an option."""
    v = VOTES.df(spark, sf).where("indicator = 'assembly'")
    text = F.concat(F.lit('{"elections": "'), F.coalesce("prediction", F.lit("none")), F.lit('"}'))
    m = v.select("row_idx", "sc_idx", A.parse_answer(text).alias("m"))
    labels = string_array(DEFAULT_REGISTRY.labels("elections"))
    return m.select(
        "row_idx",
        "sc_idx",
        A.read_dependent(F.col("m"), "elections", labels).alias("label"),
        A.read_dependent(F.col("m"), "elections", labels, "0").alias("label_or_zero"),
    )


@query(
    "request_ids",
    with_ctes(
        [RESPONSES],
        """select custom_id, cast(split_part(custom_id, '|', 1) as bigint) as row_idx, split_part(custom_id, '|', 2) as indicator,
        cast(split_part(custom_id, '|', 3) as int) as sc_idx,
        sha256('=' || split_part(custom_id, '|', 1) || chr(31) || '=' || split_part(custom_id, '|', 2)) as row_hash from responses""",
    ),
)
def request_ids(spark, sf):
    p = X.request_id_parts(F.col("custom_id"))
    return RESPONSES.df(spark, sf).select(
        "custom_id", *[c.alias(n) for n, c in p.items()], X.row_id(p["row_idx"], p["indicator"]).alias("row_hash")
    )


@query(
    "typed_answers",
    with_ctes(
        [RESPONSES, JSON],
        """select custom_id, json_extract_string(j, '$.sovereign') as sovereign, json_extract_string(j, '$.assembly') as assembly,
        cast(json_extract_string(j, '$.assembly_confidence') as int) as assembly_confidence from js""",
    ),
)
def typed_answers(spark, sf):
    """Answers read into the schema the registry expects."""
    schema = DEFAULT_REGISTRY.answer_schema(["sovereign", "assembly"])
    out = RESPONSES.df(spark, sf).select("custom_id", A.parse_typed(F.col("text"), schema).alias("a"))
    return out.select("custom_id", "a.sovereign", "a.assembly", "a.assembly_confidence")
