"""Run logs, exports, projections, column detection, user hooks and table functions, each written and read back or called."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions.templates import without_reasoning
from quorate.operators import probe as B
from quorate.operators import quality as QC
from quorate.operators import rows as R
from quorate.operators.repair import indicator_columns
from quorate.operators.requests import prompts
from quorate.operators.rollup import geo_means, rollup_polities
from quorate.plans import evaluate as E
from quorate.plans.answers import answers_long, wide_results
from quorate.plans.catalog import query
from quorate.plans.catalog.evaluation import _IND3, _LONG, classes_sql, counts_sql, rounded, summary_sql
from quorate.plans.catalog.fixtures import DOCUMENTS_WIDE, PROBE_ROWS, RAW_RULERS, RESPONSES, USAGE, VOTES, WIDE, Fixture, table, with_ctes
from quorate.plans.catalog.parsing import JSON
from quorate.plans.catalog.requests import _TEXT, FILLED, RULERS, TEMPLATE, good_rows
from quorate.plans.catalog.rollups import PROBE, ROLLUP, scored
from quorate.plans.manifest import read_manifest, run_stage, table_digest
from quorate.plans.sql_functions import register_sql
from quorate.registry import DEFAULT_REGISTRY
from quorate.session import run_folder
from quorate.sources import sinks, tables


@query(
    "polities_reread",
    with_ctes([RAW_RULERS], f"""select id, territorynamehistorical, cast(leader_count as int) as leader_count, region, start_year, end_year, assembly_binary, "exit", powersharing, sovereign,
    cast(appointment as int) as appointment, cast(tenure as int) as tenure, cast(year_range as int) as year_range from ({ROLLUP}) where territorynamehistorical is not null"""),
)
def polities_reread(spark, sf):
    """The rollup written as CSV and read back with its types."""
    folder = run_folder(spark, "polities")
    columns = [c.split()[0] for c in tables.POLITIES.split(", ")]
    out = rollup_polities(RAW_RULERS.df(spark, sf), "row_idx").where("territorynamehistorical is not null").select(columns)
    sinks.save_results(out, folder, ["csv"], order="territorynamehistorical")
    return tables.load_polities(spark, f"{folder}/csv", kind="csv")


@query(
    "run_log",
    with_ctes([USAGE], """select status as run_id, 'cost report' as kind, cast(count(*) as varchar) as calls, cast(sum(input_tokens) as varchar) as input_tokens from usage group by 1"""),
)
def run_log(spark, sf):
    """One line per run in an append-only table: here a run per status, logged one after the other."""
    folder = run_folder(spark, "run-log")
    totals = USAGE.df(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"))
    for r in totals.collect():  # one row per status
        sinks.log_run(spark, folder, r["status"], "cost report", {"calls": r["calls"], "input_tokens": r["input_tokens"]})
    log = spark.read.parquet(folder)
    return log.select("run_id", "kind", F.col("facts")["calls"].alias("calls"), F.col("facts")["input_tokens"].alias("input_tokens"))


@query(
    "rows_to_reprocess",
    with_ctes([DOCUMENTS_WIDE], "select cast(row_idx as varchar) as row_idx, sovereign_reasoning from documents_wide where sovereign_prediction is null or sovereign_confidence is null or sovereign_confidence = -1"),
)
def rows_to_reprocess(spark, sf):
    """Failed rows written with the columns a new run needs."""
    folder = run_folder(spark, "reprocess")
    failed = QC.failed_rows(DOCUMENTS_WIDE.df(spark, sf), "sovereign")
    sinks.save_for_reprocessing(failed, folder, ["row_idx", "sovereign_reasoning"])
    return tables.load_table(spark, folder, "row_idx string, sovereign_reasoning string", kind="csv")


@query("exported_analysis", with_ctes([WIDE, f"xl as ({_LONG})", counts_sql("xl", "indicator"), classes_sql("indicator")], summary_sql("indicator")))
def exported_analysis(spark, sf):
    """Summary, classes and confusion side by side in a folder; the summary read back."""
    folder = run_folder(spark, "analysis")
    sinks.export_analysis(E.analysis_tables(WIDE.df(spark, sf), DEFAULT_REGISTRY, _IND3), folder)
    return rounded(spark.read.parquet(f"{folder}/summary"))


@query("probe_results_stored", with_ctes(PROBE, "select run, row_idx, question, answer, cast(correct as int) as correct from sc"))
def probe_results_stored(spark, sf):
    """Probe answers with their correctness, written in order as CSV and JSON; the JSON read back."""
    folder = run_folder(spark, "probe")
    sinks.save_results(scored(spark, sf), folder, ["csv", "json"], order="row_idx")
    return tables.load_table(spark, f"{folder}/json", "run string, row_idx bigint, question string, answer string, correct int", kind="json")


_GEO = """select l_suppkey, count(*) as n_leaders, round(exp(avg(ln(case when l_extendedprice > 0 then l_extendedprice end))), 4) as geo_mean from lineitem group by 1"""


@query("geo_means_stored", f"select *, row_number() over (order by l_suppkey) - 1 as place from ({_GEO})")
def geo_means_stored(spark, sf):
    """Groups sorted by key in the file."""
    folder = run_folder(spark, "geo")
    out = geo_means(table(spark, sf, "lineitem"), "l_suppkey", ["l_extendedprice"])
    out = out.select("l_suppkey", "n_leaders", F.round("geo_mean_l_extendedprice", 4).alias("geo_mean"))
    sinks.save_results(out, folder, ["csv"], order="l_suppkey")
    place = tables.arrival()
    lines = spark.read.text(f"{folder}/csv").select(place["file"].alias("file"), place["block"].alias("block"), place["line"].alias("line"), F.split("value", ",").alias("v"))
    placed = R.with_row_index(lines.where(F.col("v")[0] != "l_suppkey"), ["file", "block", "line"], "place")
    return placed.select(F.col("v")[0].cast("bigint").alias("l_suppkey"), F.col("v")[1].cast("bigint").alias("n_leaders"), F.col("v")[2].cast("double").alias("geo_mean"), F.col("place").cast("bigint").alias("place"))


LEGACY = Fixture(
    "legacy", "documents",
    {
        "row_idx": "doc_id",
        "constitution_gemini": "case doc_id % 5 when 0 then null else cast(doc_id % 3 as string) end",
        "confidence_score_gemini": "case doc_id % 11 when 0 then null when 1 then -1 else cast(doc_id % 100 as int) end",
        "explanation_gemini": "case when doc_id % 13 = 0 then null else source end",
    },
)


@query(
    "legacy_failures",
    with_ctes(
        [LEGACY],
        """select row_idx, array_to_string(list_filter([case when confidence_score_gemini is null then 'confidence_missing' end, case when coalesce(confidence_score_gemini = -1, false) then 'confidence_negative' end,
        case when constitution_gemini is null then 'prediction_missing' end, case when length(coalesce(explanation_gemini, '')) < 4 then 'reasoning_short' end], lambda x: x is not null), ',') as failed
        from legacy where confidence_score_gemini is null or confidence_score_gemini = -1 or constitution_gemini is null or length(coalesce(explanation_gemini, '')) < 4""",
    ),
)
def legacy_failures(spark, sf):
    """Checks on a table with the older column names, found by name."""
    out = QC.failed_rows(LEGACY.df(spark, sf), "constitution", min_reasoning_length=4, consistency=False)
    return out.select("row_idx", F.array_join("failed_checks", ",").alias("failed"))


@query("one_indicator", with_ctes([VOTES], "select row_idx, " + ", ".join(
    f"max({f}) filter (where indicator = 'assembly' and sc_idx = {k}) as assembly_{n}SC{k + 1}" for f, n in (("prediction", ""), ("reasoning", "reasoning_"), ("confidence", "confidence_")) for k in range(3)
) + " from votes3 group by 1"))
def one_indicator(spark, sf):
    """The columns of one indicator picked out of a wide table of several."""
    wide = wide_results(VOTES.df(spark, sf), ["sovereign", "assembly"], 2)
    picked = [c for c in indicator_columns(wide.columns, "assembly") if "_SC" in c]
    return wide.select("row_idx", *picked)


@query("public_columns", with_ctes([USAGE], "select call_id, model from usage"))
def public_columns(spark, sf):
    """Working columns dropped before a table is handed on."""
    usage = USAGE.df(spark, sf).select("call_id", "model", F.col("input_tokens").alias("_input_tokens"), F.lit(1).alias("_cost"))
    return R.drop_private(usage)


_ANSWER_FORM = '{{"label": "{indicator}", "reasoning": "why", "confidence": 1}}'


@query("prompts_without_reasoning", with_ctes([RULERS, FILLED], """select row_idx, 'About ' || name || ': {"label": "sovereign", "confidence": 1}' as user_prompt from fr"""))
def prompts_without_reasoning(spark, sf):
    """The reasoning field taken out of a template before prompts are made."""
    out = prompts(good_rows(spark, sf), DEFAULT_REGISTRY, ["sovereign"], "multiple", user_template=without_reasoning("About {name}: " + _ANSWER_FORM))
    return out.select("row_idx", "user_prompt")


@query(
    "extra_answer_fields",
    with_ctes([RESPONSES, JSON], """select custom_id, i as indicator, json_extract_string(j, '$.more.k') as depth, j is not null as readable from js cross join (values ('sovereign'), ('assembly')) t(i)"""),
)
def extra_answer_fields(spark, sf):
    """A user's column builder adds a struct of its own to every label."""
    extra = lambda m: F.struct(F.get_json_object(F.try_element_at(m, F.lit("more")), "$.k").alias("depth"), m.isNotNull().alias("readable"))
    long = answers_long(RESPONSES.df(spark, sf), DEFAULT_REGISTRY, ["sovereign", "assembly"], alone=[], extra=extra, once=False)
    return long.select("custom_id", "indicator", "extra.depth", "extra.readable")


@query(
    "prompts_udtf",
    with_ctes([RULERS, FILLED], f"select row_idx, k as indicator, {_TEXT.format('k')} as user_prompt from fr cross join (values ('constitution'), ('sovereign'), ('assembly')) p(k)"),
)
def prompts_udtf(spark, sf):
    """Prompts built from SQL."""
    register_sql(spark, DEFAULT_REGISTRY, templates={n: TEMPLATE for n in DEFAULT_REGISTRY.names}, prefix="quorate_")
    good_rows(spark, sf).createOrReplaceTempView("quorate_rulers")
    return spark.sql(
        """select r.row_idx, p.indicator, p.user_prompt from quorate_rulers r,
        lateral quorate_prompts('constitution,sovereign,assembly', r.polity_name, r.leader_name, r.leader_first_year, r.leader_last_year) p"""
    )


def echo():
    """Answers from the length of the prompt; some calls fail."""

    def call(system, user, temperature):
        if len(user) % 10 == 0:
            raise RuntimeError("no answer")
        return 'So: {"sovereign": %d, "sovereign_confidence": %d, "assembly": "2"} as asked' % (len(user) % 2, len(user))

    return call


@query(
    "annotate_udtf",
    with_ctes([RULERS, FILLED, "pl as (select row_idx, length('Label ' || name) as n from fr)"],
              """select row_idx, case when n % 10 = 0 then 'error' else 'ok' end as status, case when n % 10 = 0 then 'RuntimeError: no answer' end as error,
              case when n % 10 <> 0 then cast(n % 2 as varchar) end as sovereign, case when n % 10 <> 0 then cast(n as int) end as sovereign_confidence,
              case when n % 10 <> 0 then '2' end as assembly from pl"""),
)
def annotate_udtf(spark, sf):
    """A model called from SQL; the columns come from the registry."""
    register_sql(spark, DEFAULT_REGISTRY, echo, prefix="quorate_")
    good_rows(spark, sf).createOrReplaceTempView("quorate_rulers")
    return spark.sql(
        """select r.row_idx, a.status, a.error, a.sovereign, a.sovereign_confidence, a.assembly from quorate_rulers r,
        lateral quorate_annotate('sovereign,assembly', 'label', concat('Label ', r.leader_name), 1.0D) a"""
    )


def _row_hash_sql(columns: dict[str, str]) -> str:
    marked = " || ".join(f"coalesce(strlen(cast({e} as varchar)) || ':' || cast({e} as varchar), '~')" for _, e in sorted(columns.items()))
    return f"('0x' || substr(sha256({marked}), 1, 15))::ubigint::bigint"


_DIGEST = f"""select count(*) as n_rows, sum(h)::hugeint::varchar as hash_sum, bit_xor(h) as hash_xor from (select {_row_hash_sql({'doc_id': 'doc_id', 'lang': 'lang', 'n_chars': 'n_chars', 'source': 'source', 'text': 'text'})} as h from documents)"""


@query("table_digests", _DIGEST)
def table_digests(spark, sf):
    """Digest of whole rows, texts included, by sums that no order of rows can change."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return table_digest(docs).withColumn("hash_sum", F.col("hash_sum").cast("string"))


@query(
    "run_manifest",
    """select * from (values ('as it was', true), ('reshuffled', false), ('one cell changed', true), ('another setting', true), ('again', false)) t(run, made)
    cross join (select (count(*) + 0)::bigint as n_rows from documents)""",
)
def run_manifest(spark, sf):
    """A stage run five times: it is made anew where an input cell or a setting changed, and skipped otherwise."""
    folder = run_folder(spark, "manifest")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    first = docs.agg(F.min("doc_id")).first()[0]
    changed = docs.withColumn("n_chars", F.when(F.col("doc_id") == first, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    stage = lambda rows, step=1: rows.withColumn("next", F.col("n_chars") + step)
    runs = (("as it was", docs, {}), ("reshuffled", docs.repartition(7, "lang"), {}), ("one cell changed", changed, {}), ("another setting", docs, {"step": 2}), ("again", changed, {}))
    done = [(name, run_stage(spark, folder, "next", {"rows": rows}, stage, settings)) for name, rows, settings in runs]
    out = None
    for name, (made, new) in done:
        row = made.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("run"), F.lit(new).alias("made"), "n_rows")
        out = row if out is None else out.unionByName(row)
    if read_manifest(spark, folder).count() != 3:
        raise AssertionError("the manifest has a row per made stage")
    return out
