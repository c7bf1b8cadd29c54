"""Evaluation."""

from pyspark.sql import functions as F

from quorate.operators import metrics as M
from quorate.operators import rows as R
from quorate.plans import evaluate as E
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import LABEL_RATERS, PAIRS, RATERS, WIDE, Fixture, with_ctes
from quorate.registry import DEFAULT_REGISTRY

NAMES = ["sovereign", "assembly", "entry"]


def counts_sql(src: str, keys: str) -> str:
    return f"pc as (select {keys}, truth, prediction, count(*) n from {src} where truth is not null and prediction is not null group by all)"


def classes_sql(keys: str) -> str:
    """CTE `cls`: hits, support, predicted per class."""
    return f"""cls as (select {keys}, label, cast(sum(h) as bigint) hits, cast(sum(s) as bigint) support, cast(sum(p) as bigint) predicted from (
      select {keys}, truth as label, case when truth = prediction then n else 0 end h, n s, 0 p from pc
      union all select {keys}, prediction, 0, 0, n from pc) group by {keys}, label),
rep as (select {keys}, label,
      coalesce(cast(hits as double) / nullif(predicted, 0), 0.0) as precision,
      coalesce(cast(hits as double) / nullif(support, 0), 0.0) as recall,
      coalesce(cast(2 * hits as double) / nullif(support + predicted, 0), 0.0) as f1, support, predicted, hits from cls)"""


@query(
    "accuracy",
    with_ctes(
        [PAIRS],
        """select indicator, cast(count(*) filter (where truth = prediction) as double) / count(*) as accuracy, count(*) as n_samples
        from pairs where truth is not null and prediction is not null group by 1""",
    ),
)
def accuracy(spark, sf):
    return M.accuracy(M.pair_counts(PAIRS.df(spark, sf)))


def _grid() -> str:
    cells = [(i, t, p) for i in NAMES for t in DEFAULT_REGISTRY.labels(i) for p in DEFAULT_REGISTRY.labels(i)]
    return "grid(indicator, truth, prediction) as (values " + ", ".join(map(str, cells)) + ")"


@query(
    "confusion_matrix",
    with_ctes(
        [PAIRS, counts_sql("pairs", "indicator"), _grid()],
        """select g.indicator, g.truth, g.prediction, coalesce(pc.n, 0) as n from grid g
        left join pc on g.indicator = pc.indicator and g.truth = pc.truth and g.prediction = pc.prediction""",
    ),
)
def confusion_matrix(spark, sf):
    return M.confusion_matrix(M.pair_counts(PAIRS.df(spark, sf)), DEFAULT_REGISTRY, NAMES)


@query("class_report", with_ctes([PAIRS, counts_sql("pairs", "indicator"), classes_sql("indicator")], "select * from rep"))
def class_report(spark, sf):
    return M.class_report(M.pair_counts(PAIRS.df(spark, sf)))


def summary_sql(keys: str) -> str:
    return f"""select {keys},
    round(cast(sum(hits) as double) / sum(support), 6) as accuracy,
    round(avg(precision) filter (where support > 0), 6) as macro_precision,
    round(avg(recall) filter (where support > 0), 6) as macro_recall,
    round(avg(f1) filter (where support > 0), 6) as macro_f1,
    round(avg(f1), 6) as observed_macro_f1,
    round(sum(f1 * support) / sum(support), 6) as weighted_f1,
    round(case when count(*) = 2 then arg_max(f1, label) end, 6) as binary_f1,
    round(case when count(*) = 2 then arg_max(precision, label) end, 6) as binary_precision,
    round(case when count(*) = 2 then arg_max(recall, label) end, 6) as binary_recall,
    count(*) as n_classes, cast(sum(support) as bigint) as n_samples from rep group by {keys}"""


ROUNDED = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "observed_macro_f1", "weighted_f1", "binary_f1", "binary_precision", "binary_recall")


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in df.columns])


@query("evaluation_summary", with_ctes([PAIRS, counts_sql("pairs", "indicator"), classes_sql("indicator")], summary_sql("indicator")))
def evaluation_summary(spark, sf):
    """Accuracy, macro, weighted and binary F1 of all indicators in one job."""
    return rounded(M.summary(M.pair_counts(PAIRS.df(spark, sf))))


@query(
    "compare_datasets",
    with_ctes([PAIRS, counts_sql("pairs", "dataset, indicator"), classes_sql("dataset, indicator")], summary_sql("dataset, indicator")),
)
def compare_datasets(spark, sf):
    pairs = PAIRS.df(spark, sf)
    runs = {d: pairs.where(F.col("dataset") == d).drop("dataset") for d in ("base", "checked")}
    return rounded(M.summary(M.pair_counts(M.stack_datasets(runs), ("dataset", "indicator")), ("dataset", "indicator")))


@query(
    "dataset_class_report",
    with_ctes(
        [PAIRS, counts_sql("pairs", "dataset, indicator"), classes_sql("dataset, indicator")],
        "select dataset, indicator, label, precision, recall, f1, support from rep",
    ),
)
def dataset_class_report(spark, sf):
    keys = ("dataset", "indicator")
    return M.class_report(M.pair_counts(PAIRS.df(spark, sf), keys), keys).drop("predicted", "hits")


KAPPA = """select indicator, observed as agreement,
    case when chance = square then case when hits = n then 1.0 else 0.0 end
    else (observed - cast(chance as double) / cast(square as double)) / (1.0 - cast(chance as double) / cast(square as double)) end as kappa, n as n_samples from (
    select indicator, sum(hits) hits, cast(sum(support) as bigint) n, cast(sum(hits) as double) / sum(support) observed,
    sum(cast(support as hugeint) * predicted) chance, cast(sum(support) as hugeint) * sum(support) square from cls group by 1)"""


@query("cohens_kappa", with_ctes([RATERS, counts_sql("raters", "indicator"), classes_sql("indicator")], KAPPA))
def cohens_kappa(spark, sf):
    """Two raters over all line items."""
    return M.cohens_kappa(M.pair_counts(RATERS.df(spark, sf)))


@query("label_rater_agreement", with_ctes([LABEL_RATERS, counts_sql("label_raters", "indicator"), classes_sql("indicator")], KAPPA))
def label_rater_agreement(spark, sf):
    return M.cohens_kappa(M.pair_counts(LABEL_RATERS.df(spark, sf)))


@query(
    "first_disagreements",
    with_ctes(
        [PAIRS],
        """select indicator, row_idx, truth, prediction, cast(rn as int) as rank from (
        select *, row_number() over (partition by indicator order by row_idx) rn from pairs where truth is distinct from prediction)
        where rn <= 100""",
    ),
)
def first_disagreements(spark, sf):
    return M.first_disagreements(PAIRS.df(spark, sf).drop("dataset"), 100)


@query(
    "model_disagreements",
    with_ctes(
        [WIDE],
        """select row_idx, n_unique_predictions from (select row_idx, (select count(distinct v) from (
        select unnest([sovereign_prediction, sovereign_b, sovereign_c]) v) where v not in ('nan', 'None', '')) as n_unique_predictions from wide_eval)
        where n_unique_predictions >= 2""",
    ),
)
def model_disagreements(spark, sf):
    return M.disagreeing_rows(WIDE.df(spark, sf), ["sovereign_prediction", "sovereign_b", "sovereign_c"], 2).select("row_idx", "n_unique_predictions")


_LAB = "coalesce(cast(cast(trunc(try_cast({0} as double)) as bigint) as varchar), cast({0} as varchar))"
_IND3 = ("sovereign", "collegiality", "assembly")
_LONG = " union all ".join(
    f"select row_idx, start_year, region_v1, '{i}' as indicator, {_LAB.format(i)} as truth, {_LAB.format(i + '_prediction')} as prediction from wide_eval" for i in _IND3
)


@query("stack_indicators", with_ctes([WIDE], f"select row_idx, indicator, truth, prediction from ({_LONG})"))
def stack_indicators(spark, sf):
    return M.stack_indicators(WIDE.df(spark, sf), _IND3)


ROW_ACC = f"""racc as (select row_idx, correct, total, cast(correct as double) / nullif(total, 0) as row_accuracy from (
    select row_idx, count(*) filter (where truth = prediction) correct, count(*) filter (where truth is not null and prediction is not null) total
    from ({_LONG}) group by 1))"""


@query("row_accuracy", with_ctes([WIDE, ROW_ACC], "select * from racc"))
def row_accuracy(spark, sf):
    return M.row_accuracy_wide(WIDE.df(spark, sf), _IND3).select("row_idx", "correct", "total", "row_accuracy")


@query("row_accuracy_long", with_ctes([WIDE, ROW_ACC], "select * from racc"))
def row_accuracy_long(spark, sf):
    return M.row_accuracy(M.stack_indicators(WIDE.df(spark, sf), _IND3))


@query(
    "filtered_mean_accuracy",
    with_ctes(
        [WIDE, ROW_ACC],
        """select region_v1, round(avg(row_accuracy), 6) as mean_accuracy, count(*) as n_rows from racc join wide_eval using (row_idx)
        where start_year between 0 and 1200 and region_v1 in ('en', 'fr') group by 1""",
    ),
)
def filtered_mean_accuracy(spark, sf):
    kept = R.filter_range(WIDE.df(spark, sf), {"start_year": (0, 1200)}, {"region_v1": ["en", "fr"]})
    acc = M.row_accuracy_wide(kept, _IND3)
    return acc.groupBy("region_v1").agg(F.round(F.avg("row_accuracy"), 6).alias("mean_accuracy"), F.count(F.lit(1)).alias("n_rows"))


@query("label_distribution", with_ctes([PAIRS], "select indicator, prediction, count(*) as n from pairs group by 1, 2"))
def label_distribution(spark, sf):
    return M.label_distribution(PAIRS.df(spark, sf))


_MODELS = """mp as (select row_idx, 'sovereign' as indicator, sovereign_prediction as truth,
    coalesce(cast(cast(trunc(try_cast(sovereign_c as double)) as bigint) as varchar), sovereign_c) as prediction from wide_eval)"""


@query("compare_models", with_ctes([WIDE, _MODELS, counts_sql("mp", "indicator"), classes_sql("indicator")], KAPPA))
def compare_models(spark, sf):
    return E.compare_models(WIDE.df(spark, sf), "{}_prediction", "{}_c", ["sovereign"])["agreement"]


_SECOND = {"collegiality_c": "case when n_chars % 5 = 0 then null else cast(doc_id % 2 as string) end", "assembly_c": "case when doc_id % 7 = 0 then '9' else cast(n_chars % 4 as string) end"}
_WIDER = Fixture("wide_models", "documents", {**WIDE.columns, **_SECOND})
_PLAIN = "coalesce(cast(cast(trunc(try_cast({0} as double)) as bigint) as varchar), {0})"
_MODELS_ALL = "ma as (" + " union all ".join(
    f"select row_idx, '{i}' as indicator, {_PLAIN.format(i + '_prediction')} as truth, {_PLAIN.format(i + '_c')} as prediction from wide_models" for i in _IND3
) + ")"


@query("compare_models_all", with_ctes([_WIDER, _MODELS_ALL, counts_sql("ma", "indicator"), classes_sql("indicator")], KAPPA))
def compare_models_all(spark, sf):
    return E.compare_models(_WIDER.df(spark, sf), "{}_prediction", "{}_c", _IND3)["agreement"]


_QUICK = f"""ql as (select row_idx, indicator, truth, prediction from ({_LONG}) where start_year between -100 and 1400)"""


@query("quick_eval", with_ctes([WIDE, _QUICK, counts_sql("ql", "indicator"), classes_sql("indicator")], summary_sql("indicator")))
def quick_eval(spark, sf):
    return rounded(E.quick_eval(WIDE.df(spark, sf), _IND3, {"start_year": (-100, 1400)})["indicators"])


@query(
    "compare_runs_multiclass",
    with_ctes(
        [WIDE, f"rl as (select case when region_v1 = 'en' then 'a' else 'b' end as dataset, indicator, truth, prediction from ({_LONG}))",
         counts_sql("rl", "dataset, indicator"), classes_sql("dataset, indicator")],
        f"""select dataset, indicator, accuracy, n_samples, observed_macro_f1 as f1_macro, weighted_f1 as f1_weighted
        from ({summary_sql("dataset, indicator")}) where indicator = 'assembly'""",
    ),
)
def compare_runs_multiclass(spark, sf):
    df = WIDE.df(spark, sf)
    runs = {"a": df.where("region_v1 = 'en'"), "b": df.where("region_v1 <> 'en'")}
    out = E.compare_runs(runs, _IND3)["multiclass"]
    return out.select(*[F.round(c, 6).alias(c) if c in ("accuracy", "f1_macro", "f1_weighted") else F.col(c) for c in out.columns])


@query(
    "joined_truth",
    with_ctes(
        [LABEL_RATERS],
        """select cast(count(*) filter (where truth = p) as double) / count(*) as accuracy, count(*) as n_samples from
        (select d.doc_id, cast(d.n_chars % 2 as varchar) as p, l.truth from documents d left join label_raters l on d.doc_id = l.row_idx) where truth is not null""",
    ),
)
def joined_truth(spark, sf):
    """Truth kept in a table of its own, joined by key."""
    from quorate.plans.catalog.fixtures import table

    predictions = table(spark, sf, "documents").selectExpr("doc_id as row_idx", "'quality' as indicator", "cast(n_chars % 2 as string) as prediction")
    truth = LABEL_RATERS.df(spark, sf).select("row_idx", "indicator", "truth")
    return M.accuracy(M.pair_counts(M.join_truth(predictions, truth))).drop("indicator")
