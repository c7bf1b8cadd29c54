"""The registered training-data queries and the pipeline with their production parameters, on a small folder with nulls and copies."""

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorate.llm.common import n_words
from quorate.llm.queries import ORACLES, QUERIES
from tools.check_oracles import TABLES, compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with repeated texts, null and blank texts, null sources, and urls that are null or have no host."""
    out = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        if t not in ("documents", "pages"):
            shutil.copy(f"{SMALL}/{t}.parquet", out)
    docs, pages = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "pages"))
    copies = docs.where("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    odd = docs.where("doc_id % 11 = 0").withColumn("doc_id", F.col("doc_id") + 2_000_000).withColumn("source", F.lit(None).cast("string"))
    odd = odd.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" \n\t")))
    docs.unionByName(copies).unionByName(odd).toPandas().to_parquet(f"{out}/documents.parquet", index=False)
    bare = pages.limit(3).withColumn("page_id", F.col("page_id") + 1_000_000)
    urls = bare.withColumn("url", F.when(F.col("page_id") % 3 == 0, F.lit("no scheme")).when(F.col("page_id") % 3 == 1, F.lit("http:///p")))
    pages.unionByName(urls).toPandas().to_parquet(f"{out}/pages.parquet", index=False)
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    cur = duck(folder).execute(ORACLES[name])
    result = compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall())
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_every_document_is_there(spark, folder, name):
    ids = {r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in QUERIES[name](spark, folder).select("doc_id").collect()} == ids


def test_pipeline_stages(spark, folder):
    """Line dedup drops a document only if it had words and lost them all, and the last stage packs all that is mixed."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = corpus_pipeline.drop_repeated_lines(spark, docs, folder)
    had = {r[0]: r[1] for r in docs.select("doc_id", n_words(F.col("text"))).collect()}
    has = {r[0]: r[1] for r in left.select("doc_id", n_words(F.col("text"))).collect()}
    assert left.columns == docs.columns and {i for i, n in had.items() if n == 0} <= set(has)
    assert all(n > 0 for i, n in has.items() if had[i] > 0)
    assert not {i for i in had if i > 1_000_000 and had[i] > 0} & set(has)
    assert corpus_pipeline.run(spark, folder).count() > 0
