"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import lines, mixing, ngram_join, packing, quality
from quorate.llm.common import n_words, read, stage
from quorate.llm.queries import text_cluster

# The learned steps and the signatures have no SQL; tests/llm hold the operators against brute force and run the stages.
ORACLE_SQL = None


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts. Its verdict is the same for all rows of one id and text."""
    labels = read(spark, sf_dir, "labels")
    return quality.keep_accepted(docs, labels)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; a document that had words and lost them all goes."""
    out = lines.dedup_lines(docs)
    counts = [c for c in out.columns if c not in docs.columns]
    emptied = (F.col(counts[1]) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8; documents without words stay."""
    return ngram_join.keep_one(docs, ngram_join.Join(words=5, num=80, den=100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.repeat_documents(docs, n_words(F.col("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the bin they lie in."""
    return packing.pack(docs, n_words(F.col("text")), F.col("source"), text_cluster(F.col("text")))


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("mix sources", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
