"""What the operators of this package share: words, text keys, tables written between steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.session import run_folder

# A word is a run of anything but the six ASCII blanks. bytes.split() without arguments cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors.

    The files stay until the folder named by spark.checkpoint.dir is emptied.
    """
    path = run_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A written table of at most so many narrow rows goes to every executor; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def small_side(table: DataFrame, weight: Column | None = None) -> DataFrame:
    """The table, marked for broadcast if it is counted (by rows, or by the sum of `weight`) to be small."""
    n = table.agg(F.coalesce(F.sum(weight), F.lit(0)) if weight is not None else F.count(F.lit(1))).first()[0]
    return F.broadcast(table) if n <= BROADCAST_ROWS else table


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that clashes with none of `taken` (Spark compares names without case)."""
    have = {c.lower() for c in taken}
    name = wanted
    while name.lower() in have:
        name = "_" + name
    return name
