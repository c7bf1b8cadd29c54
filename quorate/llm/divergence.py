"""Source divergence audit: joint tables of count levels by exact blocked one-hot products, priced pair by pair."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.llm.common import small_side, stage

SCALE = 1_000_000_000
# A term must occur in so many documents of its language.
MIN_DOCS = 10
TOP_TERMS = 10
# A task multiplies the terms of one block for one pair of source tiles, a slice of terms at a time. A slice has at most
# SLICE * TILE indicator columns on each side, which bounds the product whatever the data.
BLOCK, TILE, SLICE = 4096, 32, 64
# Counts a task holds before it sends them on.
HELD_TERMS = 400_000

# Terms are runs of letters A-Z in either case and of all characters above ASCII; every other byte ends a term.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def symmetric(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) in integers; 64 bits hold it for p and q up to 3 * 10^9."""
    return (p - q) ** 2 // (p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of a frame (lang, source, text) without nulls, added up within each task only."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in count.items():
                if n:
                    terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n)), pa.array([source] * len(n)), terms, pa.array(n.values(), pa.int64()),
                         pa.array(map(seen.__getitem__, n), pa.int64())], schema=schema)
            count.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                terms = text.encode().translate(TO_TERMS).split()
                n, seen = count.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(terms)
                seen.update(set(terms))
                held += len(n)
                if held > HELD_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def scaled(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly; null where there are no terms."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", top, F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(20,0)")).cast("long") + 1


def block_sums(price: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Prices of all source pairs over one block of terms.

    Per slice, X has a row per term and an indicator column per (source, level); the columns of a source hold exactly
    one 1 in each row, level 0 included. X^T X is the joint table of levels for every pair of sources at once: its cells
    count terms (at most SLICE, exact in single precision) and are priced once per cell, not per term. Terms that none of
    the two tiles has are not here; `seen` is the number of those that are.
    """

    def one_hot(level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indicators of a (terms, sources) matrix of levels; the source and a row of each column."""
        wide = level + np.arange(level.shape[1], dtype=np.int64) * (level.max(initial=0) + 1)
        _, first, column = np.unique(wide.ravel(), return_index=True, return_inverse=True)
        out = np.zeros((len(level), len(first)), np.float32)
        out[np.repeat(np.arange(len(level)), level.shape[1]), column.ravel()] = 1
        return out, first % max(1, level.shape[1]), first // max(1, level.shape[1])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, _, ti, tj = key
        heads = pdf[pdf["head"]].sort_values("g")
        sides = {t: heads[heads["g"] // TILE == t] for t in {ti, tj}}
        body = pdf[~pdf["head"]].sort_values(["lang_n", "term"], ascending=False, kind="stable")
        row = np.cumsum((body["term"] != body["term"].shift()).to_numpy()) - 1 if len(body) else np.zeros(0, np.int64)
        g, n, p = (body[c].to_numpy(np.int64) for c in ("g", "n", "p"))
        sums = np.zeros((len(sides[ti]), len(sides[tj])), np.int64)
        for start in range(0, int(row[-1]) + 1 if len(row) else 0, SLICE):
            lo, hi = np.searchsorted(row, [start, start + SLICE])
            height = min(SLICE, int(row[-1]) + 1 - start)
            built = {}
            for t, head in sides.items():
                level = np.zeros((height, len(head)), np.int64)
                value = np.tile(head["p"].to_numpy(np.int64), (height, 1))
                mine = np.flatnonzero(g[lo:hi] // TILE == t) + lo
                at = row[mine] - start, g[mine] - t * TILE
                level[at], value[at] = n[mine], p[mine]
                x, source, where = one_hot(level)
                built[t] = x, source, value[where, source]
            (xi, si, pi), (xj, sj, pj) = built[ti], built[tj]
            table = xi.T @ xj
            a, b = np.nonzero(table)
            if ti == tj:
                a, b = a[si[a] < sj[b]], b[si[a] < sj[b]]
            np.add.at(sums, (si[a], sj[b]), table[a, b].astype(np.int64) * price(pi[a], pj[b]))
        i, j = np.indices(sums.shape)
        keep = (i < j) if ti == tj else np.ones_like(i, bool)
        return pd.DataFrame({"lang": lang, "a": (i + ti * TILE)[keep], "b": (j + tj * TILE)[keep], "value": sums[keep], "seen": int(row[-1]) + 1 if len(row) else 0})

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, price: Callable = symmetric,
          text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """How far the sources of each language lie apart: (lang, source, part, item, value long, rank int).

    Part `pair`: item is each other source of the language, value the sum of `price` over all kept terms of the scaled
    shares of the two. Part `term`: the `top` terms that the source uses more than its language does, with `price` of
    its share and the language's. Ranks go by value descending, then item in UTF-8 order. `price` must be symmetric.

    A language keeps the terms of at least `min_docs` of its documents (rows). Nulls in text, language and source count
    as empty texts, which are values like any other. A source without terms is a group all the same; where a language
    keeps no term its pairs have value 0. Repeated rows count each. Long texts are read whole. An empty table gives no
    rows; other columns are left out.

    Texts are counted where they lie. One shuffle by (lang, term) adds the counts up and finds the kept terms; terms are
    dealt over blocks by hash, sources over tiles, so a hot source or language is many tasks. What leaves a block is one
    number per pair of sources. Nothing is collected.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = term_counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    kept = counted.select("lang", "term", "source", "n", F.sum("docs").over(whole).alias("docs"), F.sum("n").over(whole).alias("lang_n"))
    kept = stage(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")

    # One row per group with its place in its language, the number of terms and of occurrences.
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(size, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")],
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("width"),
    )
    groups = stage(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK))), "groups")

    known = kept.join(small_side(groups), ["lang", "source"])
    priced = known.withColumn("p", scaled(F.col("n"), F.col("total"), F.col("terms")))
    at_block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    body = priced.select("lang", at_block.alias("block"), "width", "g", F.lit(False).alias("head"), "term", "lang_n", "n", "p")
    nothing = F.coalesce(scaled(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(1))
    heads = groups.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "width", "g", F.lit(True).alias("head"), F.lit(None).cast("string").alias("term"),
        F.lit(0).cast("long").alias("lang_n"), F.lit(0).cast("long").alias("n"), nothing.alias("p"),
    )
    tile = F.floor(F.col("g") / TILE)
    dealt = body.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("width") - 1) / TILE))))
    dealt = dealt.select("lang", "block", F.least(tile, "other").alias("ti"), F.greatest(tile, "other").alias("tj"), "g", "head", "term", "lang_n", "n", "p")
    sums = dealt.groupBy("lang", "block", "ti", "tj").applyInPandas(block_sums(price), "lang string, a long, b long, value long, seen long")
    half = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "seen"))
    names = small_side(groups.select("lang", "g", "source", "terms", nothing.alias("p")))
    pairs = both.join(names.withColumnRenamed("g", "a"), ["lang", "a"]).join(names.select("lang", F.col("g").alias("b"), F.col("source").alias("item"), F.col("p").alias("q")), ["lang", "b"])
    # All kept terms that neither of the two sources' tiles has lie in one cell of their joint table.
    pairs = pairs.withColumn("value", F.col("value") + (F.col("terms") - F.col("seen")) * priced_column(price)(F.col("p"), F.col("q")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    own, all_of_it = F.col("p"), F.col("q")
    terms = priced.withColumn("q", scaled(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where("n > 0 and p > q")
    priced_terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), priced_column(price)(own, all_of_it).alias("value"))
    ranked = priced_terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(ranked)


def priced_column(price: Callable) -> Callable[[Column, Column], Column]:
    """`price` over columns; the built-in one stays in the JVM."""
    if price is symmetric:
        return lambda p, q: F.call_function("div", (p - q) * (p - q), p + q)
    return F.pandas_udf(lambda p, q: pd.Series(price(p.to_numpy(np.int64), q.to_numpy(np.int64))), "long")
