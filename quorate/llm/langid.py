"""Language identification: TF-IDF vectors of byte n-grams against several clustered centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import small_side, stage
from quorate.llm.quality import held_out

# n-grams of these lengths in bytes of the lower-cased text, words parted by one space, hashed to DIMS places.
LENGTHS, BITS = (1, 2, 3, 4), 13
DIMS = 1 << BITS
CENTROIDS, ROUNDS, LEAST_SHARE = 4, 8, 0.005
# Centroids are clustered from about so many distinct rows per language, those with the smallest hash of id and text.
# Document frequencies and the distances for rejection are taken from all learning rows.
SAMPLE = 1500
# A row is rejected where its cosine is below this quantile of the learning rows of its language and length.
REJECT_AT = 0.005
# Bytes hashed at once: memory stays bounded for a text of any length.
PIECE = 1 << 20
NONE = "und"

NOT_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LETTER = re.compile(r"[^\W\d_]")
HASH = np.uint32(2_654_435_761)


def plain(text: str | None) -> bytes:
    """Letters and characters above ASCII in lower case; anything else parts words; a blank at either end."""
    if text is None or not LETTER.search(text):
        return b""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(NOT_LETTERS).split()) + b" "


def gram_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the n-grams of a whole text, places ascending."""
    total = np.zeros(DIMS, np.int64)
    for start in range(0, len(data), PIECE):
        code = np.frombuffer(data[start: start + PIECE + max(LENGTHS) - 1], np.uint8).astype(np.uint32)
        starts = min(PIECE, len(data) - start)
        value = np.zeros(len(code), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            value = value[: len(code) - n + 1] * np.uint32(257) + code[n - 1:] + np.uint32(1)
            if n in LENGTHS and len(value):
                total += np.bincount((value[:starts] * HASH + np.uint32(n)) * HASH >> np.uint32(32 - BITS), minlength=DIMS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of length one. Plain counts, so that a text in two languages is nearest to the one it holds more of."""
    out = counts * idf
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def cluster(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS, least: float = LEAST_SHARE) -> np.ndarray:
    """Up to k centroids of length one by spherical k-means, started from rows drawn far apart.

    The draw has a fixed seed, so the result follows from the rows and their order alone. A cluster with under `least`
    of the rows would let a few strays speak for the language; it is dropped.
    """
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    rng = np.random.default_rng(7)
    centre = vectors[[rng.integers(len(vectors))]]
    while len(centre) < min(k, len(vectors)):
        away = np.maximum(0.0, 1.0 - (vectors @ centre.T).max(axis=1)).astype(np.float64)
        if away.max() < 1e-6:
            break
        centre = np.vstack([centre, vectors[[rng.choice(len(vectors), p=away / away.sum())]]])
    for _ in range(rounds):
        owner = (vectors @ centre.T).argmax(axis=1)
        big = [c for c in range(len(centre)) if (owner == c).sum() >= max(1.0, least * len(vectors))]
        centre = unit(np.stack([vectors[owner == c].mean(axis=0) for c in big]))
    return centre


@dataclass(frozen=True)
class Centroids:
    """Languages in UTF-8 order, idf, and centroids (rows) with the place of their language."""

    langs: tuple[str, ...]
    idf: np.ndarray
    owner: np.ndarray
    vectors: np.ndarray  # (DIMS, centroids), so that the few places of a text are rows

    def nearest(self, text: str | None) -> tuple[str, float, int]:
        """(language, cosine, number of n-grams); `und` and 0 for texts without a letter."""
        data = plain(text)
        if not data or not self.langs:
            return NONE, 0.0, 0
        at, counts = gram_counts(data)
        cosines = weights(counts, self.idf[at]) @ self.vectors[at]
        best = int(cosines.argmax())
        return self.langs[self.owner[best]], float(min(1.0, max(0.0, cosines[best]))), int(counts.sum())


def learn(rows: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Centroids:
    """Centroids from (lang, key long, text): document frequencies over all rows, clusters over a sample by language.

    The sample of a language has about `sample` distinct keys. Clusters are found in one task per language; the driver
    gets DIMS frequencies and at most k vectors of DIMS numbers per language.
    """
    size = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(small_side(size), "lang").select("lang", "key", "text", (share * F.col("rows") < sample).alias("picked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, texts = np.zeros(DIMS, np.int64), 0
        for pdf in batches:
            out = []
            for lang, key, text, wanted in zip(pdf["lang"], pdf["key"], pdf["text"], pdf["picked"]):
                data = plain(text)
                if data:
                    at, counts = gram_counts(data)
                    seen[at] += 1
                    texts += 1
                    if wanted:
                        out.append((lang, key, at.tobytes(), counts.astype(np.int64).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "key", "at", "counts"])
        yield pd.DataFrame([(None, texts, None, seen.tobytes())], columns=["lang", "key", "at", "counts"])

    found = stage(picked.mapInPandas(run, "lang string, key long, at binary, counts binary"), "grams")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, seen = 0, np.zeros(DIMS, np.int64)
        for pdf in batches:
            texts += int(pdf["key"].sum())
            for x in pdf["counts"]:
                seen = seen + np.frombuffer(x, np.int64)
        yield pd.DataFrame([(texts, seen.tobytes())], columns=["texts", "seen"])

    # One row per task, added up in a few tasks and then here.
    sums = found.where("lang is null").select("key", "counts").mapInPandas(add, "texts long, seen binary").collect()
    texts = sum(r["texts"] for r in sums)
    seen = sum((np.frombuffer(r["seen"], np.int64) for r in sums), np.zeros(DIMS, np.int64))
    idf = 1.0 + np.log((1.0 + texts) / (1.0 + seen))

    def centres(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        vectors = np.zeros((len(pdf), DIMS), np.float32)
        for i, (at, counts) in enumerate(zip(pdf["at"], pdf["counts"])):
            at = np.frombuffer(at, np.int32)
            vectors[i, at] = weights(np.frombuffer(counts, np.int64), idf[at])
        return pd.DataFrame([(key[0], c.astype(np.float32).tobytes()) for c in cluster(vectors, k)], columns=["lang", "centre"])

    once = found.where("lang is not null").dropDuplicates(["lang", "key"])
    got = sorted((r["lang"], r["centre"]) for r in once.groupBy("lang").applyInPandas(centres, "lang string, centre binary").collect())
    langs = tuple(sorted({lang for lang, _ in got}, key=str.encode))
    owner = np.array([langs.index(lang) for lang, _ in got], np.int64)
    vectors = np.stack([np.frombuffer(c, np.float32) for _, c in got]).T.astype(np.float64) if got else np.zeros((DIMS, 0))
    return Centroids(langs, idf, owner, np.ascontiguousarray(vectors))


def named(text: Column, model: Centroids, spark) -> Column:
    """Struct (lang, cosine, grams) of a whole text."""
    # Plain arrays travel: tasks need not have this package.
    shared = spark.sparkContext.broadcast((model.langs, model.idf, model.owner, model.vectors))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Centroids(*shared.value)
        for texts in batches:
            yield pd.DataFrame([known.nearest(t) for t in texts], columns=["lang", "cosine", "grams"])

    return F.pandas_udf(run, "lang string, cosine double, grams long")(text)


def identify(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS, reject_at: float = REJECT_AT,
             doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score, rejected).

    lang_pred is the language of the nearest centroid by cosine and score that cosine, from 0 to 1. `rejected` tells
    that the text is farther from its centroid than nearly all learning texts of that language and about that length
    are, so that it is likely in none of the languages; a caller that wants no guess takes `und` there.

    Only rows with a language and a text that are not held out are learned from; language, source and id are no inputs
    of a prediction. Null texts and texts without a letter (Unicode) are `und` with score 0 and rejected, and so is all
    if nothing could be learned. A null id counts as the empty text for the hold-out; repeated rows get a row each and
    count once in the sample. Texts are read whole, in pieces. No rows, no result; other columns are left out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    out = held_out(F.col("doc_id"))
    learning = rows.where(~out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = learn(learning.select("lang", F.xxhash64("doc_id", "text").alias("key"), "text"), sample, k)
    said = rows.select("doc_id", out.alias("held_out"), "lang", named(F.col("text"), model, docs.sparkSession).alias("r"))
    # Texts of similar length are held against each other: short ones are far from any centroid.
    size = F.floor(F.log2(F.col("r.grams") + 1)).cast("int")
    told = stage(said.select("doc_id", "held_out", "lang", F.col("r.lang").alias("lang_pred"), F.col("r.cosine").alias("score"), size.alias("size")), "named")
    right = told.where(~F.col("held_out") & (F.col("lang") == F.col("lang_pred")))
    bounds = right.groupBy("lang_pred", "size").agg(F.percentile_approx("score", reject_at, 10_000).alias("least"))
    held = told.join(small_side(stage(bounds, "bounds")), ["lang_pred", "size"], "left")
    rejected = (F.col("lang_pred") == NONE) | F.coalesce(F.col("score") < F.col("least"), F.lit(False))
    return held.select("doc_id", "held_out", "lang_pred", "score", rejected.alias("rejected"))
