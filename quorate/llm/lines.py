"""Fuzzy line dedup: MinHash bands over character shingles, exact Jaccard, union-find, one line per component."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.llm.common import free_name, small_side, stage
from quorate.llm.components import tried_components
from quorate.llm.sieve import A, chain, id_sketch, is_inside, mix

# Characters per shingle; lines link from this Jaccard similarity of their shingle sets.
CHARS, THRESHOLD = 7, 0.8
# At similarity 0.8 a pair shares a band of 4 rows in one of 12 bands with probability 0.9978.
BANDS, ROWS = 12, 4
# Characters hashed at once: the permuted values of a block stay in the processor's cache.
BLOCK = 1 << 16
# 64-bit words of the parity bits of a line.
PARITY = 16
# Lines whose shingle sets a task remembers while it compares pairs.
CACHED_LINES = 256
# Places on which the shingles of a line fall when a pair is held together before its sets are built.
SLOTS = 4096

_rng = np.random.default_rng(20_240_701)
MULTIPLIERS = (_rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
OFFSETS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\v\f\r", b"abcdefghijklmnopqrstuvwxyz    ")


def normal_lines(text: str | None) -> list[bytes]:
    """Lines of a text as they are compared: A-Z lower-cased, runs of blanks one space, none at the ends."""
    if text is None:
        return []
    flat = text.encode("utf-8", "surrogatepass").translate(FOLD)
    while b"  " in flat:
        flat = flat.replace(b"  ", b" ")
    return [x.strip(b" ") for x in flat.split(b"\n")]


def line_id(line: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(line), "big", signed=True)


def shingle_set(line: str) -> set[str]:
    """A line shorter than a shingle is one shingle."""
    return {line[i: i + CHARS] for i in range(max(1, len(line) - CHARS + 1))}


def shingle_values(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mixed 64-bit values of the shingles of all lines, one line after the other, and where each line's begin."""
    size = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = np.maximum(1, size - CHARS + 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    padded = np.concatenate([code, np.zeros(CHARS, np.uint64)])
    value = np.zeros(len(code), np.uint64)
    for i in range(CHARS):
        value *= A
        value += padded[i: i + len(code)]
    # Positions where a shingle of the line starts; a short line has one, whose value is that of the whole line.
    value = value[np.repeat(start - first, count) + np.arange(count.sum())]
    for j in np.flatnonzero(size < CHARS):
        value[first[j]] = xxhash.xxh64_intdigest(texts[j].encode("utf-8", "surrogatepass"))
    return mix(value), first


def parity_bits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles of each line, and PARITY longs a line; each bit is the parity of the distinct shingles that fall
    on it. The xor of two lines' bits has at most as many ones as their sets differ in shingles, so it refutes links exactly."""
    value, first = shingle_values(texts)
    own = [np.unique(v) for v in np.split(value, first[1:])]
    n, width = np.array([len(v) for v in own]), 64 * PARITY
    spot = (np.concatenate(own) >> np.uint64(40)).astype(np.int64) % width + np.repeat(np.arange(len(own)) * width, n)
    odd = np.bincount(spot, minlength=len(own) * width) & 1
    return n, np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, PARITY)


def near_enough(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """False only for pairs that cannot reach the threshold.

    Slots that the shingles of one line take and those of the other do not stand for as many shingles that only one of
    them has, and a set has at most as many shingles as its line has places.
    """
    spot = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    value, first = shingle_values(list(spot))
    count = np.diff(first, append=len(value))
    taken = np.zeros((len(spot), SLOTS), bool)
    taken[np.repeat(np.arange(len(spot)), count), (value >> np.uint64(40)).astype(np.int64) % SLOTS] = True
    packed = np.packbits(taken, axis=1).view(np.uint64)
    i, j = (np.array([spot[x] for x in side]) for side in (a, b))
    apart = np.bitwise_count(packed[i] ^ packed[j]).sum(axis=1, dtype=np.int64)
    return apart <= (1 - threshold) / (1 + threshold) * (count[i] + count[j]) + 1e-6


def band_keys(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS) keys; lines with equal rows of a band's minima share its key."""
    value, first = shingle_values([x.decode("utf-8", "surrogatepass") for x in lines])
    value = (value >> np.uint64(32)).astype(np.uint32)
    minima, turned = np.empty((BANDS, ROWS, len(lines)), np.uint32), np.empty_like(value)
    for j in range(BANDS * ROWS):
        np.multiply(value, MULTIPLIERS[j], out=turned)
        turned += OFFSETS[j]
        np.minimum.reduceat(turned, first, out=minima[j // ROWS, j % ROWS])
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for r in range(ROWS):
        keys = mix(keys * A + minima[:, r])
    return keys.T.view(np.int64)


def _blocks(lines: list) -> Iterator[list]:
    out, n = [], 0
    for x in lines:
        out.append(x)
        n += len(x)
        if n >= BLOCK:
            yield out
            out, n = [], 0
    if out:
        yield out


def line_places(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, line_no, id) of every line that has a word, in a frame (doc_id, tkey, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [[(i, line_id(x)) for i, x in enumerate(normal_lines(t)) if x] for t in pdf["text"]]
            n = [len(x) for x in lines]
            flat = np.array([p for x in lines for p in x], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].repeat(n).to_numpy(), "tkey": pdf["tkey"].repeat(n).to_numpy(), "line_no": flat[:, 0], "id": flat[:, 1]})

    # Ids travel as text: pandas would turn integers with nulls into floats.
    kind = docs.schema["doc_id"].dataType
    out = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, tkey long, line_no int, id long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def line_bands(docs: DataFrame) -> DataFrame:
    """(bucket, id) of every line; a task signs a line that it meets again only once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        for pdf in batches:
            new: dict[int, bytes] = {}
            for text in pdf["text"]:
                for x in normal_lines(text):
                    if x and (i := line_id(x)) not in met:
                        met.add(i)
                        new[i] = x
            ids = np.fromiter(new, np.int64, len(new))
            done = 0
            for block in _blocks(list(new.values())):
                keys = band_keys(block)
                yield pd.DataFrame({"bucket": keys.ravel(), "id": np.repeat(ids[done: done + len(block)], BANDS)})
                done += len(block)

    return docs.select("text").mapInPandas(run, "bucket long, id long")


def wanted_lines(docs: DataFrame, sketch: bytes) -> DataFrame:
    """(id, line) of lines whose id is in the sketch, and of a few others; a task gives a line once."""
    last = len(sketch) * 8 - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                for x in normal_lines(text):
                    if x and sketch[((i := line_id(x)) & last) >> 3] >> (i & 7) & 1 and i not in met:
                        met.add(i)
                        out.append((i, x.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["id", "line"])

    return docs.select("text").mapInPandas(run, "id long, line string")


def line_signs(lines: DataFrame) -> DataFrame:
    """(id, n, b0, b1, ...) of lines (id, line); n is the number of shingles, the others are the parity bits."""
    names = [f"b{i}" for i in range(PARITY)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = 0
            for block in _blocks(pdf["line"].to_list()):
                n, bits = parity_bits(block)
                out = pd.DataFrame(bits, columns=names)
                out.insert(0, "id", pdf["id"].to_numpy()[done: done + len(block)])
                out.insert(1, "n", n)
                yield out
                done += len(block)

    return lines.select("id", "line").mapInPandas(run, ", ".join(["id long", "n int", *[f"{x} long" for x in names]]))


def similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, a_line, b_line) whose shingle sets reach the threshold, exactly.

    Most pairs are refuted by `near_enough`; sets are built for the others. A line mostly comes in several pairs in a
    row; the sets of CACHED_LINES lines are remembered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = lru_cache(CACHED_LINES)(shingle_set)
        for pdf in batches:
            keep, done = [], 0
            for block in _blocks(pdf["b_line"].to_list()):
                first = pdf["a_line"].iloc[done: done + len(block)].to_list()
                done += len(block)
                for x, y, near in zip(first, block, near_enough(first, block, threshold)):
                    both, all_of = 0, 1
                    if near:
                        s, t = shingles(x), shingles(y)
                        both = len(s & t)
                        all_of = len(s) + len(t) - both
                    keep.append(both >= threshold * all_of - 1e-9)
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def line_components(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, component) of lines that link with another line."""
    over = Window.partitionBy("bucket")
    bands = line_bands(docs).select("bucket", "id", F.min("id").over(over).alias("lo"), F.max("id").over(over).alias("hi"))
    # The smallest line of a bucket leads it.
    buckets = stage(bands.where("lo < hi").select("bucket", "id", "lo").distinct(), "bands")
    # Texts are read again where they lie: the sketch says which lines to send, so that no text is shuffled.
    lines = stage(wanted_lines(docs, id_sketch(buckets)).dropDuplicates(["id"]), "candidate-lines")

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda c: lines.select(F.col("id").alias(c), F.col("line").alias(f"{c}_line"))
        return similar(pairs.join(side("a"), "a").join(side("b"), "b"), threshold)

    def signed(rows: DataFrame) -> DataFrame:
        signs = line_signs(lines.join(rows.select("id").distinct(), "id", "left_semi"))
        return rows.join(signs, "id")

    # Literals are doubles (D): plain ones are decimals, which cost many times as much for each pair.
    apart = " + ".join(f"bit_count(x.b{i} ^ y.b{i})" for i in range(PARITY))
    may_link = f"least(x.n, y.n) >= {threshold}D * greatest(x.n, y.n) - 1e-6D and ({apart}) <= {(1 - threshold) / (1 + threshold)}D * (x.n + y.n) + 1e-6D"
    to_leader = buckets.where("lo <> id").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    return tried_components(buckets.select("bucket", "id"), to_leader, linked, may_link, signed, few_buckets=True)


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, the text without repeated lines, and n_lines, n_dropped (long).

    Lines are compared with A-Z lower-cased and blanks run together; they link from `threshold` on. Of each component
    (equal lines included) the occurrence first in (doc_id, text hash, line number) stays; a null id comes first. Lines
    without a word never drop. A null text stays null with no lines; a text may end up empty. Rows equal in id and text
    count as one and keep the same lines. Columns named n_lines or n_dropped are not overwritten: the counts then take
    the same names behind an underscore. An empty table gives no rows.
    """
    drops = free_name(docs.columns, "line_drops")
    n_lines, n_dropped = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_dropped")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    places = stage(line_places(source), "places")
    comps = line_components(source, threshold)
    place = F.struct("doc_id", "tkey", "line_no")
    # Only lines that occur twice or link with others can drop.
    first = places.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).join(comps, "id", "left").where("n > 1 or component is not null")
    first = stage(first.withColumn("component", F.coalesce("component", "id")), "first-lines")
    stays = first.groupBy("component").agg(F.min("first").alias("stays"))
    # A footer on a third of all documents is one id: the small side travels where it can, and no task gets all places of one.
    fate = places.join(small_side(stage(first.join(stays, "component").select("id", "stays"), "stays")), "id")
    # Texts stay where they lie: a chain of sketches says exactly, for every line of the documents, whether it goes.
    gone = stage(fate.where(~place.eqNullSafe(F.col("stays"))).select(F.xxhash64(F.xxhash64("doc_id", "tkey"), "line_no").alias("id")).distinct(), "gone")
    names = F.transform(F.array_repeat(F.xxhash64(doc_id, F.xxhash64(text)), F.size(F.split(text, "\n"))), lambda x, i: F.xxhash64(x, i))
    levels = chain(gone, docs.select(F.explode(names).alias("id")))

    def rebuild(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, names in batches:
            size = [0 if x is None else len(x) for x in names]
            flat = [x for x in names if x is not None and len(x)]
            lost = np.split(is_inside(np.concatenate(flat), levels) if flat else np.zeros(0, bool), np.cumsum(size)[:-1])
            n = [int(x.sum()) for x in lost]
            yield pd.DataFrame({
                "text": pd.Series(["\n".join(x for x, g in zip(t.split("\n"), gone) if not g) if k else None for t, gone, k in zip(texts, lost, n)], dtype=object),
                "n": np.array(n, np.int64),
            })

    # Texts that keep all lines do not come back from Python.
    counted = docs.withColumn(drops, F.pandas_udf(rebuild, "text string, n long")(text, names)).withColumns({
        n_lines: F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long"),
        n_dropped: F.col(f"{drops}.n"),
    })
    return counted.withColumn(text, F.when(F.col(n_dropped) > 0, F.col(f"{drops}.text")).otherwise(F.col(text))).select(*docs.columns, n_lines, n_dropped)
