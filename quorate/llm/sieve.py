"""Sets of 64-bit ids told apart in place: bit sketches, and chains of them that are exact for a known table of ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import stage

# Bits of a sketch, at most: 16 MB.
SKETCH_BITS = 1 << 27
# The chain ends with a list of at most so many ids.
LISTED = 10_000
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def turned(ids: np.ndarray, level: int) -> np.ndarray:
    """The ids (longs) hashed anew for a level of a chain."""
    return mix(ids.view(np.uint64) + np.uint64((level + 1) * int(A) % (1 << 64))).view(np.int64)


def id_sketch(rows: DataFrame, level: int | None = None) -> bytes:
    """Bits at the low bits of the ids, `turned` for the level, of a written table; tasks make the bitmaps, and at most
    SKETCH_BITS reach the driver."""
    bits = min(SKETCH_BITS, max(1 << 15, 1 << (8 * rows.count()).bit_length()))
    ids = F.col("id") if level is None else F.pandas_udf(lambda x: pd.Series(turned(x.to_numpy(), level)), "long")("id")
    place = ids.bitwiseAND(F.lit(bits - 1)) + 1
    placed = rows.select(place.alias("place"))
    parts = placed.groupBy(F.bitmap_bucket_number("place").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = bytearray(bits // 8)
    for r in parts.collect():
        out[(r["k"] - 1) * 4096: r["k"] * 4096] = r["bits"]
    return bytes(out)


def in_sketch(ids: np.ndarray, sketch: bytes, level: int) -> np.ndarray:
    spot = turned(ids, level) & (len(sketch) * 8 - 1)
    return (np.frombuffer(sketch, np.uint8)[spot >> 3] >> (spot & 7) & 1).astype(bool)


def chain(inside: DataFrame, universe: DataFrame) -> list[bytes | np.ndarray]:
    """Sketches and a last list that tell the ids `inside`, a written table, from the others of `universe`, exactly.

    Each sketch holds the ids that the one before takes in wrongly, so they get smaller fast.
    """
    levels: list[bytes | np.ndarray] = []
    while inside.count() > LISTED:
        sketch, level = id_sketch(inside, len(levels)), len(levels)

        def run(batches: Iterator[pd.DataFrame], sketch=sketch, level=level) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[in_sketch(pdf["id"].to_numpy(), sketch, level)]

        levels.append(sketch)
        wrong = universe.select("id").mapInPandas(run, "id long").join(inside, "id", "left_anti").distinct()
        inside, universe = stage(wrong, "sieved"), inside
    levels.append(np.array([r["id"] for r in inside.collect()], np.int64))
    return levels


def is_inside(ids: np.ndarray, levels: list[bytes | np.ndarray]) -> np.ndarray:
    """Which ids of the universe the chain was made for."""
    out, open_ = np.zeros(len(ids), bool), np.arange(len(ids))
    for level, held in enumerate(levels):
        hit = np.isin(ids[open_], held) if isinstance(held, np.ndarray) else in_sketch(ids[open_], held, level)
        # An id that the last level takes in belongs to it; one that a level does not hold belongs to the level before.
        out[open_[~hit]] = level % 2 == 1
        open_ = open_[hit]
        if level == len(levels) - 1:
            out[open_] = level % 2 == 0
    return out
