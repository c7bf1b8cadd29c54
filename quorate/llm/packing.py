"""Best-fit packing of documents into bins under conflicts of source and duplicate cluster."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import stage

CAPACITY = 2048
# Pieces packed by one task. Tasks pack apart; the more pieces each has, the less room their last bins leave.
PIECES_PER_TASK = 40_000
# Conflict keys carried by at least this share of a task's pieces have counts of compatible bins per residual.
HOT_SHARE = 0.01
# Equal rows numbered at a time.
BLOCK = 10_000


class Bins:
    """Open bins of one task by residual, and within a residual by bitmap of the conflict keys they carry.

    Bins with equal residual and bitmap are interchangeable, so the search looks at bitmaps, not at bins. For hot keys
    it also knows how many bins of each residual lack the key, and steps over residuals that have none.
    """

    def __init__(self, capacity: int, hot: set[int]):
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.levels: list[int] = []  # residuals that have bins, sorted
        self.free = {bit: np.zeros(capacity + 1, np.int64) for bit in hot}
        self.count = 0

    def _count(self, residual: int, bitmap: int, by: int) -> None:
        for bit, lacking in self.free.items():
            if not bitmap >> bit & 1:
                lacking[residual] += by

    def put(self, residual: int, bitmap: int, bin_no: int) -> None:
        level = self.at[residual]
        if not level:
            insort(self.levels, residual)
        level.setdefault(bitmap, []).append(bin_no)
        self._count(residual, bitmap, 1)

    def take(self, size: int, bits: list[int]) -> tuple[int, int, int] | None:
        """(residual, bitmap, bin) of the tightest bin with room and none of the keys; the oldest such bitmap's last bin."""
        need = sum(1 << b for b in bits)
        hot = [self.free[b] for b in bits if b in self.free]
        i = bisect_left(self.levels, size)
        while i < len(self.levels):
            residual = self.levels[i]
            if hot and not all(f[residual] for f in hot):
                ahead = np.logical_and.reduce([f[residual:] > 0 for f in hot])
                step = int(ahead.argmax())
                if not ahead[step]:
                    return None
                i = bisect_left(self.levels, residual + step)
                continue
            level = self.at[residual]
            for bitmap, bins in level.items():
                if not bitmap & need:
                    bin_no = bins.pop()
                    if not bins:
                        del level[bitmap]
                        if not level:
                            del self.levels[i]
                    self._count(residual, bitmap, -1)
                    return residual, bitmap, bin_no
            i += 1
        return None


def best_fit(sizes: np.ndarray, keys: list[list[int]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, packed in the given order; keys[i] are the conflict keys of piece i (dense ints).

    A piece goes to the open bin with the least room that still takes it and carries none of its keys; the search runs
    up the residuals until one is found, and a new bin is opened only if there is none.
    """
    n_keys = 1 + max((k for ks in keys for k in ks), default=-1)
    uses = np.bincount([k for ks in keys for k in ks], minlength=n_keys) if n_keys else np.zeros(0)
    # A key used once can conflict with nothing and needs no bit.
    bit = {int(k): i for i, k in enumerate(np.flatnonzero(uses > 1))}
    hot = {bit[int(k)] for k in np.flatnonzero(uses > max(1, HOT_SHARE * len(sizes)))}
    bins, out, offset = Bins(capacity, hot), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        bits = [bit[k] for k in keys[i] if k in bit]
        found = bins.take(size, bits)
        if found is None:
            found = capacity, 0, bins.count
            bins.count += 1
        residual, bitmap, bin_no = found
        out[i], offset[i] = bin_no, capacity - residual
        for b in bits:
            bitmap |= 1 << b
        if residual > size:
            bins.put(residual - size, bitmap, bin_no)
    return out, offset


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, capacity: int = CAPACITY,
         pieces_per_task: int = PIECES_PER_TASK, doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: (doc_id, piece, n_pieces, start, size, bin_id, offset).

    A document longer than `capacity` is cut into full pieces, each a bin of its own, and a rest. Rests and short
    documents are packed: no bin holds two pieces of one source or of one duplicate cluster. Documents are dealt to
    tasks by a hash, equal rows by their number, so a hot source or row is spread evenly and a task's memory is bounded;
    the tightest bin is the tightest of one task. Within a task pieces come by
    falling size, then id (as text), cluster and source. bin_id names task and bin and is the same in every run.

    Null sizes count 0; documents of size 0 are one piece of size 0 and take no room, but keep to the conflicts. A
    null source or cluster conflicts with nothing. Null ids are kept; repeated rows are pieces of their own. An empty
    table gives no rows. Other columns are left out.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(size, F.lit(0)).cast("long").alias("total"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    kept = ["doc_id", "total", "source", "cluster"]
    counted = stage(rows.groupBy(*kept).agg(F.count(F.lit(1)).alias("n")), "pieces")
    n_tasks = max(1, -(-(counted.agg(F.sum("n")).first()[0] or 0) // pieces_per_task))
    # Equal rows are numbered, so that they are spread as others are; blocks keep the arrays short.
    blocks = counted.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK})")))
    rows = blocks.select(*kept, F.explode(F.expr(f"sequence(block * {BLOCK}, least(n, (block + 1) * {BLOCK}) - 1)")).alias("copy"))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)).cast("long")
    rest = F.when(F.col("total") > 0, (F.col("total") - 1) % capacity + 1).otherwise(0).cast("long")
    rows = rows.withColumns({"n_pieces": n_pieces, "rest": rest, "task": F.pmod(F.xxhash64(*kept, "copy"), F.lit(n_tasks)).cast("long")})
    # Ids travel as text: pandas would turn integers with nulls into floats.
    kind = rows.schema["doc_id"].dataType

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", "doc_id", "cluster", "source", "total"], ascending=[False, True, True, True, True], kind="stable")
        source_code, _ = pd.factorize(pdf["source"])
        cluster_code, _ = pd.factorize(pdf["cluster"])
        base = int(source_code.max(initial=-1)) + 1
        keys = [[k for k in (s, base + c if c >= 0 else -1) if k >= 0] for s, c in zip(source_code.tolist(), cluster_code.tolist())]
        bins, offset = best_fit(pdf["rest"].to_numpy(), keys, capacity)
        out = pdf[["doc_id", "total", "n_pieces", "rest"]].copy()
        out["bin"], out["offset"] = [f"{pdf['task'].iloc[0]}-{b}" for b in bins], offset
        return out

    named = rows.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("task")
    packed = named.applyInPandas(run, "doc_id string, total long, n_pieces long, rest long, bin string, offset long").withColumn("doc_id", F.col("doc_id").cast(kind))
    # Full pieces fill a bin each; the rest is the last piece.
    each = packed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)))
    last = F.col("piece") == F.col("n_pieces") - 1
    # Repeated rows are told apart by the place of their rest.
    return each.select(
        "doc_id", "piece", "n_pieces", (F.col("piece") * capacity).alias("start"),
        F.when(last, F.col("rest")).otherwise(capacity).cast("long").alias("size"),
        F.when(last, F.col("bin")).otherwise(F.concat_ws("-", "bin", "offset", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece")).alias("bin_id"),
        F.when(last, F.col("offset")).otherwise(0).cast("long").alias("offset"),
    )
