"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.llm.common import stage, text_key

N_SHARDS = 24
# Items differenced in one task. Above it, tasks bundle their items first, and bundles are differenced in the next level.
ITEMS_PER_TASK = 50_000
# An item above 1 / (shards * LARGE) of all bytes is not bundled; there are at most shards * LARGE of those.
LARGE = 64
ROWS_PER_SLOT_BUCKET = 20_000


def combine(start: np.ndarray) -> np.ndarray:
    """k-way differencing of n partial partitions, given as rows of k falling sums; the shard of every slot, as (n, k).

    The two partial partitions with the largest spread are combined, the larger sums of one meeting the smaller sums of
    the other, until one is left. Memory is O(n * k).
    """
    n, k = start.shape
    if n == 0:
        return np.zeros((0, k), np.int32)
    sums = np.zeros((2 * n - 1, k), np.int64)
    sums[:n] = start - start[:, -1:]
    left, right = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)
    order = np.zeros((n - 1, k), np.int16)
    heap = [(-int(s), i) for i, s in enumerate(sums[:n, 0])]
    heapq.heapify(heap)
    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        perm = np.argsort(-both, kind="stable")
        both = both[perm]
        both -= both[-1]
        sums[node] = both
        left[node - n], right[node - n], order[node - n] = a, b, perm
        heapq.heappush(heap, (-int(both[0]), node))
    place = np.zeros((2 * n - 1, k), np.int16)
    place[-1] = np.arange(k)
    for node in range(2 * n - 2, n - 1, -1):
        at = np.empty(k, np.int16)
        at[order[node - n]] = place[node]
        place[left[node - n]] = at
        place[right[node - n]] = at[::-1]
    return place[:n].astype(np.int32)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Shard 0..k-1 of each item; every item starts as a partial partition (size, 0, ..., 0)."""
    start = np.zeros((len(sizes), k), np.int64)
    start[:, 0] = sizes
    return combine(start)[:, 0]


def _assign(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = np.zeros((len(pdf), k), np.int64)
        for i, sums in enumerate(pdf["sums"]):
            start[i, : len(sums)] = sums
        # By falling spread, then by item, whatever order the rows came in.
        by = sorted(range(len(pdf)), key=lambda i: (-(start[i, 0] - start[i, -1]), pdf["item"].iloc[i]))
        place = combine(start[by])
        lengths = [len(pdf["sums"].iloc[i]) for i in by]
        slots = np.concatenate([np.arange(n) for n in lengths])
        rows = np.repeat(np.arange(len(by)), lengths)
        return pd.DataFrame({
            "task": pdf["task"].iloc[0], "item": pdf["item"].iloc[by].repeat(lengths).to_numpy(), "slot": slots,
            "size": start[by][rows, slots], "part": place[rows, slots],
        })

    return run


def assign_items(items: DataFrame, n_shards: int = N_SHARDS, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """(item, shard) for a frame (item binary, size long) of unique, indivisible items.

    One task can difference `items_per_task` items. With more, each task combines its own items into one partial
    partition of n_shards sums, which the next level combines on with those of the other tasks, slot by slot, as
    differencing does with any two. Large items skip the first level, so that one item above a whole shard is still evened
    out by all the others, and so does an even share of the rest, half of what a task can take, which fills what the
    large ones leave uneven. The number of partial partitions falls by items_per_task with each level, so two or three
    levels serve any input.
    """
    total, n = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not items_per_task > n_shards:
        raise ValueError("items_per_task must exceed the number of shards")
    large = max(1, total // (n_shards * LARGE))
    schema = "task int, item binary, slot int, size long, part int"
    levels: list[DataFrame] = []
    current = items.select("item", F.array("size").alias("sums"))
    spread = F.get("sums", F.lit(0)) - F.coalesce(F.get("sums", F.lit(n_shards - 1)), F.lit(0)) if n_shards > 1 else F.lit(0)
    while n > items_per_task + n_shards * LARGE:
        tasks = -(-n // items_per_task)
        single = (F.size("sums") == 1) & (F.pmod(F.xxhash64(F.lit("single"), "item"), F.lit(1 << 30)) < int((1 << 30) * items_per_task / 2 / n))
        alone = ~(spread < large) | single
        small = current.where(~alone).withColumn("task", F.pmod(F.xxhash64("item"), F.lit(tasks)).cast("int"))
        bundled = stage(small.groupBy("task").applyInPandas(_assign(n_shards), schema), "bundles")
        name = F.concat(F.encode(F.lit(f"bundle {len(levels)} "), "UTF-8"), F.encode(F.col("task").cast("string"), "UTF-8"))
        sums = bundled.groupBy("task", "part").agg(F.sum("size").alias("size"))
        # The sums of a task, falling: at most n_shards in a list.
        lists = sums.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("size", "part")), asc=False).alias("s"))
        partial = stage(lists.select(name.alias("item"), "task", "s.size", "s.part"), "partials")
        slots = partial.select("task", F.col("item").alias("bundle"), F.posexplode("part").alias("bundle_slot", "part"))
        levels.append(stage(bundled.join(slots, ["task", "part"]).select("item", "slot", "bundle", "bundle_slot"), "level"))
        current = stage(current.where(alone).unionByName(partial.select("item", F.col("size").alias("sums"))), "items")
        n = current.count()
    last = current.select(F.lit(0).alias("task"), "item", "sums").groupBy("task").applyInPandas(_assign(n_shards), schema)
    placed = stage(last.select("item", "slot", F.col("part").alias("shard")), "placed")
    for level in reversed(levels):
        top = placed.select(F.col("item").alias("bundle"), F.col("slot").alias("bundle_slot"), "shard")
        inner = level.join(top, ["bundle", "bundle_slot"]).select("item", "slot", "shard")
        placed = stage(placed.unionByName(inner), "placed")
    return placed.where("slot = 0").select("item", "shard")


def shard(docs: DataFrame, size: Column, group: Column, n_shards: int = N_SHARDS, doc_id: str = "doc_id",
          text: str = "text", items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, shard, slot), groups kept together, bytes near equal.

    `group` is a binary key; documents with the same key share a shard, and null is a group as well. A group larger
    than an even share fills its shard alone; the others stay even among themselves. slot numbers the rows of a shard
    from 0 without gaps, in the order of hash ranges of the id, then id. Null ids and null texts are kept (crc null);
    repeated rows get a slot each; no rows, no result. Other columns are left out, so their names cannot clash.
    """
    rows = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"), size.cast("long").alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
            F.coalesce(group, F.lit(bytearray())).alias("item"),
        ),
        "sizes",
    )
    placed = assign_items(rows.groupBy("item").agg(F.sum("size").alias("size")), n_shards, items_per_task)
    n_buckets = max(1, -(-rows.count() // (n_shards * ROWS_PER_SLOT_BUCKET)))
    known = rows.join(placed, "item").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int"))
    known = stage(known.drop("item"), "sharded")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = known.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    slot = (F.row_number().over(inside) - 1).cast("long")
    return (
        known.withColumn("at", slot).join(starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).alias("slot"))
    )


def shard_texts(docs: DataFrame, n_shards: int = N_SHARDS, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """`shard` with equal texts as groups and UTF-8 bytes plus 8 as size."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 8
    return shard(docs, size, text_key(F.col(text)), n_shards, doc_id, text, **more)
