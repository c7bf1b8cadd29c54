"""Near-duplicate vectors by tiled comparison in PCA order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quorate.llm.common import small_side, stage
from quorate.llm.components import connected_components

THRESHOLD = 0.95
TILE = 2048
# Leading dimensions of the rotated vectors that order them by cells and bound a tile by a box; cells per reach.
BOX_DIMS, FINENESS = 8, 2
# A block is what meets other blocks as one row: at most so many bytes of vectors and so many tiles, and if the table
# allows it at least so many blocks.
BLOCK_BYTES, BLOCK_TILES, BLOCKS = 4 << 20, 16, 16
# The first comparison takes so many leading dimensions that two vectors differ there by this many times the reach, squared.
HEAD_GAP = 7.0
# Room for rounding in bounds, and in those that are calculated in single precision.
SLACK, SINGLE_SLACK = 1e-9, 1e-5
# Rows and columns whose bounds are calculated at a time; pairs whose products are calculated one by one, at a time.
PIECE, SOME_PAIRS = 512, 1 << 14


def usable(v: Column) -> Column:
    """Whether a vector can be compared: it is not null, empty or zero, and holds no null and no non-finite parts."""
    low, high, inf = F.array_min(v), F.array_max(v), float("inf")
    # NaN is above infinity; parts that are null have no order.
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()) & (high < inf) & (low > -inf) & ((high > 0) | (low < 0))


def keyed(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, key, v) of all rows; the key, 128 bits of the vector, is null where there is nothing to compare."""
    single = isinstance(vectors.schema[embedding].dataType.elementType, FloatType)
    v = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    key = F.struct(F.xxhash64(v).alias("p"), F.xxhash64(F.lit(1), v).alias("q"))
    return vectors.select(F.col(vec_id).alias("vec_id"), F.when(F.col(vec_id).isNotNull() & usable(v), key).alias("key"), v.alias("v"))


def _classes(fine: DataFrame, repeated: DataFrame) -> DataFrame:
    """Classes of equal vectors that can be compared: (rep, copies, v). Only first rows of vectors that repeat are gathered by key."""
    alone = lambda table: table.select(F.col("vec_id").cast("long").alias("rep"), F.lit(1).cast("long").alias("copies"), "v")
    if not repeated.head(1):
        return alone(fine)
    kept = stage(fine.join(small_side(repeated), "key", "left").where("copies is null or cast(vec_id as long) = rep"), "kept")
    firsts = kept.where("copies is not null").groupBy("key").agg(*[F.first(c).alias(c) for c in ("rep", "copies", "v")])
    return alone(kept.where("copies is null")).unionByName(firsts.drop("key"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaling by the largest entry first keeps tiny and huge vectors exact enough."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _turned(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit rows along the axes, some rows at a time, for the steps between are in double precision and of full width."""
    out = np.empty((len(x), axes.shape[1]))
    for k in range(0, len(x), TILE):
        np.matmul(_unit(x[k : k + TILE]), axes, out=out[k : k + TILE])
    return out


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def principal_axes(classes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes (columns) of all unit vectors of this dimension by falling second moment, and the variance along each.

    Both follow from sums made inside tasks.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim))
        n = 0
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch, dim))
                total[:dim] += x.T @ x
                total[dim] += x.sum(axis=0)
                n += len(x)
        sums = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(sums)), "m": sums})

    sums = classes.select("v").mapInArrow(moments, "i long, m double").groupBy("i").agg(F.sum("m").alias("m"))
    flat = sums.toPandas().sort_values("i")["m"].to_numpy()
    total = flat[:-1].reshape(dim + 1, dim) / max(1.0, flat[-1])
    axes = np.linalg.eigh((total[:dim] + total[:dim].T) / 2)[1][:, ::-1].copy()
    spread = np.einsum("ij,ik,kj->j", axes, total[:dim] - np.outer(total[dim], total[dim]), axes)
    return axes, np.maximum(spread, 0.0)


def _head_dims(spread: np.ndarray, reach: float, least: int) -> int:
    """Leading dimensions of the first comparison, in steps of 8."""
    gap = 2 * np.cumsum(spread)
    return int(min(len(spread), max(least, -(-(np.searchsorted(gap, HEAD_GAP * reach * reach) + 1) // 8) * 8)))


def _head(x: np.ndarray) -> np.ndarray:
    """Leading parts of rotated unit rows and, last, the length of the rest, in single precision.

    The product of two such rows is an upper bound of the product of the rows: what the rest adds is at most the product
    of the two lengths.
    """
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))
    return np.hstack([x, rest]).astype(np.float32)


def close_pairs(a: Callable[[np.ndarray], np.ndarray], b: Callable[[np.ndarray], np.ndarray], head_a: np.ndarray, head_b: np.ndarray,
                threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows and columns that link, and the boolean matrix of their links; None if there are none to tell.

    The heads refute pairs by their bound, in pieces that stay in the processor's cache. What is left is decided on the
    vectors themselves, which `a` and `b` give by row, in double precision and by the same sum wherever a product is near
    the threshold, so that no pair depends on how vectors are dealt.
    """
    floor = np.float32(threshold - SINGLE_SLACK - 1e-7 * head_a.shape[1])
    room, links = np.empty(PIECE * PIECE, np.float32), None
    for i in range(0, len(head_a), PIECE):
        x = head_a[i : i + PIECE]
        for j in range(0, len(head_b), PIECE):
            y = head_b[j : j + PIECE]
            bound = np.matmul(x, y.T, out=room[: len(x) * len(y)].reshape(len(x), len(y)))
            if bound.max() >= floor:
                if links is None:
                    links = np.zeros((len(head_a), len(head_b)), bool)
                links[i : i + PIECE, j : j + PIECE] = bound >= floor
    if links is None:
        return None
    rows, cols = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    links = links[np.ix_(rows, cols)]
    x, y = _unit(a(rows)), _unit(b(cols))
    if 16 * np.count_nonzero(links) > links.size:
        unsure = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for i in range(0, len(x), PIECE):
            product = x[i : i + PIECE] @ y.T
            links[i : i + PIECE] = product >= threshold
            product -= threshold
            at, c = np.nonzero(np.abs(product, out=product) < SLACK)
            unsure.append((at + i, c))
        r, c = (np.concatenate(side) for side in zip(*unsure))
    else:
        r, c = np.nonzero(links)
    for k in range(0, len(r), SOME_PAIRS):
        some = r[k : k + SOME_PAIRS], c[k : k + SOME_PAIRS]
        links[some] = np.einsum("ij,ij->i", x[some[0]], y[some[1]]) >= threshold
    return rows, cols, links


def _roots(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the component of each row and column of a matrix of links; -1 where there is no link."""
    root_a, root_b = np.full(links.shape[0], -1), np.full(links.shape[1], -1)
    for number, start in enumerate(np.flatnonzero(links.any(axis=1))):
        if root_a[start] >= 0:
            continue
        front = np.array([start])
        root_a[start] = number
        while len(front):
            new_cols = np.flatnonzero(links[front].any(axis=0) & (root_b < 0))
            root_b[new_cols] = number
            front = np.flatnonzero(links[:, new_cols].any(axis=1) & (root_a < 0))
            root_a[front] = number
    return root_a, root_b


class _Block:
    """Vectors that lie in a row of the blocks' table, with what their comparison needs."""

    def __init__(self, ids: bytes, copies: bytes, x: bytes, axes: np.ndarray, kind: type, tile: int):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.x = np.frombuffer(x, kind).reshape(len(self.ids), -1)
        turned = _turned(self.x, axes)
        self.head, self.box = _head(turned), turned[:, :BOX_DIMS].copy()
        self.starts = np.arange(0, len(self.ids), tile)
        self.lo, self.hi = np.minimum.reduceat(self.box, self.starts), np.maximum.reduceat(self.box, self.starts)
        self.ends = np.append(self.starts[1:], len(self.ids))

    def near(self, i: int, other: _Block, j: int, far: float) -> np.ndarray:
        """Places of the vectors of tile i that can reach the box of tile j of the other block."""
        box = self.box[self.starts[i] : self.ends[i]]
        gap = np.maximum(np.maximum(other.lo[j] - box, box - other.hi[j]), 0.0)
        return self.starts[i] + np.flatnonzero((gap * gap).sum(axis=1) <= far)


def _compare_blocks(a: _Block, b: _Block, same: bool, threshold: float, far: float) -> pd.DataFrame:
    """(id, n, root) of vectors of two blocks that link there: how often, and the smallest id they reach there."""
    # Places in a come first, those in b after them; in a block that meets itself both are one.
    shift = 0 if same else len(a.ids)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    n, nodes, comps, n_comps = np.zeros(len(ids), np.int64), [], [], 0
    gap = np.maximum(np.maximum(a.lo[:, None] - b.hi[None], b.lo[None] - a.hi[:, None]), 0.0)
    gap = (gap * gap).sum(axis=2)
    for i, j in zip(*np.nonzero(gap <= far)):
        if same and j < i:
            continue
        rows, cols = (a.near(i, b, j, far), b.near(j, a, i, far)) if gap[i, j] else (np.arange(a.starts[i], a.ends[i]), np.arange(b.starts[j], b.ends[j]))
        if not len(rows) or not len(cols):
            continue
        found = close_pairs(lambda at: a.x[rows[at]], lambda at: b.x[cols[at]], a.head[rows], b.head[cols], threshold)  # noqa: B023
        if found is None:
            continue
        rows, cols, links = rows[found[0]], cols[found[1]], found[2]
        if same and i == j:
            # A vector is no link of its own; rows and columns hold every pair twice, and the columns are not counted.
            links &= rows[:, None] != cols[None]
        else:
            n[cols + shift] += a.copies[rows] @ links
        n[rows] += links @ b.copies[cols]
        root_a, root_b = _roots(links)
        for at, root in ((rows, root_a), (cols + shift, root_b)):
            nodes.append(at[root >= 0])
            comps.append(root[root >= 0] + n_comps)
        n_comps += len(rows)
    if not nodes:
        return pd.DataFrame({"id": [], "n": [], "root": []}, dtype=np.int64)
    # Smallest id per component of the tile pairs, carried on through vectors that lie in several of them.
    node, comp, low = np.concatenate(nodes), np.concatenate(comps), ids.copy()
    while True:
        least = np.full(n_comps, np.iinfo(np.int64).max)
        np.minimum.at(least, comp, low[node])
        was = low.copy()
        np.minimum.at(low, node, least[comp])
        if (was == low).all():
            break
    at = np.unique(node)
    return pd.DataFrame({"id": ids[at], "n": n[at], "root": low[at]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept), links being pairs with cosine >= threshold > 0.

    Vectors are rotated to their principal axes and put in the order of cells along the leading ones; two vectors that link
    differ by at most sqrt(2 - 2 * threshold) along any axis. Runs of that order are tiles of bounded size, however hot
    a cell is, and runs of tiles are blocks, written once. Every two blocks meet in a task that reads both where they
    lie, so no vector is shuffled for a comparison. Blocks and tiles whose boxes in the leading axes are too far apart
    are not compared, nor vectors that are too far from the other tile's box. Two blocks yield a row per linked vector
    (its number of links and the smallest id it reaches there), never its pairs.

    Equal vectors are one class and count as many links as there are. Vectors that are null, empty, zero or hold null
    or non-finite parts link with nothing, nor do vectors of different length. A null id stays alone. Rows that repeat an
    id with an equal vector link with each other by number. An empty table gives no rows; extra columns are left out.
    """
    rows = keyed(vectors, vec_id, embedding)
    fine = rows.where("key is not null")
    of_key = fine.groupBy("key").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(F.size("v")).alias("dim"))
    keys = stage(of_key, "keys")
    repeated = keys.where("copies > 1").drop("dim")
    classes, found = _classes(fine, repeated), None
    for dim, n in keys.groupBy("dim").count().collect():
        part = _compare(classes.where(F.size("v") == dim), dim, n, threshold, tile)
        found = part if found is None else found.unionByName(part)
    ids = rows.select("vec_id", "key")
    if found is None:
        return ids.select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found, "near")
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    # Only classes with links or copies matter to the vectors; all others keep what they have.
    told = stage(counts.join(comps.withColumnRenamed("id", "rep"), "rep", "left"), "told")
    named = ids.join(small_side(repeated), "key", "left").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("key").isNotNull(), F.coalesce("rep", F.col("vec_id").cast("long"))).alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"),
    )
    out = named.join(small_side(told), "rep", "left").select(
        "vec_id",
        F.when(F.col("rep").isNotNull(), F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare(classes: DataFrame, dim: int, n: int, threshold: float, tile: int) -> DataFrame:
    """(id, n, root) per class and pair of blocks in which it has links; n is the number of classes."""
    axes, spread = principal_axes(classes, dim)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    far, n_box = reach * reach + SLACK, min(BOX_DIMS, dim)
    head_axes = axes[:, : _head_dims(spread, reach, n_box)]
    kind = np.float32 if isinstance(classes.schema["v"].dataType.elementType, FloatType) else np.float64
    width = np.dtype(kind).itemsize * dim
    tile = max(1, min(tile, BLOCK_BYTES // width))
    block = tile * max(1, min(BLOCK_TILES, BLOCK_BYTES // width // tile, n // (tile * BLOCKS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, dim)
            cells = np.floor(_turned(x, axes[:, :n_box]) * (FINENESS / reach)) + (1 << 15)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"),
                                              _binary(np.clip(cells, 0, (1 << 16) - 1).astype(">u2")), _binary(np.ascontiguousarray(x, dtype=kind))],
                                             names=["rep", "copies", "cell", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, n_held = [], 0
        for batch in batches:
            held.append(batch.select(["rep", "copies", "x"]))
            n_held += batch.num_rows
            # Up to two blocks wait, so that the last ones can be evened out.
            while n_held >= 2 * block:
                rest = pa.Table.from_batches(held).combine_chunks()
                yield packed(rest.slice(0, block), number)
                held, n_held, number = rest.slice(block).to_batches(), n_held - block, number + 1
        if n_held:
            rest = pa.Table.from_batches(held).combine_chunks()
            size = n_held if n_held <= block else -(-n_held // 2)
            for k in range(0, n_held, size):
                yield packed(rest.slice(k, size), number)
                number += 1

    def packed(rows: pa.Table, number: int) -> pa.RecordBatch:
        x = b"".join(v.as_buffer() for v in rows.column("x"))
        turned = _turned(np.frombuffer(x, kind).reshape(-1, dim), axes[:, :n_box])
        ids, copies = (rows.column(c).to_numpy().tobytes() for c in ("rep", "copies"))
        return pa.RecordBatch.from_pydict({
            "block": [number], "turn": [(number >> 32) + (number & 0xFFFFFFFF)], "lo": [turned.min(axis=0).tolist()], "hi": [turned.max(axis=0).tolist()],
            "ids": [ids], "copies": [copies], "x": [x],
        })

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                side = lambda p: _Block(*(batch.column(f"{p}_{c}")[r].as_buffer() for c in ("ids", "copies", "x")), head_axes, kind, tile)  # noqa: B023, E731
                number, other = batch.column("a_block")[r].as_py(), batch.column("b_block")[r].as_py()
                if number != last:
                    last, a = number, side("a")
                yield pa.RecordBatch.from_pandas(_compare_blocks(a, a if other == number else side("b"), other == number, threshold, far), preserve_index=False)

    placed = classes.mapInArrow(place, "rep long, copies long, cell binary, x binary")
    dealt = placed.repartitionByRange(max(1, -(-n // block)), "cell", "rep").sortWithinPartitions("cell", "rep")
    blocks = stage(dealt.mapInArrow(pack, "block long, turn long, lo array<double>, hi array<double>, ids binary, copies binary, x binary"), "blocks")
    side = lambda p: blocks.select(*[F.col(c).alias(f"{p}_{c}") for c in blocks.columns])
    # Of the two orders of a pair one counts, by turns, so that every task of the product has as much to do.
    once = "a_block = b_block or (a_block < b_block) = ((a_turn + b_turn) % 2 = 0)"
    gap = F.zip_with(
        F.zip_with("a_lo", "b_hi", lambda p, q: p - q), F.zip_with("b_lo", "a_hi", lambda p, q: p - q),
        lambda p, q: F.pow(F.greatest(p, q, F.lit(0.0)), F.lit(2.0)),
    )
    met = F.expr(once) & (F.aggregate(gap, F.lit(0.0), lambda s, g: s + g) <= far)
    work = side("a").join(side("b").hint("shuffle_replicate_nl"), met).drop("a_lo", "a_hi", "a_turn", "b_lo", "b_hi", "b_turn")
    return work.mapInArrow(compare, "id long, n long, root long")


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    width = x.shape[1] * x.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(x.tobytes())])
