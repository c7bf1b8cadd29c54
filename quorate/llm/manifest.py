"""Merkle manifest of a dataset: a postorder append log written by aligned builders, and proofs read from it by position."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.llm.common import small_side, stage

FAN = 16
# A builder owns an aligned run of FAN ** LEVELS nodes and writes the subtree above them. The log of a tree is one
# segment per builder; the tops of the segments are the leaves of the next round.
LEVELS = 3
SEGMENT = FAN**LEVELS
# Rows that are ordered in one task; the number of ranges follows the number of rows.
ROWS_PER_RANGE = 20_000
DIGEST = 32


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves: nodes are joined FAN by FAN while there are several."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def position(level: int, index: np.ndarray | int, n: int) -> np.ndarray | int:
    """Place in the postorder log of node `index` of `level` in a tree of n leaves.

    Every complete subtree of 16^k leaves takes (16^(k+1) - 1) / 15 places, so a leaf comes after as many inner nodes as
    there are complete runs before it, and an inner node right after the levels below that end with its last leaf.
    """
    last = np.minimum((index + 1) * FAN**level, n) - 1
    out, run = last + level, last // FAN
    for _ in range(height(n)):
        out, run = out + run, run // FAN
    return out


def log_size(n: int) -> int:
    """Number of nodes of a tree of n leaves."""
    return int(position(height(n), 0, n)) + 1 if n else 0


def write_log(leaves: list[bytes]) -> bytes:
    """The nodes over some leaves in completion order: a node is appended as soon as its last child is.

    Open runs are a stack of at most `height` lists, so a builder holds little besides its log.
    """
    top = height(len(leaves))
    open_runs: list[list[bytes]] = [[] for _ in range(top + 1)]
    out = bytearray()
    for i, leaf in enumerate(leaves):
        last = i == len(leaves) - 1
        level, node = 0, leaf
        while True:
            out += node
            open_runs[level].append(node)
            if level == top or not (len(open_runs[level]) == FAN or last):
                break
            node = hash_nodes(open_runs[level])
            open_runs[level] = []
            level += 1
    return bytes(out)


def hash_nodes(nodes: list[bytes]) -> bytes:
    """sha256 of the digests as lowercase hex text, one after the other."""
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def proof_at(log: bytes, index: int, n: int) -> list[tuple[str, str]]:
    """Per level, from the leaf up, the siblings left and right of the path as hex text, read from the log by position."""
    out, level = [], 0
    count = n
    while count > 1:
        run = index // FAN
        nodes = np.arange(run * FAN, min((run + 1) * FAN, count))
        at = position(level, nodes, n) * DIGEST
        hexed = [log[p: p + DIGEST].hex() for p in at.tolist()]
        mine = index - run * FAN
        out.append(("".join(hexed[:mine]), "".join(hexed[mine + 1:])))
        index, count, level = run, -(-count // FAN), level + 1
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf (hex text) and its siblings lead to."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def field(value: Column) -> Column:
    """Byte count, colon and value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*columns: Column) -> Column:
    """32-byte digest of a row by its fields, in the order given."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def tree_name(key: Column) -> Column:
    """Null-free name of a tree that sorts like its key with null first."""
    return F.coalesce(F.concat(F.lit("+"), key.cast("string")), F.lit(""))


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """The rows with `idx` (long, from 0 in each tree, in the given order) and `n` (rows of the tree).

    Rows are cut into ranges of tree and order, so a tree with a third of all rows spreads over many tasks; counts per
    range place them. Rows equal in everything are interchangeable and are spread by a random last key.
    """
    n_ranges = max(1, -(-rows.count() // ROWS_PER_RANGE))
    cut = rows.repartitionByRange(n_ranges, F.col(tree), *order, F.rand(7)).withColumn("range", F.spark_partition_id())
    cut = stage(cut, "ranges")
    before = Window.partitionBy(tree).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(tree, "range").agg(F.count(F.lit(1)).alias("rows"))
    starts = sizes.select(tree, "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy(tree)).alias("n"))
    inside = Window.partitionBy("range", tree).orderBy(*order)
    return cut.withColumn("at", F.row_number().over(inside) - 1).join(small_side(starts), [tree, "range"]).withColumn("idx", F.col("start") + F.col("at")).drop("range", "at", "start")


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("idx")
    log = write_log(pdf["digest"].tolist())
    return pd.DataFrame([{"tree": key[0], "segment": key[1], "leaves": len(pdf), "n": int(pdf["n"].iloc[0]), "log": log, "top": log[-DIGEST:]}])


def build(leaves: DataFrame) -> list[DataFrame]:
    """The log of every tree over leaves (tree, idx, n, digest): per round a written table
    (tree, segment, leaves, n, log, top), segment k holding leaves k * SEGMENT and on in postorder.

    A segment is at most SEGMENT leaves in one task. Its top is leaf k of the next round; rounds end when every tree has
    one segment, whose top is the root of the tree. Each round has SEGMENT times fewer rows. Over the places inside
    a round `position` holds as it stands, for a round is a tree whose leaves are the tops below.
    """
    rounds: list[DataFrame] = []
    current = leaves.select("tree", "idx", "n", "digest")
    while True:
        placed = current.select("tree", F.floor(F.col("idx") / SEGMENT).alias("segment"), "idx", "n", "digest")
        built = placed.groupBy("tree", "segment").applyInPandas(_build, "tree string, segment long, leaves int, n long, log binary, top binary")
        rounds.append(stage(built, f"log-{len(rounds)}"))
        most = rounds[-1].agg(F.max("n")).first()[0]
        if most is None or most <= SEGMENT:
            return rounds
        current = rounds[-1].select("tree", F.col("segment").alias("idx"), F.ceil(F.col("n") / SEGMENT).alias("n"), F.col("top").alias("digest"))


PATH = "path array<struct<left:string,right:string>>"


def _paths(rows: pd.DataFrame, log: bytes, upper: list, n: int) -> list[list[tuple[str, str]]]:
    return [proof_at(log, i, n) + upper for i in (rows["idx"] % SEGMENT).tolist()]


def _tuples(path) -> list[tuple[str, str]]:
    return [(p["left"], p["right"]) for p in path]


def _extract(key: tuple, pdf: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
    """Paths of all leaves of one segment; the path above it is the same for all of them."""
    if pdf.empty or segment.empty:
        return pd.DataFrame({"tree": [], "idx": [], "path": []})
    s = segment.iloc[0]
    paths = _paths(pdf, s["log"], _tuples(s["path"]), int(s["leaves"]))
    return pd.DataFrame({"tree": pdf["tree"], "idx": pdf["idx"], "path": [[{"left": a, "right": b} for a, b in p] for p in paths]})


def segment_paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Segments of the first round with the path from their top to the root; `tops` has (tree, path) above the trees."""
    above = rounds[-1].join(small_side(tops), "tree")
    for lower in reversed(rounds[:-1]):
        leaves = lower.select("tree", F.col("segment").alias("idx"), F.floor(F.col("segment") / SEGMENT).alias("segment"))
        paths = leaves.groupBy("tree", "segment").cogroup(above.groupBy("tree", "segment")).applyInPandas(_extract, f"tree string, idx long, {PATH}")
        above = stage(lower.join(paths.withColumnRenamed("idx", "segment"), ["tree", "segment"]), "paths")
    return above


def _verify(key: tuple, pdf: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
    """Per leaf the hash of its siblings and the root its (perhaps changed) digest folds to."""
    names = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"]
    if pdf.empty or segment.empty:
        return pd.DataFrame({c: [] for c in names}, dtype=object)
    s = segment.iloc[0]
    out = []
    for doc_id, digest, seen, path in zip(pdf["doc_id"], pdf["digest"], pdf["seen"], _paths(pdf, s["log"], _tuples(s["path"]), int(s["leaves"]))):
        proof = hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest()
        out.append((doc_id, digest.hex(), s["subroot"].hex(), proof, fold(seen.hex(), path)))
    return pd.DataFrame(out, columns=names)


def manifest(rows: DataFrame, key: str) -> tuple[DataFrame, list[DataFrame], list[DataFrame], str | None]:
    """Numbered leaves, the rounds of the trees, the rounds of the tree over their roots, and the root (None for no rows).

    `rows` has (doc_id, digest, further columns) and the tree key. Leaves ascend by doc_id, null first; of equal ids the
    smaller digest comes first. Trees are ordered by key, null first, in UTF-8 order.
    """
    leaves = rows.withColumn("tree", tree_name(F.col(key)))
    leaves = stage(numbered(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")]), "leaves")
    rounds = build(leaves)
    roots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    named = stage(numbered(roots, "tree", [F.col("name")]), "roots")
    over = build(named)
    top = over[-1].select("top").first()
    return leaves, rounds, [named, *over], None if top is None else top["top"].hex()


def audit(docs: DataFrame, columns: tuple[str, ...], key: str, changed: dict[str, Column], tampered: Column, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row.

    A leaf is the digest of `columns`, in that order. Where `tampered` holds, the columns in `changed` take the given
    values before the leaf is hashed again; `verified` says whether that leaf and the siblings of the original log still
    fold to the root. Proofs are never stored: siblings are read from the log by position.

    Null fields have a form of their own, an empty text is not a null one. Null ids come first in their tree, repeated
    rows are leaves of their own, a tree of one row is its own root, and a dataset of one tree has that tree's root. No
    rows, no result. Other columns are not read; texts are hashed where they lie and only digests move.
    """
    as_is = row_digest(*[F.col(c) for c in columns])
    after = row_digest(*[changed.get(c, F.col(c)) for c in columns])
    # Ids travel as text: pandas would turn integers with nulls into floats. They are ordered before that.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(key).alias("key"), as_is.alias("digest"), F.when(tampered, after).alias("after"))
    kind = rows.schema["doc_id"].dataType
    leaves, rounds, (named, *over), root = manifest(rows, "key")
    none_above = over[-1].select("tree", F.array().cast(PATH.split(" ", 1)[1]).alias("path"))
    top_paths = segment_paths(over, none_above)
    placed = named.select("tree", F.floor(F.col("idx") / SEGMENT).alias("segment"), "idx")
    above = placed.groupBy("tree", "segment").cogroup(top_paths.groupBy("tree", "segment")).applyInPandas(_extract, f"tree string, idx long, {PATH}")
    tops = stage(named.join(above, ["tree", "idx"]).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot")), "tops")
    segments = segment_paths(rounds, tops.select("tree", "path")).join(small_side(tops.select("tree", "subroot")), "tree")
    wanted = leaves.select("tree", F.floor(F.col("idx") / SEGMENT).alias("segment"), "idx", F.col("doc_id").cast("string").alias("doc_id"), "digest", F.coalesce("after", "digest").alias("seen"))
    checked = wanted.groupBy("tree", "segment").cogroup(segments.groupBy("tree", "segment")).applyInPandas(
        _verify, "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    return checked.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )
