"""Jaccard self-join of word-shingle sets: subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.llm.common import free_name, small_side, stage
from quorate.llm.components import tried_components

# Sets up to this size may be enumerated; where the boundary lies below it is decided by counted costs.
LIGHT_MAX = 40
# Counters of the sketch that orders shingles by frequency. Any order gives the same links; a better one, shorter lists.
SKETCH_BITS = 22
# A shingle counted this often has its list dealt over several tasks.
HOT_COUNT, HOT_PARTS = 10_000, 64
# Taken off the weight of sets that may be enumerated; more than any count.
LESS = 1 << 32
# 64-bit words of the parity bits of a set.
PARITY = 8
CACHED_WORDS = 200_000
# Texts whose shingle sets a task remembers while it compares pairs.
CACHED_SETS = 64

A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@dataclass(frozen=True)
class Join:
    """Shingles of `words` words; sets link when den * intersection >= num * union."""

    words: int = 3
    num: int = 90
    den: int = 100

    def overlap(self, a: int, b: int) -> int:
        """Smallest intersection with which sets of these sizes link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def least_size(self, n: int) -> int:
        """Smallest partner of a set of n."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        """So many first shingles in the common order meet every partner's prefix."""
        return n - self.least_size(n) + 1

    def subsets(self, n: int) -> int:
        """Subsets that a set of n enumerates, over all sizes of partners."""
        return sum(comb(n, self.overlap(n, m)) for m in self.partners(n))

    def partners(self, n: int) -> range:
        return range(self.least_size(n), self.den * n // self.num + 1)

    def links(self, inter: Column, a: Column, b: Column) -> Column:
        return (self.num + self.den) * inter >= self.num * (a + b)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit names of the shingles of a whole text; A-Z are lower-cased. `seen` caches word hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(seen) > CACHED_WORDS:
        seen.clear()
    for w in set(words).difference(seen):
        seen[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * A + h[i: len(h) - width + 1 + i])
    return np.unique(out)


def set_name(tokens: np.ndarray) -> int:
    """64-bit name of a set, by its content."""
    return int(mix(mix(tokens + A).sum(dtype=np.uint64)[None] + np.uint64(len(tokens))).view(np.int64)[0])


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """PARITY longs; each bit is the parity of the shingles that fall on it.

    The xor of two sets' bits has at most as many ones as the sets differ in shingles, so it refutes links exactly.
    """
    spot = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(spot.astype(np.uint8)).view(np.int64)


def describe_sets(docs: DataFrame, join: Join) -> DataFrame:
    """Rows (row: doc_id, n, sid, tkey, tokens if small, bits) and, in the same pass, rows (chunk, counts) of a sketch.

    The sketch counts shingles by the leading bits of their names; each task sends its counters once, in packed chunks.
    """
    k, size, chunks = join.words, 1 << SKETCH_BITS, 64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        total = np.zeros(size, np.int32)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                t = shingles(text, k, seen)
                n = len(t)
                np.add.at(total, (t >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                out.append((n, set_name(t) if n else None, t.view(np.int64).tolist() if 0 < n <= LIGHT_MAX else None, parity_bits(t) if n else None))
            n, sid, tokens, bits = zip(*out) if out else ((), (), (), ())
            rows = pd.DataFrame({"n": n, "sid": pd.array(sid, "Int64"), "tokens": pd.Series(tokens, dtype=object), "bits": pd.Series(bits, dtype=object)})
            yield rows.assign(doc_id=pdf["doc_id"], tkey=pdf["tkey"], chunk=None, counts=None)[["doc_id", "tkey", "n", "sid", "tokens", "bits", "chunk", "counts"]]
        if total.any():
            parts = total.reshape(chunks, -1)
            yield pd.DataFrame({"doc_id": None, "tkey": None, "n": None, "sid": None, "tokens": None, "bits": None, "chunk": range(chunks), "counts": [pack_counts(p) for p in parts]})

    # Ids travel as text: pandas would turn integers with nulls into floats.
    kind = docs.schema["doc_id"].dataType
    out = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, tkey long, n long, sid long, tokens array<long>, bits array<long>, chunk int, counts binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def pack_counts(counts: np.ndarray) -> bytes:
    """Counters byte by byte, so that the high bytes, mostly zeros, lie together."""
    return zlib.compress(counts.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def read_sketch(described: DataFrame) -> np.ndarray:
    """The summed sketch, a fixed number of counters whatever the input."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for chunk, packed in zip(pdf["chunk"], pdf["counts"]):
                total[chunk] = total.get(chunk, 0) + unpack_counts(packed).astype(np.int64)
        out = [(c, pack_counts(x.clip(max=2**31 - 1))) for c, x in total.items()]
        yield pd.DataFrame(out, columns=["chunk", "counts"])

    chunks = described.where("chunk is not null").select("chunk", "counts").repartition("chunk")
    out = np.zeros((64, (1 << SKETCH_BITS) // 64), np.int32)
    for r in chunks.mapInPandas(add, "chunk int, counts binary").collect():
        out[r["chunk"]] = unpack_counts(r["counts"])
    return out.ravel()


def inverted_entries(texts: DataFrame, join: Join, sketch: np.ndarray) -> DataFrame:
    """(bucket, id, n, pos, weight, hot): the prefix of every set, rarest shingles first.

    weight is the count of the rarest shingle: sets that consist of common shingles only are the centres of their group. Sets
    that may be enumerated instead weigh less than all others.
    A task names a set that it meets again only once.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        seen: dict[bytes, int] = {}
        met: set[int] = set()
        for pdf in batches:
            got: list[tuple] = []
            for text in pdf["text"]:
                t = shingles(text, join.words, seen)
                if not len(t) or (sid := set_name(t)) in met:
                    continue
                met.add(sid)
                c = counts[(t >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                p = join.prefix(len(t))
                first = np.lexsort((t, c))[:p]
                got.append((t[first].view(np.int64), np.full(p, sid), np.full(p, len(t)), np.arange(p), np.full(p, int(c[first[0]]) - (LESS if len(t) <= LIGHT_MAX else 0), np.int64), c[first] >= HOT_COUNT))
                if len(got) == 500:
                    yield pd.DataFrame(dict(zip(("bucket", "id", "n", "pos", "weight", "hot"), map(np.concatenate, zip(*got)))))
                    got = []
            if got:
                yield pd.DataFrame(dict(zip(("bucket", "id", "n", "pos", "weight", "hot"), map(np.concatenate, zip(*got)))))

    return texts.select("text").mapInPandas(run, "bucket long, id long, n int, pos int, weight long, hot boolean")


def light_boundary(join: Join, sets: dict[int, int], scanned: dict[int, int]) -> int:
    """Size up to which sets are enumerated: where subsets below plus list entries read above cost least."""
    best, best_cost, light = 0, sum(scanned.values()), 0
    heavy = best_cost
    for n in range(1, LIGHT_MAX + 1):
        light += sets.get(n, 0) * join.subsets(n)
        heavy -= scanned.get(n, 0)
        if light + heavy < best_cost:
            best, best_cost = n, light + heavy
    return best


def subset_links(small: DataFrame, join: Join, boundary: int) -> DataFrame:
    """Links (a, b) among sets (sid, n, tokens) of at most `boundary` shingles.

    For each pair of sizes a set sends all its subsets of the size their intersection must have. Sets that share one
    link, if a set of the smaller size is among them; the smallest such set is linked with all others of the subset.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sid, n, tokens in zip(pdf["sid"], pdf["n"], pdf["tokens"]):
                t = mix(np.asarray(tokens, np.int64).view(np.uint64) + B)
                whole = t.sum(dtype=np.uint64)
                for m in join.partners(n):
                    gone = n - join.overlap(n, m)
                    if m > boundary or gone < 0:
                        continue
                    out = np.array(list(combinations(range(n), gone)), np.int64).reshape(comb(n, gone), gone)
                    names = whole - t[out].sum(axis=1, dtype=np.uint64)
                    yield pd.DataFrame({"lo": min(n, m), "hi": max(n, m), "name": names.view(np.int64), "id": sid, "n": n})

    rows = small.mapInPandas(run, "lo int, hi int, name long, id long, n int")
    rows = rows.groupBy("lo", "hi", "name", "id").agg(F.first("n").alias("n"))
    lead = rows.where("n = lo").groupBy("lo", "hi", "name").agg(F.min("id").alias("a"))
    return rows.join(lead, ["lo", "hi", "name"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()


def jaccard_components(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, set_id).

    Documents with equal sets are one class and are compared once; set_id names the class (64 bits of its content, so
    two different sets share a name with odds of classes^2 / 2^65). component_id is the smallest doc_id reachable by
    links. No link between different sets is lost: every pair that can link meets in a subset or an inverted list, and
    is compared exactly unless both ends are connected already.

    Null and empty texts and texts without words have an empty set, link with nothing and keep their own id. Null ids
    are kept and never chosen as the smallest unless the component has no other. Repeated rows stay and fall in one
    class. An empty table gives no rows; extra columns are left out.
    """
    sets, comps = _components(docs, join, doc_id, text)
    # Classes first: a class of copies, however large, is one row until the last join.
    classes = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = classes.join(comps.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(least, "component").select("sid", "component_id")
    return sets.join(told, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("sid").alias("set_id"),
    )


def _components(docs: DataFrame, join: Join, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their sets, and (id, component) of sets that link with another."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tkey"))
    described = stage(describe_sets(rows, join), "sets")
    sets = described.where("chunk is null").select("doc_id", "tkey", "n", "sid", "tokens", "bits")
    return sets, _linked_sets(rows, sets, read_sketch(described), join)


def keep_one(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their columns, of which one stays for each group of linked or equal sets.

    The smallest (doc_id, text hash) of a group stays, a null id being the smallest; of rows equal in both, one. Texts
    without words are in no group and all stay. An empty table gives no rows.
    """
    sets, comps = _components(docs, join, doc_id, text)
    first = F.min(F.struct("doc_id", "tkey")).alias("first")
    classes = sets.where("sid is not null").groupBy("sid").agg(first)
    named = classes.join(comps.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    stays = named.groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    key, row, ours = (free_name(docs.columns, c) for c in ("keep_tkey", "keep_row", "keep_ours"))
    # Of rows equal in id and text the one with the smallest hash of all columns; narrow rows find it.
    hashed = docs.withColumns({key: F.xxhash64(text), row: F.xxhash64(*docs.columns)})
    one = hashed.where(F.col(key).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"), F.col(key).alias("tkey")).agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("n"))
    wanted = stays.join(one, stays["doc_id"].eqNullSafe(one["doc_id"]) & (stays["tkey"] == one["tkey"])).select(stays["doc_id"], stays["tkey"], "row", "n")
    wanted = stage(wanted, "keep")
    rows = hashed.alias("d").join(
        small_side(wanted).alias("s"),
        F.col(f"d.{doc_id}").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.{key}") == F.col("s.tkey")) & (F.col(f"d.{row}") == F.col("s.row")), "left",
    ).select("d.*", F.col("s.n").alias(ours))
    wordless = ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    single = rows.where(wordless | (F.col(ours) == 1)).select(*docs.columns)
    # Rows equal in all columns cannot be told apart: one of them is kept by a plain distinct.
    again = rows.where(~wordless & (F.col(ours) > 1)).select(*docs.columns).dropDuplicates()
    return single.unionByName(again)


def _linked_sets(rows: DataFrame, sets: DataFrame, sketch: np.ndarray, join: Join) -> DataFrame:
    entries = inverted_entries(rows, join, sketch)
    # Lists of one set say nothing. Hot lists are dealt over tasks and kept as they are.
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(HOT_PARTS))).otherwise(0)
    # The leader of a list has the largest weight. Plain columns order the window, so that none but these are shuffled.
    over = Window.partitionBy("bucket", part).orderBy(F.desc("weight"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = [F.first(c).over(over).alias(f"lead_{c}") for c in ("weight", "id", "n", "pos")]
    lists = entries.select("*", F.min("id").over(over).alias("lo"), F.max("id").over(over).alias("hi"), F.count(F.lit(1)).over(over).alias("read"), *first)
    lead = F.struct((-F.col("lead_weight")).alias("w"), F.col("lead_id").alias("id"), F.col("lead_n").alias("n"), F.col("lead_pos").alias("pos"))
    shared = stage(lists.where("hot or lo < hi").select("bucket", "id", "n", "pos", "hot", "read", lead.alias("lead")), "lists")
    cost = {r["n"]: r["read"] for r in shared.where(F.col("n") <= LIGHT_MAX).groupBy("n").agg(F.sum("read").alias("read")).collect()}
    small = sets.where(F.col("tokens").isNotNull()).groupBy("sid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    count = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    light = light_boundary(join, count, cost)
    # One text stands for each class. The parity bits go with the rows of open buckets, so that pairs which cannot link are
    # refuted where lists are joined and never become rows.
    chosen = sets.where("sid is not null").groupBy("sid").agg(F.min("tkey").alias("tkey"), F.first("bits").alias("bits"))
    chosen = stage(chosen.select("sid", "tkey", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(PARITY)]), "classes")
    buckets = shared.where(F.col("n") >= join.least_size(light + 1))
    reach = "least(x.pos, y.pos) + least(x.n - x.pos, y.n - y.pos)"
    apart = " + ".join(f"bit_count(x.b{i} ^ y.b{i})" for i in range(PARITY))
    fits = f"greatest(x.n, y.n) > {light} and {join.num + join.den} * ({reach}) >= {join.num} * (x.n + y.n)"
    alike = f"{join.num + join.den} * ({apart}) <= {join.den - join.num} * (x.n + y.n)"
    signs = chosen.drop("tkey").withColumnRenamed("sid", "id")

    # The leader's place came with the list, so a member sends one narrow pair and no bits. Hot lists lie in several
    # tasks: the first of their leaders leads them all.
    hot_leads = buckets.where("hot").groupBy("bucket").agg(F.min("lead").alias("lead"))
    members = buckets.where("not hot").select("id", "n", "pos", "lead").unionByName(
        buckets.where("hot").drop("lead").join(hot_leads, "bucket").select("id", "n", "pos", "lead")
    )
    held = members.select(F.struct("id", "n", "pos").alias("x"), F.struct("lead.id", "lead.n", "lead.pos").alias("y")).where("x.id <> y.id").where(fits)
    held = held.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.expr("x.n + y.n").alias("n")).distinct()
    of = lambda c: signs.select(F.col("id").alias(c), F.struct(*[f"b{i}" for i in range(PARITY)]).alias(c * 2))
    near_bits = " + ".join(f"bit_count(aa.b{i} ^ bb.b{i})" for i in range(PARITY))
    to_leader = held.join(of("a"), "a").join(of("b"), "b").where(f"{join.num + join.den} * ({near_bits}) <= {join.den - join.num} * n").select("a", "b")

    def linked(pairs: DataFrame) -> DataFrame:
        near = stage(pairs, "near")
        ids = near.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(chosen, "sid").select("sid", "tkey")
        # Texts travel, not their sets: names of shingles take several times the room and do not compress.
        texts = rows.select("tkey", "text").join(small_side(stage(ids, "wanted")), "tkey").select("sid", "text")
        found = stage(texts.dropDuplicates(["sid"]), "compared")
        side = lambda c: found.select(F.col("sid").alias(c), F.col("text").alias(f"{c}_text"))
        return compare_texts(near.join(side("a"), "a").join(side("b"), "b"), join)

    more = subset_links(small.where(F.col("n") <= light), join, light) if light else None
    rows_of = buckets.select("bucket", "id", "n", "pos")
    return tried_components(rows_of, to_leader, linked, f"{fits} and {alike}", lambda open_rows: open_rows.join(signs, "id"), more=more)


def compare_texts(pairs: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) of (a, b, a_text, b_text) whose sets link, exactly; a text mostly comes in several pairs in a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        sets = lru_cache(CACHED_SETS)(lambda text: shingles(text, join.words, seen))
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["a_text"], pdf["b_text"]):
                s, t = sets(x), sets(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append((join.num + join.den) * both >= join.num * (len(s) + len(t)))
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.select("a", "b", "a_text", "b_text").mapInPandas(run, "a long, b long")
