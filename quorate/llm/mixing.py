"""Mix sources to target weights by hash-random order and distributed prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.llm.common import free_name, small_side, stage

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
# Rows of one bucket are ordered in one task; the number of buckets follows the number of rows.
ROWS_PER_BUCKET = 20_000


def source_targets(totals: DataFrame, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) per source.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    `max_repeats` times its source; what is cut goes to the others by weight until none is above. That end state has a
    closed form: with sources ordered by source_size / weight, the first ones are capped and the rest share one level.
    The table has a row per source, not per document, so one ordered pass over it is small.
    """
    turn = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    named = totals.withColumn("turn", F.row_number().over(turn) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")).cast("long"))
    # Small quotients are capped first. Cross-products would be exact; ties of the quotient have the same level anyway.
    by_room = Window.orderBy((F.col("source_size") / F.col("weight")), "turn")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = named.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("all"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(rest).alias("left"),
    ).withColumn("level", (F.col("all") - max_repeats * F.col("capped")).cast("double") / F.col("left"))
    # The first source whose share at its level fits under its cap ends the capped ones.
    fits = F.col("level") * F.col("weight") <= (max_repeats * F.col("source_size")).cast("double")
    first = F.min(F.when(fits, F.struct((F.col("source_size") / F.col("weight")).alias("q"), "turn", "level"))).over(Window.partitionBy())
    return level.withColumn("first", first).select(
        "source", "source_size", "weight",
        F.coalesce(
            F.least((max_repeats * F.col("source_size")).cast("double"), F.col("first.level") * F.col("weight")),
            F.lit(0.0),
        ).alias("target"),
    )


def range_of(key: Column, n_ranges: int) -> Column:
    """Which of n equal ranges a hexadecimal key lies in."""
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n_ranges / F.lit(float(1 << 32))).cast("int")


def mix(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source",
        max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, taken); taken is in words, repeats counted.

    Every document gets a random key from the hash of its id. Within a source documents are taken in key order, whole
    rounds first; the last round stops exactly at the rounded target, so the document at the cut is taken in part.
    Keys are cut into equal ranges; sums per (source, range) give each range its start, and only rows of one range are
    ordered together, so a hot source spreads over as many tasks as it has ranges.

    Nulls: a null source is a source of its own, a null id has the key of the empty text, a null size counts 0.
    Documents of size 0 take 0. Repeated rows are documents of their own. No documents, no rows. Ties in the key are
    broken by id and size; rows equal in all three are interchangeable. Other columns are left out.
    """
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.md5(ident.cast("binary")).alias("key"),
    )
    n = rows.count()
    n_ranges = max(1, -(-n // rows_per_bucket))
    rows = rows.withColumn("range", range_of(F.col("key"), n_ranges))
    per_range = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    targets = source_targets(per_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), max_repeats, weights)
    plan = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(
        starts["source"].alias("plan_source"), F.col("range").alias("plan_range"), "start", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    placed = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["plan_source"]) & (placed["range"] == plan["plan_range"]))
    budget = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - rounds * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("start") + F.col("upto") - F.col("size"))))
    return joined.select("doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + last).cast("long").alias("taken"))


# Splits before each word; blanks stay with the word they follow.
BEFORE_WORD = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def repeat_documents(docs: DataFrame, size: Column, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                     max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The mixed corpus: each document as often as `mix` takes it, with the columns of `docs`.

    A round that was cut inside a document carries its words up to the cut. Documents of which nothing is taken go, save
    those without words, which cost nothing and stay once. `docs` has to give the same rows each time it is read.

    No text is shuffled for it. Rounds are whole for every range of random keys but one per source, the one in which the
    last round ends: rows of ranges before it are taken once more, rows behind it are not, and one row per source tells
    which. Only rows of the one range are put in order, narrow, and joined back by a hash of the whole row. Rows equal in
    key, id and size follow each other by that hash, so the result does not depend on partitioning; rows equal in all
    columns are interchangeable. Nulls as in `mix`.
    """
    names = ("mix_size", "mix_key", "mix_range", "mix_turns", "mix_cut", "mix_hash", "mix_nth", "mix_turn", "mix_plan", "mix_rest", "mix_took")
    words, key, at, turns, cut, row, nth, turn, origin, rest, took = (free_name(docs.columns, c) for c in names)
    counted = docs.withColumns({words: F.coalesce(size, F.lit(0)).cast("long"), key: F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))})
    n_ranges = max(1, -(-docs.count() // rows_per_bucket))
    ranged = counted.withColumn(at, range_of(F.col(key), n_ranges))
    per_range = ranged.groupBy(F.col(source).alias("source"), F.col(at).alias("range")).agg(F.sum(words).alias("range_size"))
    per_range = stage(per_range, "mix-ranges")
    targets = source_targets(per_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), max_repeats, weights)
    ends = per_range.withColumn("end", F.sum("range_size").over(Window.partitionBy("source").orderBy("range")))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.select(F.col("source").alias(origin), whole.alias("rounds"), (budget - whole * F.col("source_size")).alias("left"))
    # The first range that the rest of the budget does not cover; its own part of the rest is what is left before it.
    reached = ends.join(plan, ends["source"].eqNullSafe(plan[origin])).where(F.col("end") > F.col("left"))
    reached = reached.groupBy(origin, "rounds", "left").agg(F.min(F.struct("range", (F.col("left") - F.col("end") + F.col("range_size")).alias("into"))).alias("cut"))
    plan = plan.join(reached.select(F.col(origin).alias("known"), "cut"), F.col(origin).eqNullSafe(F.col("known")), "left").select(origin, "rounds", "cut")
    plan = small_side(stage(plan, "mix-plan"))
    told = ranged.join(plan, F.col(source).eqNullSafe(F.col(origin))).withColumns({
        turns: F.col("rounds") + F.when(F.col(at) < F.coalesce(F.col("cut.range"), F.lit(0)), 1).otherwise(0),
        cut: F.coalesce(F.col(at) == F.col("cut.range"), F.lit(False)), rest: F.coalesce(F.col("cut.into"), F.lit(0)),
    }).select(*docs.columns, words, key, turns, cut, rest)

    # Rows of the ranges that are taken whole.
    plain = told.where(~F.col(cut)).withColumn(took, F.col(turns) * F.col(words))
    # Rows of the one range per source: ordered without their texts, then joined back.
    edge = told.where(cut).withColumn(row, F.xxhash64(*docs.columns))
    order = [F.col(key), F.col(doc_id), F.col(words), F.col(row)]
    narrow = edge.select(F.col(source).alias("s"), F.col(key), F.col(doc_id), F.col(words), F.col(row), F.col(turns), F.col(rest))
    inside = Window.partitionBy("s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(words).over(inside)
    last = F.greatest(F.lit(0), F.least(F.col(words), F.col(rest) - (upto - F.col(words))))
    same = Window.partitionBy("s", key, doc_id, words, row).orderBy(F.col("got").desc())
    got = narrow.withColumn("got", F.col(turns) * F.col(words) + last).withColumn("n", F.row_number().over(same))
    got = got.select(F.col("s"), F.col(key).alias("k"), F.col(row).alias("r"), F.col("n"), "got")
    again = Window.partitionBy(source, key, row).orderBy(F.lit(0))
    numbered = edge.withColumn(nth, F.row_number().over(again))
    back = numbered.join(got, F.col(source).eqNullSafe(F.col("s")) & (F.col(key) == F.col("k")) & (F.col(row) == F.col("r")) & (F.col(nth) == F.col("n")))
    back = back.withColumn(took, F.col("got")).select(*docs.columns, words, took)

    picked = plain.select(*docs.columns, words, took).unionByName(back).where((F.col(took) > 0) | (F.col(words) == 0))
    copies = F.when(F.col(words) > 0, F.ceil(F.col(took) / F.col(words))).otherwise(1).cast("int")
    out = picked.withColumn(turn, F.explode(F.sequence(F.lit(1), copies)))
    part = (F.col(took) - (F.col(turn) - 1) * F.col(words)).cast("int")
    pieces = F.split(F.col(text), BEFORE_WORD)
    lead = F.when(F.col(text).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    words_to_cut = F.array_join(F.slice(pieces, F.lit(1), F.greatest(part, F.lit(0)) + lead), "")
    full = (part >= F.col(words)) | (F.col(words) == 0)
    return out.withColumn(text, F.when(full, F.col(text)).otherwise(words_to_cut)).select(*docs.columns)
