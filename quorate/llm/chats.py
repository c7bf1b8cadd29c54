"""Collapse logged snapshots of growing conversations and render what is left. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.llm.common import stage

# Turns rendered into one row. Longer conversations come in several parts, so no row gathers an unbounded group.
TURNS_PER_PART = 512
# Turn numbers are cut into ranges this wide, so that even one huge conversation is ordered by several tasks.
TURN_RANGE = 1024

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def number_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, role, text, prefix_a, prefix_b): position from 1 and the rolling hash of all turns up to it.

    The hash of a prefix is the running xor of hashes of (position, role, text), 128 bits wide. Xor is associative, so
    ranges of turns are hashed apart and put together by their partial values.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
        F.coalesce(F.floor(F.col(turn) / TURN_RANGE), F.lit(1 << 60)).cast("long").alias("range"),
    ).where("conv_id is not null")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("conv_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = rows.withColumn("at", F.row_number().over(order)).join(starts, ["conv_id", "range"])
    placed = placed.withColumn("pos", (F.col("start") + F.col("at")).cast("long")).withColumns(
        {c: F.xxhash64("pos", "role", F.col("role").isNull(), "text", F.col("text").isNull(), F.lit(c)) for c in ("a", "b")}
    )
    partial = placed.groupBy("conv_id", "range").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = partial.select(
        "conv_id", "range", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("a", "b")]
    )
    upto = Window.partitionBy("conv_id", "range").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(before, ["conv_id", "range"]).select(
        "conv_id", "pos", "role", "text",
        *[F.col(f"before_{c}").bitwiseXOR(F.bit_xor(c).over(upto)).alias(f"prefix_{c}") for c in ("a", "b")],
    )


def maximal_conversations(numbered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that are no proper prefix of another.

    Of conversations equal turn by turn the smallest id stays; n_copies counts them. Prefix hashes are made distinct
    before any join, so a first turn that a third of all conversations share is one row.
    """
    key = ["pos", "prefix_a", "prefix_b"]
    lengths = numbered.groupBy("conv_id").agg(F.max_by(F.struct(*key), "pos").alias("whole"))
    whole = lengths.select("conv_id", "whole.*").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    # A prefix is proper where the conversation goes on: the next position of the same conversation exists.
    last = lengths.select("conv_id", F.col("whole.pos").alias("last"))
    proper = numbered.select("conv_id", *key).join(last, "conv_id").where("pos < last").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render_turn(role: Column, text: Column) -> Column:
    """One turn in ChatML; a null role or text is empty."""
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Rendered maximal conversations: (conv_id, part, n_turns, n_copies, rendered).

    Turns are ordered by (turn, role, text), null turns last. A conversation longer than `turns_per_part` comes in parts
    0, 1, ..., to be joined in order. Rows without conv_id belong to no conversation and give none. Null roles and
    texts are empty when rendered, but a null and an empty text make different conversations. Repeated rows are turns of
    their own. An empty table gives no rows. Extra columns are left out.
    """
    numbered = stage(number_turns(turns, conv_id, turn, role, text), "turns")
    kept = stage(maximal_conversations(numbered), "conversations")
    part = F.floor((F.col("pos") - 1) / turns_per_part).cast("int").alias("part")
    pieces = numbered.join(kept, "conv_id").groupBy("conv_id", part, "n_turns", "n_copies").agg(
        F.array_sort(F.collect_list(F.struct("pos", render_turn(F.col("role"), F.col("text")).alias("piece")))).alias("pieces")
    )
    return pieces.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered"))
