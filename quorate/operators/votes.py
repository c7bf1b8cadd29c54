"""Majority votes over repeated samples.

Two plans for two shapes of data:

* `majority_vote`: any number of votes per key. Counts per (key, vote) are combined before the shuffle, then
  the winner is taken from the few counts of a key. No vote list is ever gathered, so a key that holds a
  third of all votes costs no more than its distinct labels.
* `slot_pivot` + `slot_verdict`: at most n fixed sample slots per key. One aggregation brings the slots side by
  side, the vote is then plain arithmetic on the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.registry import string_array

KEYS = ("row_idx", "indicator")
MAX_PAIRED_SLOTS = 8


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the row with the highest `order` of each key; ties go to the greatest values of the other columns.

    Maps have no order and decide no tie.
    """
    rest = [c for c in df.columns if c not in keys]
    ties = [c for c in rest if c != order and "map<" not in df.schema[c].dataType.simpleString()]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *ties)).alias("_last"))
    return picked.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def vote_counts(
    votes: DataFrame, keys: Sequence[str] = KEYS, vote: str = "prediction", order: str = "sc_idx"
) -> DataFrame:
    """Votes per (key, label) with the order of the first one; failed (null or empty) votes count under null."""
    cast = votes.select(*keys, F.when(F.col(vote) != "", F.col(vote)).alias(vote), F.col(order).cast("bigint").alias(order))
    return cast.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n_votes"), F.min(order).alias("first_order"))


def uncertainty_of(top: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, "high").when(top == total, "none").when(top >= 2, "low").otherwise("high")


def majority_vote(
    votes: DataFrame, keys: Sequence[str] = KEYS, vote: str = "prediction", order: str = "sc_idx"
) -> DataFrame:
    """Winner, agreement and uncertainty per key; the earliest vote breaks ties.

    A key with failed votes only gives null, 0.0, "high".
    """
    counts = vote_counts(votes, keys, vote, order)
    real = F.col(vote).isNotNull()
    rank = F.struct(F.col("n_votes").alias("n"), (-F.col("first_order")).alias("early"), F.col(vote).alias("vote"))
    best = counts.groupBy(*keys).agg(
        F.max(F.when(real, rank)).alias("_top"),
        F.coalesce(F.sum(F.when(real, F.col("n_votes"))), F.lit(0)).alias("n_votes"),
    )
    return best.select(
        *keys,
        F.col("_top.vote").alias(vote),
        F.coalesce(F.col("_top.n").cast("double") / F.nullif(F.col("n_votes"), F.lit(0)), F.lit(0.0)).alias("agreement"),
        uncertainty_of(F.col("_top.n"), F.col("n_votes")).alias("uncertainty"),
        "n_votes",
    )


def vote_distribution(
    votes: DataFrame, keys: Sequence[str] = KEYS, vote: str = "prediction", order: str = "sc_idx"
) -> DataFrame:
    """Map label -> votes per key. The map holds distinct labels, not votes."""
    counts = vote_counts(votes, keys, vote, order).where(F.col(vote).isNotNull())
    entries = F.array_sort(F.collect_list(F.struct(F.col(vote).alias("key"), F.col("n_votes").alias("value"))))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias("distribution"))


def slot_pivot(
    votes: DataFrame,
    n_slots: int,
    keys: Sequence[str] = KEYS,
    fields: Sequence[str] = ("prediction",),
    slot: str = "sc_idx",
) -> DataFrame:
    """Samples side by side: {field}_SC1 .. {field}_SCn, null where a sample failed.

    The slots are named, so the schema is fixed and no job is run to find them.
    """
    if len(fields) == 1:
        f = fields[0]
        return votes.groupBy(*keys).agg(*[F.max(F.when(F.col(slot) == i, F.col(f))).alias(f"{f}_SC{i + 1}") for i in range(n_slots)])
    # Fields of a slot travel together, so that they stem from one sample and there is one buffer per slot.
    side = votes.groupBy(*keys).agg(*[F.max(F.when(F.col(slot) == i, F.struct(*fields))).alias(f"_s{i}") for i in range(n_slots)])
    return side.select(*keys, *[F.col(f"_s{i}")[f].alias(f"{f}_SC{i + 1}") for f in fields for i in range(n_slots)])


def unpivot_slots(wide: DataFrame, n_slots: int, keys: Sequence[str] = KEYS, field: str = "prediction") -> DataFrame:
    """Inverse of `slot_pivot` for one field."""
    slots = F.array(
        *[F.struct(F.lit(i).alias("sc_idx"), F.col(f"{field}_SC{i + 1}").alias(field)) for i in range(n_slots)]
    )
    return wide.select(*keys, F.inline(slots))


def slot_verdict(slots: Sequence[str]) -> dict[str, Column]:
    """Vote over slots that stand in one row: prediction, agreement, uncertainty.

    Slots are SQL texts (column names or expressions). Few slots are compared pair by pair, which compiles to plain
    arithmetic; many go through array functions, so that the text does not grow with the square of their number.
    """
    total = " + ".join(f"cast({s} is not null as int)" for s in slots)
    if len(slots) <= MAX_PAIRED_SLOTS:
        counts = ["(" + " + ".join(f"coalesce(cast({other} = {own} as int), 0)" for other in slots) + ")" for own in slots]
        top = f"greatest({', '.join(counts)})" if len(counts) > 1 else counts[0]
        winner = "coalesce(" + ", ".join(f"case when {c} = {top} then {s} end" for s, c in zip(slots, counts)) + ")"
    else:
        votes = f"array_compact(array({', '.join(slots)}))"
        counts = f"transform({votes}, own -> size(filter({votes}, other -> other = own)))"
        top = f"coalesce(array_max({counts}), 0)"
        winner = f"get({votes}, cast(array_position({counts}, {top}) as int) - 1)"
    return {
        "prediction": F.expr(winner),
        "agreement": F.expr(f"coalesce(cast({top} as double) / nullif({total}, 0), cast(0 as double))"),
        "uncertainty": F.expr(
            f"case when {total} = 0 then 'high' when {top} = {total} then 'none' when {top} >= 2 then 'low' else 'high' end"
        ),
    }


def slot_vote(
    votes: DataFrame,
    n_slots: int,
    labels: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    vote: str = "prediction",
    slot: str = "sc_idx",
) -> DataFrame:
    """Majority vote over fixed slots with one shuffle.

    With a label list the slots travel as label positions (ints), which keeps the aggregation hash-based; a
    vote outside the list is a failed vote.
    """
    if labels is None:
        wide = slot_pivot(votes, n_slots, keys, (vote,), slot)
        verdict = slot_verdict([f"nullif(`{vote}_SC{i + 1}`, '')" for i in range(n_slots)])
    else:
        known = string_array(labels)
        place = F.array_position(known, F.col(vote))
        coded = votes.select(*keys, slot, F.when(place > 0, place.cast("int")).alias("_code"))
        wide = slot_pivot(coded, n_slots, keys, ("_code",), slot)
        verdict = slot_verdict([f"_code_SC{i + 1}" for i in range(n_slots)])
        verdict["prediction"] = F.try_element_at(known, verdict["prediction"])
    return wide.select(
        *keys,
        verdict["prediction"].alias(vote),
        verdict["agreement"].alias("agreement"),
        verdict["uncertainty"].alias("uncertainty"),
    )


def agreeing_reasons(
    votes: DataFrame,
    verdicts: DataFrame,
    k: int = 3,
    keys: Sequence[str] = KEYS,
    vote: str = "prediction",
    order: str = "sc_idx",
) -> DataFrame:
    """First k non-empty reasonings of the votes that agree with the verdict.

    Votes are ranked inside their own label first; Spark applies "rank <= k" in each task before the shuffle, so a
    key with very many votes sends only a few. The verdict then picks the label.
    """
    given = votes.where((F.col("reasoning") != "") & F.col(vote).isNotNull()).select(*keys, vote, order, "reasoning")
    ranked = given.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, vote).orderBy(order))).where(F.col("rank") <= k)
    return ranked.join(verdicts.select(*keys, vote), [*keys, vote], "left_semi").select(*keys, "rank", "reasoning")
