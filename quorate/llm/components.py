"""Distributed union-find, and links inside buckets without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the links (a, b); component is the smallest id it reaches.

    Each round takes the smallest label among the neighbours and then jumps along labels, so the number of rounds
    follows the logarithm of the longest path. Labels live in written tables; one count per round reaches the driver.
    Nulls are no ends; repeated links, loops and an empty table are fine. A hub with many neighbours is met by the
    partial minimum before the shuffle.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        step = stage(low.join(far, "component").select("id", "was", F.least("component", "far").alias("component")), "labels")
        if not step.where("component <> was").head(1):
            return labels
        labels = step.select("id", "component")


def tried_components(rows: DataFrame, to_leader: DataFrame, linked: Callable[[DataFrame], DataFrame], may_link: str,
                     signed: Callable[[DataFrame], DataFrame] | None = None, more: DataFrame | None = None, few_buckets: bool = False) -> DataFrame:
    """(id, component) of ids that link with another: whatever the pairs within buckets, and links `more`, connect.

    `rows` has (bucket, id, further columns), best as a written table, for it is read several times; `linked` keeps the true
    links of a frame (a, b). `may_link` is an SQL condition over x.* and y.* that every link fulfils. First come the pairs
    `to_leader`, which hold every member of a bucket against its leader and settle groups of near copies in one comparison
    each. Then pairs whose ends still lie in different components are compared, so no link is lost and no group of copies
    gives all its pairs.

    `signed` adds to rows with an `id` what `may_link` needs; only rows of buckets that are still open ever carry it. With
    `few_buckets` `rows` is (bucket, id) and an id lies in a small, fixed number of buckets. Then two things keep the pairs few: one member stands for
    each component of a bucket first, which joins most components by one comparison; and what is left is paired in the
    first bucket that two ids share only, so that a pair is one row however many buckets it shares.
    """
    tried = stage(to_leader, "tried")
    comps = connected_components(stage(linked(tried), "linked"))

    def still_open(table: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components."""
        named = table.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        return stage(named.join(mixed, "bucket", "left_semi"), "open")

    open_rows = still_open(rows)
    if not few_buckets:
        if signed is not None:
            open_rows = stage(signed(open_rows), "signed")
        second = linked(_pairs(open_rows, may_link).distinct().join(tried, ["a", "b"], "left_anti"))
        return merged(comps, stage(second if more is None else second.unionByName(more), "linked"))
    # What `may_link` needs is kept once per id; rows take it along only into the shuffle that pairs them.
    ids = open_rows.select("id").distinct()
    signs = stage(ids if signed is None else signed(ids), "signed")
    stand_ins = open_rows.groupBy("bucket", "component").agg(F.min("id").alias("id"))
    chosen = stage(_pairs(stand_ins.join(signs, "id"), may_link).distinct().join(tried, ["a", "b"], "left_anti"), "tried")
    comps = stage(merged(comps, stage(linked(chosen), "linked")), "labels")
    open_rows = still_open(open_rows.select("bucket", "id"))
    homes = signs.join(open_rows.groupBy("id").agg(F.collect_set("bucket").alias("homes")), "id")
    first_shared = "x.bucket = array_min(array_intersect(x.homes, y.homes))"
    rest = _pairs(open_rows.join(homes, "id"), f"({may_link}) and {first_shared}").join(tried.unionByName(chosen), ["a", "b"], "left_anti")
    last = linked(rest)
    return merged(comps, stage(last if more is None else last.unionByName(more), "linked"))


def _pairs(rows: DataFrame, may_link: str) -> DataFrame:
    """(a, b) of ids of one bucket in different components that may link."""
    # One condition, the cheap parts first: a condition put on a join is evaluated after those of a filter above it, and
    # every row meets itself here.
    met = f"x.component <> y.component and x.id < y.id and ({may_link})"
    return rows.alias("x").join(rows.alias("y"), F.expr("x.bucket = y.bucket")).where(met).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after further links (a, b), a written table, have joined components or new ids."""
    if not links.head(1):
        return comps
    named_end = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    joined = links.join(named_end("a"), "a", "left").join(named_end("b"), "b", "left")
    over = connected_components(joined.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")))
    ids = comps.unionByName(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comps, "id", "left_anti").withColumn("component", F.col("id")))
    top = over.select(F.col("id").alias("component"), F.col("component").alias("top"))
    return ids.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
