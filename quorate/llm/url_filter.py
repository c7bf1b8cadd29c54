"""URL rules, and exact block lists by a cascade of Bloom filters. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import stage

BITS_PER_KEY, HASHES = 8, 4
# The filters travel inside the plan; this bounds their size. A list that needs more is matched by a join instead.
MAX_FILTER_BITS = 1 << 26

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or for null."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdicts(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does.

    A rule is (verdict, host, path). It fits its host and all subdomains if the url's path starts with the rule's. Of
    rules equally long the first in code point order counts. The rules are the caller's own list, a CASE in the plan.
    """
    rule = verdict = None
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def domains_of(host: Column) -> Column:
    """The host and all its parent domains: a.b.c gives a.b.c, b.c and c; an empty host gives none."""
    parts = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.filter(F.array_distinct(tails), lambda d: d != "")


def _positions(key: Column, level: int, bits: int) -> Column:
    """The bits of a key at a level; every level has hashes of its own."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)])


def _encode(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with the filter as an array of 64-bit words; partial ors come before the shuffle."""
    at = keys.select(F.explode(_positions(F.col("key"), level, bits)).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(ordered, lambda w: w["bits"]).alias("filter"))


def _hit(key: Column, table: DataFrame, level: int, bits: int) -> Column:
    """Whether the filter of a level has all bits of the key; the one-row table is read once, as a scalar subquery."""
    words = table.scalar()
    there = F.lit(True)
    for i in range(HASHES):
        at = F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits))
        there = there & (F.getbit(F.get(words, (at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return there


class Cascade:
    """Filters of alternating sense over one key universe; `holds` needs no join and is exact on that universe."""

    def __init__(self, levels: list[tuple[DataFrame, int]]):
        self.levels = levels

    def holds(self, key: Column) -> Column:
        """True for listed keys. The first filter that lacks the key decides: odd ones deny, even ones confirm."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            table, bits = self.levels[level]
            answer = F.when(_hit(key, table, level, bits), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def build_cascade(universe: DataFrame, listed: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_FILTER_BITS) -> Cascade | None:
    """Cascade over frames with one column `key` each; None if a filter would outgrow `max_bits`.

    Level 1 holds the listed keys of the universe, level 2 the other keys that level 1 takes for listed, level 3 the
    listed keys that level 2 takes for those, and so on until no key is mistaken. Each level is a fraction of the one
    before last, so the number of levels follows the logarithm of the universe. Keys outside the universe may be
    answered wrongly; null keys are on no list; repeated keys count once; an empty list gives a cascade without levels.
    """
    keys = stage(
        universe.where("key is not null").select("key").distinct()
        .join(listed.select("key", F.lit(True).alias("on_list")).distinct(), "key", "left")
        .select("key", F.coalesce("on_list", F.lit(False)).alias("on_list")),
        "keys",
    )
    inside, outside = keys.where("on_list").select("key"), keys.where("not on_list").select("key")
    levels: list[tuple[DataFrame, int]] = []
    while n := inside.count():
        bits = 64 * max(1, math.ceil(n * bits_per_key / 64))
        if bits > max_bits:
            return None
        table = stage(_encode(inside, len(levels), bits), "filter")
        mistaken = stage(outside.where(_hit(F.col("key"), table, len(levels), bits)), "mistaken")
        levels.append((table, bits))
        inside, outside = mistaken, inside
    return Cascade(levels)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, page_id: str = "page_id", url: str = "url",
          max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict).

    The longest rule that fits decides. Without one the page is blocked if its host or a parent domain is in `listed`
    (a frame with one column `key` of lower-case domains), else allowed. The key universe of the cascade is every host
    of the corpus but the empty one, which it is not asked for; hosts under a listed domain are its listed keys. Membership is then a look into the filters, without
    a join over the pages; only a list whose filter would outgrow `max_bits` is matched by a join of the hosts.

    Null urls and urls without :// have an empty host and path, fit no rule and are allowed. Repeated rows stay.
    Extra columns are left out. An empty table gives no rows; an empty list blocks nothing.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = stage(rows.where("host <> ''").select(F.col("host").alias("key")).distinct(), "hosts")
    domains = hosts.select("key", F.explode(domains_of(F.col("key"))).alias("domain"))
    known = domains.join(listed.select(F.col("key").alias("domain")).distinct(), "domain", "left_semi").select("key")
    cascade = build_cascade(hosts, known, max_bits=max_bits)
    if cascade is None:
        rows = rows.join(known.select(F.col("key").alias("host"), F.lit(True).alias("on_list")).distinct(), "host", "left")
        on_list = F.coalesce(F.col("on_list"), F.lit(False))
    else:
        # The empty host is on no list and outside the universe, where the filters may be wrong.
        on_list = (F.col("host") != "") & cascade.holds(F.col("host"))
    rule, verdict = rule_verdicts(F.col("host"), F.col("path"), rules)
    judged = F.coalesce(verdict, F.when(on_list, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), judged.alias("verdict"))
