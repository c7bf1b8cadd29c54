"""Text building: templates with named slots, period texts, joined lists."""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions.values import strip


def render(template: str, slots: Mapping[str, Column]) -> Column:
    """Fill {slot} places; doubled braces stand for single ones.

    The template is cut up once on the driver, so the plan holds one concat of literals and columns and a
    value that happens to contain "{...}" is never expanded again.
    """
    parts = []
    for text, slot, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if slot is not None:
            if slot not in slots:
                raise ValueError(f"template slot {slot!r} has no column")
            parts.append(slots[slot].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def period_text(start: Column, end: Column, missing: str = "unknown", dash: str = "-") -> Column:
    """"start-end", with a word for an open end."""
    return F.concat(start.cast("string"), F.lit(dash), F.coalesce(end.cast("string"), F.lit(missing)))


def pipe_list(items: Column) -> Column:
    """Join a list with " | "; an empty list gives null."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, " | "))


def source_entries(chunks: Column) -> Column:
    """array<struct<title,uri>> to "title (uri)" texts, or the bare uri where there is no title."""

    def one(c: Column) -> Column:
        title, uri = F.coalesce(c["title"], F.lit("")), F.coalesce(c["uri"], F.lit(""))
        return F.when(title != "", F.concat(title, F.lit(" ("), uri, F.lit(")"))).otherwise(uri)

    return F.transform(chunks, one)


def search_text(polity: Column, name: Column, start: Column, end: Column) -> Column:
    """Search phrase, worded by which of name, start and end are known."""
    who = strip(F.coalesce(name, F.lit("")))
    s, e = start.cast("string"), end.cast("string")
    # Wording of the search phrases.
    with_name = (
        F.when(s.isNotNull() & e.isNotNull(), F.concat(who, F.lit(" of "), polity, F.lit(" during "), s, F.lit("-"), e))
        .when(s.isNotNull(), F.concat(who, F.lit(" of "), polity, F.lit(" reign started in "), s))
        .when(e.isNotNull(), F.concat(who, F.lit(" of "), polity, F.lit(" reign ended in "), e))
        .otherwise(F.concat(who, F.lit(" of "), polity))
    )
    without_name = (
        F.when(s.isNotNull() & e.isNotNull(), F.concat(polity, F.lit(" during "), s, F.lit("-"), e))
        .when(s.isNotNull(), F.concat(polity, F.lit(" from "), s))
        .when(e.isNotNull(), F.concat(polity, F.lit(" until "), e))
        .otherwise(polity)
    )
    return F.when(who != "", with_name).otherwise(without_name)


def without_reasoning(template: str) -> str:
    """Drop the reasoning field from an answer template (driver-side, templates are small)."""
    import re

    text = re.sub(r',\s*"reasoning":\s*"[^"]*"', "", template)
    text = re.sub(r'"reasoning":\s*"[^"]*",\s*', "", text)
    return re.sub(r'(?m)^- "?reasoning"?:.*\n?', "", text)
