"""Comparing an answer with the truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions.values import number, strip


def near(truth: Column, answer: Column, window: int) -> Column:
    """Both numbers, rounded half to even, at most `window` apart; not a number is wrong."""
    gap = F.abs(F.rint(number(answer)) - F.rint(number(truth)))
    return F.coalesce(gap <= window, F.lit(False))


def name_match(truth: Column, answer: Column) -> Column:
    """The answer holds the truth, or one of its words longer than three characters."""
    t, a = F.lower(strip(truth)), F.lower(strip(answer))
    words = F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 3)
    return F.contains(a, t) | F.exists(words, lambda w: F.contains(a, w))


def correctness(truth: Column, answer: Column, kind: str, year_window: int = 3, tenure_window: int = 5) -> Column:
    """1, 0, or null when either side is missing."""
    if kind == "name":
        right = name_match(truth, answer)
    elif kind in ("year", "tenure"):
        right = near(truth, answer, year_window if kind == "year" else tenure_window)
    else:
        raise ValueError(f"unknown question kind {kind!r}")
    known = (strip(F.coalesce(truth, F.lit(""))) != "") & (strip(F.coalesce(answer, F.lit(""))) != "")
    return F.when(known, right.cast("int"))


def probability(logprob: Column) -> Column:
    return F.exp(logprob)
