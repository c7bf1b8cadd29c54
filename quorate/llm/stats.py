"""Counts and shares of whole texts, one pass per text inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (
    "n_chars", "symbol_share", "upper_share", "digit_share", "mark_share", "bang_share", "distinct_share", "dup_line_share",
    "repeat_share", "mean_word", "words_per_line", "marked_words", "long_words", "top_word_share", "stops_share", "echo_share",
)
DTYPE = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in SHARES])

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b".,;:!?'\"()-"
CONTINUATION = bytes(range(128, 192))


def without(data: bytes, drop: bytes) -> int:
    """How many bytes of `data` are in `drop`."""
    return len(data) - len(data.translate(None, drop))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur at least twice in the text, first occurrence included.

    Windows are named exactly: pairs of names of half as long windows are ranked, three times.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    width, top = 1, len(names)
    while width < WINDOW:
        if top == len(ids):  # every window of this width occurs once, so every longer one does
            return 0
        pairs = ids[:-width] * top + ids[width:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        width, top = 2 * width, len(distinct)
    twice = np.bincount(ids, minlength=top)[ids] > 1
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + WINDOW, -1)
    return int((np.cumsum(inside[:-1]) > 0).sum())


def describe(text: str | None) -> tuple:
    """All statistics of one text; null counts as empty. Shares of nothing are 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.split()]
    n, size, n_lines = len(words), max(1, len(data)), max(1, len(lines))
    joined = b"".join(words)
    chars = len(joined) - without(joined, CONTINUATION)
    symbols = without(data, SYMBOLS)
    repeats = repeated_words(words)
    dup_lines = len(lines) - len(set(lines))
    counted: dict[bytes, int] = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    m = max(1, n)
    return (
        n, chars, symbols, dup_lines, repeats,
        float(len(text or "")), symbols / size, without(data, UPPER) / size, without(data, DIGITS) / size, without(data, MARKS) / size,
        data.count(b"!") / size, len(counted) / m, dup_lines / n_lines, repeats / m, chars / m, n / n_lines,
        sum(c for w, c in counted.items() if w[-1:] in b".,;:!?") / m, sum(c for w, c in counted.items() if len(w) > 12) / m,
        max(counted.values(), default=0) / m, sum(data.count(x) for x in (b". ", b".\n")) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
    )


def _batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([describe(t) for t in texts], columns=[*COUNTS, *SHARES])


def text_stats(text: Column) -> Column:
    """Struct of COUNTS (long) and SHARES (double) of a whole text."""
    return F.pandas_udf(_batches, DTYPE)(text)
