"""Quality rules: a decision list learned by sequential covering, written as ordered Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import stage
from quorate.llm.quality import held_out, known_labels
from quorate.llm.stats import COUNTS, SHARES, text_stats

# The rules are learned from at most this many labelled rows, those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 40
# A rule must be right this often on rows it was not grown on, and reject at least so many of them.
MIN_PRECISION, MIN_COVER = 0.9, 3

NAMES = (*COUNTS, *SHARES)
# Fixed base limits: too few words, or too many of them in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # true: value > cut, false: value <= cut
    cut: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.name] > self.cut if self.above else data[self.name] <= self.cut

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{self.name}").cast("double")
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:g}"


def _covered(rule: list[Condition], data: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(data)
    return out


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, names: list[str]) -> list[Condition]:
    """Add the condition with the largest information gain until no good row is covered or nothing is gained."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if p == 0 or n == 0:
            break
        best, best_gain = None, 1e-9
        for name in names:
            values = data[name][inside]
            flags = bad[inside]
            order = np.argsort(values, kind="stable")
            v, f = values[order], flags[order]
            cuts = np.unique(np.quantile(np.unique(v), np.linspace(0, 1, CUTS), method="lower"))
            upto = np.searchsorted(v, cuts, side="right")
            total = np.concatenate([[0], np.cumsum(f)])
            for above in (False, True):
                p1 = (p - total[upto]) if above else total[upto]
                all1 = (len(v) - upto) if above else upto
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p1 > 0, p1 * (np.log2(p1 / np.maximum(all1, 1)) - np.log2(p / (p + n))), 0.0)
                at = int(np.argmax(gain))
                if gain[at] > best_gain:
                    best, best_gain = Condition(name, above, float(cuts[at])), float(gain[at])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(data)
    return rule


def _prune(rule: list[Condition], data: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Cut conditions from the end while that does not lower (right - wrong) / (right + wrong) on the pruning rows."""
    best, best_worth = rule, -2.0
    for k in range(len(rule), 0, -1):
        inside = _covered(rule[:k], data, len(bad))
        n = int(inside.sum())
        worth = (2 * int((inside & bad).sum()) - n) / n if n else -1.0
        if worth >= best_worth:
            best, best_worth = rule[:k], worth
    return best


def learn_rules(data: dict[str, np.ndarray], bad: np.ndarray, names: list[str]) -> list[list[Condition]]:
    """Ordered rejecting rules. Two thirds of the rows grow a rule, one third prunes it; what it covers is taken away,
    and the next rule is grown on the rest until no rule is precise enough."""
    rules: list[list[Condition]] = []
    part = np.arange(len(bad)) % 3
    alive = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, prune = alive & (part != 2), alive & (part == 2)
        take = lambda mask: ({k: v[mask] for k, v in data.items()}, bad[mask])  # noqa: B023, E731
        if not (bad & grow).any() or not (bad & prune).any():
            break
        rule = _grow(*take(grow), names)
        if not rule:
            break
        held, held_bad = take(prune)
        rule = _prune(rule, held, held_bad)
        inside = _covered(rule, held, len(held_bad))
        right = int((inside & held_bad).sum())
        if right < MIN_COVER or right < MIN_PRECISION * int(inside.sum()):
            break
        rules.append(rule)
        alive &= ~_covered(rule, data, len(bad))
    return rules


def fit_rules(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", label: str = "quality") -> list[list[Condition]]:
    """Rules from rows (doc_id, stats) that have a label and are not held out. A bounded sample reaches the driver."""
    learn = stats.where(~held_out(F.col("doc_id"))).join(known_labels(labels, doc_id, label), "doc_id")
    by = [F.xxhash64("doc_id"), F.col("doc_id"), *[F.col(f"stats.{c}") for c in NAMES]]
    rows = learn.orderBy(*by).limit(sample_rows).select("label", *[F.col(f"stats.{c}").cast("double").alias(c) for c in NAMES]).toPandas()
    if rows.empty:
        return []
    return learn_rules({c: rows[c].to_numpy(float) for c in NAMES}, rows["label"].to_numpy() == 0, list(NAMES))


def rule_column(rules: list[list[Condition]], stats: str = "stats") -> Column:
    """Number from 1 of the first rule that fits, 0 for none: one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        fits = F.lit(True)
        for c in rule:
            fits = fits & c.column(stats)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept).

    The base fails a text with fewer than MIN_WORDS words or more than MAX_REPEAT_PERCENT of its words in repeated
    windows. Others are kept unless a learned rule fits. Null and empty texts have counts 0 and fail. Without labels of
    both kinds there are no learned rules. Repeated rows are judged each; an empty table gives no rows; extra columns
    are left out.
    """
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), text_stats(F.col(text)).alias("stats")), "stats")
    rules = fit_rules(rows, labels, sample_rows, doc_id, label)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = rows.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in COUNTS], rule_column(rules).alias("rule"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
