"""Re-requests and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.operators.votes import last_per_key

# Key columns tried in this order.
KEY_CANDIDATES = (
    ("unique_id",),
    ("territorynamehistorical", "start_year", "end_year"),
    ("polity_name", "leader_first_year", "leader_last_year"),
    ("territorynamehistorical", "entrydateyear", "exitdateyear"),
    ("polity_name", "entrydateyear", "exitdateyear"),
)
# Column endings that belong to an indicator.
PLAIN_ENDINGS = ("_prediction", "_reasoning", "_confidence", "_agreement", "_uncertainty", "_verification", "_logprob")
DOCUMENT_COLUMNS = ("constitution_document_name", "constitution_year", "constitution_document_types")


def find_keys(left: Sequence[str], right: Sequence[str]) -> list[str]:
    for keys in KEY_CANDIDATES:
        if all(k in left and k in right for k in keys):
            return list(keys)
    raise ValueError(f"no common key columns; tried {KEY_CANDIDATES}")


def indicator_columns(columns: Sequence[str], indicator: str) -> list[str]:
    """Columns of one indicator in a wide table, plain and per sample."""
    plain = {f"{indicator}{e}" for e in PLAIN_ENDINGS}
    slots = [f"{indicator}_SC", f"{indicator}_reasoning_SC", f"{indicator}_confidence_SC"]
    if indicator == "constitution":
        plain |= set(DOCUMENT_COLUMNS)
        slots += [f"{c}_SC" for c in DOCUMENT_COLUMNS]
    return [c for c in columns if c in plain or any(c.startswith(s) for s in slots)]


def upsert(
    original: DataFrame,
    reprocessed: DataFrame,
    order: str,
    keys: Sequence[str] | None = None,
    update: Sequence[str] | None = None,
    confidence: str | None = None,
    keep_failed: bool = True,
) -> DataFrame:
    """Overwrite listed columns of matched rows.

    A failed reprocess (confidence null or -1) keeps the original values; of several good rows for a key the
    last by `order` wins; columns new to the table are null where nothing matched. Keys match null to null.
    """
    keys = list(keys or find_keys(original.columns, reprocessed.columns))
    for side, frame in (("original", original), ("reprocessed", reprocessed)):
        missing = [k for k in keys if k not in frame.columns]
        if missing:
            raise ValueError(f"key columns missing in {side}: {missing}")
    update = [c for c in (update or reprocessed.columns) if c not in keys and (update or c != order)]

    good = reprocessed
    if keep_failed and confidence and confidence in reprocessed.columns:
        score = F.col(confidence).try_cast("double")
        good = reprocessed.where(score.isNotNull() & (score != -1))
    latest = last_per_key(good.select(*keys, F.col(order).alias("_order"), *update), keys, "_order")
    new = latest.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*update).alias("_new"))

    match = None
    for k in keys:
        same = original[k].eqNullSafe(new[f"_k_{k}"])
        match = same if match is None else match & same
    joined = original.join(new, match, "left")
    hit = F.col("_new").isNotNull()
    out = []
    for c in original.columns:
        if c in update:
            kind = original.schema[c].dataType
            out.append(F.when(hit, F.col("_new")[c].try_cast(kind)).otherwise(original[c]).alias(c))
        else:
            out.append(original[c])
    out += [F.col("_new")[c].alias(c) for c in update if c not in original.columns]
    return joined.select(*out)


def upsert_long(original: DataFrame, reprocessed: DataFrame, failed: DataFrame, order: str, keys: Sequence[str] = ("row_idx", "indicator")) -> DataFrame:
    """Per-indicator upsert on the long table: only (row, indicator) pairs that failed are touched; with `sc_idx` in `keys`, only failed samples."""
    allowed = reprocessed.join(failed.select(*keys), list(keys), "left_semi")
    update = [c for c in original.columns if c not in keys and c in reprocessed.columns]
    return upsert(original, allowed, order, list(keys), update, "confidence")


def upsert_indicators(
    original: DataFrame, fresh: DataFrame, indicators: Sequence[str], key: str = "row_idx", failed: str = "_failed_{}", order: str | None = None
) -> DataFrame:
    """Per-indicator upsert on the wide table, all indicators in one join.

    `fresh` holds new columns by row key and a flag per indicator that says whether it had failed on that row. Only
    the columns of failed indicators are overwritten, and only where the new confidence is neither null nor -1. A key
    may be repaired several times: each indicator takes its own latest good repair by the column `order`; without it,
    and among equal orders, the one with the greatest values. A failed repair never replaces or hides a good one.
    """
    groups = {i: indicator_columns(fresh.columns, i) for i in indicators}
    groups = {i: cols for i, cols in groups.items() if cols}
    latest, owner = [], {c: i for i, cols in groups.items() for c in cols}
    for n, (i, cols) in enumerate(groups.items()):
        good = F.col(failed.format(i)) == 1
        if f"{i}_confidence" in cols:
            # A null score makes the condition null, and the row does not count.
            good = good & (F.col(f"{i}_confidence").try_cast("double") != -1)
        by = [] if order is None else [F.col(order).alias("_order")]
        latest.append(F.max(F.when(good, F.struct(*by, *cols))).alias(f"_new_{n}"))
    if not latest:
        return original
    joined = original.join(fresh.groupBy(key).agg(*latest), key, "left")
    new = {i: F.col(f"_new_{n}") for n, i in enumerate(groups)}
    out = [
        F.when(new[owner[c]].isNotNull(), new[owner[c]][c].try_cast(original.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in owner else F.col(c)
        for c in original.columns
    ]
    out += [new[i][c].alias(c) for c, i in owner.items() if c not in original.columns]
    return joined.select(*out)


def unanswered(requests: DataFrame, responses: DataFrame, key: str = "custom_id", text: str = "text") -> DataFrame:
    """Requests without a response, or with an empty one."""
    answered = responses.where(F.col(text) != "").select(key)
    return requests.join(answered, key, "left_anti")


def retry_requests(requests: DataFrame, failed: DataFrame, row: str = "row_idx") -> DataFrame:
    """All samples of the failed rows."""
    return requests.join(failed.select(row), row, "left_semi")


def pending(rows: DataFrame, done: DataFrame, key: str = "row_idx") -> DataFrame:
    """Rows not yet in the output (resume)."""
    return rows.join(done.select(key), key, "left_anti")


def later_wins(parts: Sequence[DataFrame], key: str = "custom_id") -> DataFrame:
    """Put result parts together; for a key in several parts the later part wins."""
    if not parts:
        raise ValueError("no parts given")
    out = None
    for n, part in enumerate(parts):
        tagged = part.withColumn("_part", F.lit(n))
        out = tagged if out is None else out.unionByName(tagged)
    return last_per_key(out, [key], "_part").drop("_part")
