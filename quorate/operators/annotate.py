"""Calling a user's model function over a request table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

RESPONSE_SCHEMA = (
    "custom_id string, text string, status string, error string, input_tokens bigint, output_tokens bigint, "
    "cached_tokens bigint, thinking_tokens bigint"
)
INPUT = ("custom_id", "system_prompt", "user_prompt", "temperature")
COUNTS = ("input_tokens", "output_tokens", "cached_tokens", "thinking_tokens")


def annotate(requests: DataFrame, open_client: Callable[[], Callable[..., Any]], partitions: int | None = None) -> DataFrame:
    """One response row per request.

    `open_client()` runs once per partition and returns call(system_prompt, user_prompt, temperature), which gives
    a text or a dict with text and token counts. A failed call becomes a row with status "error". The number of
    partitions caps how many calls run at once; pass `partitions` to set it. Only the prompt columns reach Python.

    A task that is lost runs again and so do its calls: write the result before it is used twice.
    """
    needed = requests.select(*INPUT)
    if partitions:
        needed = needed.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = open_client()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                row = {"custom_id": r.custom_id, "text": None, "status": "ok", "error": None, **dict.fromkeys(COUNTS)}
                try:
                    answer = call(r.system_prompt, r.user_prompt, r.temperature)
                    row.update({k: answer.get(k) for k in ("text", *COUNTS)} if isinstance(answer, dict) else {"text": answer})
                except Exception as e:  # a bad row must not lose its batch
                    row.update(status="error", error=f"{type(e).__name__}: {e}")
                out.append(row)
            frame = pd.DataFrame(out, columns=["custom_id", "text", "status", "error", *COUNTS])
            yield frame.astype({c: "Int64" for c in COUNTS})

    return needed.mapInPandas(run, RESPONSE_SCHEMA)
