"""Building annotation requests.

Expansion to indicator x sample is an explode of a literal array on the row: map-only, no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.templates import period_text, render
from quorate.functions.values import request_id
from quorate.operators.rows import with_row_index
from quorate.registry import DEFAULT_SEQUENCE, Registry, string_array
from quorate.session import run_folder

# Shape of a request.
COMBINED = "single"
DEFAULT_TOP_P = 0.95
DEFAULT_MAX_TOKENS = 8192
MAX_CHUNK_BYTES = 1_900 * 1024 * 1024

# Positions that are summed up in one task; totals of blocks are one narrow row each.
ROWS_PER_BLOCK = 100_000

SYSTEM_TEMPLATE = "You label historical rulers. Answer with one JSON object only."
USER_TEMPLATE = "Polity: {polity}\nRuler: {name}\nPeriod: {period}\nReturn one JSON object."


def temperatures(n_samples: int, sampled: Sequence[float] | None = None, first: float = 1.0) -> list[float]:
    """First call plus n repeated samples."""
    extra = list(sampled) if sampled is not None else [1.0] * n_samples
    return [first] + extra[:n_samples]


def row_slots(polity="polity_name", name="leader_name", start="leader_first_year", end="leader_last_year", missing_end="present") -> dict[str, Column]:
    return {
        "polity": F.col(polity),
        "name": F.col(name),
        "start_year": F.col(start),
        "end_year": F.coalesce(F.col(end).cast("string"), F.lit(missing_end)),
        "period": period_text(F.col(start), F.col(end), missing_end),
    }


def ordered_indicators(names: Sequence[str], sequence: Sequence[str] | None = None, shuffle_seed: int | None = None) -> list[str]:
    """Order of sections: given, shuffled by a seed, or the default order."""
    if sequence is not None and shuffle_seed is not None:
        raise ValueError("give either a sequence or a shuffle seed")
    if sequence is not None:
        if set(sequence) != set(names):
            raise ValueError("sequence must hold exactly the requested indicators")
        return list(sequence)
    if shuffle_seed is not None:
        import random

        out = list(names)
        random.Random(shuffle_seed).shuffle(out)
        return out
    rank = {n: i for i, n in enumerate(DEFAULT_SEQUENCE)}
    return sorted(names, key=lambda n: rank.get(n, len(rank)))


def combined_system_prompt(registry: Registry, names: Sequence[str], reasoning: bool = True, header: str = SYSTEM_TEMPLATE, version: str = "v1") -> str:
    """System text for one prompt over several indicators; depends on the registry only, so it is made once.

    Versions differ in how a definition is set out: a heading, a table-like line, or a single line.
    """
    layout = {"v1": "## {name}\n{text}\n", "v2": "* {name} | {labels} | {text}", "v3": "{name}: {text}"}
    if version not in layout:
        raise ValueError(f"unknown prompt version {version!r}")
    lines = [header]
    for n in names:
        lines.append(layout[version].format(name=n, text=registry[n].definition, labels=" / ".join(registry[n].labels)))
    lines.append("Fields:")
    for n in names:
        i = registry[n]
        kind = "JSON array out of" if i.multi_select else "one of"
        lines.append(f'"{n}": {kind} {", ".join(i.labels)}')
        if reasoning:
            lines.append(f'"{n}_reasoning": text')
        lines.append(f'"{n}_confidence": whole number 1-100')
    return "\n".join(lines)


def prompts(
    rows: DataFrame,
    registry: Registry,
    indicators: Sequence[str],
    mode: str = "single",
    slots: Mapping[str, Column] | None = None,
    user_template: str = USER_TEMPLATE,
    sections: Mapping[str, str] | None = None,
    reasoning: bool = True,
    version: str = "v1",
    sequence: Sequence[str] | None = None,
    shuffle_seed: int | None = None,
) -> DataFrame:
    """One row per prompt: (input columns, prompt_key, indicators, system_prompt, user_prompt).

    single      all indicators in one prompt; document questions keep a prompt of their own
    multiple    one prompt per indicator
    sequential  one prompt, one section per indicator in a fixed order
    """
    slots = dict(slots or row_slots())
    sections = dict(sections or {})

    def section(name: str) -> Column:
        return render(sections.get(name, user_template), {**slots, "indicator": F.lit(name)})

    def prompt(key: str, names: Sequence[str], system: str, user: Column) -> Column:
        return F.struct(
            F.lit(key).alias("prompt_key"),
            string_array(names).alias("indicators"),
            F.lit(system).alias("system_prompt"),
            user.alias("user_prompt"),
        )

    if mode == "multiple":
        made = [
            prompt(n, [n], combined_system_prompt(registry, [n], reasoning, version=version), section(n)) for n in indicators
        ]
    elif mode == "single":
        alone = [n for n in indicators if n == "constitution"]
        rest = [n for n in indicators if n != "constitution"]
        made = [prompt(n, [n], combined_system_prompt(registry, [n], reasoning, version=version), section(n)) for n in alone]
        if rest:
            system = combined_system_prompt(registry, rest, reasoning, version=version)
            made.append(prompt(COMBINED, rest, system, render(user_template, {**slots, "indicator": F.lit(COMBINED)})))
    elif mode == "sequential":
        order = ordered_indicators(indicators, sequence, shuffle_seed)
        parts: list[Column] = []
        for k, n in enumerate(order, 1):
            parts += [F.lit(f"### {k}/{len(order)} {n}\n"), section(n), F.lit("\n")]
        made = [prompt(COMBINED, order, combined_system_prompt(registry, order, reasoning, version=version), F.concat(*parts))]
    else:
        raise ValueError(f"unknown mode {mode!r}: use single, multiple or sequential")
    return rows.select("*", F.inline(F.array(*made)))


def expand_samples(prompts_df: DataFrame, temps: Sequence[float], row: str = "row_idx") -> DataFrame:
    """One row per sample with its temperature and request id."""
    samples = F.array(*[F.struct(F.lit(i).alias("sc_idx"), F.lit(float(t)).alias("temperature")) for i, t in enumerate(temps)])
    out = prompts_df.select("*", F.inline(samples))
    return out.withColumn("custom_id", request_id(F.col(row), F.col("prompt_key"), F.col("sc_idx"))).withColumn(
        "n_samples", F.lit(len(temps) - 1)
    )


def request_document(
    requests: DataFrame,
    row_columns: Sequence[str] = (),
    max_tokens: int = DEFAULT_MAX_TOKENS,
    top_p: float = DEFAULT_TOP_P,
    search: bool = False,
    search_queries: str | None = None,
    search_urls: str | None = None,
) -> DataFrame:
    """Nested request as written to JSON Lines; the input row travels with the first sample only."""
    first = F.col("sc_idx") == 0
    text = lambda c: F.array(F.struct(c.alias("text")))
    config = [
        F.struct(text(F.col("system_prompt")).alias("parts")).alias("system_instruction"),
        F.col("temperature").alias("temperature"),
        F.lit(max_tokens).alias("max_output_tokens"),
        F.lit(top_p).alias("top_p"),
    ]
    if search:
        config.append(F.array(F.struct(F.struct().alias("google_search"))).alias("tools"))
    else:
        config.append(F.lit("application/json").alias("response_mime_type"))
    meta = [
        F.col("custom_id"),
        F.col("n_samples").cast("string").alias("n_samples"),
        F.when(F.col("prompt_key") == COMBINED, F.to_json("indicators")).alias("indicators"),
    ]
    if row_columns:
        data = F.to_json(F.struct(*row_columns), {"ignoreNullFields": "false"})
        meta.append(F.when(first, data).alias("row_data"))
    for name, source in (("search_queries", search_queries), ("search_urls", search_urls)):
        if source:
            meta.append(F.when(first, F.col(source)).alias(name))
    return requests.select(
        "custom_id",
        "row_idx",
        "sc_idx",
        F.array(F.struct(text(F.col("user_prompt")).alias("parts"), F.lit("user").alias("role"))).alias("contents"),
        F.struct(*config).alias("config"),
        F.struct(*meta).alias("metadata"),
    )


def request_line(df: DataFrame) -> Column:
    return F.to_json(F.struct("contents", "config", "metadata"))


def pack_chunks(
    sized: DataFrame,
    cap_bytes: int = MAX_CHUNK_BYTES,
    order: Sequence[str] = ("row_idx", "sc_idx"),
    size: str = "n_bytes",
    shard: Column | None = None,
    n_shards: int | None = None,
    chunks_per_shard: int = 4,
) -> DataFrame:
    """Give every request a chunk id so that no chunk is larger than the cap.

    Requests are spread over shards by row (samples of a row stay together). Inside a shard a running byte sum
    is cut at a stride of cap - largest request: a chunk then holds at most stride bytes of starts plus the one
    request that crosses its end, which is never more than the cap. Requests above half the cap get a chunk of
    their own, so the stride is at least half the cap and one that exceeds the cap by itself stays alone.

    Total size and largest request are asked for first (two numbers); shards are made so many that each holds a
    few chunks, whatever the size of the table. Numbering inside a shard spills to disk, it is not held in memory.
    """
    large = F.col(size) > F.lit(cap_bytes) / 2
    small = F.when(~large, F.col(size)).otherwise(0)
    known = sized.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"), F.coalesce(F.max(small), F.lit(0)).alias("largest")).first()
    if n_shards is None:
        n_shards = max(1, -(-int(known["total"]) // (cap_bytes * chunks_per_shard)))
    shard = F.pmod(F.xxhash64(order[0]), F.lit(n_shards)) if shard is None else shard
    tagged = sized.withColumn("shard", shard.cast("int")).repartition(n_shards, "shard")
    whole = Window.partitionBy("shard").orderBy(*order)
    before = F.coalesce(F.sum(small).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stride = F.lit(cap_bytes - int(known["largest"]))
    # Large requests are numbered among themselves; their chunk ids carry another mark.
    alone = F.sum(F.when(large, 1).otherwise(0)).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    return tagged.withColumn(
        "chunk",
        F.when(large, F.concat_ws("-", F.col("shard"), F.lit("x"), alone)).otherwise(
            F.concat_ws("-", F.col("shard"), F.lit("c"), F.floor(before / stride).cast("bigint"))
        ),
    )


def next_fit_chunks(
    sized: DataFrame, cap_bytes: int = MAX_CHUNK_BYTES, order: Sequence[str] = ("row_idx", "sc_idx"), size: str = "n_bytes",
) -> DataFrame:
    """Chunk 0, 1, .. of every request as sequential next-fit cuts them: a chunk is closed by the first request that no
    longer fits. A request above the cap stays alone. `order` must be a total order; null sizes count 0.

    Next-fit looks sequential, but where a chunk that starts at a given request ends does not depend on the chunks before
    it. So every request gets a pointer to the first one that a chunk started at it could not hold, found by an as-of
    match on prefix sums inside byte ranges of one cap each. The starts are the requests on the path of pointers from
    request 0; they are marked by pointer doubling, in as many rounds of narrow joins as the number of chunks has binary
    digits. Needs no shards, unlike `pack_chunks`, which cuts at a stride and shuffles once.
    """
    spark = sized.sparkSession
    folder = run_folder(spark, "next-fit")
    spot, n_bytes, upto, chunk = "_spot", "_n_bytes", "_upto", "chunk"
    placed = with_row_index(sized.withColumn(n_bytes, F.coalesce(F.col(size), F.lit(0)).cast("bigint")), order, spot)
    # Running byte sums: inside blocks of positions, then over the sums of the blocks.
    block = F.floor(F.col(spot) / ROWS_PER_BLOCK)
    inside = Window.partitionBy("_block").orderBy(spot)
    running = placed.withColumn("_block", block).withColumn("_in", F.sum(n_bytes).over(inside))
    sums = placed.groupBy(block.alias("_block")).agg(F.sum(n_bytes).alias("_sum"))
    # One row per block of positions, narrow.
    offsets = sums.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_offset"))
    running.join(offsets, "_block").withColumn(upto, F.col("_offset") + F.col("_in")).drop("_block", "_in", "_offset").write.parquet(f"{folder}/placed")
    rows = spark.read.parquet(f"{folder}/placed")

    # As-of match: for a start, the last request whose end lies within the cap behind the start's own beginning.
    ends = rows.select(F.col(upto).alias("at"), F.lit(0).alias("kind"), F.col(spot).alias("i"))
    limits = rows.select((F.col(upto) - F.col(n_bytes) + F.lit(cap_bytes)).alias("at"), F.lit(1).alias("kind"), F.col(spot).alias("i"))
    points = ends.unionByName(limits).withColumn("range", F.floor(F.col("at") / F.lit(cap_bytes)))
    so_far = Window.partitionBy("range").orderBy("at", "kind", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = points.withColumn("last", F.max(F.when(F.col("kind") == 0, F.col("i"))).over(so_far)).where("kind = 1")
    # Ranges with no end before the limit take the last end of earlier ranges; one row per range of one cap.
    tops = points.groupBy("range").agg(F.max(F.when(F.col("kind") == 0, F.col("i"))).alias("top"))
    earlier = tops.select("range", F.max("top").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    reach = F.coalesce("last", "earlier", F.lit(-1))
    pointers = here.join(earlier, "range").select("i", F.greatest(F.col("i"), reach).alias("end")).select("i", (F.col("end") + 1).alias("to"))
    pointers.write.parquet(f"{folder}/jump-0")
    # The path from request 0, doubled in length each round.
    spark.range(1).select(F.col("id").alias("i")).write.parquet(f"{folder}/starts-0")
    n = 0
    while True:
        jump, starts = spark.read.parquet(f"{folder}/jump-{n}"), spark.read.parquet(f"{folder}/starts-{n}")
        more = starts.join(jump, "i").select(F.col("to").alias("i"))
        # Beyond the last request there is nothing to point from.
        more = more.join(rows.select(F.col(spot).alias("i")), "i", "left_semi")
        starts.unionByName(more).distinct().write.parquet(f"{folder}/starts-{n + 1}")
        if spark.read.parquet(f"{folder}/starts-{n + 1}").count() == starts.count():
            break
        twice = jump.select("i", F.col("to").alias("via")).join(jump.select(F.col("i").alias("via"), "to"), "via").select("i", "to")
        twice.write.parquet(f"{folder}/jump-{n + 1}")
        n += 1
    marked = rows.join(spark.read.parquet(f"{folder}/starts-{n}").select(F.col("i").alias(spot), F.lit(1).alias("_start")), spot, "left")
    # Chunk numbers: starts counted inside blocks of positions, then over blocks.
    numbered = marked.withColumn("_block", block).withColumn("_in", F.count("_start").over(inside))
    begun = marked.groupBy(block.alias("_block")).agg(F.count("_start").alias("_n"))
    before = begun.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_offset"))
    numbered = numbered.join(before, "_block").withColumn(chunk, F.col("_offset") + F.col("_in") - 1)
    return numbered.drop("_block", "_in", "_offset", "_start", spot, n_bytes, upto)


def uses_search(requests: DataFrame) -> DataFrame:
    """Whether any request asks for a search tool (all requests are looked at)."""
    fields = requests.schema["config"].dataType.names
    used = F.size("config.tools") > 0 if "tools" in fields else F.lit(False)
    return requests.agg(F.coalesce(F.bool_or(F.coalesce(used, F.lit(False))), F.lit(False)).alias("uses_search"))


def sample_counts(requests: DataFrame) -> DataFrame:
    """Smallest and largest embedded n_samples; they must be the same."""
    n = F.col("metadata.n_samples").try_cast("int")
    return requests.agg(F.min(n).alias("min_n"), F.max(n).alias("max_n"), F.count(F.lit(1)).alias("n_requests"))


def check_sample_count(requests: DataFrame, n_samples: int) -> DataFrame:
    found = sample_counts(requests).first()
    if found["n_requests"] == 0:
        raise ValueError("no requests found")
    if found["min_n"] is not None and (found["min_n"], found["max_n"]) != (n_samples, n_samples):
        raise ValueError(f"requests embed n_samples {found['min_n']}..{found['max_n']}, not {n_samples}")
    return requests


def embedded_rows(requests: DataFrame, schema: str) -> DataFrame:
    """Input rows rebuilt from the copies inside the requests; only rows that are present."""
    from quorate.operators.votes import last_per_key

    first = requests.where((F.col("sc_idx") == 0) & F.col("metadata.row_data").isNotNull())
    rows = first.select("row_idx", F.from_json("metadata.row_data", schema).alias("row"), F.col("custom_id").alias("_order"))
    return last_per_key(rows, ["row_idx"], "_order").select("row_idx", "row.*")
