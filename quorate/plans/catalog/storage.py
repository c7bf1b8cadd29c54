"""Sources and sinks: each query writes a derived table to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.operators.repair import retry_requests
from quorate.operators.rows import with_row_index
from quorate.plans.catalog import query
from quorate.plans.catalog.fixtures import DOCUMENTS_WIDE, REPROCESSED, RULERS, VOTES, Fixture, table, with_ctes
from quorate.session import run_folder
from quorate.sources import sinks, tables
from quorate.sources.ranged import read_ranged, save_ranged
from quorate.sources.ranged import upsert_stored as upsert_stored_table

# Whole texts with quotes, line breaks and blanks at the ends.
NOTES = Fixture("notes", "documents", {"doc_id": "doc_id", "note": "' \"' || coalesce(text, '') || '\"' || chr(10) || source || ', '", "lang": "lang"})
NOTES_SCHEMA = "doc_id bigint, note string, lang string"
ACCENTS = Fixture("accents", "documents", {"doc_id": "cast(doc_id as string)", "note": "'é \"' || lang || '\"' || chr(10) || 'ü, ' || source"})
LINES = Fixture(
    "request_lines", "documents",
    {
        "row_idx": "doc_id",
        "value": "'{\"contents\":[{\"parts\":[{\"text\":\"' || lang || ' ' || cast(n_chars as string) || '\"}],\"role\":\"user\"}],"
        "\"config\":{\"temperature\":1.0,\"tools\":[{\"google_search\":{}}],\"seed\":' || cast(doc_id % 7 as string) || '},"
        "\"metadata\":{\"custom_id\":\"' || cast(doc_id as string) || '|single|' || cast(sc_idx as string) || '\",\"n_samples\":\"2\",\"owner\":\"' || source || '\"}}'",
    },
    samples=3,
)
STORED = Fixture("stored", "documents", {"row_idx": "doc_id", "label": "lang"})


@query("csv_round_trip", with_ctes([NOTES], "select * from notes"))
def csv_round_trip(spark, sf):
    folder = run_folder(spark, "notes")
    sinks.save_results(NOTES.df(spark, sf), folder, ["parquet", "csv"])
    return tables.load_table(spark, f"{folder}/csv", NOTES_SCHEMA, kind="csv")


@query("json_round_trip", with_ctes([NOTES], "select * from notes"))
def json_round_trip(spark, sf):
    folder = run_folder(spark, "notes")
    sinks.save_results(NOTES.df(spark, sf), folder, ["parquet", "json"])
    return tables.load_table(spark, f"{folder}/json", NOTES_SCHEMA, kind="json")


@query("csv_as_json_lines", with_ctes([NOTES], "select * from notes"))
def csv_as_json_lines(spark, sf):
    folder = run_folder(spark, "notes")
    sinks.save_results(NOTES.df(spark, sf), folder, ["parquet", "csv"])
    tables.csv_to_jsonl(spark, f"{folder}/csv", f"{folder}/lines.jsonl", NOTES_SCHEMA, kind="csv")
    return tables.load_table(spark, f"{folder}/lines.jsonl", NOTES_SCHEMA)


@query("charset_round_trip", with_ctes([ACCENTS], "select * from accents"))
def charset_round_trip(spark, sf):
    folder = run_folder(spark, "accents")
    ACCENTS.df(spark, sf).write.options(header=True, escape='"', encoding="ISO-8859-1").csv(f"{folder}/latin.csv")
    tables.convert_charset(spark, f"{folder}/latin.csv", "ISO-8859-1", f"{folder}/utf8.csv")
    return tables.load_table(spark, f"{folder}/utf8.csv", infer=False)


@query("rulers_loaded", with_ctes([RULERS], "select polity_name, polity_region, leader_name, leader_first_year, leader_last_year from rulers"))
def rulers_loaded(spark, sf):
    folder = run_folder(spark, "rulers")
    columns = ["polity_name", "polity_region", "leader_name", "leader_first_year", "leader_last_year"]
    RULERS.df(spark, sf).select(*columns).write.option("header", True).csv(f"{folder}/rulers.csv")
    return tables.load_rulers(spark, f"{folder}/rulers.csv")


@query(
    "unreadable_lines",
    with_ctes([LINES], "select 'good' as kind, count(*) as n from request_lines where row_idx % 10 <> 0 union all select 'bad', count(*) from request_lines where row_idx % 10 = 0"),
)
def unreadable_lines(spark, sf):
    folder = run_folder(spark, "lines")
    broken = F.when(F.col("row_idx") % 10 == 0, F.expr("left(value, 40)")).otherwise(F.col("value"))
    LINES.df(spark, sf).select(broken.alias("value")).write.text(folder)
    good, bad = tables.load_jsonl_split(spark, folder, tables.REQUESTS)
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(good, "good").unionByName(count(bad, "bad"))


@query("retry_lines", with_ctes([LINES], "select value from request_lines where row_idx % 5 = 0"))
def retry_lines(spark, sf):
    folder = run_folder(spark, "requests")
    LINES.df(spark, sf).select("value").write.text(f"{folder}/all")
    requests = tables.load_requests(spark, f"{folder}/all", n_samples=2)
    failed = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx")).where("row_idx % 5 = 0")
    sinks.save_requests(retry_requests(requests, failed), f"{folder}/retry")
    return spark.read.text(f"{folder}/retry")


@query("appended_rows", with_ctes([STORED], "select * from stored"))
def appended_rows(spark, sf):
    """The odd rows first, then all of them: each is stored once."""
    folder = run_folder(spark, "stored")
    rows = STORED.df(spark, sf)
    sinks.append_new(rows.where("row_idx % 2 = 1"), folder)
    sinks.append_new(rows, folder)
    return spark.read.parquet(folder)


@query("bucketed_votes", with_ctes([VOTES], "select row_idx, indicator, count(prediction) as n_votes from votes3 group by 1, 2"))
def bucketed_votes(spark, sf):
    name = run_folder(spark, "votes").rsplit("/", 1)[1].replace("-", "_")
    sinks.save_bucketed(VOTES.df(spark, sf), name, ["row_idx"], 8)
    return spark.table(name).groupBy("row_idx", "indicator").agg(F.count("prediction").alias("n_votes"))


@query("ordered_results", with_ctes([STORED], "select format, row_idx, row_number() over (partition by format order by row_idx) - 1 as place from stored cross join (values ('csv'), ('json')) f(format)"))
def ordered_results(spark, sf):
    """Text formats written in order: the place of each row counted through the files by name."""
    folder = run_folder(spark, "ordered")
    rows = STORED.df(spark, sf)
    sinks.save_results(rows.repartition(5, "label"), folder, order="row_idx")
    out = []
    for kind, number in (("csv", r"^(\d+),"), ("json", r'"row_idx":(\d+)')):
        place = tables.arrival()
        lines = spark.read.text(f"{folder}/{kind}").select(place["file"].alias("file"), place["block"].alias("block"), place["line"].alias("line"), F.regexp_extract("value", number, 1).alias("n"))
        placed = with_row_index(lines.where("n <> ''"), ["file", "block", "line"], "place")
        out.append(placed.select(F.lit(kind).alias("format"), F.col("n").cast("bigint").alias("row_idx"), F.col("place").cast("bigint").alias("place")))
    return out[0].unionByName(out[1])


@query(
    "upsert_stored",
    with_ctes(
        [DOCUMENTS_WIDE, REPROCESSED,
         """best as (select * from (select *, row_number() over (partition by row_idx order by attempt desc) rn from reprocessed
            where sovereign_confidence <> -1 and row_idx % 1000 < 400) where rn = 1)"""],
        """select w.row_idx, w.constitution_prediction, case when b.row_idx is not null then b.sovereign_prediction else w.sovereign_prediction end as sovereign_prediction,
        case when b.row_idx is not null then b.sovereign_confidence else w.sovereign_confidence end as sovereign_confidence
        from documents_wide w left join best b on w.row_idx = b.row_idx""",
    ),
)
def upsert_stored(spark, sf):
    """A stored table repaired in some of its ranges; the files of the others stay."""
    folder = run_folder(spark, "ranged")
    old = DOCUMENTS_WIDE.df(spark, sf).select("row_idx", "constitution_prediction", "sovereign_prediction", "sovereign_confidence")
    save_ranged(old, folder, width=200)
    again = REPROCESSED.df(spark, sf).where("row_idx % 1000 < 400").select("row_idx", "attempt", "sovereign_prediction", "sovereign_confidence")
    upsert_stored_table(spark, folder, again, "attempt", update=["sovereign_prediction", "sovereign_confidence"], confidence="sovereign_confidence")
    return read_ranged(spark, folder)
