"""Value cleaning: sentinels, labels, years, names, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value" in annotated tables.
MISSING_WORDS = ("", "nan", "none", "n/a", "na", "null", "<na>")

# A plain decimal number. Guards casts that would also take "1d", "0x1p3" or "inf".
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"
# ASCII white space.
BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.trim(text, F.lit(BLANKS))


def number(text: Column) -> Column:
    """Text to double; anything but a plain number is null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def truncated(text: Column) -> Column:
    """Number text to bigint, cut towards zero."""
    return number(text).try_cast("bigint")


def to_label(value: Column) -> Column:
    """"1.0", "1" and 1.0 all become "1"; other text stays."""
    text = value.cast("string")
    return F.coalesce(truncated(text).cast("string"), text)


def is_missing(value: Column) -> Column:
    return value.isNull() | F.lower(strip(value.cast("string"))).isin(*MISSING_WORDS)


def na_to_null(value: Column) -> Column:
    """Trim; "NA" and "" become null."""
    text = strip(value.cast("string"))
    return F.when(~F.upper(text).isin("NA", ""), text)


def upper_first(text: Column) -> Column:
    """Capitalise the first character and leave the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def list_parts(text: Column) -> Column:
    """Non-blank trimmed parts of a ";" list; a missing value is the empty list."""
    parts = F.filter(F.transform(F.split(text.cast("string"), ";"), strip), lambda p: p != "")
    return F.when(is_missing(text), F.array().cast("array<string>")).otherwise(parts)


def clean_years(text: Column) -> Column:
    """First signed whole number of each ";" part; a part without one stays as text.

    Words like "c." or "circa" before the number need no pass of their own: they hold neither digits nor a
    minus sign, so the first number found is the same with or without them.
    """
    parts = F.filter(F.transform(F.split(text, ";"), strip), lambda p: p != "")

    def year(part: Column) -> Column:
        found = F.regexp_extract(part, r"(-?\d+)", 1)
        return F.when(found != "", found).otherwise(part)

    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, year), "; ")).otherwise(text)


def row_id(*keys: Column) -> Column:
    """Stable id from key values (null differs from empty)."""
    marked = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("~")) for k in keys]
    return F.sha2(F.concat_ws("\u001f", *marked), 256)


def request_id(row: Column, indicator: Column, sample: Column) -> Column:
    """"row|indicator|sample"."""
    return F.concat_ws("|", row.cast("string"), indicator, sample.cast("string"))


def request_id_parts(cid: Column) -> dict[str, Column]:
    """Columns of a request id; all null when it does not have three parts and two whole numbers."""
    parts = F.split(cid, r"\|")
    row = F.try_element_at(parts, F.lit(1)).try_cast("bigint")
    sample = F.try_element_at(parts, F.lit(3)).try_cast("int")
    good = (F.size(parts) == 3) & row.isNotNull() & sample.isNotNull()
    return {
        "row_idx": F.when(good, row),
        "indicator": F.when(good, F.try_element_at(parts, F.lit(2))),
        "sc_idx": F.when(good, sample),
    }


# Prefixes and marks that tell the provider of a model id.
HOSTED_ARN = "arn:aws:bedrock"
HOSTED_VENDORS = ("anthropic.", "amazon.", "meta.", "cohere.", "ai21.", "mistral.")
HOSTED_REGIONS = ("us.", "global.", "eu.", "ap.")
HOSTED_REGIONAL_VENDORS = ("anthropic.", "amazon.", "meta.")


def provider_of(model: Column) -> Column:
    """Provider name of a model id or ARN."""
    low = F.lower(model)
    prefixes = list(HOSTED_VENDORS) + [r + v for r in HOSTED_REGIONS for v in HOSTED_REGIONAL_VENDORS]
    hosted = F.lit(False)
    for p in prefixes:
        hosted = hosted | low.startswith(p)
    return (
        F.when(model.startswith(HOSTED_ARN) | hosted, "bedrock")
        .when(low.contains("claude-"), "anthropic")
        .when(low.contains("gemini-"), "gemini")
        .when(model.isNotNull(), "openai")
    )


def round3(value: Column) -> Column:
    """Three decimals, half to even."""
    return F.bround(value, 3)
