"""Reading model answers: JSON out of text, labels, confidence, document fields.

All of it is JVM-side. An answer is parsed once into map<string,string>; the other functions look keys up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions.values import NUMBER, WHOLE, clean_years, number, strip, truncated

STRICT_JSON = {"allowSingleQuotes": "false"}


def parse_answer(text: Column) -> Column:
    """First JSON object in the text as map<string,string>; null when there is none.

    from_json stops at the end of the object it starts on, so fences, prose before and prose after need no
    removal: the parse starts at the first "{". Braces inside strings are handled by the JSON reader.
    A key given twice stays twice; see `last_key_wins`.
    """
    at = F.instr(text, "{")
    return F.from_json(F.when(at > 0, F.substr(text, at)), "map<string,string>", STRICT_JSON)


def parse_typed(text: Column, schema: str) -> Column:
    """The same object read into a fixed schema (see Registry.answer_schema); fields that do not fit are null."""
    at = F.instr(text, "{")
    return F.from_json(F.when(at > 0, F.substr(text, at)), schema, STRICT_JSON)


def last_key_wins(parsed: Column) -> Column:
    """Collapse repeated keys of a parsed answer to their last value."""
    keys = F.map_keys(parsed)
    unique = F.array_distinct(keys)

    def last_value(key: Column) -> Column:
        same = F.filter(F.map_entries(parsed), lambda e: e["key"] == key)
        return F.element_at(same, -1)["value"]

    return F.when(F.size(unique) < F.size(keys), F.map_from_arrays(unique, F.transform(unique, last_value))).otherwise(
        parsed
    )


def extract_json_text(text: Column) -> Column:
    """The text from the first "{" to the brace that closes it, else to the last "}", else the input.

    Depth is followed over the pieces between "}" marks, not over single characters, and only for texts with
    more than one of them.
    """
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    pieces = F.split(span, r"\}")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        opened = F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        depth = acc["depth"] + opened - 1
        pos = acc["pos"] + F.length(piece) + 1
        end = F.when(acc["end"] > 0, acc["end"]).when(depth == 0, pos).otherwise(0)
        return F.struct(depth.alias("depth"), pos.alias("pos"), end.alias("end"))

    # The piece after the last "}" is empty and closes nothing.
    closed = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step)["end"]
    several = F.length(span) - F.length(F.replace(span, F.lit("}"), F.lit(""))) > 1
    cut = F.when(several & (closed > 0), F.substring(span, F.lit(1), closed)).otherwise(span)
    return F.when(span == "", text).otherwise(cut)


def has_key(parsed: Column, key: Column | str) -> Column:
    return F.map_contains_key(parsed, key if isinstance(key, Column) else F.lit(key))


def get_key(parsed: Column, key: Column | str) -> Column:
    return F.try_element_at(parsed, key if isinstance(key, Column) else F.lit(key))


def was_quoted(text: Column, key: Column | str) -> Column:
    """Whether the value of a key stands in quotes in the raw text.

    map<string,string> cannot tell "true" from true or "85.5" from 85.5. Asked only for those rare values.
    """
    name = key if isinstance(key, Column) else F.lit(key)
    return F.regexp_like(text, F.concat(F.lit('"'), name, F.lit('"\\s*:\\s*"')))


def _plus(name: Column, suffix: str) -> Column:
    return F.concat(name, F.lit(suffix))


def pick_label(value: Column, labels: Column, quoted: Column | None = None) -> Column:
    """One valid label from a raw value, or null.

    In this order: the value itself, its number cut to a whole one, its leading digits.
    """
    quoted = F.lit(False) if quoted is None else quoted
    whole = truncated(value).cast("string")
    lead = F.regexp_extract(value, r"^\s*([0-9]+)", 1)
    truth = F.when(value == "true", "1").when(value == "false", "0")
    return (
        F.when(F.array_contains(labels, value), value)
        .when(value.isin("true", "false"), F.when(F.array_contains(labels, truth) & ~quoted, truth))
        .when(F.array_contains(labels, whole), whole)
        .when(F.array_contains(labels, lead), lead)
    )


def pick_labels(value: Column, labels: Column) -> Column:
    """Multi-select: valid distinct labels of a JSON list in numeric order, written "[2, 4]"."""
    items = F.from_json(value, "array<string>")
    valid = F.filter(items, lambda x: F.array_contains(labels, x))
    ordered = F.array_sort(F.array_distinct(F.transform(valid, lambda x: x.try_cast("int"))))
    # Joining nothing gives "", which stands for no valid label.
    joined = F.array_join(ordered.cast("array<string>"), ", ")
    return F.concat(F.lit("["), F.nullif(joined, F.lit("")), F.lit("]"))


def label_key(parsed: Column, indicator: Column) -> Column:
    """Key that holds the label: the indicator's name, else name + "_prediction"."""
    return F.when(get_key(parsed, indicator).isNotNull(), indicator).otherwise(_plus(indicator, "_prediction"))


def read_label(value: Column, labels: Column, text: Column, key: Column) -> Column:
    """Label from the raw value under `key`; a list value is read as multi-select."""
    is_list = F.ltrim(value).startswith("[") & F.from_json(value, "array<string>").isNotNull()
    return F.when(is_list, pick_labels(value, labels)).otherwise(pick_label(value, labels, was_quoted(text, key)))


def read_reasoning(parsed: Column, indicator: Column) -> Column:
    """Reasoning text; the first key that is present wins, even when its value is null."""
    own = _plus(indicator, "_reasoning")
    return (
        F.when(has_key(parsed, "reasoning"), get_key(parsed, "reasoning"))
        .when(has_key(parsed, own), get_key(parsed, own))
        .otherwise(F.lit(""))
    )


def confidence_key(parsed: Column, indicator: Column) -> Column:
    """The first confidence key that is present decides."""
    own = _plus(indicator, "_confidence")
    return (
        F.when(has_key(parsed, "confidence_score"), F.lit("confidence_score"))
        .when(has_key(parsed, own), own)
        .otherwise(_plus(indicator, "_confidence_score"))
    )


def read_score(value: Column, text: Column, key: Column | str) -> Column:
    """Whole number 1..100. Text in quotes must be whole; a bare decimal is cut."""
    quoted = was_quoted(text, key)
    score = (
        F.when(value.rlike(WHOLE), value.try_cast("double"))
        .when(value.rlike(NUMBER), F.when(~quoted, value.try_cast("double")))
        .when(value.isin("true", "false"), F.when(~quoted, (value == "true").cast("double")))
    )
    # least and greatest pass over nulls, so a missing score is kept out of them.
    return F.when(score < 1, 1).when(score > 100, 100).otherwise(score.cast("int"))


def read_dependent(parsed: Column, name: str, labels: Column, invalid_as: str | None = None) -> Column:
    """Exact label of a dependent indicator; anything else becomes `invalid_as`."""
    value = get_key(parsed, name)
    return F.when(F.array_contains(labels, value), value).otherwise(F.lit(invalid_as).cast("string"))


def read_documents(parsed: Column, text: Column) -> Column:
    """Document answer as struct<prediction, document_name, document_types, document_years, reasoning, confidence>.

    `document_types` is null unless every part is 0, 1 or 2. A stated label wins over the highest type.
    """
    raw = F.lower(strip(F.coalesce(get_key(parsed, "constitution"), get_key(parsed, "constitution_status"))))
    cut = truncated(raw).cast("string")
    stated = (
        F.when(raw.isin("0", "1", "2"), raw)
        .when(raw.isin("yes", "true"), "2")
        .when(raw.isin("no", "false"), "0")
        .when(cut.isin("0", "1", "2"), cut)
    )
    name = strip(get_key(parsed, "document_name"))

    types_text = strip(get_key(parsed, "document_types"))
    types = F.transform(
        F.filter(F.transform(F.split(types_text, ";"), strip), lambda p: p != ""), lambda p: truncated(p)
    )
    types_good = (
        ~F.lower(types_text).isin("n/a", "none", "", "null")
        & (F.size(types) > 0)
        & F.forall(types, lambda t: F.coalesce(t.isin(0, 1, 2), F.lit(False)))
    )
    kept_types = F.when(types_good, types)

    years_text = strip(get_key(parsed, "constitution_year"))
    years = F.when(~F.lower(years_text).isin("null", "none", "", "n/a"), clean_years(years_text))

    reasoning = (
        F.when(has_key(parsed, "reasoning"), get_key(parsed, "reasoning"))
        .when(has_key(parsed, "constitution_reasoning"), get_key(parsed, "constitution_reasoning"))
        .when(has_key(parsed, "explanation"), get_key(parsed, "explanation"))
        .otherwise(F.lit(""))
    )

    def usable(key: str) -> Column:
        """Null, "", false and a bare zero give way to the next key."""
        value = get_key(parsed, key)
        empty = (value == "") | (value.isin("false") & ~was_quoted(text, key)) | (
            (number(value) == 0) & ~was_quoted(text, key)
        )
        return F.when(~F.coalesce(empty, F.lit(False)), value)

    first, second = usable("confidence_score"), get_key(parsed, "constitution_confidence_score")
    score_key = F.when(first.isNotNull(), "confidence_score").otherwise("constitution_confidence_score")
    score = F.coalesce(first, second)

    return F.struct(
        F.coalesce(stated, F.array_max(kept_types).cast("string")).alias("prediction"),
        F.coalesce(F.when(name != "", name), F.lit("N/A")).alias("document_name"),
        F.array_join(kept_types.cast("array<string>"), "; ").alias("document_types"),
        years.alias("document_years"),
        reasoning.alias("reasoning"),
        read_score(score, text, score_key).alias("confidence"),
    )


def parse_short(text: Column) -> Column:
    """Short JSON answer as map<string,string>: the whole text without fences, else the first brace pair in it."""
    fenced = F.contains(text, F.lit("```"))
    bare = F.when(fenced, strip(F.regexp_replace(text, r"```(?:json)?\s*", ""))).otherwise(strip(text))
    whole = F.when(bare.startswith("{") & bare.endswith("}"), F.from_json(bare, "map<string,string>", STRICT_JSON))
    return F.coalesce(whole, F.from_json(F.regexp_extract(bare, r"\{[^}]+\}", 0), "map<string,string>", STRICT_JSON))


def read_field(text: Column, name: str) -> Column:
    """One field of a short JSON answer; null when absent or unreadable."""
    return get_key(parse_short(text), name)
