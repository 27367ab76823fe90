"""JSON and time text as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}
NULL_TOKEN = "\\N"
EMPTY_MAP = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(EMPTY_MAP)


# Text that JSON quotes without any escape.
PLAIN = r'^[^"\\\x00-\x1f]*$'


def json_string(value: Column) -> Column:
    """Quoted and escaped JSON string; NULL gives null. Only text with something to escape meets the JSON writer."""
    escaped = F.btrim(F.to_json(F.array(value)), F.lit("[]"))
    return F.when(value.isNull(), "null").when(value.rlike(PLAIN), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(escaped)


def json_fields(*columns: Column) -> Column:
    """`"a":1,"b":null` without the braces. The first key and the last value never start or end with a brace."""
    return F.btrim(F.to_json(F.struct(*columns), KEEP_NULLS), F.lit("{}"))


def json_map(values: Column) -> Column:
    """JSON object from a row map, in map order, values copied as they are."""
    entries = F.transform(
        F.map_entries(values),
        lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null"))),
    )
    return F.coalesce(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")), F.lit("null"))


def json_changes(changes: Column) -> Column:
    items = F.transform(
        changes,
        lambda c: F.concat(
            F.lit('{"name":'), json_string(c["name"]),
            F.lit(',"old_value":'), F.coalesce(c["old_value"], F.lit("null")),
            F.lit(',"new_value":'), F.coalesce(c["new_value"], F.lit("null")), F.lit("}"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def canonical_map(values: Column) -> Column:
    """Key-sorted text of a row map, for hashing and comparison only."""
    return F.to_json(F.sort_array(F.map_entries(values)), KEEP_NULLS)


def identity_text(*parts: Column) -> Column:
    """One string from many values; NULL becomes a token so that shifted fields cannot look alike."""
    return F.concat_ws("|", *[F.coalesce(part.cast("string"), F.lit(NULL_TOKEN)) for part in parts])


def unquoted(literal: Column) -> Column:
    """Text of a JSON literal: strings lose their quotes, other literals stay."""
    parsed = F.get_json_object(F.concat(F.lit("["), literal, F.lit("]")), "$[0]")
    inner = F.substring(literal, F.lit(2), F.length(literal) - 2)
    return F.when(~literal.startswith('"'), literal).when(~literal.contains("\\"), inner).otherwise(parsed)


def iso8601(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_time(text: Column) -> Column:
    """ISO-8601 with date, time and offset; anything else gives NULL."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
    return F.when(text.rlike(shape), F.try_to_timestamp(text))


def iso8601_utc(text: Column) -> Column:
    """Any offset to UTC text at second precision; bad text gives NULL."""
    return iso8601(parse_time(text))


def epoch_seconds(text: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(text))


def literal_map(values: Column) -> Column:
    """Parsed JSON object (map of variants) to a row map of literal text."""
    return F.transform_values(values, lambda _k, v: F.nullif(F.to_json(v), F.lit("null")))


def without_keys(values: Column, *keys: str) -> Column:
    return F.map_filter(values, lambda k, _v: ~k.isin(*keys))


def put(values: Column, key: str, value: Column) -> Column:
    """Map with one key set; the key is dropped first because a repeated key raises."""
    base = F.coalesce(values, empty_map())
    return F.map_concat(without_keys(base, key), F.create_map(F.lit(key), value))
