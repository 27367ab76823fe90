"""Persisted payloads back to change events. A bad payload is set aside with its reason, or fails the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions import text as T
from changeflow.schemas import CHANGES

# Payload fields that are copied into the metadata when present.
COPIED_TO_METADATA = ("event_id", "source", "source_position", "changes", "type")

_OBJECT = "map<string,variant>"
# Plain text fields lose their quotes in parsing; fields that are copied as they are stay variants.
_EVENT = f"""
    operation string, namespace string, schema string, entity string, `table` string,
    identity {_OBJECT}, primary_key {_OBJECT}, data {_OBJECT}, old_values {_OBJECT}, new_values {_OBJECT},
    transaction_id string, commit_lsn string, sequence_number string, occurred_at string, metadata {_OBJECT},
    event_id variant, source variant, source_position variant, changes variant, type variant
"""
_ROW_FIELDS = ("data", "identity", "primary_key", "old_values", "new_values", "metadata")
_TRANSACTION = "transaction_id string, commit_lsn string, source_position string, committed_at string, events array<string>"


def _literal(value: Column) -> Column:
    return F.nullif(F.to_json(value), F.lit("null"))


def _changes(value: Column) -> Column:
    parsed = F.from_json(F.to_json(value), "array<struct<name:string,old_value:variant,new_value:variant>>")
    return F.transform(parsed, lambda c: F.struct(
        c["name"].alias("name"), _literal(c["old_value"]).alias("old_value"), _literal(c["new_value"]).alias("new_value"),
    )).cast(CHANGES)


def _has(keys: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(keys, F.lit(key)), F.lit(False))


def enrich_metadata(metadata: Column, keys: Column, fields: dict[str, Column]) -> Column:
    """Metadata plus the copied fields, when the payload has the key, even with a null value.

    `keys` are the payload's own keys and `fields` the copied fields as literal text. The copied keys
    are dropped from the metadata first, because a repeated key raises.
    """
    every = F.create_map(*[item for name in COPIED_TO_METADATA for item in (F.lit(name), fields[name])])
    copied = F.map_filter(every, lambda k, _v: F.array_contains(keys, k))
    base = F.coalesce(metadata, T.empty_map())
    kept = F.map_filter(base, lambda k, _v: ~(k.isin(*COPIED_TO_METADATA) & F.array_contains(keys, k)))
    return F.map_concat(kept, copied)


def _event_reason(text: Column, parsed: Column, keys: Column) -> Column:
    """Why an event payload is malformed; NULL for a good one."""
    time_text = parsed["occurred_at"]
    wrong_shape = F.lit(False)
    for name in _ROW_FIELDS:
        # Present, not parsed as an object, and not null either.
        unread = _has(keys, name) & parsed[name].isNull()
        wrong_shape = wrong_shape | F.when(unread, F.get_json_object(text, f"$.{name}").isNotNull()).otherwise(False)
    return (
        F.when(keys.isNull() | parsed.isNull(), "not a JSON object")
        .when(~_has(keys, "operation"), "missing operation")
        .when(parsed["namespace"].isNull() & ~_has(keys, "schema"), "missing namespace")
        .when(parsed["entity"].isNull() & ~_has(keys, "table"), "missing entity")
        .when(time_text.isNotNull() & T.parse_time(time_text).isNull(), "unreadable occurred_at")
        .when(wrong_shape, "wrong shape")
    )


def read_event_payloads(payloads: DataFrame, text: str = "payload_json") -> DataFrame:
    """Change-event columns from one JSON payload per row; `error_reason` is NULL for good rows."""
    # Exploding a one-element array keeps filters on the result above the parse. Pushed below it, a
    # filter would parse the text again for every field it looks at.
    once = F.struct(F.from_json(text, _EVENT, {"mode": "PERMISSIVE"}).alias("p"), F.json_object_keys(text).alias("keys"))
    parsed = payloads.select("*", F.inline(F.array(once)).alias("_p", "_keys"))
    keys = F.col("_keys")

    def field(name: str) -> Column:
        return F.col(f"_p.{name}")

    data = T.literal_map(field("data"))
    deleted = F.coalesce(field("operation") == "delete", F.lit(False))
    reason = _event_reason(F.col(text), F.col("_p"), keys)
    copied = {name: _literal(field(name)) for name in COPIED_TO_METADATA}
    keep = [c for c in payloads.columns if c != text]
    return parsed.select(
        *keep,
        field("operation").alias("operation"),
        F.coalesce(field("namespace"), field("schema")).alias("namespace"),
        F.coalesce(field("entity"), field("table")).alias("entity"),
        T.literal_map(F.coalesce(field("identity"), field("primary_key"))).alias("identity"),
        F.coalesce(T.literal_map(field("old_values")), F.when(deleted, data)).alias("old_values"),
        F.coalesce(T.literal_map(field("new_values")), F.when(~deleted, data)).alias("new_values"),
        field("transaction_id").alias("transaction_id"),
        F.coalesce(field("commit_lsn"), T.unquoted(copied["source_position"])).alias("commit_lsn"),
        field("sequence_number").try_cast("int").alias("sequence_number"),
        T.parse_time(field("occurred_at")).alias("occurred_at"),
        F.when(keys.isNotNull(), enrich_metadata(T.literal_map(field("metadata")), keys, copied)).alias("metadata"),
        F.when(_has(keys, "changes"), F.coalesce(_changes(field("changes")), F.array().cast(CHANGES)))
        .alias("explicit_changes"),
        reason.alias("error_reason"),
        F.col(text),
    )


def read_transaction_payloads(payloads: DataFrame, text: str = "payload_json") -> DataFrame:
    """One row per child event with its envelope's fields; an envelope without events gives one row with no child.

    The payload's place in its array is the sequence number where the child has none of its own. A broken child
    rejects its whole envelope: every row of it carries the first reason.
    """
    parsed = payloads.withColumn("_t", F.from_json(text, _TRANSACTION)).withColumn("_keys", F.json_object_keys(text))
    time_text = F.col("_t.committed_at")
    # Each child is parsed into a struct first, so that the fields looked at share one parse.
    children = F.transform("_t.events", lambda t: F.named_struct(
        F.lit("text"), t, F.lit("p"), F.from_json(t, _EVENT, {"mode": "PERMISSIVE"}), F.lit("keys"), F.json_object_keys(t)))
    broken = F.get(F.array_compact(F.transform(children, lambda c: _event_reason(c["text"], c["p"], c["keys"]))), F.lit(0))
    envelope = parsed.select(
        *[c for c in payloads.columns if c != text],
        F.col("_t.transaction_id").alias("envelope_transaction_id"),
        F.coalesce("_t.commit_lsn", "_t.source_position").alias("envelope_commit_lsn"),
        T.parse_time(time_text).alias("committed_at"),
        (
            F.when(F.col("_keys").isNull(), "not a JSON object")
            .when(~_has(F.col("_keys"), "transaction_id"), "missing transaction_id")
            .when(F.col("_t.events").isNull(), "missing events")
            .when(time_text.isNotNull() & T.parse_time(time_text).isNull(), "unreadable committed_at")
            .otherwise(F.concat(F.lit("broken event: "), broken))
        ).alias("envelope_error"),
        F.posexplode_outer(F.col("_t.events")).alias("position", text),
    )
    children = read_event_payloads(envelope, text)
    return children.withColumn("sequence_number", F.coalesce("sequence_number", "position")).withColumn(
        "error_reason", F.col("envelope_error")
    ).drop("position", "envelope_error")


def quarantine_malformed(read: DataFrame, mode: str = "split") -> tuple[DataFrame, DataFrame | None]:
    """Good rows and bad rows with their reason; mode="fail" raises on the first bad row instead."""
    if mode == "fail":
        message = F.concat(F.lit("invalid persisted change: "), F.col("error_reason"))
        checked = read.withColumn(
            "operation", F.when(F.col("error_reason").isNotNull(), F.raise_error(message)).otherwise(F.col("operation"))
        )
        return checked.drop("error_reason"), None
    good = read.where(F.col("error_reason").isNull()).drop("error_reason")
    return good, read.where(F.col("error_reason").isNotNull())


def load_payloads(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """JSON payload files: one payload per line, or one per file."""
    return spark.read.text(path, wholetext=whole_file).withColumnRenamed("value", "payload_json")


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Events and unwrapped envelopes as one feed; missing columns become NULL, missing feeds are ignored."""
    present = [feed for feed in feeds if feed is not None]
    result = present[0]
    for feed in present[1:]:
        result = result.unionByName(feed, allowMissingColumns=True)
    return result
