"""Canonical payload fields of one change event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeflow.functions import text as T
from changeflow.schemas import CHANGES

# The default source label and the type of a transaction payload.
DEFAULT_SOURCE = "postgresql"
TRANSACTION_TYPE = "transaction.committed"


def metadata_text(key: str, metadata: Column | None = None) -> Column:
    values = F.col("metadata") if metadata is None else metadata
    return T.unquoted(F.try_element_at(values, F.lit(key)))


def source_label() -> Column:
    return F.coalesce(metadata_text("source"), F.lit(DEFAULT_SOURCE))


def hashed_event_id() -> Column:
    """evt_ + sha256 over everything that tells one change from another, keys sorted."""
    identity = T.identity_text(
        source_label(), F.col("transaction_id"), F.col("commit_lsn"), F.col("sequence_number"),
        F.unix_micros("occurred_at"), F.col("namespace"), F.col("entity"), F.col("operation"),
        T.canonical_map(F.col("identity")), T.canonical_map(F.col("old_values")), T.canonical_map(F.col("new_values")),
    )
    return F.concat(F.lit("evt_"), F.sha2(identity, 256))


def event_id() -> Column:
    return F.coalesce(metadata_text("event_id"), hashed_event_id())


def event_data() -> Column:
    return F.coalesce(F.col("new_values"), F.col("old_values"), T.empty_map())


def occurred_at() -> Column:
    """Source time, else the stored ingest time, so that a re-run gives the same text."""
    return T.iso8601(F.coalesce(F.col("occurred_at"), F.col("ingested_at")))


def column_changes() -> Column:
    """Explicit changes win. An update needs the same columns on both sides; unchanged columns are left out."""
    old, new = F.col("old_values"), F.col("new_values")
    pairs = F.transform(
        F.map_keys(F.coalesce(new, old)),
        lambda k: F.struct(
            k.alias("name"),
            F.try_element_at(old, k).alias("old_value"),
            F.try_element_at(new, k).alias("new_value"),
        ),
    )
    changed = F.filter(pairs, lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
    same_columns = F.sort_array(F.map_keys(old)) == F.sort_array(F.map_keys(new))
    known = (F.col("operation") != "update") | F.coalesce(same_columns, F.lit(False))
    return F.coalesce(
        F.col("explicit_changes"),
        F.when(known, F.coalesce(changed, F.array().cast(CHANGES))).otherwise(F.array().cast(CHANGES)),
    )


def transaction_id_json(value: Column) -> Column:
    """Whole numbers are written bare, as the source's transaction counter is a number."""
    return F.when(value.rlike(r"^(0|[1-9][0-9]*)$"), value).otherwise(T.json_string(value))


def event_json() -> Column:
    """Compact JSON body from the twelve canonical payload columns."""
    return F.concat(
        F.lit("{"),
        T.json_fields(*[F.col(c) for c in ("event_id", "source", "operation", "namespace", "entity")]),
        F.lit(',"identity":'), T.json_map(F.col("identity")),
        F.lit(',"source_position":'), T.json_string(F.col("source_position")),
        F.lit(',"transaction_id":'), transaction_id_json(F.col("transaction_id")),
        F.lit(',"occurred_at":'), T.json_string(F.col("occurred_at")),
        F.lit(',"data":'), T.json_map(F.col("data")),
        F.lit(',"changes":'), T.json_changes(F.col("changes")),
        F.lit(',"metadata":'), T.json_map(F.col("metadata")),
        F.lit("}"),
    )


def payload_type() -> Column:
    return F.coalesce(F.col("type"), F.lit("event"))


def operation_or_type() -> Column:
    """What a dead letter shows as its operation."""
    return F.coalesce(F.col("operation"), F.col("type"))


def delivery_key() -> Column:
    """Key of a received delivery; NULL marks a row to set aside, never a random key."""
    return F.coalesce(F.col("event_id"), F.col("transaction_id"))
