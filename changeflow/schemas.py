"""Row types. Row maps hold JSON literal text: "paid" keeps its quotes, 4999 has none, JSON null is NULL."""

from __future__ import annotations

ROW_MAP = "map<string,string>"
CHANGES = "array<struct<name:string,old_value:string,new_value:string>>"

CHANGE_EVENT = f"""
    source_name string, slot_name string, seq bigint,
    transport_lsn string, commit_lsn string, transaction_id string, sequence_number int,
    operation string, namespace string, entity string,
    identity {ROW_MAP}, old_values {ROW_MAP}, new_values {ROW_MAP},
    occurred_at timestamp, ingested_at timestamp, metadata {ROW_MAP}, explicit_changes {CHANGES}
"""

TXN_HEADER = f"""
    source_name string, slot_name string, group_seq bigint, transaction_id string,
    transport_lsn string, commit_lsn string, committed_at timestamp, metadata {ROW_MAP}
"""

# Canonical event columns beside the feed columns that place the event.
PROJECTED_EVENT = f"""
    source_name string, slot_name string, seq bigint, transport_lsn string, sequence_number int,
    event_id string, source string, operation string, namespace string, entity string, identity {ROW_MAP},
    source_position string, transaction_id string, occurred_at string, data {ROW_MAP}, changes {CHANGES},
    metadata {ROW_MAP}
"""

# Canonical transaction columns without its keys and events.
ENVELOPE = f"""
    event_id string, type string, source string, source_position string, commit_lsn string,
    committed_at string, event_count bigint, last_part bigint, metadata {ROW_MAP}
"""

TXN_KEYS = ["source_name", "slot_name", "transaction_id"]

CHECKPOINTS = "source_name string, slot_name string, publication_name string, last_lsn string, updated_at timestamp"

LEDGER = """
    idempotency_key string, source_name string, slot_name string, destination string,
    delivery_unit string, transaction_id string, source_position string, delivered_at timestamp
"""

ATTEMPTS = """
    idempotency_key string, destination string, attempt int, status_code int,
    error_class string, error_message string, attempted_at timestamp
"""

# What a delivery's ledger row says beside its key, kept with the dead letter for a later replay.
WORK = "struct<source_name:string,slot_name:string,delivery_unit:string,transaction_id:string>"

# What a body's events are about, each once: enough to hold a stored body of any size against a route.
TOUCHED = "array<struct<namespace:string,entity:string,operation:string>>"

DEAD_LETTERS = f"""
    dead_letter_id string, idempotency_key string, event_id string, source_name string, destination string, operation string,
    namespace string, entity string, source_position string, error_class string, error_message string,
    retry_count int, status string, failed_at timestamp, updated_at timestamp, work {WORK}, payload_json string,
    parts bigint, touched {TOUCHED}, policy_fingerprint string, body_digest string
"""

# Bodies of letters whose payload has more than one part; their payload_json is NULL.
DEAD_LETTER_PARTS = "dead_letter_id string, part bigint, body string"

DEAD_LETTER_STATUS = "dead_letter_id string, status string, updated_at timestamp"

SLOT_STATUS = """
    slot_name string, slot_type string, plugin string, database string, active boolean,
    retained_wal_bytes bigint, wal_status string, safe_wal_size bigint, inactive_since timestamp,
    invalidation_reason string, restart_lsn string, confirmed_flush_lsn string, conflicting boolean
"""

PUBLICATION_TABLES = """
    relation_id bigint, schema_name string, table_name string, publishes_updates boolean,
    publishes_deletes boolean, replica_identity string, replica_identity_columns array<string>,
    primary_key_usable boolean, replica_identity_index_usable boolean
"""
