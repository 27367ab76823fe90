"""Canonical event and transaction payloads.

A transaction may hold a large share of all changes, so nothing gathers one whole. Facts about a
transaction are plain sums, minima and maxima, which Spark pre-aggregates before the shuffle, and
the ordered body is built in parts of PART_EVENTS events by sequence number. A transaction with
fewer events has exactly one part, and that row is its whole envelope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions import payload as P
from changeflow.functions import text as T
from changeflow.operators.few import shuffled
from changeflow.schemas import TXN_KEYS

PART_EVENTS = 4096
PART = "part"
DIGEST_LIMBS = 4


def part_number() -> Column:
    return F.coalesce(F.expr(f"sequence_number div {PART_EVENTS}"), F.lit(0))


def project_events(events: DataFrame, *more: str | Column) -> DataFrame:
    """The twelve canonical columns, beside the feed columns that place the event and any others asked for."""
    return events.select(
        "source_name", "slot_name", "seq", "transport_lsn", "sequence_number",
        P.event_id().alias("event_id"),
        P.source_label().alias("source"),
        "operation", "namespace", "entity", "identity",
        F.col("commit_lsn").alias("source_position"),
        "transaction_id",
        P.occurred_at().alias("occurred_at"),
        P.event_data().alias("data"),
        P.column_changes().alias("changes"),
        "metadata", *more,
    )


def event_bodies(projected: DataFrame) -> DataFrame:
    """Compact JSON body per event."""
    return projected.withColumn("body", P.event_json())


def transaction_facts(projected: DataFrame) -> DataFrame:
    """One row per transaction: count, first source, last position, and a digest of the ordered child ids.

    The digest adds up the leading 32-bit limbs of sha256(sequence|child id). Sums do not depend on how
    rows are split, so a hot transaction is pre-aggregated on every task that reads some of it.
    """
    has_position = F.col("source_position").isNotNull()
    child = F.sha2(F.concat_ws("|", F.col("sequence_number").cast("string"), F.col("event_id")), 256)
    limbs = [
        F.sum(F.conv(F.substring("_child", 1 + 8 * n, 8), 16, 10).cast("bigint")).cast("string") for n in range(DIGEST_LIMBS)
    ]
    return projected.withColumn("_child", child).groupBy(*TXN_KEYS).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("source", "sequence_number").alias("first_source"),
        F.max_by("source_position", F.when(has_position, F.col("sequence_number"))).alias("last_position"),
        F.min(part_number()).alias("first_part"),
        F.max(part_number()).alias("last_part"),
        F.concat_ws(".", *limbs).alias("children_digest"),
    )


def transaction_id_hash(source: Column, transaction_id: Column, position: Column, count: Column, digest: Column) -> Column:
    return F.concat(F.lit("txn_"), F.sha2(T.identity_text(source, transaction_id, position, count, digest), 256))


def headers_from_events(events: DataFrame) -> DataFrame:
    """Headers for a feed that has none: position from the events, latest source time as commit time."""
    return events.groupBy(*TXN_KEYS).agg(
        F.min("seq").alias("group_seq"),
        F.max_by("transport_lsn", "seq").alias("transport_lsn"),
        F.lit(None).cast("string").alias("commit_lsn"),
        F.max(F.coalesce("occurred_at", "ingested_at")).alias("committed_at"),
    ).withColumn("metadata", T.empty_map())


def project_transactions(projected: DataFrame, headers: DataFrame) -> DataFrame:
    """The canonical envelope columns without the events, one row per transaction; an envelope may be empty."""
    facts = transaction_facts(projected)
    joined = headers.join(facts, TXN_KEYS, "left")
    source = F.coalesce("first_source", F.lit(P.DEFAULT_SOURCE))
    position = F.coalesce("commit_lsn", "last_position")
    count = F.coalesce("event_count", F.lit(0))
    hashed = transaction_id_hash(
        source, F.col("transaction_id"), position, count, F.coalesce("children_digest", F.lit("0"))
    )
    return joined.select(
        "source_name", "slot_name", "group_seq", "transport_lsn",
        F.coalesce(P.metadata_text("event_id"), hashed).alias("event_id"),
        F.lit(P.TRANSACTION_TYPE).alias("type"),
        source.alias("source"), "transaction_id",
        position.alias("source_position"), position.alias("commit_lsn"),
        T.iso8601(F.col("committed_at")).alias("committed_at"),
        count.alias("event_count"),
        F.coalesce("first_part", F.lit(0)).alias("first_part"),
        F.coalesce("last_part", F.lit(0)).alias("last_part"),
        "metadata",
    )


def event_parts(projected: DataFrame, keys: list[str] = TXN_KEYS, *same: str) -> DataFrame:
    """JSON of the child events in sequence order, at most PART_EVENTS of them per row.

    `same` are columns that do not differ within a part. Rows that come with their part keep it, and so the place that a join by
    it has given them: a part made anew is another column to the planner, and all text would be shuffled once more.
    """
    # The text is made first, so that only it and the number are sorted and shuffled, not the row it came from.
    part = F.col(PART) if PART in projected.columns else part_number().cast("bigint").alias(PART)
    bodies = projected.select(*keys, part, *same, "sequence_number", P.event_json().alias("body"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sequence_number", "body"))), lambda c: c["body"])
    return bodies.groupBy(*keys, PART).agg(F.array_join(ordered, ",").alias("children"), *(F.first(name).alias(name) for name in same))


def transaction_bodies(transactions: DataFrame, parts: DataFrame, keys: list[str] = TXN_KEYS) -> DataFrame:
    """Body text per (transaction, part); the parts of one transaction, joined in order, are its body.

    Parts without events have no row. Transactions without a `first_part` column number their events from zero.
    """
    if "first_part" not in transactions.columns:
        transactions = transactions.withColumn("first_part", F.lit(0))
    return part_bodies(transactions.join(shuffled(parts), keys).unionByName(empty_parts(transactions)))


def empty_parts(transactions: DataFrame) -> DataFrame:
    """The only part of each transaction without events."""
    return transactions.where("event_count = 0").withColumns({PART: F.lit(0).cast("bigint"), "children": F.lit("")})


def part_bodies(rows: DataFrame) -> DataFrame:
    """`body` from the envelope columns, `part`, `first_part` and `children`."""
    head = F.concat(
        F.lit("{"),
        T.json_fields(F.col("event_id"), F.col("type"), F.col("source")),
        F.lit(',"transaction_id":'), P.transaction_id_json(F.col("transaction_id")), F.lit(","),
        T.json_fields(F.col("source_position"), F.col("commit_lsn"), F.col("committed_at"), F.col("event_count")),
        F.lit(',"events":['),
    )
    tail = F.concat(F.lit('],"metadata":'), T.json_map(F.col("metadata")), F.lit("}"))
    body = F.concat(
        F.when(F.col(PART) == F.col("first_part"), head).otherwise(F.lit(",")),
        F.col("children"),
        F.when(F.col(PART) == F.col("last_part"), tail).otherwise(F.lit("")),
    )
    return rows.withColumn("body", body).drop("children", "first_part")


def unwrap_to_events(events: DataFrame) -> DataFrame:
    """Event unit: an envelope becomes its events, `group_end` on the last only; a bare event ends its own group.

    The last sequence number comes from a pre-aggregated maximum, matched back per part so that the
    rows of a hot transaction stay spread over its parts. Bare events have no key and skip the join.
    """
    bare = F.col("transaction_id").isNull()
    numbered = events.where(~bare).withColumn(PART, part_number())
    ends = (
        numbered.groupBy(*TXN_KEYS).agg(F.max("sequence_number").alias("sequence_number"))
        .withColumn(PART, part_number())
        .withColumn("_last", F.lit(True))
    )
    joined = numbered.join(ends, [*TXN_KEYS, PART, "sequence_number"], "left")
    whole = joined.withColumn("group_end", F.coalesce("_last", F.lit(False))).drop("_last", PART)
    return whole.unionByName(events.where(bare).withColumn("group_end", F.lit(True)))


def wrap_as_transactions(events: DataFrame) -> DataFrame:
    """Transaction unit: a bare event becomes the only event of its own transaction.

    Its event id is the key, as other bare events may stand at the same position; `shown_transaction_id` is what a reader is shown.
    """
    bare = F.col("transaction_id").isNull()
    return events.withColumns({
        "sequence_number": F.when(bare, F.lit(0)).otherwise(F.col("sequence_number")),
        "transaction_id": F.coalesce("transaction_id", P.event_id()),
        "shown_transaction_id": F.coalesce("transaction_id", P.metadata_text("event_id"), "commit_lsn"),
    })


def restore_prepared(stored: DataFrame, stamp: str) -> DataFrame:
    """Stored body as it is, with the policy fingerprint of its metadata; a letter of several parts carries it beside the body."""
    found = F.get_json_object("payload_json", f"$.metadata.{stamp}.fingerprint")
    kept = F.col("policy_fingerprint") if "policy_fingerprint" in stored.columns else F.lit(None).cast("string")
    return stored.withColumn("policy_fingerprint", F.coalesce(found, kept))
