"""What a receiver does with delivered changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.text import canonical_map
from changeflow.operators.sliced import WIDTH, previous_value, running_count, running_max

# The ordering scopes a configuration may name.
SCOPES = ("global", "transaction", "relation", "primary_key", "none")
RECENT = 250


def batch_number(work: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Fixed-size batches in arrival order per source; the last may be short."""
    return running_count(work, keys, order, "_n").withColumn(
        "batch_number", F.expr(f"(_n - 1) div {int(size)}")
    ).drop("_n")


def receive_attempts(receipts: DataFrame, order: str) -> DataFrame:
    """Attempt number per delivery key, in order of arrival."""
    return running_count(receipts, ["delivery_key"], order, "attempt")


def completion_inversions(received: DataFrame, keys: list[str], order: str, completed: str) -> DataFrame:
    """Rows that completed before an earlier commit had completed."""
    seen = running_max(received, keys, order, completed, "_latest", inclusive=False)
    return seen.withColumn("inverted", F.coalesce(F.col(completed) < F.col("_latest"), F.lit(False))).drop("_latest")


def latest_image(events: DataFrame, keys: list[str], position: Column, image: list[str]) -> DataFrame:
    """Current row per identity: the last change wins and a delete removes. Folds before the shuffle."""
    last = F.max_by(F.struct("operation", *image), F.struct(position, F.col("sequence_number"))).alias("last")
    return events.groupBy(*keys).agg(last).where(F.col("last.operation") != "delete").select(*keys, "last.*").drop("operation")


def previous_status(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Inferred value before each change, for feeds that only carry new rows."""
    return previous_value(events, keys, order, value, f"inferred_previous_{value}")


def recent_events(receipts: DataFrame, order: str, keep: int = RECENT) -> DataFrame:
    return receipts.orderBy(F.col(order).desc()).limit(keep)


def scope_key(scope: str) -> Column | None:
    """What must stay in order together; None means no order at all."""
    if scope not in SCOPES:
        raise ValueError(f"ordering scope must be one of {', '.join(SCOPES)}")
    if scope == "none":
        return None
    keys = {
        "global": F.lit("all"),
        "transaction": F.concat_ws(":", "source_name", "slot_name", "transaction_id"),
        "relation": F.concat_ws(".", "namespace", "entity"),
        "primary_key": F.concat_ws(":", "namespace", "entity", canonical_map(F.col("identity"))),
    }
    return keys[scope]


def order_work(work: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """Range-sorted by (scope key, position): a key too big for one task goes on in the next partition,
    so even the global scope is sorted by many tasks."""
    key = scope_key(scope)
    return work if key is None else work.withColumn("scope_key", key).orderBy("scope_key", *order)


def number_in_scope(work: DataFrame, scope: str, order: str, width: int = WIDTH) -> DataFrame:
    """Place of each item inside its scope."""
    keyed = work.withColumn("scope_key", scope_key(scope))
    return running_count(keyed, ["scope_key"], order, "place", width)


def apply_once(received: DataFrame, applied: DataFrame, order: str) -> DataFrame:
    """Attempts per event id, and the first attempt to apply unless the event is applied already."""
    folded = received.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.min(order).alias("first_attempt")
    )
    known = applied.select("event_id").distinct().withColumn("_known", F.lit(True))
    return folded.join(known, "event_id", "left").withColumn(
        "applied_now", F.col("_known").isNull().cast("bigint")
    ).drop("_known")


def materialize(current: DataFrame | None, events: DataFrame, keys: list[str], position: Column, image: list[str]) -> DataFrame:
    """Current state after a batch of changes. Deletes stay as rows marked `deleted`, so that a late, older
    change cannot bring a row back."""
    version = F.struct(position.alias("position"), F.col("sequence_number").cast("bigint").alias("sequence_number"))
    changes = events.select(
        *keys, version.alias("version"), (F.col("operation") == "delete").alias("deleted"), *image
    )
    rows = changes if current is None else current.select(*changes.columns).unionByName(changes)
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "version").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def unsupported_routes(events: DataFrame, handled: list[tuple[str, str]]) -> DataFrame:
    """Changes of tables the receiver has no handler for."""
    known = F.lit(False)
    for namespace, entity in handled:
        known = known | ((F.col("namespace") == namespace) & (F.col("entity") == entity))
    return events.where(~F.coalesce(known, F.lit(False)))


def check_payload_shape(data: Column, field: str, old_status: str, new_status: str, value: str) -> Column:
    """v1 before the migration without the new column, v2 after it with the column; else why it is refused."""
    status = F.try_element_at(data, F.lit("status"))
    has = F.map_contains_key(data, F.lit(field))
    return (
        F.when((status == old_status) & has, "v1 must not have the column")
        .when(status == old_status, "v1")
        .when((status == new_status) & ~F.try_element_at(data, F.lit(field)).eqNullSafe(F.lit(value)), "v2 needs the column")
        .when(status == new_status, "v2")
        .otherwise("unexpected status")
    )


def key_sets(payloads: DataFrame) -> DataFrame:
    """Column sets seen per entity, with first and last position: how the shape moved over time."""
    names = F.array_join(F.sort_array(F.map_keys("data")), ",").alias("columns")
    return payloads.groupBy("namespace", "entity", names).agg(
        F.count(F.lit(1)).alias("payloads"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def check_identity(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per transaction: one identity throughout, which every event has, with the expected number of columns."""
    text = canonical_map(F.col("identity"))
    return events.groupBy(*keys).agg(
        (F.coalesce(F.min(text) == F.max(text), F.lit(False)) & (F.count("identity") == F.count(F.lit(1)))).alias("same_identity"),
        F.min(F.coalesce(F.size("identity"), F.lit(0))).alias("fewest_columns"),
        F.count(F.lit(1)).alias("events"),
    )


def delivery_audit(prepared: DataFrame, outcomes: DataFrame, verified: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, outcome and signature check per delivery; deliveries without an outcome are open."""
    return prepared.join(outcomes, keys, "left").join(verified, keys, "left").withColumns({
        "status": F.coalesce("status", F.lit("open")),
        "attempts": F.coalesce("attempts", F.lit(0)),
        "signature_verified": F.coalesce("signature_verified", F.lit(False)),
    })


def unreconciled_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Paid orders without a captured payment."""
    captured = payments.where(F.col("status") == "captured").select("order_id")
    return orders.where(F.col("status") == "paid").join(captured, "order_id", "left_anti")


def payment_balance(payments: DataFrame) -> DataFrame:
    """Captured, reversed and net cents per order, and entries whose sign does not fit their kind."""
    amount = F.col("amount_cents")
    captured, reversed_ = F.col("status") == "captured", F.col("status") == "reversed"
    return payments.groupBy("order_id").agg(
        F.sum(F.when(captured, amount).otherwise(0)).alias("captured_cents"),
        F.sum(F.when(reversed_, amount).otherwise(0)).alias("reversed_cents"),
        F.sum("amount_cents").alias("net_cents"),
        F.count_if((captured & (amount <= 0)) | (reversed_ & (amount >= 0))).alias("bad_entries"),
    )
