"""Idempotency keys and the delivered ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.config import Destination, check_unit
from changeflow.operators.few import BROADCAST_BYTES, text_bytes
from changeflow.operators.route import by_destination, enabled

KEY = "idempotency_key"
KEY_MODES = ("safe", "reference")
# 2^14 cells: a standard error of 0.8 per cent.
SKETCH_BITS = 14


def idempotency_key(unit: str, mode: str = "safe") -> Column:
    """Non-null parts joined with a colon.

    mode="reference" prefers the transaction id for both units, so two events of one transaction at
    one position share a key and the second counts as a duplicate. mode="safe", the default, uses the
    event id for the event unit. Transactions are the same in both.
    """
    check_unit(unit)
    if mode not in KEY_MODES:
        raise ValueError(f"key mode must be one of {', '.join(KEY_MODES)}")
    preferred = F.coalesce("transaction_id", "event_id")
    work = F.col("event_id") if unit == "event" and mode == "safe" else preferred
    return F.concat_ws(":", "source_name", "slot_name", "destination", F.lit(unit), work, "source_position")


def first_per_key(pairs: DataFrame, order: str) -> DataFrame:
    """The first row of each key, as (key, order value). Copies of one key fold before the shuffle."""
    return pairs.groupBy(KEY).agg(F.min(order).alias(order))


def known_keys(stored: DataFrame, ledger: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Ledger keys that a written batch can meet.

    A batch whose keys measure up to `limit` is broadcast to the ledger, which is then scanned without a
    shuffle and leaves only the keys in question. For a larger batch the ledger is joined as it is.
    """
    keys = stored.select(KEY).distinct()
    if text_bytes(keys) <= limit:
        return ledger.select(KEY).join(F.broadcast(keys), KEY, "left_semi")
    return ledger.select(KEY)


def undelivered(pairs: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """Rows that still need delivery: the first of each key, unless the ledger has the key."""
    first = first_per_key(pairs, order)
    open_keys = first.join(ledger.select(KEY), KEY, "left_anti")
    return pairs.join(open_keys, [KEY, order], "left_semi")


def skip_reason(pairs: DataFrame, destinations: list[Destination], ledger: DataFrame, order: str, matched: str) -> DataFrame:
    """disabled, then route_mismatch, then duplicate; NULL means attempt.

    Only rows that would be attempted compete for being first of their key. The verdict is matched
    back on (key, order), which is unique, so many copies of one key do not meet in one task.
    """
    flagged = pairs.withColumn(
        "_config_skip",
        F.when(~enabled(destinations), F.lit("disabled")).when(~F.col(matched), F.lit("route_mismatch")),
    )
    candidates = first_per_key(flagged.where(F.col("_config_skip").isNull()), order)
    open_keys = candidates.join(ledger.select(KEY), KEY, "left_anti").withColumn("_open", F.lit(True))
    joined = flagged.join(open_keys, [KEY, order], "left")
    reason = F.coalesce(F.col("_config_skip"), F.when(F.col("_open").isNull(), F.lit("duplicate")))
    return joined.withColumn("skip_reason", reason).drop("_config_skip", "_open")


def record_delivered(ledger: DataFrame, delivered: DataFrame, order: str) -> DataFrame:
    """Insert-or-ignore: rows to append. The ledger wins over new rows, and the earliest new row wins."""
    columns = [c for c in delivered.columns if c != KEY]
    first = delivered.groupBy(KEY).agg(F.min_by(F.struct(*columns), order).alias("row"))
    return first.join(ledger.select(KEY), KEY, "left_anti").select(KEY, "row.*")


def delivered_by_destination(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("destination").agg(F.count(F.lit(1)).alias("delivered"))


def list_ledger(ledger: DataFrame) -> DataFrame:
    """Rows in the order they were recorded: by the batches' place in the log where they come from one, then by time."""
    return ledger.orderBy(*[c for c in ("seen", "batch_id", "delivered_at") if c in ledger.columns], KEY)


def ledger_sketches(ledger: DataFrame) -> DataFrame:
    """Per destination the rows, and a sketch of the transactions that any batch's sketch can be united with."""
    return ledger.groupBy("destination").agg(
        F.count(F.lit(1)).alias("ledger_rows"), F.hll_sketch_agg("transaction_id", SKETCH_BITS).alias("sketch"))


def growth_from_sketches(sketches: DataFrame) -> DataFrame:
    """Rows, and distinct transactions within about two per cent, from the sketches of any number of batches."""
    return sketches.groupBy("destination").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("transactions"), F.sum("ledger_rows").alias("ledger_rows"))


def ledger_growth(ledger: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct transactions per destination; two-step exact count, or a sketch."""
    if approximate:
        return ledger.groupBy("destination").agg(F.approx_count_distinct("transaction_id").alias("transactions"))
    distinct = ledger.groupBy("destination", "transaction_id").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("destination").agg(
        F.count("transaction_id").alias("transactions"), F.sum("n").alias("ledger_rows")
    )


def retry_settings(destinations: list[Destination]) -> tuple[Column, Column]:
    attempts = by_destination(destinations, lambda d: F.lit(d.max_attempts))
    schedule = by_destination(destinations, lambda d: F.array(*[F.lit(s) for s in d.schedule_seconds]))
    return attempts, schedule
