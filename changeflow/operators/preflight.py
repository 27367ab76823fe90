"""Start-up checks on replication slots and published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.lsn import lsn_to_number
from changeflow.operators.few import shuffled, spread_join


class PreflightError(RuntimeError):
    """The source cannot be read safely from where it should resume."""


# Retention states in which the slot may have lost its log, and the identity codes of the catalog.
LOST_STATES = ("lost", "unreserved")
IDENTITY_NAMES = {"d": "default", "n": "nothing", "f": "full", "i": "index"}
REQUIRED_TYPE, REQUIRED_PLUGIN = "logical", "pgoutput"


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def slot_reason() -> Column:
    """Why a running slot is not ready; NULL means ready. A running slot has to be active."""
    return (
        F.when(~F.coalesce("present", F.lit(False)), "slot is missing")
        .when(~F.coalesce("active", F.lit(False)), "slot is inactive")
        .when(F.col("wal_status").isin(*LOST_STATES), F.concat(F.lit("wal_status="), F.col("wal_status")))
        .when(~_blank("invalidation_reason"), F.concat(F.lit("slot is invalidated: "), F.col("invalidation_reason")))
        .when(F.coalesce("conflicting", F.lit(False)), "slot is conflicting")
        .when(_blank("restart_lsn"), "slot has no restart LSN")
    )


def slot_health(slots: DataFrame) -> DataFrame:
    return slots.withColumn("reason", slot_reason()).withColumn("ready", F.col("reason").isNull())


def invalidated() -> Column:
    """Conflicting, or a reason that is not blank."""
    return F.coalesce("conflicting", F.lit(False)) | ~_blank("invalidation_reason")


def position_reachable(resume: Column) -> Column:
    """False when a boundary that is set lies past the resume position."""
    reachable = F.lit(True)
    for boundary in ("restart_lsn", "confirmed_flush_lsn"):
        passed = ~_blank(boundary) & (lsn_to_number(resume) < lsn_to_number(F.col(boundary)))
        reachable = reachable & ~F.coalesce(passed, F.lit(False))
    return reachable


def slot_preflight(database: Column, expected_slot: Column) -> Column:
    """First reason not to start, NULL when safe. Expects resume_lsn, temporary_slot, auto_create_slot beside the
    slot facts. Unlike slot_reason, an active slot is a fault here: another consumer holds it."""
    resuming = ~_blank("resume_lsn")
    missing = ~F.coalesce("present", F.lit(False))
    bounds_unreadable = F.lit(False)
    for name in ("resume_lsn", "restart_lsn", "confirmed_flush_lsn"):
        bounds_unreadable = bounds_unreadable | (~_blank(name) & lsn_to_number(F.col(name)).isNull())
    return (
        F.when(resuming & F.coalesce("temporary_slot", F.lit(False)), "temporary slot cannot resume a checkpoint")
        .when(missing & resuming, "missing slot must not be recreated while resuming")
        .when(missing & ~F.coalesce("auto_create_slot", F.lit(False)), "missing slot and auto-create is off")
        .when(missing, F.lit(None))
        .when(~F.col("slot_name").eqNullSafe(expected_slot), "wrong slot")
        .when(
            ~(F.col("slot_type").eqNullSafe(F.lit(REQUIRED_TYPE)) & F.col("plugin").eqNullSafe(F.lit(REQUIRED_PLUGIN))),
            "not a logical pgoutput slot",
        )
        .when(~F.col("database").eqNullSafe(database), "different database")
        .when(F.coalesce("active", F.lit(False)), "already active")
        .when(F.col("wal_status").isin(*LOST_STATES), F.concat(F.lit("cannot retain WAL: "), F.col("wal_status")))
        .when(invalidated(), "invalidated")
        .when(_blank("restart_lsn"), "no reachable restart LSN")
        .when(resuming & bounds_unreadable, "unreadable position")
        .when(resuming & ~position_reachable(F.col("resume_lsn")), "resume position is no longer retained")
    )


def require_ready(verdicts: DataFrame) -> None:
    """Fail closed on the first slot that has a verdict."""
    bad = verdicts.where(F.col("verdict").isNotNull()).select("slot_name", "verdict").take(1)
    if bad:
        raise PreflightError(f"slot {bad[0]['slot_name']}: {bad[0]['verdict']}")


def replica_identity_name(code: Column) -> Column:
    """Known codes to words; unknown codes pass through."""
    result = F.when(code == "d", IDENTITY_NAMES["d"])
    for key in ("n", "f", "i"):
        result = result.when(code == key, IDENTITY_NAMES[key])
    return result.otherwise(code)


def identity_usable() -> Column:
    needed = F.col("publishes_updates") | F.col("publishes_deletes")
    usable = (
        F.when(F.col("replica_identity") == "d", F.col("primary_key_usable"))
        .when(F.col("replica_identity") == "i", F.col("replica_identity_index_usable"))
        .otherwise(F.col("replica_identity") == "f")
    )
    return ~needed | F.coalesce(usable, F.lit(False))


def identity_preflight_report(tables: DataFrame) -> DataFrame:
    """Every published table whose updates or deletes cannot be identified."""
    actions = F.array_join(F.array_compact(F.array(
        F.when(F.col("publishes_updates"), "UPDATE"), F.when(F.col("publishes_deletes"), "DELETE"),
    )), "/")
    return tables.where(~identity_usable()).select(
        F.concat_ws(".", "schema_name", "table_name").alias("qualified_name"),
        actions.alias("actions"),
        replica_identity_name(F.col("replica_identity")).alias("replica_identity"),
    )


def require_identity(tables: DataFrame) -> None:
    bad = identity_preflight_report(tables).take(1)
    if bad:
        raise PreflightError(f"{bad[0]['qualified_name']} has no usable identity for {bad[0]['actions']}")


def publication_actions(members: DataFrame, publications: DataFrame) -> DataFrame:
    """Which of update and delete any of the chosen publications sends, per table."""
    return members.join(publications, "publication").groupBy("schema_name", "table_name").agg(
        F.bool_or("publishes_update").alias("publishes_updates"),
        F.bool_or("publishes_delete").alias("publishes_deletes"),
    )


def usable_index() -> Column:
    return F.col("is_valid") & F.col("is_ready") & F.col("is_live")


def _ordered_names(order: str) -> Column:
    # Gathers the columns of one index or table: at most 1600 by the source's own limit.
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col("column_name").alias("name"))))
    return F.transform(listed, lambda c: c["name"])


def identity_columns(relations: DataFrame, index_columns: DataFrame, attributes: DataFrame) -> DataFrame:
    """Ordered identity columns: key columns of the fitting usable index, or every live column for full identity.

    A catalog has as many relations as it likes, so its tables are joined by shuffle.
    """
    columns = shuffled(attributes).where((F.col("attnum") > 0) & ~F.col("dropped"))
    by_index = (
        index_columns.where(usable_index() & (F.col("is_primary") | F.col("is_replident")))
        .join(columns, ["relation_id", "attnum"])
        .join(shuffled(relations).select("relation_id", "replica_identity"), "relation_id")
        .where(
            ((F.col("replica_identity") == "d") & F.col("is_primary"))
            | ((F.col("replica_identity") == "i") & F.col("is_replident"))
        )
        .groupBy("relation_id").agg(_ordered_names("ordinal").alias("names"))
    )
    full = relations.where(F.col("replica_identity") == "f").select("relation_id")
    by_table = columns.join(full, "relation_id", "left_semi").groupBy("relation_id").agg(
        _ordered_names("attnum").alias("names")
    )
    found = by_index.unionByName(by_table)
    return shuffled(relations).join(found, "relation_id", "left").withColumn(
        "replica_identity_columns", F.coalesce("names", F.array().cast("array<string>"))
    ).drop("names")


def publication_facts(
    members: DataFrame, publications: DataFrame, relations: DataFrame, index_columns: DataFrame, attributes: DataFrame
) -> DataFrame:
    """One row per published table with all facts the identity check needs."""
    actions = publication_actions(members, publications)
    indexes = index_columns.where(usable_index()).groupBy("relation_id").agg(
        F.bool_or("is_primary").alias("primary_key_usable"),
        F.bool_or("is_replident").alias("replica_identity_index_usable"),
    )
    return (
        identity_columns(relations, index_columns, attributes)
        .join(shuffled(actions), ["schema_name", "table_name"])
        .join(shuffled(indexes), "relation_id", "left")
        .withColumns({
            name: F.coalesce(name, F.lit(False)) for name in ("primary_key_usable", "replica_identity_index_usable")
        })
    )


def attach_identity(changes: DataFrame, tables: DataFrame) -> DataFrame:
    """Identity map per change from its table's identity columns; `identity_complete` is false when one is absent.

    Tables without identity columns leave the change as it is.
    """
    known = tables.where(F.size("replica_identity_columns") > 0).select(
        F.col("schema_name").alias("namespace"), F.col("table_name").alias("entity"), "replica_identity_columns",
    )
    joined = spread_join(changes, known, ["namespace", "entity"], by="seq", how="left")
    names = F.col("replica_identity_columns")
    row = F.coalesce("new_values", "old_values")
    picked = F.map_filter(row, lambda k, _v: F.array_contains(names, k))
    complete = F.size(picked) == F.size(names)
    return joined.withColumns({
        "identity": F.when(names.isNotNull(), picked).otherwise(F.col("identity")),
        "identity_complete": names.isNull() | F.coalesce(complete, F.lit(False)),
    })


def require_complete_identity(changes: DataFrame) -> None:
    """A change that lacks part of its table's key cannot be identified downstream."""
    bad = changes.where(~F.col("identity_complete")).select("namespace", "entity", "seq").take(1)
    if bad:
        raise PreflightError(f"{bad[0]['namespace']}.{bad[0]['entity']}: change {bad[0]['seq']} lacks identity columns")
