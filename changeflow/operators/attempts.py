"""Delivery outcomes from an attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.config import Destination
from changeflow.operators.ledger import KEY, retry_settings

# The status codes that count as success.
SUCCESS_CODES = (200, 299)


def succeeded(status_code: Column | None = None) -> Column:
    code = F.col("status_code") if status_code is None else status_code
    return F.coalesce(code.between(*SUCCESS_CODES), F.lit(False))


def resolve_attempts(attempts: DataFrame, destinations: list[Destination]) -> DataFrame:
    """Attempts stop at the first success or at the destination's limit. Entries after that point are ignored.

    `finished_at` is the time of the first success, else of the latest attempt; a delivery has no `error`.
    """
    limit, _ = retry_settings(destinations)
    used = attempts.withColumn("max_attempts", limit).where(F.col("attempt") <= F.col("max_attempts"))
    first = F.when(succeeded(), F.struct("attempt", "attempted_at"))
    folded = used.groupBy(KEY, "destination").agg(
        F.min(first).alias("first"),
        F.max("attempt").alias("last_attempt"),
        F.max("max_attempts").alias("max_attempts"),
        F.max_by(F.struct("error_class", "error_message", "status_code"), F.when(~succeeded(), F.col("attempt"))).alias("error"),
        F.max("attempted_at").alias("last_at"),
    )
    status = (
        F.when(F.col("first").isNotNull(), "delivered")
        .when(F.col("last_attempt") >= F.col("max_attempts"), "dead_lettered")
        .otherwise("in_progress")
    )
    return folded.select(
        KEY, "destination", status.alias("status"),
        F.coalesce("first.attempt", "last_attempt").alias("attempts"),
        F.when(F.col("first").isNull(), F.col("error")).alias("error"),
        F.when(F.col("first").isNotNull(), F.col("first.attempted_at")).otherwise(F.col("last_at")).alias("finished_at"),
    )


def retry_delay(schedule: Column, attempt: Column) -> Column:
    """Wait before the next attempt: the schedule's entry, else its last one."""
    return F.coalesce(F.get(schedule, attempt - 1), F.element_at(schedule, -1))


def total_wait(schedule: Column, attempts: Column) -> Column:
    """Waits of a work item that took `attempts` attempts."""
    steps = F.when(attempts > 1, F.sequence(F.lit(1), (attempts - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0), lambda total, n: total + retry_delay(schedule, n))


def with_waits(outcomes: DataFrame, destinations: list[Destination]) -> DataFrame:
    _, schedule = retry_settings(destinations)
    return outcomes.withColumn("_schedule", schedule).withColumns({
        "next_delay": retry_delay(F.col("_schedule"), F.col("attempts")),
        "waited": total_wait(F.col("_schedule"), F.col("attempts")),
    }).drop("_schedule")


def durable(status: Column) -> Column:
    """The outcomes that allow progress: delivered, duplicate or intended skip, dead-lettered."""
    return F.coalesce(status.isin("delivered", "skipped", "dead_lettered"), F.lit(False))


def fanout_summary(outcomes: DataFrame, work: list[str]) -> DataFrame:
    """Counts per work item; fanout_delivered when every destination delivered or skipped."""
    counted = outcomes.groupBy(*work).agg(*[
        F.count_if(F.col("status") == status).alias(status) for status in ("delivered", "skipped", "dead_lettered")
    ], F.count(F.lit(1)).alias("destinations"))
    whole = F.col("delivered") + F.col("skipped") == F.col("destinations")
    return counted.withColumn("status", F.when(whole, "fanout_delivered").otherwise("fanout_partial"))


def processor_result(status: Column) -> Column:
    """skipped stays skipped; a dead letter or a partial fan-out is a failure that is not retried; unfinished work is open."""
    return (
        F.when(status == "skipped", "skipped")
        .when(status.isNull() | (status == "in_progress"), "open")
        .when(status.isin("dead_lettered", "fanout_partial"), "failure")
        .otherwise("success")
    )
