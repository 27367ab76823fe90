"""Counts, gauges and reports over the state tables, slots and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.config import Destination
from changeflow.functions.lsn import lsn_to_number
from changeflow.operators.deadletters import STATUSES
from changeflow.operators.preflight import invalidated
from changeflow.operators.sliced import running_max

# Metric names without their prefix.
STATE_TOTALS = ("checkpoints_total", "dead_letters_total", "delivered_envelopes_total")
DISPATCH_TOTALS = {
    "started": "dispatch_started_total",
    "success": "dispatch_succeeded_total",
    "failure": "dispatch_failed_total",
    "skipped": "dispatch_skipped_total",
}
PREFIX = "changeflow_"


def state_counts(checkpoints: DataFrame, dead_letters: DataFrame, ledger: DataFrame) -> DataFrame:
    parts = [
        table.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value")
        for name, table in zip(STATE_TOTALS, (checkpoints, dead_letters, ledger), strict=True)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def delivery_gauges(dead_letters: DataFrame, ledger: DataFrame, destinations: list[Destination]) -> DataFrame:
    """(name, destination, value): totals overall and per configured destination, zeros kept.

    Both tables fold to one row per destination and status before they meet, and the configured
    destinations are a literal list.
    """
    folded = letter_tally(dead_letters).unionByName(ledger_tally(ledger))
    return gauges_from_tallies(folded, destinations)


def letter_tally(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.groupBy("destination", "status").agg(F.count(F.lit(1)).alias("n"))


def ledger_tally(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("destination").agg(F.count(F.lit(1)).alias("n")).select("destination", F.lit("delivered").alias("status"), "n")


def status_tally(letters: DataFrame, status: str) -> DataFrame:
    """What moving these letters from their present status to another adds and takes away."""
    moved = letters.where(F.col("status") != status)
    there = moved.groupBy("destination").agg(F.count(F.lit(1)).alias("n")).select("destination", F.lit(status).alias("status"), "n")
    return there.unionByName(letter_tally(moved).withColumn("n", -F.col("n")))


def gauges_from_tallies(tallies: DataFrame, destinations: list[Destination]) -> DataFrame:
    """The delivery gauges from (destination, status, n) rows of any number of batches: their cost does not grow with the ledger."""
    folded = tallies.groupBy("destination", "status").agg(F.sum("n").alias("n"))
    sums = {"dead_letters_total": F.sum(F.when(F.col("status") != "delivered", F.col("n")))}
    for status in STATUSES:
        sums[f"dead_letters_{status}_total"] = F.sum(F.when(F.col("status") == status, F.col("n")))
    sums["delivered_envelopes_total"] = F.sum(F.when(F.col("status") == "delivered", F.col("n")))
    spark = tallies.sparkSession
    configured = spark.range(1).select(F.explode(F.array(*[F.lit(d.name) for d in destinations])).alias("destination"))
    totals = [total.alias(name) for name, total in sums.items()]
    overall = folded.agg(*totals).withColumn("destination", F.lit(None).cast("string"))
    each = configured.join(folded.groupBy("destination").agg(*totals), "destination", "left")
    return (
        overall.unionByName(each)
        .select("destination", F.explode(F.create_map(*[
            item for name in sums for item in (F.lit(name), F.coalesce(name, F.lit(0)))
        ])).alias("name", "value"))
        .select("name", "destination", "value")
    )


def dispatch_counters(results: DataFrame, tags: list[str]) -> DataFrame:
    """Started, and for finished work one of succeeded, failed, skipped, by metric and sorted tags."""
    counted = results.groupBy("result", *sorted(tags)).agg(F.count(F.lit(1)).alias("n"))
    metrics = F.array(
        F.lit(DISPATCH_TOTALS["started"]),
        F.when(F.col("result") == "success", DISPATCH_TOTALS["success"])
        .when(F.col("result") == "failure", DISPATCH_TOTALS["failure"])
        .when(F.col("result") == "skipped", DISPATCH_TOTALS["skipped"]),
    )
    return counted.withColumn("name", F.explode(F.array_compact(metrics))).groupBy("name", *sorted(tags)).agg(F.sum("n").alias("value"))


def sorted_metrics(counters: DataFrame, tags: list[str]) -> DataFrame:
    return counters.orderBy("name", *sorted(tags))


def escape_label(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(escaped, F.lit("\n"), F.lit("\\n"))


def metric_line(name: Column, service: str, labels: dict[str, Column], value: Column) -> Column:
    """name{labels} value, the service label first; labels without a value are left out."""
    pairs = [F.concat(F.lit('service_name="'), escape_label(F.lit(service)), F.lit('"'))]
    for label, content in labels.items():
        pairs.append(F.concat(F.lit(f'{label}="'), escape_label(content), F.lit('"')))
    return F.concat(F.lit(PREFIX), name, F.lit("{"), F.concat_ws(",", *pairs), F.lit("} "), value.cast("bigint").cast("string"))


def latency_summary(samples: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """Mean in thousandths and nearest-rank percentile.

    Values are whole milliseconds. They fold to one row per distinct value first, so the ordered
    part works on distinct values, of which a receiver timeout bounds the number.
    """
    counts = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumns({"_rank": F.sum("n").over(upto), "_all": F.sum("n").over(whole)})
    rank = F.expr(f"(_all * {int(percent)} + 99) div 100")
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("samples"),
        F.expr(f"sum(n * `{value}`) * 1000 div sum(n)").alias("mean_thousandths"),
        F.min(F.when(F.col("_rank") >= rank, F.col(value))).alias(f"p{percent}"),
    )


def throughput(items: Column, elapsed_seconds: Column) -> Column:
    """Items per second to two places; zero when no time passed."""
    return F.coalesce(F.round(F.try_divide(items.cast("decimal(20,0)"), F.nullif(elapsed_seconds, F.lit(0))), 2), F.lit(0)).cast(
        "decimal(20,2)"
    )


def delivery_rate(ledger: DataFrame, keys: list[str], minutes: int = 5) -> DataFrame:
    """Deliveries per tumbling window, and the mean rate in thousandths per second."""
    span = F.window("delivered_at", f"{minutes} minutes")
    return ledger.groupBy(*keys, span.alias("w")).agg(F.count(F.lit(1)).alias("delivered")).select(
        *keys, F.unix_timestamp("w.start").alias("window_start"), "delivered",
        F.expr(f"delivered * 1000 div {minutes * 60}").alias("rate_thousandths"),
    )


def wal_budget_ratio() -> Column:
    """Share of the log budget in use; NULL, and so no sample, where either size is unknown."""
    retained, safe = F.col("retained_wal_bytes"), F.col("safe_wal_size")
    return F.when(retained.isNotNull() & safe.isNotNull(), retained / F.greatest(retained + safe, F.lit(1)))


def sustained_alerts(
    samples: DataFrame, keys: list[str], order: str, time: str, condition: Column, seconds: int
) -> DataFrame:
    """Unbroken runs of the condition that lasted at least `seconds`, from first to last true sample.

    `order` is a unique whole number that follows the sample time.
    """
    marked = samples.withColumn("_on", F.coalesce(condition, F.lit(False))).withColumn(
        "_off_at", F.when(~F.col("_on"), F.col(order))
    )
    runs = running_max(marked, keys, order, "_off_at", "_run", inclusive=True).where("_on")
    return (
        runs.groupBy(*keys, "_run")
        .agg(F.min(time).alias("started_at"), F.max(time).alias("ended_at"), F.count(F.lit(1)).alias("samples"))
        .where(F.unix_micros("ended_at") - F.unix_micros("started_at") >= seconds * 1_000_000)
        .drop("_run")
    )


def readiness_report(state: DataFrame, health: DataFrame) -> DataFrame:
    """ready, or unready with the first reason: state first, then the slot."""
    state_ok = F.coalesce("state_ok", F.lit(False))
    joined = health.join(state, "service_name", "left")
    reason = F.when(~state_ok, "operational state is unavailable").otherwise(F.col("reason"))
    return joined.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "ready").otherwise("unready")
    )


def slot_gauges(health: DataFrame) -> DataFrame:
    """(slot_name, name, wal_status, value): two gauges for a missing slot, up to eleven for a present one.

    Where `inspected` is given and false, the inspection itself failed, and that is all there is to report.
    """
    inspected = F.coalesce("inspected", F.lit(False)) if "inspected" in health.columns else F.lit(True)
    present = F.coalesce("present", F.lit(False)) & inspected

    def flag(value: Column) -> Column:
        return F.when(present, F.coalesce(value, F.lit(False)).cast("bigint"))

    gauges = {
        "slot_inspection_up": inspected.cast("bigint"),
        "slot_present": F.when(inspected, present.cast("bigint")),
        "slot_ready": flag(F.col("ready")),
        "slot_active": flag(F.col("active")),
        "slot_wal_status": F.when(present, F.lit(1).cast("bigint")),
        "slot_invalidated": flag(invalidated()),
        "slot_retained_wal_bytes": F.when(present, F.col("retained_wal_bytes")),
        "slot_safe_wal_size_bytes": F.when(present, F.col("safe_wal_size")),
        "slot_inactive_since_timestamp_seconds": F.when(present, F.unix_timestamp("inactive_since")),
        "slot_restart_lsn_bytes": F.when(present, lsn_to_number(F.col("restart_lsn"))),
        "slot_confirmed_flush_lsn_bytes": F.when(present, lsn_to_number(F.col("confirmed_flush_lsn"))),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in gauges.items()])
    label = F.when(F.col("g.name") == "slot_wal_status", F.coalesce("wal_status", F.lit("unknown")))
    return (
        health.withColumn("g", F.explode(rows)).where(F.col("g.value").isNotNull())
        .select("slot_name", F.col("g.name").alias("name"), label.alias("wal_status"), F.col("g.value").alias("value"))
    )
