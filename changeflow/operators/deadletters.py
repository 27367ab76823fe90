"""Dead letters: append-only rows plus an append-only status log, latest status wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.config import Destination
from changeflow.functions import text as T
from changeflow.functions.payload import operation_or_type
from changeflow.operators.ledger import KEY
from changeflow.operators.route import by_destination, enabled
from changeflow.operators.redact import STAMP
from changeflow.schemas import TOUCHED, WORK

# The three states of a dead letter, the listing limit and the default replay filter.
STATUSES = ("pending", "resolved", "ignored")
DEFAULT_LIMIT = 100
DEFAULT_STATUS = "pending"


class DeadLetterError(ValueError):
    """A request that names no dead letter, or a state that does not exist."""


def dead_letter_id() -> Column:
    """Deterministic, so that writing a batch again gives the same rows."""
    body = F.coalesce("payload_json", "body_digest")
    return F.concat(F.lit("dl_"), F.sha2(T.identity_text(F.col("destination"), F.col("event_id"), F.unix_micros("failed_at"), body), 256))


def body_facts(body: Column) -> dict[str, Column]:
    """What a letter says about a body that is at hand in one piece."""
    child = "struct<namespace:string,entity:string,operation:string>"
    stored = F.from_json(body, f"namespace string, entity string, operation string, events array<{child}>")
    own = F.array(F.struct(stored["namespace"].alias("namespace"), stored["entity"].alias("entity"), stored["operation"].alias("operation")))
    return {
        "parts": F.lit(1).cast("bigint"),
        "touched": F.array_distinct(F.coalesce(stored["events"], F.when(stored.isNotNull(), own))).cast(TOUCHED),
        "policy_fingerprint": F.get_json_object(body, f"$.metadata.{STAMP}.fingerprint"),
        "body_digest": F.sha2(body, 256),
    }


def part_facts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Per body its number of parts, its text if it has only one, and a digest: of the text, or of its parts' digests in order."""
    digests = F.transform(F.sort_array(F.collect_list(F.struct("part", F.sha2("body", 256).alias("digest")))), lambda x: x["digest"])
    facts = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), F.max(F.when(F.col("part") == 0, F.col("body"))).alias("_first"), digests.alias("_digests"))
    single = F.col("parts") == 1
    return facts.select(
        *keys, "parts", F.when(single, F.col("_first")).alias("body"),
        F.when(single, F.element_at("_digests", 1)).otherwise(F.sha2(F.array_join("_digests", "|"), 256)).alias("body_digest"))


def build_dead_letters(failed: DataFrame) -> DataFrame:
    """Exhausted deliveries as pending rows that hold the exact prepared payload.

    Expects the payload columns, `body`, and the resolved `error`, `attempts` and `finished_at`. A body in several parts
    comes as NULL, with the columns of `body_facts` beside it.
    """
    if "body_digest" not in failed.columns:
        failed = failed.withColumns(body_facts(F.col("body")))
    operation = operation_or_type() if "type" in failed.columns else F.col("operation")
    work = F.col("work") if "work" in failed.columns else F.lit(None).cast(WORK)
    rows = failed.select(
        KEY, "event_id", F.col("source").alias("source_name"), "destination",
        operation.alias("operation"), "namespace", "entity", "source_position",
        F.col("error.error_class").alias("error_class"), F.col("error.error_message").alias("error_message"),
        F.col("attempts").cast("int").alias("retry_count"),
        F.lit(DEFAULT_STATUS).alias("status"),
        F.col("finished_at").alias("failed_at"), F.col("finished_at").alias("updated_at"),
        work.alias("work"), F.col("body").alias("payload_json"), "parts", "touched", "policy_fingerprint", "body_digest",
    )
    return rows.select(dead_letter_id().alias("dead_letter_id"), "*")


def check_status(status: str) -> str:
    if status not in STATUSES:
        raise DeadLetterError(f"status must be one of {', '.join(STATUSES)}")
    return status


def status_change(dead_letters: DataFrame, status: str, at: Column) -> DataFrame:
    """Rows to append to the status log."""
    return dead_letters.select("dead_letter_id", F.lit(check_status(status)).alias("status"), at.alias("updated_at"))


def set_status(dead_letters: DataFrame, ids: DataFrame, status: str, at: Column) -> DataFrame:
    """Rows to append to the status log for named letters, all of which must exist."""
    check_status(status)
    missing = unknown_ids(dead_letters, ids).take(1)
    if missing:
        raise DeadLetterError(f"dead letter not found: {missing[0][0]}")
    return status_change(by_ids(dead_letters, ids), status, at)


def current(dead_letters: DataFrame, log: DataFrame) -> DataFrame:
    """Dead letters with their latest status. Changes fold per letter before the join.

    Of changes at one time, that of the batch which had seen more counts, then that of the later batch, where the log tells them.
    """
    order = [c for c in ("updated_at", "seen", "batch_id") if c in log.columns]
    latest = log.groupBy("dead_letter_id").agg(F.max(F.struct(*order, "status")).alias("_latest"))
    joined = dead_letters.join(latest, "dead_letter_id", "left")
    return joined.withColumns({
        "status": F.coalesce("_latest.status", "status"),
        "updated_at": F.coalesce("_latest.updated_at", "updated_at"),
    }).drop("_latest")


def dead_letter_filter(
    dead_letters: DataFrame, status: str | None = None, destination: str | None = None,
    failed_after: str | None = None, failed_before: str | None = None,
) -> DataFrame:
    """Conjunction of the given filters; both time bounds are inclusive; status "all" filters nothing."""
    if status and status != "all":
        dead_letters = dead_letters.where(F.col("status") == check_status(status))
    if destination:
        dead_letters = dead_letters.where(F.col("destination") == destination)
    if failed_after:
        dead_letters = dead_letters.where(F.col("failed_at") >= F.to_timestamp(F.lit(failed_after)))
    if failed_before:
        dead_letters = dead_letters.where(F.col("failed_at") <= F.to_timestamp(F.lit(failed_before)))
    return dead_letters


def list_dead_letters(dead_letters: DataFrame, limit: int = DEFAULT_LIMIT, **filters: str | None) -> DataFrame:
    """Oldest first, id as tiebreak."""
    return dead_letter_filter(dead_letters, **filters).orderBy("failed_at", "dead_letter_id").limit(limit)


def by_ids(dead_letters: DataFrame, ids: DataFrame) -> DataFrame:
    return dead_letters.join(ids.select("dead_letter_id"), "dead_letter_id", "left_semi")


def unknown_ids(dead_letters: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("dead_letter_id").join(dead_letters.select("dead_letter_id"), "dead_letter_id", "left_anti")


def select_replay(
    dead_letters: DataFrame, ids: DataFrame | None = None, limit: int = DEFAULT_LIMIT, **filters: str | None
) -> DataFrame:
    """Given ids, all of which must exist, or a filtered list; selecting nothing is an error."""
    if ids is not None:
        missing = unknown_ids(dead_letters, ids).take(1)
        if missing:
            raise DeadLetterError(f"dead letter not found: {missing[0][0]}")
        chosen = by_ids(dead_letters, ids)
    else:
        filters.setdefault("status", DEFAULT_STATUS)
        chosen = list_dead_letters(dead_letters, limit, **filters)
    if not chosen.select("dead_letter_id").take(1):
        raise DeadLetterError("no dead letters selected for replay")
    return chosen


def show_dead_letters(dead_letters: DataFrame, ids: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """The named letters with their payload parsed to a variant; a body in several parts is put together."""
    shown = by_ids(dead_letters, ids)
    if parts is not None:
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "body"))), lambda x: x["body"]), "")
        whole = by_ids(parts, ids).groupBy("dead_letter_id").agg(text.alias("_whole"))
        shown = shown.join(whole, "dead_letter_id", "left").withColumn("payload_json", F.coalesce("payload_json", "_whole")).drop("_whole")
    return shown.withColumn("payload", F.parse_json("payload_json"))


def show_dead_letter(dead_letters: DataFrame, letter: str, parts: DataFrame | None = None) -> DataFrame:
    one = dead_letters.sparkSession.range(1).select(F.lit(letter).alias("dead_letter_id"))
    return show_dead_letters(dead_letters, one, parts)


def with_payload(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.withColumn("payload", F.try_parse_json("payload_json"))


def letter_bodies(dead_letters: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(letter, part, body): the stored payload of each letter, exactly as it was prepared."""
    columns = ["dead_letter_id", KEY, "destination"]
    single = dead_letters.where(F.col("payload_json").isNotNull()).select(
        *columns, F.lit(0).cast("bigint").alias("part"), F.col("payload_json").alias("body")
    )
    if parts is None:
        return single
    many = dead_letters.where(F.col("payload_json").isNull()).select(*columns)
    return single.unionByName(many.join(parts.select("dead_letter_id", "part", "body"), "dead_letter_id"))


def _stored_match(route) -> Column:
    """Whether any of the events that a stored body holds still fits a route. A body of unknown content fits an open route only."""

    def fits(event: Column) -> Column:
        match = F.lit(True)
        for values, name in ((route.schemas, "namespace"), (route.tables, "entity"), (route.operations, "operation")):
            if values:
                match = match & F.lower(F.coalesce(event[name], F.lit(""))).isin(*values)
        return match

    return F.coalesce(F.exists("touched", fits), F.lit(False))


def replay_plan(dead_letters: DataFrame, destinations: list[Destination], ledger: DataFrame) -> DataFrame:
    """Letters with `skip_reason`: unknown destinations raise; then disabled, route_mismatch, duplicate.

    The route is held against what the letter's body touches, which is the same for bodies of one part and of many.
    """
    names = [d.name for d in destinations]
    known = F.when(F.col("destination").isin(*names), F.col("destination")).otherwise(
        F.raise_error(F.concat(F.lit("unknown destination: "), F.col("destination")))
    )
    touched = F.coalesce("touched", body_facts(F.col("payload_json"))["touched"])
    matched = by_destination(destinations, lambda d: _stored_match(d.route))
    delivered = ledger.select(KEY).distinct().withColumn("_delivered", F.lit(True))
    reason = (
        F.when(~enabled(destinations), "disabled")
        .when(~F.col("_matched"), "route_mismatch")
        .when(F.col("_delivered").isNotNull(), "duplicate")
    )
    return (
        dead_letters.withColumns({"destination": known, "touched": touched}).withColumn("_matched", matched)
        .join(delivered, KEY, "left")
        .withColumn("skip_reason", reason).drop("_matched", "_delivered")
    )


def replay_resolved(status: Column, duplicate: Column) -> Column:
    """A replay settles its letter when delivered or found in the ledger. Other skips leave it pending."""
    return (status == "delivered") | F.coalesce(duplicate, F.lit(False))


def dead_letters_by_destination(dead_letters: DataFrame, status: str | None = None) -> DataFrame:
    return dead_letter_filter(dead_letters, status=status).groupBy("destination").agg(F.count(F.lit(1)).alias("dead_letters"))
