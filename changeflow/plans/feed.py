"""Change data, state and catalog rows as fixed functions of the driver's tables.

Everything here is row-local arithmetic on whole tables, so the work of a query grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow import config
from changeflow.functions import text as T
from changeflow.functions.lsn import number_to_lsn
from changeflow.operators import ledger as L
from changeflow.operators import project as P
from changeflow.operators import route as R
from changeflow.operators.deadletters import build_dead_letters, status_change
from changeflow.schemas import CHANGES
from changeflow.sources.catalog import read_slot_status

SOURCE = "shop"
STATUSES = ("pending", "paid", "shipped", "received", "cancelled")
BASE_POSITION = 16777216

SETTINGS = {
    "retry": {"max_attempts": 3, "schedule_seconds": [1, 5]},
    "destinations": [
        {"name": "all"},
        {
            "name": "payments_only",
            "route": {"tables": ["Payments"]},
            "retry": {"max_attempts": 2, "schedule_seconds": [2]},
            "payload_policy": {"rules": [{"action": "mask", "columns": ["customer_email"]}]},
        },
        {
            "name": "audit_deletes",
            "route": {"schemas": ["AUDIT"], "operations": ["delete"]},
            "payload_policy": {"rules": [
                {"action": "remove", "columns": ["customer_email", "total_cents"], "tables": ["ORDERS"]},
                {"action": "mask", "columns": ["status"], "schemas": ["audit"], "replacement": "hidden"},
            ]},
        },
        {"name": "disabled", "enabled": False},
    ],
}
DESTINATIONS = config.destinations(SETTINGS)
PROTECTED = ("customer_email", "total_cents")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table. Its times carry no zone and are taken as UTC, the zone of every time in this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    zoneless = [field for field, kind in rows.dtypes if kind == "timestamp_ntz"]
    return rows.withColumns({field: F.col(field).cast("timestamp") for field in zoneless}) if zoneless else rows


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def position_number(transaction: Column) -> Column:
    return F.lit(BASE_POSITION) + transaction * 64


def position_text(transaction: Column) -> Column:
    return number_to_lsn(position_number(transaction))


def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Four changes per transaction, three slots; some positions, times, labels and old rows are left out."""
    return feed_columns(table(spark, sf, "events"))


def feed_columns(events: DataFrame) -> DataFrame:
    eid, user = F.col("event_id"), F.col("user_id")
    transaction = F.expr("event_id div 4")
    operation = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    cents = F.round(F.col("value") * 100).cast("bigint")
    email = F.concat(F.lit("user"), user.cast("string"), F.lit("@example.com"))
    user_id = user.cast("string")

    def row(status: Column, total: Column, mail: Column) -> Column:
        return F.create_map(
            F.lit("id"), user_id, F.lit("status"), _quoted(status),
            F.lit("total_cents"), total.cast("string"), F.lit("customer_email"), _quoted(mail),
        )

    new = row(_pick(STATUSES, eid % 5), cents, F.when(eid % 11 != 0, email))
    old = row(_pick(STATUSES, (eid * 7 + user) % 5), F.when(eid % 2 == 0, cents).otherwise(cents + 100), email)
    only_key = F.create_map(F.lit("id"), user_id)
    labels = F.map_filter(
        F.create_map(
            F.lit("source"), F.when(eid % 3 == 0, F.lit('"shop-db"')),
            F.lit("event_id"), F.when(eid % 10 == 0, F.concat(F.lit('"evt-explicit-'), eid.cast("string"), F.lit('"'))),
        ),
        lambda _k, v: v.isNotNull(),
    )
    manual = F.array(F.struct(
        F.lit("status").alias("name"), F.lit(None).cast("string").alias("old_value"), F.lit('"manual"').alias("new_value"),
    ))
    position = number_to_lsn(position_number(transaction))
    return events.select(
        F.lit(SOURCE).alias("source_name"),
        F.concat(F.lit("slot_"), (transaction % 3).cast("string")).alias("slot_name"),
        eid.alias("seq"),
        number_to_lsn(position_number(transaction) + 48).alias("transport_lsn"),
        F.when(eid % 40 != 39, position).alias("commit_lsn"),
        transaction.cast("string").alias("transaction_id"),
        (eid % 4).cast("int").alias("sequence_number"),
        operation.alias("operation"),
        F.when(user % 3 == 0, "audit").otherwise("public").alias("namespace"),
        F.when(F.col("event_type") == "purchase", "payments").otherwise("orders").alias("entity"),
        only_key.alias("identity"),
        F.when(operation == "insert", None).when((operation == "update") & (user % 5 == 0), only_key).otherwise(old).alias("old_values"),
        F.when(operation != "delete", new).alias("new_values"),
        F.when(eid % 97 != 0, F.col("ts")).alias("occurred_at"),
        (F.col("ts") + F.expr("interval 1 second")).alias("ingested_at"),
        labels.alias("metadata"),
        F.when(eid % 50 == 0, F.array().cast(CHANGES)).when(eid % 50 == 25, manual).alias("explicit_changes"),
    )


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """One header per transaction, every odd one with its own position, and some envelopes without events."""
    events = table(spark, sf, "events")
    transaction = F.expr("event_id div 4")

    def header(rows: DataFrame, name: Column, position: Column) -> DataFrame:
        number = F.expr("event_id div 4")
        return rows.select(
            F.lit(SOURCE).alias("source_name"),
            F.concat(F.lit("slot_"), (number % 3).cast("string")).alias("slot_name"),
            F.col("event_id").alias("group_seq"),
            name.alias("transaction_id"),
            number_to_lsn(position_number(number) + 48).alias("transport_lsn"),
            position.alias("commit_lsn"),
            F.col("ts").alias("committed_at"),
            F.when(number % 25 == 0, F.create_map(F.lit("event_id"), F.concat(F.lit('"txn-explicit-'), name, F.lit('"'))))
            .otherwise(T.empty_map()).alias("metadata"),
        )

    own = F.when(transaction % 2 == 1, number_to_lsn(position_number(transaction)))
    whole = header(events.where("event_id % 4 = 0"), transaction.cast("string"), own)
    empty = header(events.where("event_id % 100 = 1"), F.concat(F.lit("empty-"), F.col("event_id").cast("string")), own)
    return whole.unionByName(empty)


def destination_number() -> Column:
    return R.by_destination(DESTINATIONS, lambda d: F.lit(DESTINATIONS.index(d)))


def transaction_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(transaction, destination) pairs that routing keeps, with key and position."""
    verdicts = R.transaction_verdicts(change_feed(spark, sf), DESTINATIONS)
    number = F.col("transaction_id").cast("bigint")
    pairs = verdicts.select(
        "source_name", "slot_name", "transaction_id", "destination",
        number.alias("work"), number_to_lsn(position_number(number)).alias("source_position"),
        F.lit(None).cast("string").alias("event_id"),
    )
    return pairs.withColumn(L.KEY, L.idempotency_key("transaction")).drop("event_id")


def attempt_log(pairs: DataFrame, work: str = "work") -> DataFrame:
    """Up to three tries per pair; every thirteenth item has only been tried once so far."""
    tries = F.when(F.col(work) % 13 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    tried = pairs.withColumn("attempt", F.explode(tries))
    step = (F.col(work) * 7 + destination_number() * 3 + F.col("attempt")) % 5
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 204, 500, 503, 429)]), (step + 1).cast("int"))
    failed = ~code.between(200, 299)
    return tried.select(
        L.KEY, "destination", "attempt", code.alias("status_code"),
        F.when(failed, "DeliveryError").alias("error_class"),
        F.when(failed, F.concat(F.lit("destination answered "), code.cast("string"))).alias("error_message"),
        F.timestamp_seconds(F.lit(1704067200) + F.col(work) * 10 + F.col("attempt")).alias("attempted_at"),
    )


def earlier_ledger(pairs: DataFrame) -> DataFrame:
    """What an earlier run delivered: every even work item."""
    return pairs.where(F.col("work") % 2 == 0).select(
        L.KEY, "source_name", "slot_name", "destination", F.lit("transaction").alias("delivery_unit"),
        "transaction_id", "source_position",
        F.timestamp_seconds(F.lit(1704067200) + F.col("work") * 10).alias("delivered_at"),
    )


def projected(spark: SparkSession, sf: str) -> DataFrame:
    return P.project_events(change_feed(spark, sf))


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Event-unit deliveries that used up their attempts, holding the prepared body."""
    routed = R.route_events(projected(spark, sf), DESTINATIONS)
    number = destination_number()
    failed = routed.where((F.col("seq") * 7 + number * 3) % 5 == 2)
    rows = failed.select(
        L.idempotency_key("event").alias(L.KEY), "event_id", "source", "destination", "operation", "namespace", "entity", "source_position", "seq",
        F.struct(F.lit("DeliveryError").alias("error_class"), F.lit("destination answered 500").alias("error_message")).alias("error"),
        (number % 3 + 1).alias("attempts"),
        F.timestamp_seconds(F.lit(1704067200) + F.expr("seq div 7") * 60).alias("finished_at"),
        F.concat(
            F.lit('{"event_id":"'), F.col("event_id"), F.lit('","operation":"'), F.col("operation"),
            F.lit('","metadata":{"payload_policy":{"fingerprint":"sha256:'), F.col("seq").cast("string"), F.lit('"}}}'),
        ).alias("body"),
    )
    return build_dead_letters(rows)


def dead_letter_log(letters: DataFrame) -> DataFrame:
    """Status changes: every third letter was resolved, every sixth of them ignored a minute later."""
    minute = F.unix_timestamp("failed_at") / 60

    def after(seconds: int) -> Column:
        return F.timestamp_seconds(F.unix_timestamp("failed_at") + seconds)

    return status_change(letters.where(minute % 3 == 0), "resolved", after(60)).unionByName(status_change(letters.where(minute % 6 == 0), "ignored", after(120)))


def slot_samples(spark: SparkSession, sf: str) -> DataFrame:
    """One catalog sample per event over seven slots."""
    eid = F.col("event_id")
    position = F.lit(BASE_POSITION) + eid * 64
    exists = eid % 29 != 0
    active = (eid % 5 != 0) & (F.expr("event_id div 70") % 4 != 0)
    raw = table(spark, sf, "events").select(
        eid.alias("sample"), F.col("ts").alias("sampled_at"),
        F.concat(F.lit("slot_"), (eid % 7).cast("string")).alias("slot_name"),
        F.when(exists, F.when(eid % 37 == 0, "physical").otherwise("logical")).alias("slot_type"),
        F.lit("pgoutput").alias("plugin"),
        F.when(eid % 41 == 0, "other").otherwise("shop").alias("database"),
        active.alias("active"),
        (eid * 10).alias("retained_wal_bytes"),
        F.element_at(F.array(*[F.lit(s) for s in ("reserved", "extended", "unreserved", "lost", None)]),
                     (F.expr("event_id div 3") % 5 + 1).cast("int")).alias("wal_status"),
        F.when(eid % 31 != 0, F.lit(50000) - (eid * 3) % 50000).alias("safe_wal_size"),
        F.when(~active, F.col("ts")).alias("inactive_since"),
        F.when(eid % 17 == 0, "wal_removed").otherwise("").alias("invalidation_reason"),
        F.when(eid % 23 != 0, number_to_lsn(position)).alias("restart_lsn"),
        F.when(eid % 13 != 0, number_to_lsn(position + 32)).alias("confirmed_flush_lsn"),
        F.when(eid % 19 == 0, True).alias("conflicting"),
        F.when(eid % 3 != 0, number_to_lsn(position + (eid % 4) * 16)).alias("resume_lsn"),
        (eid % 43 == 0).alias("temporary_slot"), (eid % 2 == 0).alias("auto_create_slot"),
    )
    return read_slot_status(raw)


def relations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("relation_id"),
        F.lower("p_type").alias("schema_name"),
        F.concat(F.lit("table_"), key.cast("string")).alias("table_name"),
        _pick(("d", "n", "f", "i"), key % 4).alias("replica_identity"),
    )


def publications(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("publication"),
        (F.col("n_nationkey") % 2 == 0).alias("publishes_update"),
        (F.col("n_nationkey") % 3 == 0).alias("publishes_delete"),
    )


def members(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array_distinct(F.array(
        F.concat(F.lit("NATION_"), (F.col("p_partkey") % 25).cast("string")),
        F.concat(F.lit("NATION_"), (F.col("p_size") % 25).cast("string")),
    ))
    return table(spark, sf, "part").select(
        F.explode(names).alias("publication"), F.lower("p_type").alias("schema_name"),
        F.concat(F.lit("table_"), F.col("p_partkey").cast("string")).alias("table_name"),
    )


def index_columns(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("relation_id"), F.explode(F.sequence(F.lit(1), (F.col("p_size") % 3 + 1).cast("int"))).alias("ordinal"),
        (key % 3 != 0).alias("is_primary"), (key % 5 != 0).alias("is_replident"),
        (key % 11 != 0).alias("is_valid"), (key % 17 != 0).alias("is_ready"), F.lit(True).alias("is_live"), F.col("p_size"),
    ).withColumn("attnum", F.lit(5) - F.col("ordinal"))


def attributes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("relation_id"), F.explode(F.sequence(F.lit(0), (F.col("p_size") % 4 + 4).cast("int"))).alias("attnum"),
    ).select(
        "relation_id", "attnum", F.concat(F.lit("c"), F.col("attnum").cast("string")).alias("column_name"),
        ((F.col("relation_id") + F.col("attnum")) % 13 == 0).alias("dropped"),
    )


def shop_orders(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "pending").otherwise("shipped")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), status.alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_cents"),
    )


def shop_payments(spark: SparkSession, sf: str) -> DataFrame:
    """One captured entry for most orders, a reversal for some, with a few wrong signs."""
    key = F.col("order_id")
    entries = F.array_compact(F.array(
        F.when(key % 3 != 0, F.struct(F.lit("captured").alias("status"), F.col("total_cents").alias("amount_cents"))),
        F.when(key % 7 == 0, F.struct(F.lit("reversed").alias("status"),
                                      F.when(key % 35 == 0, F.col("total_cents")).otherwise(-F.col("total_cents")).alias("amount_cents"))),
    ))
    return shop_orders(spark, sf).select("order_id", F.explode(entries).alias("e")).select("order_id", "e.*")


def persisted_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Stored event payloads as JSON text, under either name of each field, some of them broken."""
    eid = F.col("event_id")
    text = F.concat(
        F.lit("{"),
        F.when(eid % 30 == 29, "").otherwise('"operation":"'),
        F.when(eid % 30 == 29, "").otherwise(F.when(F.col("event_type") == "error", "delete").otherwise("insert")),
        F.when(eid % 30 == 29, "").otherwise('",'),
        F.when(eid % 2 == 0, '"namespace":"public",').otherwise('"schema":"public",'),
        F.when(eid % 30 == 17, "").when(eid % 3 == 0, '"entity":"orders",').otherwise('"table":"orders",'),
        F.when(eid % 4 == 0, '"identity":{"id":').otherwise('"primary_key":{"id":'), F.col("user_id").cast("string"), F.lit("},"),
        F.lit('"data":{"id":'), F.col("user_id").cast("string"), F.lit(',"kind":"'), F.col("event_type"), F.lit('","gone":null},'),
        F.when(eid % 5 == 0, F.concat(F.lit('"event_id":"e-'), eid.cast("string"), F.lit('",'))).when(eid % 5 == 1, '"event_id":null,').otherwise(""),
        F.when(eid % 6 == 0, '"changes":null,').otherwise(""),
        F.when(eid % 2 == 0, '"commit_lsn":"').otherwise('"source_position":"'), eid.cast("string"), F.lit('",'),
        F.lit('"metadata":{"event_id":"old","k":1},'),
        F.lit('"occurred_at":"'),
        F.when(eid % 30 == 11, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")),
        F.lit('"}'),
    )
    return table(spark, sf, "events").select(
        eid.alias("seq"), F.when(eid % 30 == 5, F.lit("{broken")).otherwise(text).alias("payload_json")
    )


def persisted_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Stored transaction payloads: the events of each transaction as children, some without any, some with a broken one."""
    eid = F.col("event_id")
    child = F.concat(
        F.lit("{"), F.when((eid % 120 == 54), "").otherwise(F.concat(F.lit('"operation":"'), F.col("event_type"), F.lit('",'))),
        F.lit('"namespace":"public","entity":"orders","data":{"id":'),
        F.col("user_id").cast("string"), F.lit("}}"),
    )
    rows = table(spark, sf, "events").withColumn("transaction", F.expr("event_id div 4")).groupBy("transaction").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(eid.alias("at"), child.alias("body")))), lambda c: c["body"]), ",").alias("children")
    )
    return rows.select(
        F.col("transaction").alias("stored"),
        F.concat(
            F.lit('{"type":"transaction.committed",'),
            F.when(F.col("transaction") % 50 == 49, "").otherwise(F.concat(F.lit('"transaction_id":'), F.col("transaction").cast("string"), F.lit(","))),
            F.lit('"source_position":"p'), F.col("transaction").cast("string"), F.lit('","committed_at":"2024-01-01T00:00:00Z","events":['),
            F.when(F.col("transaction") % 20 == 7, "").otherwise(F.col("children")), F.lit("]}"),
        ).alias("payload_json"),
    )


def registered_items(spark: SparkSession, sf: str) -> DataFrame:
    """Work items in source order: a group per transaction, the last group of each slot still open."""
    feed = change_feed(spark, sf)
    number = F.col("transaction_id").cast("bigint")
    return feed.select(
        "source_name", "slot_name", number.alias("group_seq"), F.col("sequence_number").cast("bigint").alias("item_seq"),
        F.when((number % 11 != 0) & (F.col("seq") % 4 != 3), F.col("transport_lsn")).alias("position"),
        F.lit(True).alias("group_closed"), "seq",
    )


def item_outcomes(items: DataFrame) -> DataFrame:
    """Outcomes for the items; one in a thousand is unfinished, though never in the first slot."""
    unfinished = (F.col("seq") % 1000 == 999) & (F.col("group_seq") % 3 != 0)
    status = F.when(F.col("seq") % 3 == 0, "delivered").when(F.col("seq") % 3 == 1, "skipped").otherwise("dead_lettered")
    return items.select(
        "source_name", "slot_name", "group_seq", "item_seq", F.when(unfinished, "in_progress").otherwise(status).alias("status")
    )
