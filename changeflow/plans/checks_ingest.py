"""Queries: sources, sinks, state tables, set operations and scalar functions."""

from __future__ import annotations

import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow import config
from changeflow.functions import lsn as N
from changeflow.functions import payload as PF
from changeflow.functions import signing
from changeflow.functions import text as T
from changeflow.operators import attempts as A
from changeflow.operators import ledger as L
from changeflow.operators import metrics as M
from changeflow.operators import preflight as PR
from changeflow.operators import project as P
from changeflow.operators import route as R
from changeflow.operators.few import shuffled
from changeflow.plans import feed as FD
from changeflow.plans.registry import query
from changeflow.schemas import TXN_KEYS
from changeflow.session import run_folder
from changeflow.sources import payload_files as PL
from changeflow.sources.catalog import read_publication_tables, read_slot_status
from changeflow.sources.feeds import stream_change_feed
from changeflow.sources.sinks import Transport, deliver_batch, write_payload_json
from changeflow.sources.state import StateTables
from changeflow.streaming.stream import run_finite

SECRET = "a-shared-secret"


def field(column: str, key: str) -> Column:
    return F.try_element_at(column, F.lit(key))


# --- A: sources and sinks ---------------------------------------------------------------------

_STORED = """, stored AS (
  SELECT event_id AS seq, event_id % 30 AS m, event_id % 30 = 5 AS broken, *
  FROM events
)"""


@query("a1_read_event_payloads", _STORED + """
SELECT seq, CASE WHEN m NOT IN (5, 29) THEN CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END END AS operation,
  CASE WHEN NOT broken THEN 'public' END AS namespace, CASE WHEN m NOT IN (5, 17) THEN 'orders' END AS entity,
  CASE WHEN NOT broken THEN CAST(user_id AS VARCHAR) END AS identity_id,
  CASE WHEN NOT broken AND m <> 29 AND event_type = 'error' THEN '"error"' END AS old_kind,
  CASE WHEN NOT broken AND (m = 29 OR event_type <> 'error') THEN '"' || event_type || '"' END AS new_kind,
  CASE WHEN NOT broken THEN CAST(event_id AS VARCHAR) END AS commit_lsn,
  CASE WHEN m NOT IN (5, 11) THEN epoch(date_trunc('second', ts))::BIGINT - 7200 END AS occurred_epoch
FROM stored""")
def a1_read_event_payloads(spark: SparkSession, sf: str) -> DataFrame:
    events = PL.read_event_payloads(FD.persisted_payloads(spark, sf))
    return events.select(
        "seq", "operation", "namespace", "entity", field("identity", "id").alias("identity_id"),
        field("old_values", "kind").alias("old_kind"), field("new_values", "kind").alias("new_kind"),
        "commit_lsn", F.unix_timestamp("occurred_at").alias("occurred_epoch"),
    )


@query("a2_read_transaction_payloads", """, t AS (SELECT n AS stored, sn, event_type, user_id, n % 20 = 7 AS empty, n % 50 = 49 AS nameless,
  n % 30 = 13 AND max(sn) OVER (PARTITION BY n) >= 2 AS broken FROM feed)
SELECT stored, CAST(CASE WHEN NOT empty THEN sn END AS INTEGER) AS sequence_number,
  CASE WHEN NOT empty AND NOT (broken AND sn = 2) THEN event_type END AS operation,
  CASE WHEN NOT nameless THEN CAST(stored AS VARCHAR) END AS envelope_transaction_id,
  'p' || stored AS envelope_commit_lsn,
  CASE WHEN NOT empty AND event_type <> 'delete' THEN CAST(user_id AS VARCHAR) END AS new_id,
  CASE WHEN nameless THEN 'missing transaction_id' WHEN broken THEN 'broken event: missing operation' END AS error_reason
FROM t WHERE NOT empty OR sn = 0""")
def a2_read_transaction_payloads(spark: SparkSession, sf: str) -> DataFrame:
    events = PL.read_transaction_payloads(FD.persisted_transactions(spark, sf))
    return events.select(
        "stored", "sequence_number", "operation", "envelope_transaction_id", "envelope_commit_lsn",
        field("new_values", "id").alias("new_id"), "error_reason",
    )


@query("a3_enrich_metadata", _STORED + """
SELECT seq, CASE WHEN event_id % 5 = 0 THEN '"e-' || event_id || '"' WHEN event_id % 5 <> 1 THEN '"old"' END AS metadata_event_id,
  CASE WHEN event_id % 2 = 1 THEN '"' || event_id || '"' END AS metadata_position,
  CAST(2 + CAST(event_id % 2 = 1 AS INTEGER) + CAST(event_id % 6 = 0 AS INTEGER) AS INTEGER) AS keys,
  event_id % 6 = 0 AS has_changes
FROM stored WHERE NOT broken""")
def a3_enrich_metadata(spark: SparkSession, sf: str) -> DataFrame:
    events = PL.read_event_payloads(FD.persisted_payloads(spark, sf))
    readable = events.where(~F.col("error_reason").eqNullSafe(F.lit("not a JSON object")))
    return readable.select(
        "seq", field("metadata", "event_id").alias("metadata_event_id"),
        field("metadata", "source_position").alias("metadata_position"), F.size("metadata").alias("keys"),
        F.map_contains_key("metadata", F.lit("changes")).alias("has_changes"),
    )


@query("a4_quarantine_malformed", _STORED + """
SELECT seq, CASE m WHEN 5 THEN 'not a JSON object' WHEN 29 THEN 'missing operation' WHEN 17 THEN 'missing entity'
  WHEN 11 THEN 'unreadable occurred_at' ELSE 'good' END AS verdict FROM stored""")
def a4_quarantine_malformed(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = PL.quarantine_malformed(PL.read_event_payloads(FD.persisted_payloads(spark, sf)))
    return good.select("seq", F.lit("good").alias("verdict")).unionByName(bad.select("seq", F.col("error_reason").alias("verdict")))


@query("a5_stream_change_feed", "SELECT seq, transport AS transport_lsn, operation, user_id FROM feed")
def a5_stream_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_folder(spark, "feed")
    stream = stream_change_feed(spark, sf, FD.table(spark, sf, "events").schema, names="events.parquet")

    def land(rows: DataFrame, batch: int) -> None:
        FD.feed_columns(rows).select("seq", "transport_lsn", "operation", field("identity", "id").cast("bigint").alias("user_id")) \
            .write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch}")

    run_finite(stream, land, f"{folder}/offsets")
    return spark.read.schema("seq bigint, transport_lsn string, operation string, user_id bigint").parquet(f"{folder}/rows").drop("batch_id")


@query("a6_read_slot_status", """
SELECT sample, slot_name, present, wal_status, CAST(NULL AS BIGINT) AS safe_wal_size, CAST(NULL AS BOOLEAN) AS conflicting FROM slots""")
def a6_read_slot_status(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog version without two of the columns."""
    older = FD.slot_samples(spark, sf).drop("safe_wal_size", "conflicting", "present")
    return read_slot_status(older).select("sample", "slot_name", "present", "wal_status", "safe_wal_size", "conflicting")


@query("a6_read_publication_tables", """
SELECT relation_id, schema_name, table_name, publishes_updates, CAST(NULL AS BOOLEAN) AS publishes_deletes, names,
  primary_key_usable FROM facts""")
def a6_read_publication_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot with JSON array text, t/f text and one column missing."""
    facts = publication_facts(spark, sf).select(
        "relation_id", "schema_name", "table_name", F.when(F.col("publishes_updates"), "t").otherwise("f").alias("publishes_updates"),
        F.to_json("replica_identity_columns").alias("replica_identity_columns"),
        F.when(F.col("primary_key_usable"), "t").otherwise("f").alias("primary_key_usable"),
    )
    return read_publication_tables(facts).select(
        "relation_id", "schema_name", "table_name", "publishes_updates", "publishes_deletes",
        F.array_join("replica_identity_columns", ",").alias("names"), "primary_key_usable",
    )


def publication_facts(spark: SparkSession, sf: str) -> DataFrame:
    return PR.publication_facts(
        FD.members(spark, sf), FD.publications(spark, sf), FD.relations(spark, sf), FD.index_columns(spark, sf), FD.attributes(spark, sf)
    )


BODIES = """, bodies AS (
  SELECT *, '{"event_id":"' || event_id || '","source":"' || source || '","operation":"' || operation || '","namespace":"' || namespace
    || '","entity":"' || entity || '","identity":{"id":' || user_id || '},"source_position":' || coalesce('"' || position || '"', 'null')
    || ',"transaction_id":' || transaction_id || ',"occurred_at":"' || occurred_at || '","data":{"id":' || user_id
    || CASE WHEN has_new THEN ',"status":"' || new_status || '","total_cents":' || new_cents || ',"customer_email":' || coalesce('"' || new_mail || '"', 'null')
            ELSE ',"status":"' || old_status || '","total_cents":' || old_cents || ',"customer_email":"' || old_mail || '"' END
    || '},"changes":[' || CASE WHEN seq % 50 = 0 THEN '' WHEN seq % 50 = 25 THEN '{"name":"status","old_value":null,"new_value":"manual"}'
      WHEN operation = 'insert' THEN concat_ws(',', '{"name":"id","old_value":null,"new_value":' || user_id || '}',
        '{"name":"status","old_value":null,"new_value":"' || new_status || '"}', '{"name":"total_cents","old_value":null,"new_value":' || new_cents || '}',
        '{"name":"customer_email","old_value":null,"new_value":"' || new_mail || '"}')
      WHEN operation = 'delete' THEN concat_ws(',', '{"name":"id","old_value":' || user_id || ',"new_value":null}',
        '{"name":"status","old_value":"' || old_status || '","new_value":null}', '{"name":"total_cents","old_value":' || old_cents || ',"new_value":null}',
        '{"name":"customer_email","old_value":"' || old_mail || '","new_value":null}')
      WHEN full_old THEN concat_ws(',',
        CASE WHEN old_status <> new_status THEN '{"name":"status","old_value":"' || old_status || '","new_value":"' || new_status || '"}' END,
        CASE WHEN old_cents <> new_cents THEN '{"name":"total_cents","old_value":' || old_cents || ',"new_value":' || new_cents || '}' END,
        CASE WHEN new_mail IS NULL THEN '{"name":"customer_email","old_value":"' || old_mail || '","new_value":null}' END)
      ELSE '' END
    || '],"metadata":{' || concat_ws(',', CASE WHEN seq % 3 = 0 THEN '"source":"shop-db"' END, '"event_id":"' || explicit_id || '"') || '}}' AS body
  FROM projected
)"""


@query("a7_write_payload_json", BODIES + " SELECT body FROM bodies")
def a7_write_payload_json(spark: SparkSession, sf: str) -> DataFrame:
    path = run_folder(spark, "bodies")
    write_payload_json(P.event_bodies(FD.projected(spark, sf)), path)
    return spark.read.text(path).withColumnRenamed("value", "body")


def answering(codes: tuple[int, ...]) -> Transport:
    """In-process receiver that reads the whole body and answers by transaction number."""

    def receive(destination: str, key: str, chunks, headers: dict | None = None, timeout: int | None = None) -> int:
        if sum(len(chunk) for chunk in chunks) == 0:
            raise ConnectionError("empty body")
        return codes[int(key.split(":")[4]) % len(codes)]

    return receive


@query("a8_deliver_batch", """
SELECT idempotency_key, destination, CAST(1 AS INTEGER) AS attempt,
  CAST(list_extract([200, 204, 500, 503, 429], CAST(n % 5 + 1 AS INTEGER)) AS INTEGER) AS status_code,
  CASE WHEN n % 5 > 1 THEN 'DeliveryError' END AS error_class FROM pairs""")
def a8_deliver_batch(spark: SparkSession, sf: str) -> DataFrame:
    events = FD.projected(spark, sf)
    bodies = P.transaction_bodies(P.project_transactions(events, FD.headers(spark, sf)), P.event_parts(events))
    routed = bodies.join(shuffled(FD.transaction_pairs(spark, sf)).select(*TXN_KEYS, "destination", L.KEY), TXN_KEYS)
    path = run_folder(spark, "sent")
    deliver_batch(routed, answering((200, 204, 500, 503, 429)), connections=spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.parquet(path).drop("error_message")


def _checking(codes: tuple[int, ...], secret: str) -> Transport:
    """Receiver that answers 401 unless the headers are those of its destination and the signature fits the body it gets."""
    answer = answering(codes)

    def receive(destination: str, key: str, chunks, headers: dict, timeout: int) -> int:
        body = b"".join(chunks)
        wanted = "sha256=" + hmac.new(secret.encode(), headers.get("X-Sent-At", "").encode() + b"." + body, "sha256").hexdigest()
        if (headers.get("X-Body-Signature"), headers.get("X-For"), headers.get("Authorization"), timeout) != (wanted, destination, f"Bearer {secret}", len(destination)):
            return 401
        return answer(destination, key, iter([body]))

    return receive


@query("a8_signed_delivery", """
SELECT idempotency_key, destination,
  CAST(list_extract([200, 204, 500, 503, 429], CAST(n % 5 + 1 AS INTEGER)) AS INTEGER) AS status_code FROM pairs""")
def a8_signed_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies in three parts, each request with its destination's headers, timeout and a signature over the whole body.
    The receiver works the signature out anew from what arrives and refuses any other."""
    targets = config.destinations({"destinations": [{
        "name": d.name, "timeout_seconds": len(d.name), "headers": {"X-For": d.name}, "header_env": {"Authorization": "TOKEN"},
        "signing": {"secret_env": "SECRET", "signature_header": "X-Body-Signature", "timestamp_header": "X-Sent-At"},
    } for d in FD.DESTINATIONS]})
    events = FD.projected(spark, sf)
    bodies = P.transaction_bodies(P.project_transactions(events, FD.headers(spark, sf)), P.event_parts(events))
    routed = bodies.join(shuffled(FD.transaction_pairs(spark, sf)).select(*TXN_KEYS, "destination", L.KEY), TXN_KEYS)
    third = F.ceil(F.length("body") / 3).cast("int")
    pieces = F.array(*[F.struct(F.lit(n).cast("bigint").alias("part"), F.substring(F.col("body"), F.lit(1) + third * n, third).alias("body")) for n in range(3)])
    cut = routed.select(L.KEY, "destination", F.inline(pieces))
    path = run_folder(spark, "sent")
    secrets = {"SECRET": "a secret", "TOKEN": "Bearer a secret"}.__getitem__
    deliver_batch(cut, _checking((200, 204, 500, 503, 429), "a secret"), spark.sparkContext.defaultParallelism, 1, targets, secrets).write.parquet(path)
    return spark.read.parquet(path).select(L.KEY, "destination", "status_code")


@query("a9_state_tables", """
SELECT 'ledger' AS name, CAST(CASE WHEN n % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS batch_id, count(*) AS n FROM ledger GROUP BY ALL
UNION ALL SELECT 'dead_letters', CAST(0 AS BIGINT), count(*) FROM letters""")
def a9_state_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, each run twice: once it breaks off before its commit, and once it comes again after it. Another writer's
    batch of the same number stays beside them, and compaction between keeps all rows."""
    state = StateTables(spark, run_folder(spark, "state"))
    ledger = FD.earlier_ledger(FD.transaction_pairs(spark, sf))
    first = F.col("transaction_id").cast("bigint") % 4 == 0
    state.begin(0).write("ledger", ledger)  # never committed
    for number, rows in enumerate((first, ~first)):
        for _again in range(2):
            state.write("ledger", ledger.where(rows), number)
        state.compact("ledger")
    state.write("dead_letters", FD.dead_letters(spark, sf), 0, writer="replay")
    counts = [
        state.read(name).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "batch_id", "n")
        for name in ("ledger", "dead_letters")
    ]
    return counts[0].unionByName(counts[1])


# --- I: set operations ------------------------------------------------------------------------


@query("i1_union_feeds", _STORED + """
SELECT 'event' AS feed, seq AS item, CAST(NULL AS INTEGER) AS sequence_number, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS operation
FROM stored WHERE m NOT IN (5, 11, 17, 29)
UNION ALL SELECT 'transaction', n, CAST(sn AS INTEGER), event_type FROM feed WHERE n % 20 <> 7 AND n % 50 <> 49 AND n % 30 <> 13""")
def i1_union_feeds(spark: SparkSession, sf: str) -> DataFrame:
    events, _ = PL.quarantine_malformed(PL.read_event_payloads(FD.persisted_payloads(spark, sf)))
    children, _ = PL.quarantine_malformed(PL.read_transaction_payloads(FD.persisted_transactions(spark, sf)))
    feed = PL.union_feeds(
        events.withColumns({"feed": F.lit("event"), "item": F.col("seq")}),
        children.where(F.col("operation").isNotNull()).withColumns({"feed": F.lit("transaction"), "item": F.col("stored")}),
    )
    return feed.select("feed", "item", "sequence_number", "operation")


@query("i2_record_delivered", "SELECT idempotency_key, destination, n * 2 AS arrival FROM outcomes WHERE status = 'delivered' AND n % 2 = 1")
def i2_record_delivered(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivered pair is reported twice; the ledger already has the even transactions."""
    pairs = FD.transaction_pairs(spark, sf)
    delivered = A.resolve_attempts(FD.attempt_log(pairs), FD.DESTINATIONS).where("status = 'delivered'")
    number = F.split_part(L.KEY, F.lit(":"), F.lit(5)).cast("bigint")
    reports = delivered.select(L.KEY, "destination", F.explode(F.array(number * 2 + 1, number * 2)).alias("arrival"))
    return L.record_delivered(FD.earlier_ledger(pairs), reports, "arrival")


# --- J: scalar functions ----------------------------------------------------------------------

_MIXED = """, mixed AS (
  SELECT seq, n, transport, CASE seq % 7 WHEN 0 THEN 'zz/10' WHEN 1 THEN CAST(16777216 + n AS VARCHAR) WHEN 2 THEN lower(transport)
    WHEN 3 THEN '-5' WHEN 4 THEN '' WHEN 5 THEN 'FFFFFFFF/FFFFFFFF' ELSE transport END AS text FROM feed
)"""


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    feed = FD.change_feed(spark, sf).select("seq", "transport_lsn", F.col("transaction_id").cast("bigint").alias("n"))
    m = F.col("seq") % 7
    return feed.withColumn(
        "text",
        F.when(m == 0, "zz/10").when(m == 1, (F.lit(FD.BASE_POSITION) + F.col("n")).cast("string"))
        .when(m == 2, F.lower("transport_lsn")).when(m == 3, "-5").when(m == 4, "")
        .when(m == 5, "FFFFFFFF/FFFFFFFF").otherwise(F.col("transport_lsn")),
    )


@query("j1_lsn_to_number", _MIXED + """
SELECT seq, text, CASE seq % 7 WHEN 1 THEN 16777216 + n WHEN 2 THEN 16777216 + n * 64 + 48 WHEN 6 THEN 16777216 + n * 64 + 48 END AS number FROM mixed""")
def j1_lsn_to_number(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).select("seq", "text", N.lsn_to_number(F.col("text")).alias("number"))


@query("j2_number_to_lsn", """
SELECT seq, printf('%X', (seq * 1000003) // 4294967296) || '/' || printf('%X', (seq * 1000003) % 4294967296) AS lsn FROM feed""")
def j2_number_to_lsn(spark: SparkSession, sf: str) -> DataFrame:
    return FD.change_feed(spark, sf).select("seq", N.number_to_lsn(F.col("seq") * 1000003).alias("lsn"))


@query("j3_lsn_valid", _MIXED + " SELECT seq, seq % 7 IN (1, 2, 5, 6) AS valid FROM mixed")
def j3_lsn_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).select("seq", N.lsn_valid(F.col("text")).alias("valid"))


@query("j4_pick_position", """
SELECT seq, CASE WHEN seq % 2 = 0 THEN 's' || seq WHEN seq % 3 = 0 THEN 'w' || seq WHEN seq % 5 = 0 THEN 'f' || seq END AS payload_position,
  CASE WHEN seq % 3 = 0 THEN 'w' || seq END AS acknowledge_position FROM feed""")
def j4_pick_position(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("seq")
    text = s.cast("string")
    positions = F.map_filter(F.create_map(
        F.lit("final_lsn"), F.when(s % 5 == 0, F.concat(F.lit("f"), text)),
        F.lit("wal_end_lsn"), F.when(s % 3 == 0, F.concat(F.lit("w"), text)),
        F.lit("source_position"), F.when(s % 2 == 0, F.concat(F.lit("s"), text)),
    ), lambda _k, v: v.isNotNull())
    return FD.change_feed(spark, sf).select(
        "seq", N.pick_position(positions, N.PAYLOAD_POSITION_KEYS).alias("payload_position"),
        N.pick_position(positions, N.ACKNOWLEDGE_POSITION_KEYS).alias("acknowledge_position"),
    )


@query("j5_idempotency_key", """
SELECT seq, destination, concat_ws(':', 'shop', slot_name, destination, 'event', event_id, position) AS safe_key,
  concat_ws(':', 'shop', slot_name, destination, 'event', transaction_id, position) AS reference_key,
  concat_ws(':', 'shop', slot_name, destination, 'transaction', transaction_id, position) AS transaction_key FROM matched""")
def j5_idempotency_key(spark: SparkSession, sf: str) -> DataFrame:
    return R.route_events(FD.projected(spark, sf), FD.DESTINATIONS).select(
        "seq", "destination", L.idempotency_key("event").alias("safe_key"),
        L.idempotency_key("event", "reference").alias("reference_key"), L.idempotency_key("transaction").alias("transaction_key"),
    )


_INNER, _OUTER = signing._pads(SECRET)
_HMAC = f"sha256(from_hex('{_OUTER.hex()}') || unhex(sha256(from_hex('{_INNER.hex()}') || encode(%s))))"


@query("j6_sign_payload", BODIES + " SELECT seq, 'sha256=' || " + _HMAC % "occurred_at || '.' || body" + " AS signature FROM bodies")
def j6_sign_payload(spark: SparkSession, sf: str) -> DataFrame:
    bodies = P.event_bodies(FD.projected(spark, sf))
    return bodies.select("seq", signing.sign_payload(SECRET, F.col("occurred_at"), F.col("body")).alias("signature"))


@query("j7_verify_signature", """
SELECT seq, seq % 11 <> 0 AND seq % 5 <> 0 AND abs(epoch_us(ts) + (seq % 7) * 100000000
  - epoch_us(date_trunc('second', ts))) <= 300000000 AS verified FROM feed""")
def j7_verify_signature(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("seq")
    rows = FD.table(spark, sf, "events").select(F.col("event_id").alias("seq"), "ts", F.col("props").alias("body"))
    stamp = F.when(s % 11 != 0, T.iso8601(F.col("ts")))
    good = signing.sign_payload(SECRET, T.iso8601(F.col("ts")), F.col("body"))
    received = F.timestamp_micros(F.unix_micros("ts") + (s % 7) * 100_000_000)
    given = F.when(s % 5 == 0, "sha256=wrong").otherwise(good)
    return rows.select("seq", signing.verify_signature(SECRET, stamp, F.col("body"), given, received).alias("verified"))


@query("j8_retry_delay", """
SELECT idempotency_key, CAST(attempts AS INTEGER) AS attempts,
  CASE WHEN destination = 'payments_only' THEN 2 WHEN attempts = 1 THEN 1 ELSE 5 END AS next_delay,
  CASE WHEN destination = 'payments_only' THEN 2 * (attempts - 1) WHEN attempts = 1 THEN 0 WHEN attempts = 2 THEN 1 ELSE 6 END AS waited
FROM outcomes""")
def j8_retry_delay(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = A.resolve_attempts(FD.attempt_log(FD.transaction_pairs(spark, sf)), FD.DESTINATIONS)
    return A.with_waits(outcomes, FD.DESTINATIONS).select(L.KEY, "attempts", "next_delay", "waited")


@query("j9_metric_line", r"""
SELECT 'changeflow_events_total{service_name="shop \"main\"",entity="' || entity || '",kind="a\\b\n' || event_type || '"} ' || count(*) AS line
FROM feed GROUP BY entity, event_type""")
def j9_metric_line(spark: SparkSession, sf: str) -> DataFrame:
    events = FD.table(spark, sf, "events")
    entity = F.when(F.col("event_type") == "purchase", "payments").otherwise("orders")
    counts = events.groupBy(entity.alias("entity"), F.concat(F.lit("a\\b\n"), "event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    labels = {"entity": F.col("entity"), "kind": F.col("kind")}
    return counts.select(M.metric_line(F.lit("events_total"), 'shop "main"', labels, F.col("n")).alias("line"))


@query("j10_iso8601_utc", """
SELECT seq, CASE WHEN seq % 9 <> 0 THEN strftime(ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM feed""")
def j10_iso8601_utc(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 9 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:30'")).otherwise("last week")
    return FD.table(spark, sf, "events").select(F.col("event_id").alias("seq"), T.iso8601_utc(text).alias("utc"))


@query("j11_replica_identity_name", """
SELECT relation_id, CASE replica_identity WHEN 'd' THEN 'default' WHEN 'n' THEN 'nothing' WHEN 'f' THEN 'full' ELSE
  CASE WHEN relation_id % 8 = 3 THEN 'x' ELSE 'index' END END AS name FROM rel""")
def j11_replica_identity_name(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("relation_id") % 8 == 3, "x").otherwise(F.col("replica_identity"))
    return FD.relations(spark, sf).select("relation_id", PR.replica_identity_name(code).alias("name"))


@query("j12_epoch_seconds", "SELECT seq, CASE WHEN seq % 4 <> 0 THEN epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM feed")
def j12_epoch_seconds(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return FD.table(spark, sf, "events").select(F.col("event_id").alias("seq"), T.epoch_seconds(text).alias("seconds"))


@query("j13_invalidated", "SELECT sample, conflicting OR invalid AS invalidated FROM slots")
def j13_invalidated(spark: SparkSession, sf: str) -> DataFrame:
    return FD.slot_samples(spark, sf).select("sample", PR.invalidated().alias("invalidated"))


@query("j14_payload_type", """
SELECT 'event' AS payload_type, operation, count(*) AS n FROM feed GROUP BY operation
UNION ALL SELECT 'transaction.committed', 'transaction.committed', count(DISTINCT n) FROM feed""")
def j14_payload_type(spark: SparkSession, sf: str) -> DataFrame:
    events = FD.projected(spark, sf).select("operation", F.lit(None).cast("string").alias("type"))
    whole = P.transaction_facts(FD.projected(spark, sf)).select(
        F.lit(None).cast("string").alias("operation"), F.lit(PF.TRANSACTION_TYPE).alias("type")
    )
    return events.unionByName(whole).groupBy(
        PF.payload_type().alias("payload_type"), PF.operation_or_type().alias("operation")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("j15_delivery_key", """
SELECT seq, CASE WHEN seq % 4 <> 1 THEN event_id WHEN seq % 3 <> 0 THEN transaction_id END AS delivery_key,
  seq % 4 = 1 AND seq % 3 = 0 AS quarantined FROM projected""")
def j15_delivery_key(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("seq")
    received = FD.projected(spark, sf).withColumns({
        "event_id": F.when(s % 4 != 1, F.col("event_id")),
        "transaction_id": F.when(s % 3 != 0, F.col("transaction_id")),
    })
    return received.select("seq", PF.delivery_key().alias("delivery_key"), PF.delivery_key().isNull().alias("quarantined"))


@query("j16_lsn_diff", "SELECT sample, CASE WHEN restart IS NOT NULL AND confirmed IS NOT NULL THEN confirmed - restart END AS bytes FROM slots")
def j16_lsn_diff(spark: SparkSession, sf: str) -> DataFrame:
    return FD.slot_samples(spark, sf).select(
        "sample", N.lsn_diff(F.col("confirmed_flush_lsn"), F.col("restart_lsn")).alias("bytes")
    )
