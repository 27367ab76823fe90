"""Queries: metrics, listings, receiver-side operators and destination settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.config import destinations
from changeflow.functions import signing
from changeflow.functions import text as T
from changeflow.functions.lsn import lsn_to_number
from changeflow.operators import attempts as A
from changeflow.operators import consume as C
from changeflow.operators import deadletters as DL
from changeflow.operators import ledger as L
from changeflow.operators import metrics as M
from changeflow.operators import preflight as PR
from changeflow.operators import progress as PG
from changeflow.operators import project as P
from changeflow.operators import route as R
from changeflow.plans import feed as FD
from changeflow.plans.checks_delivery import _checkpoints, resolved
from changeflow.plans.checks_ingest import SECRET, field
from changeflow.plans.checks_payload import current_letters
from changeflow.plans.registry import query
from changeflow.session import run_folder

# --- F: aggregations --------------------------------------------------------------------------


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return FD.earlier_ledger(FD.transaction_pairs(spark, sf))


@query("f1_state_counts", """
SELECT 'checkpoints_total' AS name, count(DISTINCT user_id) AS value FROM feed UNION ALL SELECT 'dead_letters_total', count(*) FROM letters
UNION ALL SELECT 'delivered_envelopes_total', count(*) FROM ledger""")
def f1_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.state_counts(PG.latest_checkpoints(_checkpoints(spark, sf), "seq"), FD.dead_letters(spark, sf), _ledger(spark, sf))


@query("f2_delivered_by_destination", "SELECT destination, count(*) AS delivered FROM ledger GROUP BY destination")
def f2_delivered_by_destination(spark: SparkSession, sf: str) -> DataFrame:
    return L.delivered_by_destination(_ledger(spark, sf))


@query("f3_dead_letters_by_destination", "SELECT destination, count(*) AS dead_letters FROM current_letters WHERE status = 'ignored' GROUP BY destination")
def f3_dead_letters_by_destination(spark: SparkSession, sf: str) -> DataFrame:
    return DL.dead_letters_by_destination(current_letters(spark, sf), "ignored")


_GAUGES = """, tallies AS (
  SELECT destination, status, count(*) AS n FROM current_letters WHERE destination <> 'audit_deletes' GROUP BY ALL
  UNION ALL SELECT destination, 'delivered', count(*) FROM ledger WHERE destination <> 'audit_deletes' GROUP BY ALL
), wanted AS (SELECT destination FROM targets UNION ALL SELECT NULL), names(name, wanted_status) AS (
  VALUES ('dead_letters_total', NULL), ('dead_letters_pending_total', 'pending'), ('dead_letters_resolved_total', 'resolved'),
    ('dead_letters_ignored_total', 'ignored'), ('delivered_envelopes_total', 'delivered')
), gauges AS (
  SELECT name, w.destination, CAST(coalesce((SELECT sum(n) FROM tallies t WHERE (w.destination IS NULL OR t.destination = w.destination)
    AND CASE WHEN wanted_status IS NULL THEN t.status <> 'delivered' ELSE t.status = wanted_status END), 0) AS BIGINT) AS value
  FROM wanted w CROSS JOIN names
)"""


def _gauges(spark: SparkSession, sf: str) -> DataFrame:
    """One configured destination has no rows at all and is reported with zeros."""
    seen = F.col("destination") != "audit_deletes"
    return M.delivery_gauges(current_letters(spark, sf).where(seen), _ledger(spark, sf).where(seen), FD.DESTINATIONS)


@query("f4_delivery_gauges", _GAUGES + " SELECT name, destination, value FROM gauges")
def f4_delivery_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return _gauges(spark, sf)


@query("f5_publication_actions", """
SELECT schema_name, table_name, publishes_updates, publishes_deletes FROM rel JOIN actions USING (relation_id)""")
def f5_publication_actions(spark: SparkSession, sf: str) -> DataFrame:
    return PR.publication_actions(FD.members(spark, sf), FD.publications(spark, sf))


@query("f6_identity_columns", """
SELECT relation_id, '[' || CASE WHEN coalesce(names, '') = '' THEN '' ELSE '"' || replace(names, ',', '","') || '"' END || ']' AS columns
FROM rel LEFT JOIN idcols USING (relation_id)""")
def f6_identity_columns(spark: SparkSession, sf: str) -> DataFrame:
    found = PR.identity_columns(FD.relations(spark, sf), FD.index_columns(spark, sf), FD.attributes(spark, sf))
    return found.select("relation_id", F.to_json("replica_identity_columns").alias("columns"))


_FANOUT = """, verdicts AS (
  SELECT t.n, d.destination, coalesce(o.status, 'skipped') AS status, coalesce(CAST(o.attempts AS BIGINT), 0) AS attempts
  FROM (SELECT DISTINCT n FROM feed) t CROSS JOIN targets d LEFT JOIN outcomes o ON o.n = t.n AND o.destination = d.destination AND o.enabled
), fanouts AS (
  SELECT n, count(*) FILTER (status = 'delivered') AS delivered, count(*) FILTER (status = 'skipped') AS skipped,
    count(*) FILTER (status = 'dead_lettered') AS dead_lettered, count(*) AS destinations,
    CASE WHEN bool_and(status IN ('delivered', 'skipped')) THEN 'fanout_delivered' ELSE 'fanout_partial' END AS status
  FROM verdicts GROUP BY n
)"""


def _all_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every (transaction, destination): skipped when not routed or disabled, else its resolved status."""
    matches = R.transaction_matches(FD.change_feed(spark, sf), FD.DESTINATIONS).withColumns({
        "work": F.col("transaction_id").cast("bigint"), "event_id": F.lit(None).cast("string"),
    })
    keyed = matches.withColumn("source_position", FD.position_text(F.col("work"))).withColumn(L.KEY, L.idempotency_key("transaction"))
    takes = F.col("matched") & R.enabled(FD.DESTINATIONS)
    joined = keyed.join(resolved(spark, sf).drop("destination"), L.KEY, "left")
    return joined.withColumns({
        "status": F.when(takes, F.col("status")).otherwise("skipped"), "attempts": F.when(takes, F.col("attempts")).otherwise(0),
    })


@query("f7_fanout_summary", _FANOUT + " SELECT n AS work, delivered, skipped, dead_lettered, destinations, status FROM fanouts")
def f7_fanout_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.fanout_summary(_all_outcomes(spark, sf), ["work"])


@query("f8_processor_result", _FANOUT + """
SELECT 'fanout' AS kind, CASE status WHEN 'fanout_partial' THEN 'failure' ELSE 'success' END AS result, count(*) AS n FROM fanouts GROUP BY ALL
UNION ALL SELECT 'single', CASE status WHEN 'skipped' THEN 'skipped' WHEN 'dead_lettered' THEN 'failure' WHEN 'in_progress' THEN 'open' ELSE 'success' END, count(*) FROM verdicts GROUP BY ALL""")
def f8_processor_result(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = _all_outcomes(spark, sf)
    single = outcomes.select(F.lit("single").alias("kind"), A.processor_result(F.col("status")).alias("result"))
    fanned = A.fanout_summary(outcomes, ["work"]).select(F.lit("fanout").alias("kind"), A.processor_result(F.col("status")).alias("result"))
    return single.unionByName(fanned).groupBy("kind", "result").agg(F.count(F.lit(1)).alias("n"))


_DISPATCH = _FANOUT + """, results AS (
  SELECT destination, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS lane,
    CASE status WHEN 'skipped' THEN 'skipped' WHEN 'dead_lettered' THEN 'failed' WHEN 'in_progress' THEN 'open' ELSE 'succeeded' END AS result FROM verdicts
), counters AS (
  SELECT 'dispatch_' || result || '_total' AS name, destination, lane, count(*) AS value FROM results WHERE result <> 'open' GROUP BY ALL
  UNION ALL SELECT 'dispatch_started_total', destination, lane, count(*) FROM results GROUP BY ALL
)"""


def _counters(spark: SparkSession, sf: str) -> DataFrame:
    lane = F.when(F.col("work") % 2 == 0, "even").otherwise("odd")
    results = _all_outcomes(spark, sf).withColumns({"lane": lane, "result": A.processor_result(F.col("status"))})
    return M.dispatch_counters(results, ["lane", "destination"])


@query("f9_dispatch_counters", _DISPATCH + " SELECT name, destination, lane, CAST(value AS BIGINT) AS value FROM counters")
def f9_dispatch_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _counters(spark, sf)


@query("f10_transaction_sizes", "SELECT transaction_id, count(*) AS event_count FROM feed GROUP BY 1 UNION ALL SELECT 'empty-' || seq, 0 FROM feed WHERE seq % 100 = 1")
def f10_transaction_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return P.project_transactions(FD.projected(spark, sf), FD.headers(spark, sf)).select("transaction_id", "event_count")


@query("f11_latency_summary", """, latencies AS (SELECT entity, (seq * 37 + user_id * 11) % 997 AS ms FROM feed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ms) AS r, count(*) OVER (PARTITION BY entity) AS c FROM latencies)
SELECT entity, count(*) AS samples, CAST(sum(ms) * 1000 // count(*) AS BIGINT) AS mean_thousandths, min(ms) FILTER (r >= (c * 95 + 99) // 100) AS p95
FROM ranked GROUP BY entity""")
def f11_latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    wait = (F.col("seq") * 37 + field("identity", "id").cast("bigint") * 11) % 997
    return M.latency_summary(FD.change_feed(spark, sf).select("entity", wait.alias("ms")), ["entity"], "ms", 95)


@query("f12_throughput", """
SELECT user_id, CAST(CASE WHEN user_id % 10 = 0 THEN 0 ELSE round(count(*) * 1.0 / (user_id % 10), 2) * 100 END AS BIGINT) AS per_second_hundredths FROM feed GROUP BY user_id""")
def f12_throughput(spark: SparkSession, sf: str) -> DataFrame:
    counts = FD.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rate = M.throughput(F.col("n"), F.col("user_id") % 10)
    return counts.select("user_id", (rate * 100).cast("bigint").alias("per_second_hundredths"))


@query("f13_delivery_rate_5m", """
SELECT destination, CAST(epoch(delivered_at) AS BIGINT) // 300 * 300 AS window_start, count(*) AS delivered, count(*) * 1000 // 300 AS rate_thousandths
FROM ledger GROUP BY ALL""")
def f13_delivery_rate_5m(spark: SparkSession, sf: str) -> DataFrame:
    return M.delivery_rate(_ledger(spark, sf), ["destination"])


@query("f14_wal_budget_ratio", "SELECT sample, CASE WHEN retained IS NOT NULL AND safe IS NOT NULL THEN CAST(retained AS DOUBLE) / (CASE WHEN retained + safe < 1 THEN 1 ELSE retained + safe END) END AS ratio FROM slots")
def f14_wal_budget_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return FD.slot_samples(spark, sf).select("sample", M.wal_budget_ratio().alias("ratio"))


@query("f15_sustained_alerts", """, marked AS (
  SELECT *, NOT active AS on_, max(CASE WHEN active THEN sample END) OVER (PARTITION BY slot_name ORDER BY sample) AS run FROM slots
)
SELECT slot_name, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS samples FROM marked WHERE on_
GROUP BY slot_name, run HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 30000000""")
def f15_sustained_alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = M.sustained_alerts(FD.slot_samples(spark, sf), ["slot_name"], "sample", "sampled_at", ~F.col("active"), 30)
    return alerts.select("slot_name", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "samples")


@query("f16_ledger_growth", "SELECT destination, count(DISTINCT transaction_id) AS transactions, count(*) AS ledger_rows FROM ledger GROUP BY destination")
def f16_ledger_growth(spark: SparkSession, sf: str) -> DataFrame:
    return L.ledger_growth(_ledger(spark, sf))


@query("f16_ledger_growth_approximate")
def f16_ledger_growth_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """A sketch, so there is no exact answer to compare with."""
    return L.ledger_growth(_ledger(spark, sf), approximate=True)


@query("f16_ledger_growth_sketched", "SELECT destination, count(*) AS ledger_rows, true AS within_bound FROM ledger GROUP BY destination")
def f16_ledger_growth_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of four batches, stored, read back and united: rows are exact, transactions within three per cent of the count."""
    ledger = _ledger(spark, sf)
    folder = run_folder(spark, "sketches")
    for number in range(4):
        batch = ledger.where(F.col("transaction_id").cast("bigint") % 4 == number)
        L.ledger_sketches(batch).write.parquet(f"{folder}/batch={number}")
    grown = L.growth_from_sketches(spark.read.parquet(folder)).withColumnRenamed("transactions", "estimate")
    exact = L.ledger_growth(ledger).select("destination", "transactions")
    within = F.abs(F.col("estimate") - F.col("transactions")) <= F.col("transactions") * 0.03
    return grown.join(exact, "destination").select("destination", "ledger_rows", within.alias("within_bound"))


# --- H: sorts, limits -------------------------------------------------------------------------


@query("h1_list_dead_letters", """
SELECT dead_letter_id, destination, failed_epoch FROM current_letters WHERE status = 'pending' AND destination = 'all' ORDER BY failed_epoch, dead_letter_id LIMIT 100""")
def h1_list_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    listed = DL.list_dead_letters(current_letters(spark, sf), status="pending", destination="all")
    return listed.select("dead_letter_id", "destination", F.unix_timestamp("failed_at").alias("failed_epoch"))


@query("h2_list_ledger", "SELECT idempotency_key, destination, transaction_id FROM ledger ORDER BY delivered_at, idempotency_key")
def h2_list_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return L.list_ledger(_ledger(spark, sf)).select(L.KEY, "destination", "transaction_id")


@query("h3_recent_events", "SELECT seq, user_id FROM feed ORDER BY seq DESC LIMIT 250")
def h3_recent_events(spark: SparkSession, sf: str) -> DataFrame:
    return C.recent_events(FD.table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id"), "seq")


@query("h4_order_work", """
SELECT 'global' AS scope, seq, row_number() OVER (ORDER BY seq) AS place FROM feed
UNION ALL SELECT 'transaction', seq, row_number() OVER (PARTITION BY n ORDER BY seq) FROM feed
UNION ALL SELECT 'relation', seq, row_number() OVER (PARTITION BY namespace, entity ORDER BY seq) FROM feed
UNION ALL SELECT 'primary_key', seq, row_number() OVER (PARTITION BY namespace, entity, user_id ORDER BY seq) FROM feed
UNION ALL SELECT 'none', seq, NULL FROM feed""")
def h4_order_work(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every change in each scope; the order itself is what order_work sorts by."""
    feed = FD.change_feed(spark, sf)
    parts = []
    for scope in C.SCOPES:
        numbered = C.number_in_scope(feed, scope, "seq", 1000) if scope != "none" else C.order_work(feed, scope, ["seq"]).withColumn("place", F.lit(None).cast("bigint"))
        parts.append(numbered.select(F.lit(scope).alias("scope"), "seq", "place"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("h4_sorted_work", """
SELECT namespace || '.' || entity AS scope_key, seq, transaction_id FROM feed""")
def h4_sorted_work(spark: SparkSession, sf: str) -> DataFrame:
    return C.order_work(FD.change_feed(spark, sf), "relation", ["seq"]).select("scope_key", "seq", "transaction_id")


@query("h5_sorted_metrics", _DISPATCH + " SELECT name, destination, lane, CAST(value AS BIGINT) AS value FROM counters ORDER BY name, destination, lane")
def h5_sorted_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.sorted_metrics(_counters(spark, sf), ["lane", "destination"])


@query("h6_show_dead_letter", """
SELECT dead_letter_id, event_id AS payload_event_id, operation AS payload_operation, 'sha256:' || seq AS payload_fingerprint FROM letters""")
def h6_show_dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    """Every letter by its id; the bodies of every other one are stored in parts beside it."""
    letters = FD.dead_letters(spark, sf).withColumn("_cut", F.unix_timestamp("failed_at") / 60 % 2 == 0)
    pieces = F.array(*[F.struct(F.lit(n).cast("bigint").alias("part"), F.substring("payload_json", 1 + 40 * n, 40 if n < 3 else 100000).alias("body")) for n in range(4)])
    parts = letters.where("_cut").select("dead_letter_id", F.inline(pieces))
    stored = letters.withColumn("payload_json", F.when(~F.col("_cut"), F.col("payload_json"))).drop("_cut")
    shown = DL.show_dead_letters(stored, letters.select("dead_letter_id"), parts)
    path = "$.metadata.payload_policy.fingerprint"
    return shown.select(
        "dead_letter_id", F.variant_get("payload", "$.event_id", "string").alias("payload_event_id"),
        F.variant_get("payload", "$.operation", "string").alias("payload_operation"),
        F.variant_get("payload", path, "string").alias("payload_fingerprint"),
    )


# --- M: receivers -----------------------------------------------------------------------------


@query("m1_apply_once", """, received AS (SELECT event_id, seq * 2 AS arrival FROM projected UNION ALL SELECT event_id, seq * 2 + 1 FROM projected WHERE seq % 4 = 0)
SELECT r.event_id, count(*) AS attempts, min(arrival) AS first_attempt, CAST(CASE WHEN min(arrival) % 10 = 0 THEN 0 ELSE 1 END AS BIGINT) AS applied_now FROM received r GROUP BY r.event_id""")
def m1_apply_once(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth event is delivered twice, and every fifth was applied before."""
    events = FD.projected(spark, sf).select("event_id", "seq")
    copies = F.when(F.col("seq") % 4 == 0, F.array(F.col("seq") * 2, F.col("seq") * 2 + 1)).otherwise(F.array(F.col("seq") * 2))
    applied = events.where("seq % 5 = 0").select("event_id")
    return C.apply_once(events.withColumn("at", F.explode(copies)), applied, "at")


def _state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    changes = FD.change_feed(spark, sf).select(
        "namespace", "entity", field("identity", "id").cast("bigint").alias("user_id"), "operation", "sequence_number", "transport_lsn", "seq",
        field("new_values", "total_cents").cast("bigint").alias("total_cents"),
    )
    cut = F.col("transport_lsn")
    return changes.where(lsn_to_number(cut) % 128 == 48), changes.where(lsn_to_number(cut) % 128 != 48)


@query("m2_materialize_current_state", """
SELECT namespace, entity, user_id, cents AS total_cents, operation = 'delete' AS deleted FROM (
  SELECT *, CASE WHEN has_new THEN new_cents END AS cents, row_number() OVER (PARTITION BY namespace, entity, user_id ORDER BY seq DESC) AS r FROM feed) WHERE r = 1""")
def m2_materialize_current_state(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches that interleave in time, so that the second brings late, older changes."""
    first, second = _state(spark, sf)
    keys, position = ["namespace", "entity", "user_id"], lsn_to_number(F.col("transport_lsn"))
    state = C.materialize(None, first, keys, position, ["total_cents"])
    state = C.materialize(state, second, keys, position, ["total_cents"])
    return state.select(*keys, "total_cents", "deleted")


@query("m2_unsupported_routes", "SELECT seq, namespace, entity FROM feed WHERE NOT (namespace = 'public' AND entity IN ('orders', 'payments'))")
def m2_unsupported_routes(spark: SparkSession, sf: str) -> DataFrame:
    return C.unsupported_routes(FD.change_feed(spark, sf), [("public", "orders"), ("public", "payments")]).select("seq", "namespace", "entity")


@query("m3_check_payload_shape", """
SELECT seq, CASE seq % 5 WHEN 0 THEN CASE WHEN seq % 3 = 0 THEN 'v1 must not have the column' ELSE 'v1' END
  WHEN 1 THEN CASE WHEN seq % 3 = 0 AND seq % 4 <> 0 THEN 'v2' ELSE 'v2 needs the column' END ELSE 'unexpected status' END AS shape
FROM feed WHERE has_new""")
def m3_check_payload_shape(spark: SparkSession, sf: str) -> DataFrame:
    """New rows, a third of them with a currency, of which a quarter is not the expected one."""
    currency = F.when(F.col("seq") % 4 == 0, '"EUR"').otherwise('"USD"')
    rows = FD.change_feed(spark, sf).where(F.col("new_values").isNotNull())
    data = F.when(F.col("seq") % 3 == 0, F.map_concat("new_values", F.create_map(F.lit("currency"), currency))).otherwise(F.col("new_values"))
    return rows.select("seq", C.check_payload_shape(data, "currency", '"pending"', '"paid"', '"USD"').alias("shape"))


@query("m3_key_sets", """
SELECT namespace, entity, 'customer_email,id,status,total_cents' AS columns, count(*) AS payloads, min(seq) AS first_seq, max(seq) AS last_seq FROM feed GROUP BY namespace, entity""")
def m3_key_sets(spark: SparkSession, sf: str) -> DataFrame:
    return C.key_sets(FD.projected(spark, sf))


@query("m4_check_identity", """
SELECT transaction_id, count(DISTINCT user_id) = 1 AS same_identity, CAST(min(CASE WHEN user_id % 4 = 0 THEN 1 ELSE 2 END) AS INTEGER) AS fewest_columns, count(*) AS events
FROM feed GROUP BY transaction_id""")
def m4_check_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Two-column keys, one column missing for every fourth user."""
    user = field("identity", "id")
    pair = F.create_map(F.lit("tenant_id"), F.lit("9"), F.lit("member"), user)
    keyed = FD.change_feed(spark, sf).withColumn(
        "identity", F.when(user.cast("bigint") % 4 == 0, F.create_map(F.lit("member"), user)).otherwise(pair)
    )
    return C.check_identity(keyed, ["transaction_id"])


@query("m5_delivery_audit", """
SELECT p.idempotency_key, CASE WHEN p.n % 3 = 0 THEN 'open' ELSE o.status END AS status, CAST(CASE WHEN p.n % 3 = 0 THEN 0 ELSE o.attempts END AS INTEGER) AS attempts,
  p.n % 3 = 1 AND p.n % 7 <> 0 AS signature_verified FROM pairs p JOIN outcomes o USING (idempotency_key)""")
def m5_delivery_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the deliveries have no outcome yet, a third no receipt, and some receipts a bad signature."""
    pairs = FD.transaction_pairs(spark, sf).select(L.KEY, "destination", "work")
    number = F.split_part(L.KEY, F.lit(":"), F.lit(5)).cast("bigint")
    outcomes = resolved(spark, sf).where(number % 3 != 0).select(L.KEY, "status", "attempts")
    sent_at = F.timestamp_seconds(F.lit(1704067200) + F.col("work"))
    good = signing.sign_payload(SECRET, T.iso8601(sent_at), F.col(L.KEY))
    given = F.when(F.col("work") % 7 == 0, "sha256=wrong").otherwise(good)
    checked = signing.verify_signature(SECRET, T.iso8601(sent_at), F.col(L.KEY), given, sent_at)
    receipts = pairs.where("work % 3 = 1").select(L.KEY, checked.alias("signature_verified"))
    return C.delivery_audit(pairs, outcomes, receipts, [L.KEY]).select(L.KEY, "status", "attempts", "signature_verified")


@query("m6_payment_balance", """
SELECT order_id, CAST(coalesce(sum(amount_cents) FILTER (status = 'captured'), 0) AS BIGINT) AS captured_cents,
  CAST(coalesce(sum(amount_cents) FILTER (status = 'reversed'), 0) AS BIGINT) AS reversed_cents, CAST(sum(amount_cents) AS BIGINT) AS net_cents,
  count(*) FILTER ((status = 'captured' AND amount_cents <= 0) OR (status = 'reversed' AND amount_cents >= 0)) AS bad_entries
FROM shop_payments GROUP BY order_id""")
def m6_payment_balance(spark: SparkSession, sf: str) -> DataFrame:
    return C.payment_balance(FD.shop_payments(spark, sf))


# --- O: destination settings ------------------------------------------------------------------


@query("o1_destinations", """
SELECT destination, enabled, CAST(max_attempts AS INTEGER) AS max_attempts, CASE destination WHEN 'payments_only' THEN '2' ELSE '1,5' END AS schedule, count(*) AS events
FROM matched GROUP BY ALL
UNION ALL SELECT 'only', true, 7, '1', count(*) FROM feed""")
def o1_destinations(spark: SparkSession, sf: str) -> DataFrame:
    """Events per destination with its resolved settings, for the list form and for the single-webhook form."""
    single = destinations({"retry": {"max_attempts": 7, "schedule_seconds": [1]}, "webhook": {"name": "only"}})
    parts = []
    for listed in (FD.DESTINATIONS, single):
        limit, schedule = L.retry_settings(listed)
        routed = R.route_events(FD.change_feed(spark, sf), listed)
        parts.append(routed.groupBy(
            "destination", R.enabled(listed).alias("enabled"), limit.alias("max_attempts"), F.array_join(schedule, ",").alias("schedule")
        ).agg(F.count(F.lit(1)).alias("events")))
    return parts[0].unionByName(parts[1])
