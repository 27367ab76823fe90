"""Queries: projection, routing, health predicates and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow import config
from changeflow.functions import payload as PF
from changeflow.functions import text as T
from changeflow.operators import deadletters as DL
from changeflow.operators import ledger as L
from changeflow.operators import preflight as PR
from changeflow.operators import project as P
from changeflow.operators import redact as RD
from changeflow.operators import route as R
from changeflow.plans import feed as FD
from changeflow.plans.checks_ingest import BODIES, field, publication_facts
from changeflow.plans.registry import query
from changeflow.schemas import CHANGE_EVENT
from changeflow.sources.catalog import conform

# --- B: projections ---------------------------------------------------------------------------


@query("b1_project_events", """
SELECT seq, event_id, source, operation, namespace, entity, CAST(user_id AS VARCHAR) AS identity_id, position AS source_position,
  transaction_id, occurred_at, '"' || CASE WHEN has_new THEN new_status ELSE old_status END || '"' AS data_status,
  CAST(CASE WHEN explicit_id IS NULL THEN 0 ELSE 1 END + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS metadata_keys
FROM projected""")
def b1_project_events(spark: SparkSession, sf: str) -> DataFrame:
    return FD.projected(spark, sf).select(
        "seq", "event_id", "source", "operation", "namespace", "entity", field("identity", "id").alias("identity_id"),
        "source_position", "transaction_id", "occurred_at", field("data", "status").alias("data_status"),
        F.size("metadata").alias("metadata_keys"),
    )


@query("b2_event_id", "SELECT seq, event_id, hashed_id FROM projected")
def b2_event_id(spark: SparkSession, sf: str) -> DataFrame:
    return FD.change_feed(spark, sf).select("seq", PF.event_id().alias("event_id"), PF.hashed_event_id().alias("hashed_id"))


@query("b3_source_label", "SELECT seq, source FROM feed")
def b3_source_label(spark: SparkSession, sf: str) -> DataFrame:
    return FD.change_feed(spark, sf).select("seq", PF.source_label().alias("source"))


@query("b4_event_data", """
SELECT seq, CAST(CASE WHEN has_new THEN new_cents WHEN full_old THEN old_cents END AS VARCHAR) AS total_cents,
  CAST(CASE WHEN has_new OR full_old THEN 4 ELSE 1 END AS INTEGER) AS columns FROM feed WHERE seq % 7 <> 0
UNION ALL SELECT seq, NULL, 0 FROM feed WHERE seq % 7 = 0""")
def b4_event_data(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh change has neither row."""
    kept = F.col("seq") % 7 != 0
    feed = FD.change_feed(spark, sf).withColumns({c: F.when(kept, F.col(c)) for c in ("old_values", "new_values")})
    return feed.select("seq", field_of(PF.event_data(), "total_cents").alias("total_cents"), F.size(PF.event_data()).alias("columns"))


def field_of(values: Column, key: str) -> Column:
    return F.try_element_at(values, F.lit(key))


@query("b5_occurred_at", "SELECT seq, occurred_at FROM feed")
def b5_occurred_at(spark: SparkSession, sf: str) -> DataFrame:
    return FD.change_feed(spark, sf).select("seq", PF.occurred_at().alias("occurred_at"))


@query("b6_column_changes", """, sides AS (
  SELECT seq, operation, full_old, unnest([
    {'name': 'id', 'o': CAST(user_id AS VARCHAR), 'n': CAST(user_id AS VARCHAR)},
    {'name': 'status', 'o': '"' || old_status || '"', 'n': '"' || new_status || '"'},
    {'name': 'total_cents', 'o': CAST(old_cents AS VARCHAR), 'n': CAST(new_cents AS VARCHAR)},
    {'name': 'customer_email', 'o': '"' || old_mail || '"', 'n': '"' || new_mail || '"'}]) AS c
  FROM feed WHERE seq % 25 <> 0
), diffs AS (
  SELECT seq, c.name AS name, CASE WHEN operation <> 'insert' THEN c.o END AS old_value, CASE WHEN operation <> 'delete' THEN c.n END AS new_value
  FROM sides WHERE operation <> 'update' OR full_old
)
SELECT * FROM diffs WHERE old_value IS DISTINCT FROM new_value
UNION ALL SELECT seq, 'status', NULL, '"manual"' FROM feed WHERE seq % 50 = 25""")
def b6_column_changes(spark: SparkSession, sf: str) -> DataFrame:
    return FD.change_feed(spark, sf).select("seq", F.inline(PF.column_changes()))


@query("b7_normalise_keys", """
SELECT seq, CAST(n AS VARCHAR) AS transaction_id, CAST(sn AS INTEGER) AS sequence_number, upper(operation) AS operation, CAST(user_id AS VARCHAR) AS key_seven FROM feed""")
def b7_normalise_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-number ids and map keys become text; the operation keeps its case."""
    feed = FD.change_feed(spark, sf).withColumns({
        "transaction_id": F.col("transaction_id").cast("bigint"), "sequence_number": F.col("sequence_number").cast("bigint"),
        "operation": F.upper("operation"), "identity": F.create_map(F.lit(7), F.col("identity")["id"].cast("bigint")),
    })
    normal = conform(feed, CHANGE_EVENT)
    return normal.select("seq", "transaction_id", "sequence_number", "operation", field("identity", "7").alias("key_seven"))


TRANSACTIONS = """, limbs AS (
  SELECT n, sn, event_id, sha256(sn || '|' || event_id) AS d FROM projected
), digests AS (
  SELECT n, concat_ws('.', """ + ", ".join(
    f"CAST(sum(CAST('0x' || substr(d, {1 + 8 * k}, 8) AS BIGINT)) AS VARCHAR)" for k in range(4)
) + """) AS digest, count(*) AS cnt FROM limbs GROUP BY n
), txn AS (
  SELECT p.n, CAST(p.n AS VARCHAR) AS transaction_id, cnt AS event_count, digest,
    (SELECT source FROM feed f WHERE f.seq = p.n * 4) AS source, '0/' || printf('%X', 16777216 + p.n * 64) AS place
  FROM digests p
), envelopes AS (
  SELECT transaction_id, event_count, source, place AS position, f.ts AS committed, n % 25 = 0 AS named,
    CASE WHEN n % 25 = 0 THEN 'txn-explicit-' || transaction_id ELSE 'txn_' || sha256(source || '|' || transaction_id || '|' || place || '|' || event_count || '|' || digest) END AS event_id
  FROM txn JOIN feed f USING (transaction_id, n, source) WHERE f.sn = 0
  UNION ALL
  SELECT 'empty-' || seq, 0, 'postgresql', CASE WHEN n % 2 = 1 THEN txn_position END, ts, n % 25 = 0,
    CASE WHEN n % 25 = 0 THEN 'txn-explicit-empty-' || seq ELSE 'txn_' || sha256('postgresql|empty-' || seq || '|' || coalesce(CASE WHEN n % 2 = 1 THEN txn_position END, '\\N') || '|0|0') END
  FROM feed WHERE seq % 100 = 1
)"""


def _transactions(spark: SparkSession, sf: str) -> DataFrame:
    return P.project_transactions(FD.projected(spark, sf), FD.headers(spark, sf))


@query("b8_project_transactions", BODIES + TRANSACTIONS + """
SELECT e.transaction_id, '{"event_id":"' || e.event_id || '","type":"transaction.committed","source":"' || e.source || '","transaction_id":'
  || CASE WHEN e.event_count = 0 THEN '"' || e.transaction_id || '"' ELSE e.transaction_id END
  || ',"source_position":' || coalesce('"' || e.position || '"', 'null') || ',"commit_lsn":' || coalesce('"' || e.position || '"', 'null')
  || ',"committed_at":"' || strftime(committed, '%Y-%m-%dT%H:%M:%SZ') || '","event_count":' || e.event_count || ',"events":['
  || coalesce((SELECT string_agg(body, ',' ORDER BY sn) FROM bodies b WHERE b.transaction_id = e.transaction_id), '') || '],"metadata":'
  || CASE WHEN named THEN '{"event_id":"' || e.event_id || '"}' ELSE '{}' END || '}' AS body
FROM envelopes e""")
def b8_project_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Whole envelope text. Every transaction here has one part."""
    bodies = P.transaction_bodies(_transactions(spark, sf), P.event_parts(FD.projected(spark, sf)))
    return bodies.select("transaction_id", "body")


@query("b9_transaction_event_id", TRANSACTIONS + " SELECT transaction_id, event_id FROM envelopes")
def b9_transaction_event_id(spark: SparkSession, sf: str) -> DataFrame:
    return _transactions(spark, sf).select("transaction_id", "event_id")


@query("b10_transaction_position", """
SELECT transaction_id, CASE WHEN n % 2 = 1 THEN txn_position ELSE arg_max(position, sn) FILTER (position IS NOT NULL) END AS source_position
FROM feed GROUP BY transaction_id, n, txn_position
UNION ALL SELECT 'empty-' || seq, CASE WHEN n % 2 = 1 THEN txn_position END FROM feed WHERE seq % 100 = 1""")
def b10_transaction_position(spark: SparkSession, sf: str) -> DataFrame:
    return _transactions(spark, sf).select("transaction_id", "source_position")


@query("b11_transaction_source", """
SELECT transaction_id, source FROM feed WHERE sn = 0 UNION ALL SELECT 'empty-' || seq, 'postgresql' FROM feed WHERE seq % 100 = 1""")
def b11_transaction_source(spark: SparkSession, sf: str) -> DataFrame:
    return _transactions(spark, sf).select("transaction_id", "source")


def _some_bare(spark: SparkSession, sf: str) -> DataFrame:
    """Every ninth transaction arrives as bare events."""
    whole = F.col("transaction_id").cast("bigint") % 9 != 0
    return FD.change_feed(spark, sf).withColumn("transaction_id", F.when(whole, F.col("transaction_id")))


@query("b12_unwrap_to_events", """
SELECT seq, n % 9 = 0 OR sn = max(sn) OVER (PARTITION BY n) AS group_end FROM feed""")
def b12_unwrap_to_events(spark: SparkSession, sf: str) -> DataFrame:
    return P.unwrap_to_events(_some_bare(spark, sf)).select("seq", "group_end")


@query("b13_wrap_as_transactions", r"""
SELECT seq, CASE WHEN n % 9 <> 0 THEN transaction_id ELSE coalesce(explicit_id, 'evt_' || sha256(source || '|\N|' || coalesce(position, '\N')
    || '|' || sn || '|' || coalesce(CAST(epoch_us(occurred) AS VARCHAR), '\N') || '|' || namespace || '|' || entity || '|' || operation
    || '|[{"key":"id","value":"' || user_id || '"}]|' || coalesce(old_text, '\N') || '|' || coalesce(new_text, '\N'))) END AS transaction_id,
  CASE WHEN n % 9 <> 0 THEN transaction_id ELSE coalesce(explicit_id, position) END AS shown_transaction_id,
  CAST(CASE WHEN n % 9 = 0 THEN 0 ELSE sn END AS INTEGER) AS sequence_number FROM texts""")
def b13_wrap_as_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return P.wrap_as_transactions(_some_bare(spark, sf)).select("seq", "transaction_id", "shown_transaction_id", "sequence_number")


@query("b14_restore_prepared", "SELECT payload_json, 'sha256:' || seq AS policy_fingerprint FROM letters")
def b14_restore_prepared(spark: SparkSession, sf: str) -> DataFrame:
    return P.restore_prepared(FD.dead_letters(spark, sf), RD.STAMP).select("payload_json", "policy_fingerprint")


# --- C: filters -------------------------------------------------------------------------------


@query("c1_route_events", "SELECT seq, destination FROM matched")
def c1_route_events(spark: SparkSession, sf: str) -> DataFrame:
    return R.route_events(FD.change_feed(spark, sf), FD.DESTINATIONS).select("seq", "destination")


@query("c2_route_transactions", "SELECT seq, destination FROM feed JOIN pairs USING (n)")
def c2_route_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return R.route_transactions(FD.change_feed(spark, sf), FD.DESTINATIONS).select("seq", "destination")


@query("c3_enabled_destinations", """
SELECT destination, CASE WHEN enabled THEN 'enabled' ELSE 'disabled' END AS verdict, count(*) AS pairs FROM matched GROUP BY ALL""")
def c3_enabled_destinations(spark: SparkSession, sf: str) -> DataFrame:
    routed = R.route_events(FD.change_feed(spark, sf), FD.DESTINATIONS)
    verdict = F.when(R.enabled(FD.DESTINATIONS), "enabled").otherwise("disabled")
    return routed.groupBy("destination", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("pairs"))


@query("c4_skip_reason", """, everything AS (
  SELECT t.n, destination, enabled, dno, c.copy, p.n IS NOT NULL AS matched
  FROM (SELECT DISTINCT n FROM feed) t CROSS JOIN targets LEFT JOIN pairs p USING (n, destination, enabled, dno),
    (VALUES (0), (1)) c(copy) WHERE c.copy = 0 OR t.n % 17 = 0
)
SELECT n * 2 + copy AS arrival, destination, CASE WHEN NOT enabled THEN 'disabled' WHEN NOT matched THEN 'route_mismatch'
  WHEN n % 2 = 0 OR copy = 1 THEN 'duplicate' END AS skip_reason FROM everything""")
def c4_skip_reason(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs, some arriving twice, against a ledger of the even transactions."""
    number = F.col("transaction_id").cast("bigint")
    matches = R.transaction_matches(FD.change_feed(spark, sf), FD.DESTINATIONS)
    pairs = matches.withColumns({
        "source_position": FD.position_text(number), "event_id": F.lit(None).cast("string"),
        "arrival": F.explode(F.when(number % 17 == 0, F.array(number * 2, number * 2 + 1)).otherwise(F.array(number * 2))),
    }).withColumn(L.KEY, L.idempotency_key("transaction"))
    ledger = FD.earlier_ledger(FD.transaction_pairs(spark, sf))
    return L.skip_reason(pairs, FD.DESTINATIONS, ledger, "arrival", "matched").select("arrival", "destination", "skip_reason")


AFTER, BEFORE = "2024-01-01T01:00:00Z", "2024-01-01T20:00:00Z"


@query("c5_dead_letter_filter", """
SELECT dead_letter_id, status, failed_epoch FROM current_letters
WHERE status = 'pending' AND destination = 'all' AND failed_epoch BETWEEN 1704067200 + 3600 AND 1704067200 + 72000""")
def c5_dead_letter_filter(spark: SparkSession, sf: str) -> DataFrame:
    letters = current_letters(spark, sf)
    found = DL.dead_letter_filter(letters, "pending", "all", AFTER, BEFORE)
    return found.select("dead_letter_id", "status", F.unix_timestamp("failed_at").alias("failed_epoch"))


def current_letters(spark: SparkSession, sf: str) -> DataFrame:
    letters = FD.dead_letters(spark, sf)
    return DL.current(letters, FD.dead_letter_log(letters))


@query("c6_slot_reason", "SELECT sample, slot_name, reason, reason IS NULL AS ready FROM health")
def c6_slot_reason(spark: SparkSession, sf: str) -> DataFrame:
    return PR.slot_health(FD.slot_samples(spark, sf)).select("sample", "slot_name", "reason", "ready")


@query("c7_slot_preflight", """
SELECT sample, CASE WHEN resume IS NOT NULL AND temporary_slot THEN 'temporary slot cannot resume a checkpoint'
  WHEN NOT present AND resume IS NOT NULL THEN 'missing slot must not be recreated while resuming'
  WHEN NOT present AND NOT auto_create THEN 'missing slot and auto-create is off'
  WHEN NOT present THEN NULL
  WHEN sample % 47 = 0 THEN 'wrong slot' WHEN slot_type <> 'logical' THEN 'not a logical pgoutput slot'
  WHEN database <> 'shop' THEN 'different database' WHEN active THEN 'already active'
  WHEN wal_status IN ('lost', 'unreserved') THEN 'cannot retain WAL: ' || wal_status
  WHEN conflicting OR invalid THEN 'invalidated' WHEN restart IS NULL THEN 'no reachable restart LSN'
  WHEN resume < restart OR resume < confirmed THEN 'resume position is no longer retained' END AS verdict
FROM slots""")
def c7_slot_preflight(spark: SparkSession, sf: str) -> DataFrame:
    expected = F.when(F.col("sample") % 47 == 0, "slot_x").otherwise(F.col("slot_name"))
    return FD.slot_samples(spark, sf).select("sample", PR.slot_preflight(F.lit("shop"), expected).alias("verdict"))


@query("c8_position_reachable", """
SELECT sample, NOT (coalesce(resume < restart, false) OR coalesce(resume < confirmed, false)) AS reachable FROM slots WHERE resume IS NOT NULL""")
def c8_position_reachable(spark: SparkSession, sf: str) -> DataFrame:
    resuming = FD.slot_samples(spark, sf).where(F.col("resume_lsn").isNotNull())
    return resuming.select("sample", PR.position_reachable(F.col("resume_lsn")).alias("reachable"))


_USABLE = """(NOT (publishes_updates OR publishes_deletes) OR CASE replica_identity WHEN 'd' THEN primary_key_usable
  WHEN 'i' THEN replica_identity_index_usable WHEN 'f' THEN true ELSE false END)"""


@query("c9_identity_usable", f"SELECT relation_id, {_USABLE} AS usable FROM facts")
def c9_identity_usable(spark: SparkSession, sf: str) -> DataFrame:
    return publication_facts(spark, sf).select("relation_id", PR.identity_usable().alias("usable"))


@query("c10_identity_preflight_report", f"""
SELECT schema_name || '.' || table_name AS qualified_name,
  concat_ws('/', CASE WHEN publishes_updates THEN 'UPDATE' END, CASE WHEN publishes_deletes THEN 'DELETE' END) AS actions,
  CASE replica_identity WHEN 'd' THEN 'default' WHEN 'n' THEN 'nothing' ELSE 'index' END AS replica_identity FROM facts WHERE NOT {_USABLE}""")
def c10_identity_preflight_report(spark: SparkSession, sf: str) -> DataFrame:
    return PR.identity_preflight_report(publication_facts(spark, sf))


# --- D: redaction -----------------------------------------------------------------------------


def _policy(*rules: dict) -> config.Policy:
    return config.Policy.parse({"rules": list(rules)})


REMOVE = _policy({"action": "remove", "columns": ["customer_email", "id"], "schemas": ["PUBLIC"]})
MASK = _policy({"action": "mask", "columns": ["customer_email", "id"], "operations": ["Update", "DELETE"]})
ORDERED = _policy(
    {"action": "mask", "columns": ["status"], "tables": ["ORDERS"]},
    {"action": "mask", "columns": ["STATUS", "total_cents"], "replacement": "x"},
    {"action": "remove", "columns": ["status"], "tables": ["payments"], "operations": ["update"]},
)

# How many changes an event shows, and which of them are about each column, before redaction.
_SHOWN = """, shown AS (
  SELECT *, seq % 25 = 0 AS fixed, operation <> 'update' OR full_old AS known,
    CASE WHEN has_new THEN new_status ELSE old_status END AS status, CASE WHEN has_new THEN new_cents ELSE old_cents END AS cents,
    CASE WHEN has_new THEN new_mail ELSE old_mail END AS mail,
    CASE WHEN seq % 25 = 0 OR operation = 'update' THEN 0 ELSE 1 END AS id_changes,
    CASE WHEN seq % 50 = 0 THEN 0 WHEN seq % 50 = 25 THEN 1 WHEN operation <> 'update' THEN 1 WHEN full_old AND old_status <> new_status THEN 1 ELSE 0 END AS status_changes,
    CASE WHEN seq % 25 = 0 THEN 0 WHEN operation <> 'update' THEN 1 WHEN full_old AND old_cents <> new_cents THEN 1 ELSE 0 END AS cents_changes,
    CASE WHEN seq % 25 = 0 THEN 0 WHEN operation = 'delete' THEN 1 WHEN operation = 'insert' THEN CAST(new_mail IS NOT NULL AS INTEGER)
      WHEN full_old AND new_mail IS NULL THEN 1 ELSE 0 END AS mail_changes
  FROM feed
)"""


def _summary(events: DataFrame, *more: Column) -> DataFrame:
    """Flat view of a redacted event."""
    return events.select(
        "seq", *more, field("data", "id").alias("data_id"), field("data", "customer_email").alias("data_email"),
        field("data", "status").alias("data_status"), field("data", "total_cents").alias("data_cents"),
        F.size("data").alias("columns"), F.size("identity").alias("keys"), F.size("changes").alias("changed"),
        F.array_join(F.transform("changes", lambda c: F.concat_ws(
            ":", c["name"], F.coalesce(c["old_value"], F.lit("-")), F.coalesce(c["new_value"], F.lit("-"))
        )), ",").alias("change_text"),
    )


@query("d1_remove_columns", _SHOWN + """
SELECT seq, CASE WHEN namespace = 'audit' THEN CAST(user_id AS VARCHAR) END AS data_id, CASE WHEN namespace = 'audit' THEN '"' || mail || '"' END AS data_email,
  '"' || status || '"' AS data_status, CAST(cents AS VARCHAR) AS data_cents, CAST(CASE WHEN namespace = 'audit' THEN 4 ELSE 2 END AS INTEGER) AS columns,
  CAST(CASE WHEN namespace = 'audit' THEN 1 ELSE 0 END AS INTEGER) AS keys,
  CAST(status_changes + cents_changes + CASE WHEN namespace = 'audit' THEN id_changes + mail_changes ELSE 0 END AS INTEGER) AS changed FROM shown""")
def d1_remove_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(RD.apply_policy(FD.projected(spark, sf), REMOVE)).drop("change_text")


@query("d2_mask_columns", _SHOWN + """
SELECT seq, CASE WHEN operation = 'insert' THEN CAST(user_id AS VARCHAR) ELSE '"[REDACTED]"' END AS data_id,
  CASE WHEN operation = 'insert' OR mail IS NULL THEN '"' || mail || '"' ELSE '"[REDACTED]"' END AS data_email,
  CAST(id_changes + mail_changes AS INTEGER) AS touched,
  CASE WHEN mail_changes = 0 THEN '' WHEN operation = 'insert' THEN 'customer_email:-:"' || new_mail || '"' ELSE 'customer_email:"[REDACTED]":-' END AS email_change
FROM shown""")
def d2_mask_columns(spark: SparkSession, sf: str) -> DataFrame:
    masked = RD.apply_policy(FD.projected(spark, sf), MASK)
    touched = F.filter("changes", lambda c: c["name"].isin("id", "customer_email"))
    email = F.filter("changes", lambda c: c["name"] == "customer_email")
    return masked.select(
        "seq", field("data", "id").alias("data_id"), field("data", "customer_email").alias("data_email"), F.size(touched).alias("touched"),
        F.array_join(F.transform(email, lambda c: F.concat_ws(
            ":", c["name"], F.coalesce(c["old_value"], F.lit("-")), F.coalesce(c["new_value"], F.lit("-")))), ",").alias("email_change"),
    )


@query("d3_rule_match", _SHOWN + """
SELECT seq, CASE WHEN entity = 'payments' AND operation = 'update' THEN NULL WHEN entity = 'orders' THEN '"[REDACTED]"' ELSE '"' || status || '"' END AS data_status,
  '"x"' AS data_cents, CAST(CASE WHEN entity = 'payments' AND operation = 'update' THEN 3 ELSE 4 END AS INTEGER) AS columns FROM shown""")
def d3_rule_match(spark: SparkSession, sf: str) -> DataFrame:
    """Selectors ignore case, column names do not, and later rules see what earlier ones left."""
    return _summary(RD.apply_policy(FD.projected(spark, sf), ORDERED)).select("seq", "data_status", "data_cents", "columns")


def _expected_fingerprint(name: str) -> str:
    raw = next(d["payload_policy"] for d in FD.SETTINGS["destinations"] if d["name"] == name)
    return config.fingerprint(raw)


_STAMPED = ("payments_only", "audit_deletes")
_PRINTS = "CASE destination " + " ".join(f"WHEN '{n}' THEN '{_expected_fingerprint(n)}'" for n in _STAMPED) + " END"


@query("d4_policy_fingerprint", """
SELECT destination, CASE destination
    WHEN 'payments_only' THEN 'sha256:' || sha256('{"rules":[{"action":"mask","columns":["customer_email"]}]}')
    WHEN 'audit_deletes' THEN 'sha256:' || sha256('{"rules":[{"action":"remove","columns":["customer_email","total_cents"],"tables":["ORDERS"]},{"action":"mask","columns":["status"],"replacement":"hidden","schemas":["audit"]}]}')
  END AS fingerprint, count(*) AS payloads FROM matched GROUP BY destination""")
def d4_policy_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    routed = R.route_events(FD.change_feed(spark, sf), FD.DESTINATIONS)
    return routed.groupBy("destination", RD.policy_fingerprint(FD.DESTINATIONS).alias("fingerprint")).agg(F.count(F.lit(1)).alias("payloads"))


@query("d5_stamp_policy", f"""
SELECT seq, destination, '{{"fingerprint":"' || {_PRINTS} || '"}}' AS stamp,
  CAST(CASE WHEN explicit_id IS NULL THEN 0 ELSE 1 END + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN destination IN ('payments_only', 'audit_deletes') THEN 1 ELSE 0 END AS INTEGER) AS keys
FROM matched""")
def d5_stamp_policy(spark: SparkSession, sf: str) -> DataFrame:
    """An older stamp in the metadata is replaced, not repeated."""
    routed = R.route_events(FD.projected(spark, sf), FD.DESTINATIONS)
    stamped = RD.stamp_for_destinations(RD.stamp_for_destinations(routed, FD.DESTINATIONS), FD.DESTINATIONS)
    return stamped.select("seq", "destination", field("metadata", RD.STAMP).alias("stamp"), F.size("metadata").alias("keys"))


@query("d6_policy_transactions", _SHOWN + """
SELECT seq, destination, CASE WHEN destination = 'payments_only' AND mail IS NOT NULL THEN '"[REDACTED]"'
    WHEN destination = 'audit_deletes' AND entity = 'orders' THEN NULL ELSE '"' || mail || '"' END AS data_email,
  CASE WHEN destination = 'audit_deletes' AND namespace = 'audit' THEN '"hidden"' ELSE '"' || status || '"' END AS data_status,
  CASE WHEN destination = 'audit_deletes' AND entity = 'orders' THEN NULL ELSE CAST(cents AS VARCHAR) END AS data_cents
FROM shown JOIN pairs USING (n)""")
def d6_policy_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Each child under the destination's policy, also children that the route alone would not keep."""
    kept = R.route_transactions(FD.projected(spark, sf), FD.DESTINATIONS)
    redacted = RD.redact_for_destinations(kept, FD.DESTINATIONS)
    return _summary(redacted, F.col("destination")).select("seq", "destination", "data_email", "data_status", "data_cents")


BROKEN_POLICIES = {
    "unknown_action": {"rules": [{"action": "encrypt", "columns": ["id"]}]},
    "no_columns": {"rules": [{"action": "mask", "columns": []}]},
    "fine": {"rules": [{"action": "mask", "columns": ["id"]}]},
}


def _accepted(raw: dict) -> bool:
    try:
        config.Policy.parse(raw)
    except config.ConfigError:
        return False
    return True


@query("d7_validate_policy", """
SELECT policy, CASE policy WHEN 'fine' THEN count(*) ELSE 0 END AS redacted FROM feed, (VALUES ('unknown_action'), ('no_columns'), ('fine')) p(policy) GROUP BY policy""")
def d7_validate_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A policy that does not validate is refused before any plan exists, so it redacts nothing."""
    accepted = [F.lit(name) for name, raw in BROKEN_POLICIES.items() if _accepted(raw)]
    masked = RD.apply_policy(FD.projected(spark, sf), config.Policy.parse(BROKEN_POLICIES["fine"]))
    shown = masked.withColumn("policy", F.explode(F.array(*[F.lit(name) for name in BROKEN_POLICIES])))
    hit = F.col("policy").isin(*accepted) & (field("data", "id") == '"[REDACTED]"')
    return shown.groupBy("policy").agg(F.count_if(hit).alias("redacted"))


@query("d8_inactive_policy", BODIES + " SELECT seq, body FROM bodies")
def d8_inactive_policy(spark: SparkSession, sf: str) -> DataFrame:
    empty = config.Policy.parse({"rules": []})
    untouched = RD.stamp_policy(RD.apply_policy(FD.projected(spark, sf), empty), empty)
    return P.event_bodies(untouched).select("seq", "body")


@query("d9_redaction_audit", _SHOWN + """, audited AS (
  SELECT destination, s.*, destination IN ('all', 'disabled') OR (destination = 'audit_deletes' AND s.entity = 'payments') AS mail_open,
    NOT (destination = 'audit_deletes' AND s.entity = 'orders') AS naming
  FROM shown s JOIN matched m ON m.seq = s.seq
)
SELECT destination, count(*) AS payloads,
  count(*) FILTER (CASE WHEN destination = 'audit_deletes' THEN entity = 'payments' ELSE true END) AS open_rows,
  count(*) FILTER (naming AND cents_changes + mail_changes > 0) AS rows_naming_changes FROM audited GROUP BY destination""")
def d9_redaction_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Masked text still counts as a value: the audit finds columns that are present and not null."""
    routed = R.route_events(FD.projected(spark, sf), FD.DESTINATIONS)
    return RD.redaction_audit(RD.redact_for_destinations(routed, FD.DESTINATIONS), FD.PROTECTED)


@query("d9_policy_audit", """, audited AS (SELECT destination, entity, namespace, seq % 50 = 0 AS planted FROM matched)
SELECT 'payments_only' AS destination, CAST(0 AS INTEGER) AS rule, 'mask' AS action, count(*) AS payloads, count(*) FILTER (planted) AS open_rows
FROM audited WHERE destination = 'payments_only'
UNION ALL SELECT 'audit_deletes', 0, 'remove', count(*), count(*) FILTER (planted) FROM audited WHERE destination = 'audit_deletes' AND entity = 'orders'
UNION ALL SELECT 'audit_deletes', 1, 'mask', count(*), 0 FROM audited WHERE destination = 'audit_deletes' AND namespace = 'audit'""")
def d9_policy_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Masks are no leak. An address that is put back into some payloads is one, under every rule that was to take it away."""
    routed = R.route_events(FD.projected(spark, sf), FD.DESTINATIONS)
    redacted = RD.redact_for_destinations(routed, FD.DESTINATIONS)
    planted = T.put(F.col("data"), "customer_email", F.lit('"open@example.com"'))
    return RD.policy_audit(redacted.withColumn("data", F.when(F.col("seq") % 50 == 0, planted).otherwise(F.col("data"))), FD.DESTINATIONS)
