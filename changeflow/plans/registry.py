"""Named queries over the driver's tables, each with an independent SQL answer where SQL can give one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ANSWERS: dict[str, str] = {}

# The change feed of plans/feed.py in the SQL of the checking engine, written out independently.
FEED = r"""
WITH raw AS (
  SELECT *, event_id // 4 AS n, CAST(round(value * 100) AS BIGINT) AS cents,
    CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation,
    'user' || user_id || '@example.com' AS mail
  FROM events
), feed AS (
  SELECT event_id AS seq, n, CAST(n AS VARCHAR) AS transaction_id, event_id % 4 AS sn,
    'slot_' || (n % 3) AS slot_name, user_id, ts, operation, event_type,
    CASE WHEN user_id % 3 = 0 THEN 'audit' ELSE 'public' END AS namespace,
    CASE WHEN event_type = 'purchase' THEN 'payments' ELSE 'orders' END AS entity,
    '0/' || printf('%X', 16777216 + n * 64) AS txn_position,
    CASE WHEN event_id % 40 <> 39 THEN '0/' || printf('%X', 16777216 + n * 64) END AS position,
    '0/' || printf('%X', 16777216 + n * 64 + 48) AS transport,
    CASE WHEN event_id % 3 = 0 THEN 'shop-db' ELSE 'postgresql' END AS source,
    CASE WHEN event_id % 10 = 0 THEN 'evt-explicit-' || event_id END AS explicit_id,
    CASE WHEN event_id % 97 <> 0 THEN ts END AS occurred,
    strftime(CASE WHEN event_id % 97 <> 0 THEN ts ELSE ts + INTERVAL 1 SECOND END, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at,
    operation <> 'delete' AS has_new, operation <> 'insert' AS has_old,
    operation = 'delete' OR (operation = 'update' AND user_id % 5 <> 0) AS full_old,
    list_extract(['pending','paid','shipped','received','cancelled'], CAST(event_id % 5 + 1 AS INTEGER)) AS new_status,
    list_extract(['pending','paid','shipped','received','cancelled'], CAST((event_id * 7 + user_id) % 5 + 1 AS INTEGER)) AS old_status,
    cents AS new_cents, CASE WHEN event_id % 2 = 0 THEN cents ELSE cents + 100 END AS old_cents,
    CASE WHEN event_id % 11 <> 0 THEN mail END AS new_mail, mail AS old_mail
  FROM raw
), texts AS (
  SELECT *,
    CASE WHEN has_new THEN '[{"key":"customer_email","value":' || coalesce('"\"' || new_mail || '\""', 'null')
      || '},{"key":"id","value":"' || user_id || '"},{"key":"status","value":"\"' || new_status
      || '\""},{"key":"total_cents","value":"' || new_cents || '"}]' END AS new_text,
    CASE WHEN full_old THEN '[{"key":"customer_email","value":"\"' || old_mail || '\""},{"key":"id","value":"' || user_id
      || '"},{"key":"status","value":"\"' || old_status || '\""},{"key":"total_cents","value":"' || old_cents || '"}]'
      WHEN has_old THEN '[{"key":"id","value":"' || user_id || '"}]' END AS old_text
  FROM feed
), projected AS (
  SELECT *, 'evt_' || sha256(source || '|' || transaction_id || '|' || coalesce(position, '\N') || '|' || sn || '|'
      || coalesce(CAST(epoch_us(occurred) AS VARCHAR), '\N') || '|' || namespace || '|' || entity || '|' || operation
      || '|[{"key":"id","value":"' || user_id || '"}]|' || coalesce(old_text, '\N') || '|' || coalesce(new_text, '\N')) AS hashed_id,
    coalesce(explicit_id, hashed_id) AS event_id
  FROM texts
), targets(dno, destination, enabled, max_attempts) AS (
  VALUES (0, 'all', true, 3), (1, 'payments_only', true, 2), (2, 'audit_deletes', true, 3), (3, 'disabled', false, 3)
), matched AS (
  SELECT p.*, t.* FROM projected p CROSS JOIN targets t
  WHERE dno IN (0, 3) OR (dno = 1 AND entity = 'payments') OR (dno = 2 AND namespace = 'audit' AND operation = 'delete')
), pairs AS (
  SELECT DISTINCT n, transaction_id, slot_name, dno, destination, enabled, max_attempts, txn_position,
    'shop:' || slot_name || ':' || destination || ':transaction:' || transaction_id || ':' || txn_position AS idempotency_key
  FROM matched
), attempts AS (
  SELECT *, (n * 7 + dno * 3 + attempt) % 5 AS step, (n * 7 + dno * 3 + attempt) % 5 IN (0, 1) AS ok,
    list_extract([200, 204, 500, 503, 429], CAST((n * 7 + dno * 3 + attempt) % 5 + 1 AS INTEGER)) AS status_code
  FROM pairs CROSS JOIN (VALUES (1), (2), (3)) AS a(attempt) WHERE attempt = 1 OR n % 13 <> 0
), resolved AS (
  SELECT n, transaction_id, slot_name, dno, destination, enabled, idempotency_key,
    min(attempt) FILTER (ok) AS first_ok, max(attempt) AS last_attempt, max(max_attempts) AS lim
  FROM attempts WHERE attempt <= max_attempts GROUP BY ALL
), outcomes AS (
  SELECT *, CASE WHEN first_ok IS NOT NULL THEN 'delivered' WHEN last_attempt >= lim THEN 'dead_lettered'
    ELSE 'in_progress' END AS status, coalesce(first_ok, last_attempt) AS attempts FROM resolved
), ledger AS (
  SELECT idempotency_key, slot_name, destination, transaction_id, txn_position, n,
    to_timestamp(1704067200 + n * 10) AS delivered_at FROM pairs WHERE n % 2 = 0
), letters AS (
  SELECT event_id, source AS source_name, destination, operation, namespace, entity, position AS source_position, seq,
    CAST(dno % 3 + 1 AS INTEGER) AS retry_count, 1704067200 + (seq // 7) * 60 AS failed_epoch,
    '{"event_id":"' || event_id || '","operation":"' || operation || '","metadata":{"payload_policy":{"fingerprint":"sha256:' || seq || '"}}}' AS payload_json,
    'dl_' || sha256(destination || '|' || event_id || '|' || (failed_epoch * 1000000) || '|' || payload_json) AS dead_letter_id
  FROM matched WHERE (seq * 7 + dno * 3) % 5 = 2
), current_letters AS (
  SELECT *, CASE WHEN (failed_epoch // 60) % 6 = 0 THEN 'ignored' WHEN (failed_epoch // 60) % 3 = 0 THEN 'resolved'
    ELSE 'pending' END AS status,
    failed_epoch + CASE WHEN (failed_epoch // 60) % 6 = 0 THEN 120 WHEN (failed_epoch // 60) % 3 = 0 THEN 60 ELSE 0 END AS updated_epoch
  FROM letters
), slots AS (
  SELECT event_id AS sample, ts, 'slot_' || (event_id % 7) AS slot_name, event_id % 29 <> 0 AS present,
    CASE WHEN event_id % 29 <> 0 THEN CASE WHEN event_id % 37 = 0 THEN 'physical' ELSE 'logical' END END AS slot_type,
    CASE WHEN event_id % 41 = 0 THEN 'other' ELSE 'shop' END AS database,
    event_id % 5 <> 0 AND (event_id // 70) % 4 <> 0 AS active, event_id * 10 AS retained,
    list_extract(['reserved', 'extended', 'unreserved', 'lost', NULL], CAST((event_id // 3) % 5 + 1 AS INTEGER)) AS wal_status,
    CASE WHEN event_id % 31 <> 0 THEN 50000 - (event_id * 3) % 50000 END AS safe,
    event_id % 17 = 0 AS invalid, event_id % 19 = 0 AS conflicting,
    CASE WHEN event_id % 23 <> 0 THEN 16777216 + event_id * 64 END AS restart,
    CASE WHEN event_id % 13 <> 0 THEN 16777216 + event_id * 64 + 32 END AS confirmed,
    CASE WHEN event_id % 3 <> 0 THEN 16777216 + event_id * 64 + (event_id % 4) * 16 END AS resume,
    event_id % 43 = 0 AS temporary_slot, event_id % 2 = 0 AS auto_create
  FROM events
), health AS (
  SELECT *, CASE WHEN NOT present THEN 'slot is missing' WHEN NOT active THEN 'slot is inactive'
    WHEN wal_status IN ('lost', 'unreserved') THEN 'wal_status=' || wal_status
    WHEN invalid THEN 'slot is invalidated: wal_removed' WHEN conflicting THEN 'slot is conflicting'
    WHEN restart IS NULL THEN 'slot has no restart LSN' END AS reason
  FROM slots
), rel AS (
  SELECT p_partkey AS relation_id, lower(p_type) AS schema_name, 'table_' || p_partkey AS table_name, p_size,
    list_extract(['d','n','f','i'], CAST(p_partkey % 4 + 1 AS INTEGER)) AS replica_identity,
    p_partkey % 11 <> 0 AND p_partkey % 17 <> 0 AS usable, p_partkey % 3 <> 0 AS prim, p_partkey % 5 <> 0 AS ident
  FROM part
), pubs AS (
  SELECT n_name AS publication, n_nationkey % 2 = 0 AS upd, n_nationkey % 3 = 0 AS del FROM nation
), actions AS (
  SELECT m.relation_id, bool_or(upd) AS publishes_updates, bool_or(del) AS publishes_deletes
  FROM (SELECT p_partkey AS relation_id, 'NATION_' || (p_partkey % 25) AS publication FROM part
        UNION SELECT p_partkey, 'NATION_' || (p_size % 25) FROM part) m JOIN pubs USING (publication) GROUP BY 1
), cols AS (
  SELECT relation_id, a.attnum, 'c' || a.attnum AS column_name
  FROM rel, LATERAL (SELECT unnest(range(1, CAST(p_size % 4 + 5 AS BIGINT))) AS attnum) a
  WHERE (relation_id + a.attnum) % 13 <> 0
), keycols AS (
  SELECT relation_id, k.ordinal, 5 - k.ordinal AS attnum
  FROM rel, LATERAL (SELECT unnest(range(1, CAST(p_size % 3 + 2 AS BIGINT))) AS ordinal) k WHERE usable
), idcols AS (
  SELECT r.relation_id, string_agg(column_name, ',' ORDER BY ordinal) AS names
  FROM rel r JOIN keycols USING (relation_id) JOIN cols c ON c.relation_id = r.relation_id AND c.attnum = keycols.attnum
  WHERE (replica_identity = 'd' AND prim) OR (replica_identity = 'i' AND ident) GROUP BY 1
  UNION ALL
  SELECT r.relation_id, string_agg(column_name, ',' ORDER BY attnum) FROM rel r JOIN cols USING (relation_id)
  WHERE replica_identity = 'f' GROUP BY 1
), facts AS (
  SELECT rel.*, coalesce(names, '') AS names, publishes_updates, publishes_deletes,
    usable AND prim AS primary_key_usable, usable AND ident AS replica_identity_index_usable
  FROM rel JOIN actions USING (relation_id) LEFT JOIN idcols USING (relation_id)
), shop_orders AS (
  SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'shipped' END AS status,
    CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents FROM orders
), shop_payments AS (
  SELECT order_id, 'captured' AS status, total_cents AS amount_cents FROM shop_orders WHERE order_id % 3 <> 0
  UNION ALL
  SELECT order_id, 'reversed', CASE WHEN order_id % 35 = 0 THEN total_cents ELSE -total_cents END FROM shop_orders WHERE order_id % 7 = 0
), items AS (
  SELECT seq, slot_name, n AS group_seq, sn AS item_seq,
    CASE WHEN n % 11 <> 0 AND sn <> 3 THEN transport END AS position, seq % 1000 = 999 AND n % 3 <> 0 AS unfinished
  FROM feed
), groups AS (
  SELECT slot_name, group_seq, NOT bool_or(unfinished) AS done,
    arg_max(position, item_seq) FILTER (position IS NOT NULL) AS position FROM items GROUP BY 1, 2
), prefix AS (
  SELECT * FROM groups g WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT slot_name, min(group_seq) AS gap FROM groups WHERE NOT done GROUP BY 1) f
    WHERE f.slot_name = g.slot_name AND f.gap <= g.group_seq)
)
"""


def query(name: str, answer: str | None = None, feed: bool = True) -> Callable[[Query], Query]:
    """Register a query; `answer` continues the shared feed SQL unless `feed` is off."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if answer is not None:
            ANSWERS[name] = (FEED + answer) if feed else answer
        return function

    return add
