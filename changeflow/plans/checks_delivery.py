"""Queries: joins, ordered progress, delivery state and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions.lsn import lsn_to_number, number_to_lsn
from changeflow.operators import attempts as A
from changeflow.operators import consume as C
from changeflow.operators import deadletters as DL
from changeflow.operators import ledger as L
from changeflow.operators import metrics as M
from changeflow.operators import preflight as PR
from changeflow.operators import progress as PG
from changeflow.operators import project as P
from changeflow.operators import route as R
from changeflow.operators.few import CODEC, shuffled, spread_join
from changeflow.plans import feed as FD
from changeflow.plans.checks_ingest import answering, field, publication_facts
from changeflow.plans.checks_payload import current_letters
from changeflow.plans.registry import query
from changeflow.plans.relay import Relay
from changeflow.schemas import CHANGE_EVENT
from changeflow.session import run_folder, write_parquet
from changeflow.sources.feeds import stream_change_feed
from changeflow.sources.state import StateTables
from changeflow.streaming.stream import run_finite, run_relay

# --- E: joins ---------------------------------------------------------------------------------


@query("e1_fan_out", "SELECT seq, destination FROM feed CROSS JOIN targets")
def e1_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    return R.fan_out(FD.change_feed(spark, sf), FD.DESTINATIONS).select("seq", "destination")


@query("e2_undelivered", "SELECT idempotency_key, n * 2 AS arrival FROM pairs WHERE n % 2 = 1")
def e2_undelivered(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair arrives twice; the ledger has the even transactions."""
    pairs = FD.transaction_pairs(spark, sf)
    twice = pairs.withColumn("arrival", F.explode(F.array(F.col("work") * 2, F.col("work") * 2 + 1)))
    return L.undelivered(twice, FD.earlier_ledger(pairs), "arrival").select(L.KEY, "arrival")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    items = FD.registered_items(spark, sf)
    return PG.attach_outcomes(items, FD.item_outcomes(items))


@query("e3_attach_outcomes", """
SELECT 'registered' AS kind, slot_name, group_seq, CAST(item_seq AS BIGINT) AS item_seq, NOT unfinished AS completed FROM items WHERE seq % 10 <> 3
UNION ALL SELECT 'stray', slot_name, group_seq, item_seq, NULL FROM items WHERE seq % 10 = 3""")
def e3_attach_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the outcomes belong to work that was never registered."""
    everything = FD.registered_items(spark, sf)
    registered = everything.where("seq % 10 <> 3")
    outcomes = FD.item_outcomes(everything)
    columns = ["slot_name", "group_seq", "item_seq"]
    known = PG.attach_outcomes(registered, outcomes).select(F.lit("registered").alias("kind"), *columns, "completed")
    stray = PG.stray_outcomes(registered, outcomes)
    return known.unionByName(stray.select(F.lit("stray").alias("kind"), *columns, F.lit(None).cast("boolean").alias("completed")))


@query("e4_attach_identity_columns", """, known AS (SELECT *, len(string_split(names, ',')) AS needed,
    contains(',' || names || ',', ',c1,') AS c1, contains(',' || names || ',', ',c2,') AS c2, contains(',' || names || ',', ',c3,') AS c3 FROM facts)
SELECT seq, CASE WHEN names <> '' THEN CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER) + CAST(c3 AS INTEGER) ELSE 1 END AS keys,
  CASE WHEN names <> '' THEN needed = CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER) + CAST(c3 AS INTEGER) ELSE true END AS complete
FROM feed JOIN known ON relation_id = seq % (SELECT count(*) FROM part)""")
def e4_attach_identity_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Changes spread over all published tables, each row having the columns c1, c2 and c3."""
    events = FD.table(spark, sf, "events").select(F.col("event_id").alias("seq"))
    known = FD.relations(spark, sf).select(F.col("relation_id").alias("relation"), F.col("schema_name").alias("namespace"))
    # A bare count is one row by construction.
    count = FD.table(spark, sf, "part").agg(F.count(F.lit(1))).first()[0]
    numbered = events.withColumn("relation", F.col("seq") % count)
    row = F.create_map(*[x for c in ("c1", "c2", "c3") for x in (F.lit(c), F.lit("1"))])
    changes = numbered.join(shuffled(known), "relation").withColumns({
        "entity": F.concat(F.lit("table_"), F.col("relation").cast("string")), "new_values": row,
        "old_values": F.lit(None).cast("map<string,string>"), "identity": F.create_map(F.lit("id"), F.lit("0")),
    })
    return PR.attach_identity(changes, publication_facts(spark, sf)).select(
        "seq", F.size("identity").alias("keys"), F.col("identity_complete").alias("complete")
    )


@query("e5_select_dead_letters_by_id", """
SELECT dead_letter_id, 'found' AS verdict FROM current_letters WHERE seq % 4 = 0 UNION ALL SELECT 'dl_none_' || seq, 'unknown' FROM letters WHERE seq % 4 = 1""")
def e5_select_dead_letters_by_id(spark: SparkSession, sf: str) -> DataFrame:
    letters = FD.dead_letters(spark, sf)
    number = F.regexp_extract("payload_json", "sha256:([0-9]+)", 1).cast("bigint")
    ids = letters.select(F.when(number % 4 == 0, F.col("dead_letter_id")).when(
        number % 4 == 1, F.concat(F.lit("dl_none_"), number.cast("string"))).alias("dead_letter_id")).where("dead_letter_id IS NOT NULL")
    found = DL.by_ids(letters, ids).select("dead_letter_id", F.lit("found").alias("verdict"))
    return found.unionByName(DL.unknown_ids(letters, ids).select("dead_letter_id", F.lit("unknown").alias("verdict")))


@query("e6_publication_facts", """
SELECT relation_id, schema_name, table_name, replica_identity, names, publishes_updates, publishes_deletes, primary_key_usable,
  replica_identity_index_usable FROM facts""")
def e6_publication_facts(spark: SparkSession, sf: str) -> DataFrame:
    return publication_facts(spark, sf).select(
        "relation_id", "schema_name", "table_name", "replica_identity", F.array_join("replica_identity_columns", ",").alias("names"),
        "publishes_updates", "publishes_deletes", "primary_key_usable", "replica_identity_index_usable",
    )


def _checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """One checkpoint row per change, the newest of each user's slot counting."""
    return FD.change_feed(spark, sf).select(
        "source_name", F.concat(F.lit("user_"), field("identity", "id")).alias("slot_name"), F.lit("all_tables").alias("publication_name"),
        F.when(F.col("seq") % 5 != 0, F.col("transport_lsn")).alias("last_lsn"), "seq",
    )


@query("e7_resume_point", """, latest AS (
  SELECT user_id, arg_max(CASE WHEN seq % 5 <> 0 THEN transport ELSE '' END, seq) AS lsn FROM feed GROUP BY user_id
)
SELECT c_custkey AS slot, CASE WHEN c_custkey % 4 = 0 THEN '0/ABC' ELSE nullif(lsn, '') END AS resume_lsn
FROM customer LEFT JOIN latest ON user_id = c_custkey""")
def e7_resume_point(spark: SparkSession, sf: str) -> DataFrame:
    slot = F.col("c_custkey")
    slots = FD.table(spark, sf, "customer").select(
        slot.alias("slot"), F.lit(FD.SOURCE).alias("source_name"), F.concat(F.lit("user_"), slot.cast("string")).alias("slot_name"),
        F.when(slot % 4 == 0, "0/ABC").otherwise("").alias("configured_start"),
    )
    return PG.resume_points(slots, _checkpoints(spark, sf), "seq").select("slot", "resume_lsn")


@query("e8_unreconciled_payments", """
SELECT order_id, total_cents FROM shop_orders o WHERE status = 'paid'
  AND NOT EXISTS (SELECT 1 FROM shop_payments p WHERE p.order_id = o.order_id AND p.status = 'captured')""")
def e8_unreconciled_payments(spark: SparkSession, sf: str) -> DataFrame:
    return C.unreconciled_payments(FD.shop_orders(spark, sf), FD.shop_payments(spark, sf)).select("order_id", "total_cents")


# --- G: ordered progress ----------------------------------------------------------------------


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return PG.group_states(_items(spark, sf))


@query("g1_contiguous_watermark", """
SELECT slot_name, max(group_seq) AS last_group, arg_max(position, group_seq) FILTER (position IS NOT NULL) AS last_lsn FROM prefix GROUP BY slot_name""")
def g1_contiguous_watermark(spark: SparkSession, sf: str) -> DataFrame:
    return PG.contiguous_watermark(_groups(spark, sf)).select("slot_name", "last_group", "last_lsn")


@query("g2_acknowledgements", "SELECT slot_name, group_seq, position FROM prefix WHERE position IS NOT NULL")
def g2_acknowledgements(spark: SparkSession, sf: str) -> DataFrame:
    return PG.acknowledgements(_groups(spark, sf)).select("slot_name", "group_seq", "position")


@query("g3_group_end", "SELECT seq, sn = max(sn) OVER (PARTITION BY n) AS group_end FROM feed")
def g3_group_end(spark: SparkSession, sf: str) -> DataFrame:
    return P.unwrap_to_events(FD.change_feed(spark, sf)).select("seq", "group_end")


@query("g4_batch_number", "SELECT seq, slot_name, (row_number() OVER (PARTITION BY slot_name ORDER BY seq) - 1) // 64 AS batch_number FROM feed")
def g4_batch_number(spark: SparkSession, sf: str) -> DataFrame:
    return C.batch_number(FD.change_feed(spark, sf), ["source_name", "slot_name"], "seq", 64).select("seq", "slot_name", "batch_number")


@query("g5_receive_attempts", "SELECT seq, user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS attempt FROM feed")
def g5_receive_attempts(spark: SparkSession, sf: str) -> DataFrame:
    received = FD.table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id", F.col("user_id").alias("delivery_key"))
    return C.receive_attempts(received, "seq").select("seq", "user_id", "attempt")


@query("g6_completion_inversions", """
SELECT seq, coalesce(seq * 10 + (user_id * 7) % 90 < max(seq * 10 + (user_id * 7) % 90) OVER (PARTITION BY slot_name ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inverted FROM feed""")
def g6_completion_inversions(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("seq") * 10 + (field("identity", "id").cast("bigint") * 7) % 90
    received = FD.change_feed(spark, sf).withColumn("completed", done)
    return C.completion_inversions(received, ["source_name", "slot_name"], "seq", "completed").select("seq", "inverted")


@query("g7_latest_image", """
SELECT user_id, status, cents AS total_cents FROM (
  SELECT user_id, operation, CASE WHEN has_new THEN new_status END AS status, CASE WHEN has_new THEN CAST(new_cents AS VARCHAR) END AS cents,
    row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM feed) WHERE r = 1 AND operation <> 'delete'""")
def g7_latest_image(spark: SparkSession, sf: str) -> DataFrame:
    changes = FD.change_feed(spark, sf).select(
        field("identity", "id").cast("bigint").alias("user_id"), "operation", "sequence_number", "transport_lsn",
        field("new_values", "status").alias("quoted"), field("new_values", "total_cents").alias("total_cents"),
    ).withColumn("status", F.btrim("quoted", F.lit('"')))
    return C.latest_image(changes, ["user_id"], lsn_to_number(F.col("transport_lsn")), ["status", "total_cents"])


@query("g8_previous_status", """
SELECT seq, '"' || CASE WHEN has_new THEN new_status END || '"' AS status,
  lag('"' || CASE WHEN has_new THEN new_status END || '"') OVER (PARTITION BY user_id ORDER BY seq) AS inferred_previous_status FROM feed""")
def g8_previous_status(spark: SparkSession, sf: str) -> DataFrame:
    changes = FD.change_feed(spark, sf).select("seq", field("identity", "id").alias("id"), field("new_values", "status").alias("status"))
    return C.previous_status(changes, ["id"], "seq", "status").drop("id")


# --- L: delivery state and replay -------------------------------------------------------------


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    return A.resolve_attempts(FD.attempt_log(FD.transaction_pairs(spark, sf)), FD.DESTINATIONS)


@query("l1_resolve_attempts", """
SELECT idempotency_key, destination, status, CAST(attempts AS INTEGER) AS attempts, 1704067200 + n * 10 + attempts AS finished_epoch,
  CASE WHEN status <> 'delivered' THEN 'destination answered '
    || list_extract([200, 204, 500, 503, 429], CAST((n * 7 + dno * 3 + last_attempt) % 5 + 1 AS INTEGER)) END AS error_message
FROM outcomes""")
def l1_resolve_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select(
        L.KEY, "destination", "status", "attempts", F.unix_timestamp("finished_at").alias("finished_epoch"), "error.error_message",
    )


@query("l2_write_checkpoint", """
SELECT 'user_' || user_id AS slot_name, nullif(arg_max(CASE WHEN seq % 5 <> 0 THEN transport ELSE '' END, seq), '') AS last_lsn FROM feed GROUP BY user_id""")
def l2_write_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return PG.latest_checkpoints(_checkpoints(spark, sf), "seq").select("slot_name", "last_lsn")


@query("l3_write_dead_letters", """
SELECT dead_letter_id, event_id, source_name, destination, operation, namespace, entity, source_position, retry_count, failed_epoch, payload_json FROM letters""")
def l3_write_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return FD.dead_letters(spark, sf).select(
        "dead_letter_id", "event_id", "source_name", "destination", "operation", "namespace", "entity", "source_position",
        "retry_count", F.unix_timestamp("failed_at").alias("failed_epoch"), "payload_json",
    )


@query("l4_set_dead_letter_status", "SELECT dead_letter_id, status, updated_epoch FROM current_letters")
def l4_set_dead_letter_status(spark: SparkSession, sf: str) -> DataFrame:
    return current_letters(spark, sf).select("dead_letter_id", "status", F.unix_timestamp("updated_at").alias("updated_epoch"))


@query("l5_select_replay", """
SELECT dead_letter_id, destination FROM current_letters WHERE status = 'pending' ORDER BY failed_epoch, dead_letter_id LIMIT 100""")
def l5_select_replay(spark: SparkSession, sf: str) -> DataFrame:
    return DL.select_replay(current_letters(spark, sf)).select("dead_letter_id", "destination")


@query("l6_replay_plan", """
SELECT dead_letter_id, CASE WHEN destination = 'disabled' THEN 'disabled'
      WHEN destination = 'payments_only' OR destination = 'audit_deletes' THEN 'route_mismatch'
      WHEN seq % 3 = 0 THEN 'duplicate' END AS skip_reason FROM current_letters WHERE status = 'pending'""")
def l6_replay_plan(spark: SparkSession, sf: str) -> DataFrame:
    """All pending letters. Their short bodies name no table, so routed destinations refuse them."""
    letters = current_letters(spark, sf).where("status = 'pending'")
    number = F.regexp_extract("payload_json", "sha256:([0-9]+)", 1).cast("bigint")
    ledger = letters.where(number % 3 == 0).select(L.KEY)
    return DL.replay_plan(letters, FD.DESTINATIONS, ledger).select("dead_letter_id", "skip_reason")


@query("l6_replay", """, failing AS (
  SELECT *, n % 10 = 2 AS mended, n > (SELECT max(n) // 2 FROM feed) AS later FROM pairs WHERE enabled AND n % 5 = 2
)
SELECT transaction_id, destination, mended AND NOT later AS resolved, CASE WHEN mended AND NOT later THEN 'replay' END AS ledger_writer, later AS in_second_batch,
  CAST(CASE WHEN mended OR later THEN 1 ELSE 2 END AS BIGINT) AS letters FROM failing""")
def l6_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A replay between two batches of a relay, with a number that the relay uses too. Half of what failed is accepted then:
    its letters are resolved and the ledger has it; the other half has a second letter. The letters of the second batch wait."""
    relay, half = _replayed(spark, sf)
    letters = relay.letters().select(
        L.KEY, "work.transaction_id", "destination", "status").groupBy(L.KEY, "transaction_id", "destination").agg(
        F.bool_and(F.col("status") == "resolved").alias("resolved"), F.count(F.lit(1)).alias("letters"))
    ledger = relay.state.read("ledger").select(L.KEY, F.col("writer").alias("ledger_writer"))
    return letters.join(ledger, L.KEY, "left").select(
        "transaction_id", "destination", "resolved", "ledger_writer", (F.col("transaction_id").cast("bigint") > half).alias("in_second_batch"), "letters")


def _replayed(spark: SparkSession, sf: str) -> tuple[Relay, int]:
    """A relay after two batches with a replay between them, and the last transaction of the first batch."""
    relay = _relay(spark, sf)
    rows = _raw_rows(FD.table(spark, sf, "events"))
    half = rows.agg(F.max(F.col("transaction_id").cast("bigint"))).first()[0] // 2
    early = F.col("transaction_id").cast("bigint") <= half
    relay.process(rows.where(early), 0)
    relay.transport = answering((200, 200, 200, 200, 200, 200, 200, 500, 200, 200))
    relay.replay(relay.letters().where("status = 'pending'"), 1)
    relay.transport = answering((200, 200, 500, 200, 200))
    relay.process(rows.where(~early), 1)
    return relay, half


@query("f4_gauges_from_tallies", """, letters_of AS (
  SELECT destination, n, n % 10 = 2 AND n <= (SELECT max(n) // 2 FROM feed) AS mended, n % 10 = 7 AND n <= (SELECT max(n) // 2 FROM feed) AS again
  FROM pairs WHERE enabled AND n % 5 = 2
), sums AS (
  SELECT t.destination,
    (SELECT count(*) + count(*) FILTER (again) FROM letters_of l WHERE l.destination = t.destination) AS dead_letters_total,
    (SELECT count(*) FILTER (NOT mended) + count(*) FILTER (again) FROM letters_of l WHERE l.destination = t.destination) AS dead_letters_pending_total,
    (SELECT count(*) FILTER (mended) FROM letters_of l WHERE l.destination = t.destination) AS dead_letters_resolved_total,
    CAST(0 AS BIGINT) AS dead_letters_ignored_total,
    (SELECT count(*) FROM pairs p WHERE p.destination = t.destination AND enabled AND n % 5 <> 2)
      + (SELECT count(*) FILTER (mended) FROM letters_of l WHERE l.destination = t.destination) AS delivered_envelopes_total
  FROM targets t
), lines AS (UNPIVOT sums ON dead_letters_total, dead_letters_pending_total, dead_letters_resolved_total, dead_letters_ignored_total, delivered_envelopes_total
  INTO NAME name VALUE value)
SELECT name, destination, CAST(value AS BIGINT) AS value, true AS as_counted FROM lines
UNION ALL SELECT name, NULL, CAST(sum(value) AS BIGINT), true FROM lines GROUP BY name""")
def f4_gauges_from_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """The gauges from what each batch has tallied, held against the gauges counted from ledger and letters."""
    relay, _ = _replayed(spark, sf)
    tallied = M.gauges_from_tallies(relay.state.read("tallies").select("destination", "status", "n"), FD.DESTINATIONS)
    counted = M.delivery_gauges(relay.letters(), relay.state.read("ledger"), FD.DESTINATIONS).withColumnsRenamed({"name": "_name", "destination": "_for", "value": "_counted"})
    same = (F.col("name") == F.col("_name")) & F.col("destination").eqNullSafe(F.col("_for"))
    return tallied.join(counted, same, "left").select("name", "destination", "value", (F.col("value") == F.col("_counted")).alias("as_counted"))


@query("l7_readiness_report", """
SELECT sample, CASE WHEN sample % 6 = 5 OR reason IS NOT NULL THEN 'unready' ELSE 'ready' END AS status,
  CASE WHEN sample % 6 = 5 THEN 'operational state is unavailable' ELSE reason END AS reason FROM health""")
def l7_readiness_report(spark: SparkSession, sf: str) -> DataFrame:
    """Each sample as its own service. A sixth of them has state tables whose log names a file that is gone, which the probe finds."""
    whole, broken = StateTables(spark, run_folder(spark, "state")), StateTables(spark, run_folder(spark, "state"))
    for state in (whole, broken):
        state.write("checkpoints", _checkpoints(spark, sf).withColumn("updated_at", F.current_timestamp()), 0)
    broken.append(lambda _: {"writer": "main", "batch_id": 1, "adds": {"checkpoints": [{"file": "checkpoints/gone.parquet", "batch_ids": [1, 1], "writers": ["main"]}]}})
    samples = FD.slot_samples(spark, sf).withColumn("service_name", F.col("sample").cast("string"))
    ok = F.when(F.col("sample") % 6 == 5, broken.ready()).otherwise(whole.ready())
    state = samples.select("service_name", ok.alias("state_ok"))
    return M.readiness_report(state, PR.slot_health(samples)).select("sample", "status", "reason")


@query("l8_slot_gauges", """, g AS (
  SELECT sample, 'slot_inspection_up' AS name, NULL AS wal_status, 1 AS value FROM health
  UNION ALL SELECT sample, 'slot_present', NULL, CAST(present AS BIGINT) FROM health
  UNION ALL SELECT sample, 'slot_ready', NULL, CAST(reason IS NULL AS BIGINT) FROM health WHERE present
  UNION ALL SELECT sample, 'slot_active', NULL, CAST(active AS BIGINT) FROM health WHERE present
  UNION ALL SELECT sample, 'slot_wal_status', coalesce(wal_status, 'unknown'), 1 FROM health WHERE present
  UNION ALL SELECT sample, 'slot_invalidated', NULL, CAST(conflicting OR invalid AS BIGINT) FROM health WHERE present
  UNION ALL SELECT sample, 'slot_retained_wal_bytes', NULL, retained FROM health WHERE present
  UNION ALL SELECT sample, 'slot_safe_wal_size_bytes', NULL, safe FROM health WHERE present
  UNION ALL SELECT sample, 'slot_inactive_since_timestamp_seconds', NULL, epoch(date_trunc('second', ts))::BIGINT FROM health WHERE present AND NOT active
  UNION ALL SELECT sample, 'slot_restart_lsn_bytes', NULL, restart FROM health WHERE present
  UNION ALL SELECT sample, 'slot_confirmed_flush_lsn_bytes', NULL, confirmed FROM health WHERE present
)
SELECT sample, name, wal_status, CAST(value AS BIGINT) AS value FROM g WHERE value IS NOT NULL""")
def l8_slot_gauges(spark: SparkSession, sf: str) -> DataFrame:
    """Each sample reported under its own slot name."""
    health = PR.slot_health(FD.slot_samples(spark, sf)).withColumn("slot_name", F.col("sample").cast("string"))
    return M.slot_gauges(health).select(F.col("slot_name").cast("bigint").alias("sample"), "name", "wal_status", "value")


@query("l8_failed_inspections", """
SELECT sample, 'slot_inspection_up' AS name, CAST(CASE WHEN sample % 9 = 4 THEN 0 ELSE 1 END AS BIGINT) AS value FROM health
UNION ALL SELECT sample, 'slot_present', CAST(present AS BIGINT) FROM health WHERE sample % 9 <> 4""")
def l8_failed_inspections(spark: SparkSession, sf: str) -> DataFrame:
    """A slot that could not be inspected reports just that, also where old facts about it are at hand."""
    health = PR.slot_health(FD.slot_samples(spark, sf)).withColumns({"slot_name": F.col("sample").cast("string"), "inspected": F.col("sample") % 9 != 4})
    gauges = M.slot_gauges(health).where("name IN ('slot_inspection_up', 'slot_present') OR CAST(slot_name AS BIGINT) % 9 = 4")
    return gauges.select(F.col("slot_name").cast("bigint").alias("sample"), "name", "value")


# --- K: streaming -----------------------------------------------------------------------------


def _raw_rows(events: DataFrame) -> DataFrame:
    """Change rows with a commit row after the last change of each transaction. Numbers leave room for more rows between."""
    changes = FD.feed_columns(events).withColumn("seq", F.col("seq") * 4)
    commits = FD.feed_columns(events.where("event_id % 4 = 3")).select(
        "source_name", "slot_name", (F.col("seq") * 4 + 1).alias("seq"), "transport_lsn", "transaction_id",
        F.lit("commit").alias("operation"),
    )
    return changes.withColumn("sequence_number", F.lit(None).cast("int")).unionByName(commits, allowMissingColumns=True)


def _sent_again(rows: DataFrame) -> DataFrame:
    """Some changes and commits, as a source sends them again after a restart."""
    return rows.where("seq % 7 = 0 OR seq % 5 = 1")


def _empty_commits(rows: DataFrame) -> DataFrame:
    """A commit of a transaction without changes after every eighth transaction."""
    after = rows.where("operation = 'commit' AND CAST(transaction_id AS BIGINT) % 8 = 7")
    return after.withColumns({
        "transaction_id": F.concat(F.lit("empty-"), "transaction_id"), "seq": F.col("seq") + 1,
        "transport_lsn": number_to_lsn(lsn_to_number(F.col("transport_lsn")) + 1), "commit_lsn": number_to_lsn(lsn_to_number(F.col("transport_lsn")) + 1),
    })


def _relay(spark: SparkSession, sf: str) -> Relay:
    """A new relay whose receiver refuses every fifth transaction."""
    return Relay(spark, run_folder(spark, "relay"), FD.DESTINATIONS, answering((200, 200, 500, 200, 200)))


def _run_in_pieces(spark: SparkSession, sf: str, pieces: int, run, more=None) -> None:
    """The feed as a growing folder: each piece is written, then the stream runs again and takes what is new.
    The pieces cut transactions apart. `more` gives further rows of a piece, and those that come again with the next one."""
    folder = run_folder(spark, "rows")
    rows = _raw_rows(FD.table(spark, sf, "events"))
    width = rows.agg(F.max("seq")).first()[0] // pieces + 1
    for number in range(pieces):
        piece = rows.where(F.expr(f"seq div {width}") == number)
        if more:
            piece = more(piece, rows.where(F.expr(f"seq div {width}") == number - 1))
        write_parquet(piece, folder, "append", CODEC)
        run(stream_change_feed(spark, folder, CHANGE_EVENT, names="*.parquet"))


@query("k1_assemble_transactions", """
SELECT CAST(seq * 4 AS BIGINT) AS seq, transaction_id, CAST(sn AS INTEGER) AS sequence_number, CAST(4 AS BIGINT) AS changes FROM feed
UNION ALL SELECT NULL, 'empty-' || n, NULL, 0 FROM feed WHERE sn = 3 AND n % 8 = 7""")
def k1_assemble_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions that are cut apart by the batches come out whole and numbered from zero, each change once, though changes
    and commits come twice in a batch and again in the next one; transactions without changes come out too."""
    relay = _relay(spark, sf)

    def step(rows: DataFrame, number: int) -> None:
        batch = relay.state.begin(number)
        relay.assemble(rows, batch)
        batch.commit()

    def more(piece: DataFrame, before: DataFrame) -> DataFrame:
        whole = piece.unionByName(_empty_commits(piece))
        return whole.unionByName(_sent_again(whole)).unionByName(_sent_again(before))

    _run_in_pieces(spark, sf, 3, lambda stream: run_finite(stream, step, f"{relay.root}/offsets"), more)
    events = relay.state.read("assembled").select("seq", "transaction_id", "sequence_number")
    sizes = events.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("changes"))
    groups = relay.state.read("groups").select("transaction_id").join(sizes, "transaction_id", "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    return groups.join(events, "transaction_id", "left").select("seq", "transaction_id", "sequence_number", "changes")


@query("k2_stream_dedupe", """
SELECT CASE WHEN n % 5 <> 2 THEN 'first' ELSE 'never' END AS delivered_by, count(*) AS pairs FROM pairs WHERE enabled GROUP BY 1""")
def k2_stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The same work again in a second batch, under new numbers, adds no ledger rows for what the first one delivered."""
    relay = _relay(spark, sf)
    rows = _raw_rows(FD.table(spark, sf, "events"))
    relay.process(rows, 0)
    relay.process(rows.withColumn("seq", F.col("seq") + (rows.agg(F.max("seq")).first()[0] + 1)), 1)
    ledger = relay.state.read("ledger").groupBy(L.KEY).agg(F.count(F.lit(1)).alias("n"), F.min("batch_id").alias("batch"))
    tried = relay.state.read("pairs", before=1).where("skip_reason IS NULL").select(L.KEY)
    verdict = F.when(F.col("n").isNull(), "never").when((F.col("n") == 1) & (F.col("batch") == 0), "first").otherwise("again")
    return tried.join(ledger, L.KEY, "left").groupBy(verdict.alias("delivered_by")).agg(F.count(F.lit(1)).alias("pairs"))


@query("k3_stream_progress", """, ends AS (
  SELECT slot_name, n, '0/' || printf('%X', 16777216 + n * 64 + 48 + CASE WHEN n % 8 = 7 THEN 1 ELSE 0 END) AS lsn FROM feed WHERE sn = 3)
SELECT slot_name, arg_max(lsn, n) AS last_lsn FROM ends GROUP BY slot_name""")
def k3_stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The latest checkpoint per slot after the stream has taken everything; where an empty transaction comes last, it is passed."""
    relay = _relay(spark, sf)
    _run_in_pieces(spark, sf, 2, lambda stream: run_relay(stream, relay), lambda piece, before: piece.unionByName(_empty_commits(piece)))
    newest = relay.state.read("checkpoints")
    return PG.latest_checkpoints(newest, "batch_id").select("slot_name", "last_lsn")


@query("k4_trigger_policy", "SELECT count(*) + count(*) FILTER (sn = 3) AS n, true AS batches_as_planned FROM feed")
def k4_trigger_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A few files per batch, the last batch short, and the finite run flushes it."""
    folder = run_folder(spark, "batches")
    _raw_rows(FD.table(spark, sf, "events")).write.parquet(f"{folder}/feed")
    files = len(spark.read.schema(CHANGE_EVENT).parquet(f"{folder}/feed").inputFiles())
    size = files // 3 + 1

    def land(rows: DataFrame, batch: int) -> None:
        rows.select("seq").write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch}")

    run_finite(stream_change_feed(spark, f"{folder}/feed", CHANGE_EVENT, size, "*.parquet"), land, f"{folder}/offsets")
    rows = spark.read.schema("seq bigint, batch_id bigint").parquet(f"{folder}/rows")
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.max("batch_id") + 1 == -(-files // size)).alias("batches_as_planned"))


@query("k5_resume", """
SELECT sample, resume, CASE WHEN resume IS NULL THEN 'start' WHEN resume < restart OR resume < confirmed THEN 'refuse' ELSE 'resume' END AS decision FROM slots""")
def k5_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Resume position per slot from the relay's newest checkpoint, refused when the slot no longer reaches back to it."""
    samples = FD.slot_samples(spark, sf).withColumns({
        "source_name": F.lit(FD.SOURCE), "slot_name": F.col("sample").cast("string"), "configured_start": F.lit(""),
    })
    newest = samples.select("source_name", "slot_name", F.lit("all_tables").alias("publication_name"), F.col("resume_lsn").alias("last_lsn"), F.col("sampled_at").alias("updated_at"))
    relay = _relay(spark, sf)
    relay.state.write("checkpoints", newest.withColumn("last_lsn", F.lit("0/1")), 0)
    relay.state.write("checkpoints", newest, 1)
    points = relay.starts(samples.drop("resume_lsn"), "app")
    decision = F.when(F.col("resume_lsn").isNull(), "start").when(PR.position_reachable(F.col("resume_lsn")), "resume").otherwise("refuse")
    return points.select("sample", lsn_to_number(F.col("resume_lsn")).alias("resume"), decision.alias("decision"))


@query("k6_finalize", """
SELECT slot_name, max(group_seq) FILTER (NOT open) AS running, max(group_seq) AS finalized FROM (
  SELECT slot_name, n AS group_seq, n > (SELECT max(n) FROM feed) - 3 AS open FROM feed) GROUP BY slot_name""")
def k6_finalize(spark: SparkSession, sf: str) -> DataFrame:
    """The last group of each slot is open: it holds the mark back in a running feed and not at a clean end."""
    items = FD.registered_items(spark, sf).withColumn("completed", F.lit(True))
    newest = items.groupBy("source_name", "slot_name").agg(F.max("group_seq").alias("newest"))
    marked = spread_join(items, newest, ["source_name", "slot_name"], by="seq").withColumn("group_closed", F.col("group_seq") < F.col("newest"))
    running = PG.contiguous_watermark(PG.group_states(marked)).select("slot_name", F.col("last_group").alias("running"))
    ended = PG.contiguous_watermark(PG.group_states(marked, finalize=True)).select("slot_name", F.col("last_group").alias("finalized"))
    return running.join(ended, "slot_name")


@query("k7_durable_outcomes", """, statuses AS (
  SELECT status FROM outcomes UNION ALL SELECT 'skipped' FROM feed WHERE seq % 2 = 0
)
SELECT status, status <> 'in_progress' AS durable, count(*) AS n FROM statuses GROUP BY ALL""")
def k7_durable_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    statuses = resolved(spark, sf).select("status").unionByName(
        FD.change_feed(spark, sf).where("seq % 2 = 0").select(F.lit("skipped").alias("status"))
    )
    return statuses.groupBy("status", A.durable(F.col("status")).alias("durable")).agg(F.count(F.lit(1)).alias("n"))
