"""Routing, redaction, ledger, attempts, progress and dead letters."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from changeflow import config
from changeflow.operators import attempts as A
from changeflow.operators import deadletters as DL
from changeflow.operators import ledger as L
from changeflow.operators import progress as PG
from changeflow.operators import project as P
from changeflow.operators import redact as RD
from changeflow.operators import route as R


def destinations(*entries, **more):
    return config.destinations({"destinations": list(entries), "retry": {"max_attempts": 3, "schedule_seconds": [1, 5]}, **more})


# --- configuration ---


def test_settings_are_inherited_and_overridden():
    first, second = destinations({"name": "a"}, {"name": "b", "enabled": False, "retry": {"max_attempts": 1}})
    assert (first.max_attempts, first.schedule_seconds, first.enabled) == (3, (1, 5), True)
    assert (second.max_attempts, second.schedule_seconds, second.enabled) == (1, (1, 5), False)


def test_single_webhook_means_everything_and_enabled():
    (only,) = config.destinations({"webhook": {"name": "w"}, "retry": {"max_attempts": 2, "schedule_seconds": [9]}})
    assert (only.name, only.max_attempts, only.route, only.enabled) == ("w", 2, config.Route(), True)


@pytest.mark.parametrize("bad", [
    {}, {"destinations": []}, {"destinations": [{"name": "a"}, {"name": "a"}]}, {"destinations": [{}]},
    {"destinations": [{"name": "a", "payload_policy": {"rules": [{"action": "hash", "columns": ["x"]}]}}]},
    {"destinations": [{"name": "a", "payload_policy": {"rules": [{"action": "mask", "columns": []}]}}]},
    {"destinations": [{"name": "a", "retry": {"max_attempts": 0}}]},
])
def test_bad_settings_are_refused(bad):
    with pytest.raises(config.ConfigError):
        config.destinations(bad)


def test_fingerprint_does_not_depend_on_key_order():
    one = {"rules": [{"action": "mask", "columns": ["a"]}]}
    two = {"rules": [{"columns": ["a"], "action": "mask"}]}
    assert config.fingerprint(one) == config.fingerprint(two) != config.fingerprint({"rules": []})


# --- routing ---


def test_route_ignores_case_and_needs_every_list(events):
    targets = destinations({"name": "all"}, {"name": "x", "route": {"schemas": ["PUBLIC"], "tables": ["Orders"], "operations": ["INSERT"]}})
    df = events({"entity": "ORDERS"}, {"entity": "users"}, {"operation": "delete"}, {"namespace": None})
    got = {(r["seq"], r["destination"]) for r in R.route_events(df, targets).collect()}
    assert got == {(0, "all"), (1, "all"), (2, "all"), (3, "all"), (0, "x")}


def test_any_child_keeps_the_whole_envelope(events):
    targets = destinations({"name": "orders", "route": {"tables": ["orders"]}})
    df = events({"entity": "users"}, {"entity": "orders"}, {"transaction_id": "2", "entity": "users"})
    assert sorted(r["seq"] for r in R.route_transactions(df, targets).collect()) == [0, 1]


def test_hot_transaction_keeps_every_event(spark, events):
    targets = destinations({"name": "orders", "route": {"tables": ["orders"]}}, {"name": "all"})
    count = 3 * P.PART_EVENTS
    many = events({"entity": "users"}).crossJoin(spark.range(count).withColumnRenamed("id", "n")).withColumns(
        {"seq": F.col("n"), "sequence_number": F.col("n").cast("int"),
         "entity": F.when(F.col("n") == count - 1, "orders").otherwise("users")}).drop("n")
    routed = R.route_transactions(many, targets)
    assert routed.groupBy("destination").count().orderBy("destination").collect() == [("all", count), ("orders", count)]


# --- redaction ---


def payload(events, **more):
    row = {"operation": "update", "identity": {"id": "1", "account": '"x"'},
           "old_values": {"id": "1", "email": None, "account": '"w"', "status": '"pending"'},
           "new_values": {"id": "1", "email": '"a@b"', "account": '"x"', "status": '"paid"'}, **more}
    return P.project_events(events(row))


def policy(*rules):
    return config.Policy.parse({"rules": list(rules)})


def test_remove_with_upper_case_selectors(events):
    rule = {"action": "remove", "columns": ["email", "account"], "schemas": ["PUBLIC"], "tables": ["ORDERS"], "operations": ["UPDATE"]}
    row = RD.apply_policy(payload(events), policy(rule)).first()
    assert (row["data"], row["identity"]) == ({"id": "1", "status": '"paid"'}, {"id": "1"})
    assert [c["name"] for c in row["changes"]] == ["status"]


def test_mask_keeps_nulls(events):
    row = RD.apply_policy(payload(events), policy({"action": "mask", "columns": ["email", "account"]})).first()
    assert row["data"] == {"id": "1", "email": '"[REDACTED]"', "account": '"[REDACTED]"', "status": '"paid"'}
    by_name = {c["name"]: (c["old_value"], c["new_value"]) for c in row["changes"]}
    assert by_name == {"email": (None, '"[REDACTED]"'), "account": ('"[REDACTED]"', '"[REDACTED]"'), "status": ('"pending"', '"paid"')}
    nulls = payload(events, new_values={"id": "1", "email": None, "account": '"x"', "status": '"paid"'})
    assert RD.apply_policy(nulls, policy({"action": "mask", "columns": ["email"]})).first()["data"]["email"] is None


def test_column_names_are_exact_and_null_identity_stays_null(events):
    row = RD.apply_policy(payload(events, identity=None), policy({"action": "remove", "columns": ["EMAIL", "status"]})).first()
    assert set(row["data"]) == {"id", "email", "account"} and row["identity"] is None


def test_rules_see_the_result_of_earlier_rules(events):
    rules = policy({"action": "mask", "columns": ["status"], "replacement": 'say "no"'}, {"action": "remove", "columns": ["status"]})
    assert "status" not in RD.apply_policy(payload(events), rules).first()["data"]
    assert RD.apply_policy(payload(events), policy(*[{"action": "mask", "columns": ["status"], "replacement": 'say "no"'}])).first()["data"]["status"] == '"say \\"no\\""'


def test_stamp_replaces_an_older_one_and_inactive_policy_leaves_no_trace(events):
    rules = policy({"action": "mask", "columns": ["nowhere"]})
    stamped = RD.stamp_policy(RD.stamp_policy(payload(events), rules), rules).first()
    assert stamped["metadata"] == {RD.STAMP: f'{{"fingerprint":"{rules.fingerprint}"}}'}
    assert RD.stamp_policy(payload(events), policy()).first()["metadata"] == {}


def test_only_the_matching_child_is_redacted(events):
    df = P.project_events(events({"new_values": {"email": '"a"'}}, {"namespace": "audit", "new_values": {"email": '"a"'}}))
    rows = RD.apply_policy(df, policy({"action": "remove", "columns": ["email"], "schemas": ["public"]})).orderBy("seq").collect()
    assert [r["data"] for r in rows] == [{}, {"email": '"a"'}]


# --- ledger ---


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "idempotency_key string, destination string, matched boolean, arrival long")


def test_key_skips_nulls_and_differs_by_unit_and_mode(spark):
    row = spark.createDataFrame([("s", "slot", "d", "7", "e", None)], "source_name string, slot_name string, destination string, transaction_id string, event_id string, source_position string")
    keys = row.select(L.idempotency_key("event"), L.idempotency_key("event", "reference"), L.idempotency_key("transaction")).first()
    assert tuple(keys) == ("s:slot:d:event:e", "s:slot:d:event:7", "s:slot:d:transaction:7")


def test_skip_reason_order(spark):
    targets = destinations({"name": "on"}, {"name": "off", "enabled": False})
    ledger = spark.createDataFrame([("seen",)], "idempotency_key string")
    df = pairs(spark, ("seen", "off", False, 1), ("seen", "on", False, 2), ("seen", "on", True, 3), ("new", "on", True, 5), ("new", "on", True, 4), ("gone", "on", False, 6))
    got = {r["arrival"]: r["skip_reason"] for r in L.skip_reason(df, targets, ledger, "arrival", "matched").collect()}
    assert got == {1: "disabled", 2: "route_mismatch", 3: "duplicate", 4: None, 5: "duplicate", 6: "route_mismatch"}


def test_copies_of_one_key_leave_one_attempt(spark):
    many = spark.range(20000).select(F.lit("k").alias("idempotency_key"), F.lit("d").alias("destination"), F.col("id").alias("arrival"))
    empty = spark.createDataFrame([], "idempotency_key string")
    assert [r["arrival"] for r in L.undelivered(many, empty, "arrival").collect()] == [0]
    assert L.undelivered(many, spark.createDataFrame([("k",)], "idempotency_key string"), "arrival").count() == 0


def test_known_keys_with_and_without_broadcast(spark):
    ledger = spark.createDataFrame([("a",), ("b",)], "idempotency_key string")
    batch = pairs(spark, ("a", "d", True, 1), ("c", "d", True, 2))
    assert [r[0] for r in L.known_keys(batch, ledger).collect()] == ["a"]
    assert sorted(r[0] for r in L.known_keys(batch, ledger, limit=0).collect()) == ["a", "b"]


def test_first_ledger_write_wins(spark):
    ledger = spark.createDataFrame([("a", "old", 0)], "idempotency_key string, destination string, at int")
    new = spark.createDataFrame([("a", "new", 1), ("b", "late", 3), ("b", "early", 2)], "idempotency_key string, destination string, at int")
    assert L.record_delivered(ledger, new, "at").collect() == [("b", "early", 2)]


# --- attempts ---


def attempts(spark, *rows):
    return spark.createDataFrame([(k, d, n, c, None, None, None) for k, d, n, c in rows],
                                 "idempotency_key string, destination string, attempt int, status_code int, error_class string, error_message string, attempted_at timestamp")


def test_attempts_stop_at_success_or_limit(spark):
    targets = destinations({"name": "d"}, {"name": "two", "retry": {"max_attempts": 2}})
    log = attempts(spark, ("a", "d", 1, 500), ("a", "d", 2, 200), ("a", "d", 3, 500), ("b", "d", 1, 500), ("b", "d", 2, 0), ("b", "d", 3, 300),
                   ("c", "d", 1, 199), ("d", "two", 1, 500), ("d", "two", 2, 500), ("d", "two", 3, 200), ("e", "d", 1, 299))
    got = {r["idempotency_key"]: (r["status"], r["attempts"]) for r in A.resolve_attempts(log, targets).collect()}
    assert got == {"a": ("delivered", 2), "b": ("dead_lettered", 3), "c": ("in_progress", 1), "d": ("dead_lettered", 2), "e": ("delivered", 1)}


def test_what_follows_the_first_success_does_not_count(spark):
    log = attempts(spark, ("a", "d", 1, 500), ("a", "d", 2, 200), ("a", "d", 3, 500), ("b", "d", 1, 500), ("b", "d", 2, 503))
    log = log.withColumns({"error_message": F.concat(F.lit("e"), F.col("attempt").cast("string")), "attempted_at": F.timestamp_seconds("attempt")})
    got = {r["idempotency_key"]: (r["error"] and r["error"]["error_message"], r["at"]) for r in
           A.resolve_attempts(log, destinations({"name": "d"})).withColumn("at", F.unix_timestamp("finished_at")).collect()}
    assert got == {"a": (None, 2), "b": ("e2", 2)}


def test_last_delay_is_reused(spark):
    schedule = F.array(F.lit(2))
    got = spark.range(1, 5).select(A.retry_delay(schedule, F.col("id").cast("int")), A.total_wait(F.array(F.lit(1), F.lit(4)), F.col("id").cast("int"))).collect()
    assert [tuple(r) for r in got] == [(2, 0), (2, 1), (2, 5), (2, 9)]


def test_fanout_summary_and_result(spark):
    df = spark.createDataFrame([(1, "delivered"), (1, "skipped"), (2, "delivered"), (2, "dead_lettered"), (3, "skipped")], "work int, status string")
    got = {r["work"]: r["status"] for r in A.fanout_summary(df, ["work"]).collect()}
    assert got == {1: "fanout_delivered", 2: "fanout_partial", 3: "fanout_delivered"}
    results = spark.createDataFrame([("skipped",), ("dead_lettered",), ("fanout_partial",), ("fanout_delivered",), ("delivered",)], "s string").select(A.processor_result(F.col("s"))).collect()
    assert [r[0] for r in results] == ["skipped", "failure", "failure", "success", "success"]


# --- progress ---


def groups(spark, *rows, finalize=False):
    items = spark.createDataFrame([("src", "slot", *row) for row in rows],
                                  "source_name string, slot_name string, group_seq long, item_seq long, position string, completed boolean, group_closed boolean")
    return PG.group_states(items, finalize)


def mark(frame):
    row = PG.contiguous_watermark(frame).first()
    return row and row["last_lsn"]


def test_out_of_order_completion_waits_for_the_first(spark):
    def at(*done):
        return groups(spark, *[(n, 0, f"0/{n}", n in done, True) for n in (1, 2, 3)])

    assert mark(at(2)) is None and mark(at(2, 3)) is None
    assert mark(at(1, 2, 3)) == "0/3"
    acks = PG.acknowledgements(at(1, 2, 3)).orderBy("group_seq").collect()
    assert [r["position"] for r in acks] == ["0/1", "0/2", "0/3"]


def test_group_waits_for_all_its_items(spark):
    assert mark(groups(spark, (1, 0, None, True, True), (1, 1, "0/1", False, True))) is None
    assert mark(groups(spark, (1, 0, None, True, True), (1, 1, "0/1", True, True))) == "0/1"


def test_group_without_position_is_passed_silently(spark):
    frame = groups(spark, (1, 0, "0/1", True, True), (2, 0, None, True, True))
    row = PG.contiguous_watermark(frame).first()
    assert (row["last_group"], row["last_lsn"]) == (2, "0/1")
    assert PG.acknowledgements(frame).count() == 1


def test_open_group_holds_the_mark_until_a_clean_end(spark):
    rows = [(1, 0, "0/1", True, True), (2, 0, "0/2", True, False)]
    assert mark(groups(spark, *rows)) == "0/1"
    assert mark(groups(spark, *rows, finalize=True)) == "0/2"


def test_position_of_a_group_is_the_last_one_given(spark):
    assert mark(groups(spark, (1, 0, "0/F", True, True), (1, 1, "0/1", True, True), (1, 2, None, True, True))) == "0/1"


def test_stray_completion_is_an_error(spark):
    schema = "source_name string, slot_name string, group_seq long, item_seq long"
    registered = spark.createDataFrame([("a", "s", 1, 0)], schema)
    outcomes = spark.createDataFrame([("a", "s", 1, 0, "delivered"), ("a", "s", 9, 0, "delivered")], schema + ", status string")
    PG.require_registered(registered, outcomes.where("group_seq = 1"))
    with pytest.raises(PG.StrayCompletion):
        PG.require_registered(registered, outcomes)


def test_latest_checkpoint_and_configured_start(spark):
    schema = "source_name string, slot_name string, publication_name string, last_lsn string, updated_at timestamp"
    t = datetime(2026, 1, 1)
    log = spark.createDataFrame([("a", "s", "p", "0/1", t), ("a", "s", "p", "0/2", t + timedelta(1))], schema)
    assert PG.latest_checkpoints(log).first()["last_lsn"] == "0/2"
    slots = spark.createDataFrame([("a", "s", ""), ("a", "s", "0/9"), ("a", "t", None)], "source_name string, slot_name string, configured_start string")
    got = sorted((r["slot_name"], r["configured_start"] or "", r["resume_lsn"]) for r in PG.resume_points(slots, log).collect())
    assert got == [("s", "", "0/2"), ("s", "0/9", "0/9"), ("t", "", None)]


# --- dead letters ---


def letters(spark, *rows):
    from changeflow.schemas import DEAD_LETTERS

    base = spark.createDataFrame([(i, f"k{i}", d, s, datetime.fromisoformat(t), p) for i, d, s, t, p in rows],
                                 "dead_letter_id string, idempotency_key string, destination string, status string, failed_at timestamp, payload_json string")
    from changeflow.sources.catalog import conform

    return conform(base, DEAD_LETTERS)


def test_time_window_is_inclusive(spark):
    df = letters(spark, ("a", "d", "pending", "2026-07-05T00:00:00", "{}"), ("b", "d", "pending", "2026-07-06T00:00:00", "{}"))
    found = DL.list_dead_letters(df, failed_after="2026-07-05T12:00:00Z", failed_before="2026-07-06T12:00:00Z")
    assert [r["dead_letter_id"] for r in found.collect()] == ["b"]
    assert DL.list_dead_letters(df, failed_after="2026-07-06T00:00:00Z", failed_before="2026-07-06T00:00:00Z").count() == 1


def test_status_log_and_listing_order(spark):
    df = letters(spark, ("b", "d", "pending", "2026-01-02T00:00:00", "{}"), ("a", "d", "pending", "2026-01-02T00:00:00", "{}"), ("c", "x", "pending", "2026-01-01T00:00:00", "{}"))
    log = DL.status_change(df.where("dead_letter_id = 'b'"), "resolved", F.lit(datetime(2026, 1, 3)))
    now = DL.current(df, log.unionByName(DL.status_change(df.where("dead_letter_id = 'b'"), "ignored", F.lit(datetime(2026, 1, 4)))))
    assert [r["dead_letter_id"] for r in DL.list_dead_letters(now, status="pending").collect()] == ["c", "a"]
    assert [r["dead_letter_id"] for r in DL.list_dead_letters(now, status="all", destination="d").collect()] == ["a", "b"]
    assert DL.dead_letter_filter(now, status="ignored").count() == 1
    with pytest.raises(DL.DeadLetterError):
        DL.status_change(df, "lost", F.lit(None))


def test_replay_selection(spark):
    df = letters(spark, ("a", "d", "pending", "2026-01-01T00:00:00", "{}"), ("b", "d", "resolved", "2026-01-02T00:00:00", "{}"))
    ids = spark.createDataFrame([("b",)], "dead_letter_id string")
    assert [r["dead_letter_id"] for r in DL.select_replay(df, ids).collect()] == ["b"]
    assert [r["dead_letter_id"] for r in DL.select_replay(df).collect()] == ["a"]
    with pytest.raises(DL.DeadLetterError, match="not found: z"):
        DL.select_replay(df, spark.createDataFrame([("z",)], "dead_letter_id string"))
    with pytest.raises(DL.DeadLetterError, match="no dead letters"):
        DL.select_replay(df, destination="nowhere")


def test_replay_plan(spark):
    targets = destinations({"name": "d", "route": {"tables": ["orders"]}}, {"name": "off", "enabled": False})
    event, txn, other = '{"namespace":"p","entity":"ORDERS"}', '{"events":[{"entity":"users"},{"entity":"orders"}]}', '{"events":[]}'
    t = "2026-01-01T00:00:00"
    df = letters(spark, ("a", "d", "pending", t, event), ("b", "d", "pending", t, txn), ("c", "d", "pending", t, other),
                 ("e", "off", "pending", t, event), ("f", "d", "pending", t, event))
    plan = DL.replay_plan(df, targets, spark.createDataFrame([("kf",)], "idempotency_key string"))
    assert {r["dead_letter_id"]: r["skip_reason"] for r in plan.collect()} == {"a": None, "b": None, "c": "route_mismatch", "e": "disabled", "f": "duplicate"}
    with pytest.raises(Exception, match="unknown destination: gone"):
        DL.replay_plan(letters(spark, ("a", "gone", "pending", t, event)), targets, spark.createDataFrame([], "idempotency_key string")).collect()


def test_show_parses_the_payload(spark):
    df = letters(spark, ("a", "d", "pending", "2026-01-01T00:00:00", '{"x":{"y":3}}'))
    assert DL.show_dead_letter(df, "a").select(F.variant_get("payload", "$.x.y", "int")).first()[0] == 3
