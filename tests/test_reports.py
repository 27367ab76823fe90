"""Positions, preflight, metrics, ordered operators and receivers."""

import hashlib
import hmac
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from changeflow import config
from changeflow.functions import lsn as N
from changeflow.functions import signing
from changeflow.functions import text as T
from changeflow.operators import consume as C
from changeflow.operators import few, sliced
from changeflow.operators import metrics as M
from changeflow.operators import preflight as PR


def column(spark, values, kind="string"):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}").orderBy("n")


def test_positions(spark):
    got = column(spark, ["0/10", "16/B374D848", "12", "zz", None, "", "FFFFFFFF/FFFFFFFF", "7fffffff/ffffffff"]).select(N.lsn_to_number(F.col("v"))).collect()
    assert [r[0] for r in got] == [16, 97500059720, 12, None, None, None, None, 2**63 - 1]
    back = column(spark, [16, 97500059720, 0], "long").select(N.number_to_lsn(F.col("v"))).collect()
    assert [r[0] for r in back] == ["0/10", "16/B374D848", "0/0"]
    normal = column(spark, ["0/ab", "255", "", None]).select(N.normalise_lsn(F.col("v"))).collect()
    assert [r[0] for r in normal] == ["0/ab", "0/FF", None, None]


@pytest.mark.parametrize("secret", ["short", "x" * 100])
def test_signature_equals_a_standard_hmac(spark, secret):
    body = 'ü{"a":1}'
    got = spark.range(1).select(signing.sign_payload(secret, F.lit("2026-01-01T00:00:00Z"), F.lit(body))).first()[0]
    assert got == "sha256=" + hmac.new(secret.encode(), f"2026-01-01T00:00:00Z.{body}".encode(), hashlib.sha256).hexdigest()


def test_signature_check(spark):
    good = "sha256=" + hmac.new(b"k", b"2026-01-01T00:00:00Z.b", hashlib.sha256).hexdigest()
    rows = [("2026-01-01T00:00:00Z", good, 300), ("2026-01-01T00:00:00Z", good, 301), ("2026-01-01T00:00:00Z", good, -300), (None, good, 0),
            ("soon", good, 0), ("2026-01-01T00:00:00Z", None, 0), ("2026-01-01T00:00:00Z", good[:-1], 0)]
    base = datetime(2026, 1, 1)
    df = spark.createDataFrame([(n, t, s, base + timedelta(seconds=d)) for n, (t, s, d) in enumerate(rows)], "n int, t string, s string, r timestamp").orderBy("n")
    got = df.select(signing.verify_signature("k", F.col("t"), F.lit("b"), F.col("s"), F.col("r"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, False, False]


def test_times(spark):
    got = column(spark, ["2026-07-19T12:00:00+02:00", "2026-07-19T12:00:00.5Z", "2026-07-19", "nope"]).select(T.iso8601_utc(F.col("v"))).collect()
    assert [r[0] for r in got] == ["2026-07-19T10:00:00Z", "2026-07-19T12:00:00Z", None, None]


# --- preflight ---

SLOT = {"slot_name": "s", "slot_type": "logical", "plugin": "pgoutput", "database": "db", "present": True, "active": True, "wal_status": "reserved",
        "invalidation_reason": None, "conflicting": False, "restart_lsn": "0/10", "confirmed_flush_lsn": "0/20",
        "resume_lsn": None, "temporary_slot": False, "auto_create_slot": False}
SLOT_DDL = ("slot_name string, slot_type string, plugin string, database string, present boolean, active boolean, wal_status string, invalidation_reason string, "
            "conflicting boolean, restart_lsn string, confirmed_flush_lsn string, resume_lsn string, temporary_slot boolean, auto_create_slot boolean")


def slot(spark, **change):
    return spark.createDataFrame([tuple({**SLOT, **change}.values())], SLOT_DDL)


@pytest.mark.parametrize(("change", "reason"), [
    ({}, None), ({"present": False}, "slot is missing"), ({"active": False}, "slot is inactive"), ({"wal_status": "lost"}, "wal_status=lost"),
    ({"invalidation_reason": "x"}, "slot is invalidated: x"), ({"conflicting": True}, "slot is conflicting"), ({"restart_lsn": ""}, "slot has no restart LSN"),
])
def test_slot_reason(spark, change, reason):
    row = PR.slot_health(slot(spark, **change)).first()
    assert (row["reason"], row["ready"]) == (reason, reason is None)


@pytest.mark.parametrize(("change", "verdict"), [
    ({}, None), ({"active": True}, "already active"), ({"resume_lsn": "0/20"}, None), ({"resume_lsn": "0/1F"}, "resume position is no longer retained"),
    ({"resume_lsn": "0/F", "confirmed_flush_lsn": None}, "resume position is no longer retained"), ({"resume_lsn": "junk"}, "unreadable position"),
    ({"resume_lsn": "0/20", "temporary_slot": True}, "temporary slot cannot resume a checkpoint"), ({"present": False}, "missing slot and auto-create is off"),
    ({"present": False, "auto_create_slot": True}, None), ({"present": False, "auto_create_slot": True, "resume_lsn": "0/1"}, "missing slot must not be recreated while resuming"),
    ({"slot_name": "t"}, "wrong slot"), ({"plugin": "test_decoding"}, "not a logical pgoutput slot"), ({"database": "x"}, "different database"),
    ({"wal_status": "unreserved"}, "cannot retain WAL: unreserved"), ({"conflicting": True}, "invalidated"), ({"restart_lsn": None}, "no reachable restart LSN"),
])
def test_slot_preflight(spark, change, verdict):
    frame = slot(spark, **{"active": False, **change}).withColumn("verdict", PR.slot_preflight(F.lit("db"), F.lit("s")))
    assert frame.first()["verdict"] == verdict
    if verdict:
        with pytest.raises(PR.PreflightError):
            PR.require_ready(frame)
    else:
        PR.require_ready(frame)


@pytest.mark.parametrize(("facts", "usable"), [
    ((False, False, "n", False, False), True), ((True, False, "d", True, False), True), ((True, False, "d", False, True), False),
    ((False, True, "i", True, False), False), ((False, True, "i", False, True), True), ((True, True, "f", False, False), True), ((True, True, "n", True, True), False),
])
def test_identity_usable(spark, facts, usable):
    frame = spark.createDataFrame([("p", "t", *facts)], "schema_name string, table_name string, publishes_updates boolean, publishes_deletes boolean, replica_identity string, "
                                  "primary_key_usable boolean, replica_identity_index_usable boolean")
    assert frame.select(PR.identity_usable()).first()[0] is usable
    assert PR.identity_preflight_report(frame).count() == (0 if usable else 1)


@pytest.mark.parametrize("limit", [few.BROADCAST_BYTES, 0])
def test_identity_is_picked_from_the_row_with_and_without_broadcast(spark, events, monkeypatch, limit):
    monkeypatch.setattr(few.spread_join, "__defaults__", ("inner", limit))
    tables = spark.createDataFrame([("public", "orders", ["tenant", "member"]), ("public", "free", [])], "schema_name string, table_name string, replica_identity_columns array<string>")
    row = {"tenant": "9", "member": '"m"', "x": "1"}
    df = events({"new_values": row}, {"operation": "delete", "old_values": row}, {"new_values": {"tenant": "9"}}, {"entity": "free", "new_values": row, "identity": {"id": "1"}}, {"entity": "unknown", "new_values": row})
    attached = PR.attach_identity(df, tables)
    PR.require_complete_identity(attached.where("seq <> 2"))
    with pytest.raises(PR.PreflightError, match="change 2 lacks"):
        PR.require_complete_identity(attached)
    got = [(r["identity"], r["identity_complete"]) for r in attached.orderBy("seq").collect()]
    key = {"tenant": "9", "member": '"m"'}
    assert got == [(key, True), (key, True), ({"tenant": "9"}, False), ({"id": "1"}, True), (None, True)]


# --- ordered operators ---


@pytest.mark.parametrize("width, step", [(1, 1), (3, 1), (7, 10**12), (1000, 1)])
def test_sliced_operators_equal_plain_loops(spark, width, step):
    rng = random.Random(width)
    keys = ["hot", "hot", "hot", "b", None] if width < 1000 else ["hot"] * 9 + [None]
    rows = [(rng.choice(keys), order * step, rng.choice([None, *range(20)])) for order in rng.sample(range(200), 90)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    expected = {}
    seen = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        past = seen.setdefault(k, [])
        known = [x for x in past if x is not None]
        expected[o] = (len(past) + 1, max(known, default=None), max([*known, *([v] if v is not None else [])], default=None), past[-1] if past else None)
        past.append(v)
    result = sliced.running_count(df, ["k"], "o", "n", width)
    result = sliced.running_max(result, ["k"], "o", "v", "before", inclusive=False, width=width)
    result = sliced.running_max(result, ["k"], "o", "v", "upto", inclusive=True, width=width)
    result = sliced.previous_value(result, ["k"], "o", "v", "prev", width)
    assert {r["o"]: (r["n"], r["before"], r["upto"], r["prev"]) for r in result.collect()} == expected


@pytest.mark.parametrize("step", [1, 10**12, -(10**9)])
def test_slices_are_small_however_far_apart_the_orders_lie(spark, step):
    df = spark.range(20000).select(F.when(F.col("id") % 10 > 0, "hot").alias("k"), (F.col("id") * step).alias("o"))
    slices = sliced.cut(df, ["k"], "o", 100).groupBy("k", "_slice").agg(F.count("*").alias("n"), F.min("o").alias("low"), F.max("o").alias("high")).collect()
    assert sum(r["n"] for r in slices) == 20000 and max(r["n"] for r in slices) < 1200 and 100 < len(slices) < 320
    hot = sorted((r["low"], r["high"], r["_slice"]) for r in slices if r["k"] == "hot")
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(hot, hot[1:]))
    counted = sliced.running_count(df, ["k"], "o", "n", 100).groupBy("k").agg(F.max("n").alias("most"), F.countDistinct("n").alias("different")).collect()
    assert sorted((r["k"] or "", r["most"], r["different"]) for r in counted) == [("", 2000, 2000), ("hot", 18000, 18000)]


def test_batches_may_end_short(spark):
    df = spark.range(7).select(F.lit("s").alias("s"), F.col("id").alias("seq"))
    got = [r["batch_number"] for r in C.batch_number(df, ["s"], "seq", 3).orderBy("seq").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2]


@pytest.mark.parametrize("scope", C.SCOPES)
def test_work_is_sorted_inside_its_scope(spark, events, scope):
    df = events(*[{"seq": n, "transaction_id": str(n % 3), "entity": f"t{n % 2}", "identity": {"id": str(n % 4)}} for n in (5, 3, 9, 1, 7, 2, 8)])
    rows = C.order_work(df, scope, ["seq"]).collect()
    assert len(rows) == 7
    if scope != "none":
        assert rows == sorted(rows, key=lambda r: (r["scope_key"], r["seq"]))
    with pytest.raises(ValueError, match="scope"):
        C.order_work(df, "table", ["seq"])


# --- metrics ---


def test_gauges_keep_zeros_and_ignore_unknown_destinations_per_destination(spark):
    targets = config.destinations({"destinations": [{"name": "a"}, {"name": "idle"}]})
    dead = spark.createDataFrame([("a", "pending"), ("a", "ignored"), ("old", "pending")], "destination string, status string")
    ledger = spark.createDataFrame([("a",)], "destination string")
    got = {(r["name"], r["destination"]): r["value"] for r in M.delivery_gauges(dead, ledger, targets).collect()}
    assert len(got) == 15
    assert got["dead_letters_total", None] == 3 and got["dead_letters_total", "a"] == 2 and got["dead_letters_pending_total", "a"] == 1
    assert got["delivered_envelopes_total", None] == 1 and got["delivered_envelopes_total", "idle"] == 0 and ("dead_letters_total", "old") not in got


def test_gauges_of_empty_tables_are_zero(spark):
    targets = config.destinations({"destinations": [{"name": "a"}]})
    got = M.delivery_gauges(spark.createDataFrame([], "destination string, status string"), spark.createDataFrame([], "destination string"), targets).collect()
    assert len(got) == 10 and {r["value"] for r in got} == {0}


def test_nearest_rank_percentile(spark):
    df = spark.range(1, 101).select(F.lit("x").alias("k"), F.col("id").alias("ms"))
    row = M.latency_summary(df, ["k"], "ms", 95).first()
    assert (row["samples"], row["mean_thousandths"], row["p95"]) == (100, 50500, 95)
    assert M.latency_summary(df.limit(1), ["k"], "ms", 95).first()["p95"] == 1


def test_throughput_without_time_is_zero(spark):
    df = spark.createDataFrame([(10, 0), (10, 3)], "n long, s long")
    assert [float(r[0]) for r in df.orderBy("s").select(M.throughput(F.col("n"), F.col("s"))).collect()] == [0.0, 3.33]


def test_alert_needs_an_unbroken_run(spark):
    times = [(0, True), (20, True), (25, False), (40, True), (60, True), (70, True), (100, False), (200, True)]
    start = datetime(2026, 1, 1)
    df = spark.createDataFrame([("s", n, start + timedelta(seconds=t), on) for n, (t, on) in enumerate(times)], "slot string, n long, at timestamp, bad boolean")
    rows = M.sustained_alerts(df, ["slot"], "n", "at", F.col("bad"), 30).collect()
    assert [((r["started_at"] - start).seconds, (r["ended_at"] - start).seconds, r["samples"]) for r in rows] == [(40, 70, 3)]


def test_metric_line_escapes_and_orders(spark):
    df = spark.createDataFrame([('a"b\\c\nd', 3)], "v string, n long")
    line = df.select(M.metric_line(F.lit("x_total"), "svc", {"l": F.col("v"), "none": F.lit(None).cast("string")}, F.col("n"))).first()[0]
    assert line == 'changeflow_x_total{service_name="svc",l="a\\"b\\\\c\\nd"} 3'


def test_missing_slot_has_two_gauges(spark):
    frame = slot(spark, present=False, slot_type=None).withColumns({
        "retained_wal_bytes": F.lit(5).cast("long"), "safe_wal_size": F.lit(None).cast("long"), "inactive_since": F.lit(None).cast("timestamp")})
    assert M.slot_gauges(PR.slot_health(frame)).count() == 2
    present = frame.withColumns({"present": F.lit(True), "wal_status": F.lit(None).cast("string")})
    rows = {r["name"]: (r["wal_status"], r["value"]) for r in M.slot_gauges(PR.slot_health(present)).collect()}
    assert rows["slot_wal_status"] == ("unknown", 1) and rows["slot_restart_lsn_bytes"] == (None, 16) and "slot_safe_wal_size_bytes" not in rows


# --- receivers ---


def test_apply_once_counts_attempts(spark):
    received = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "event_id string, at int")
    got = {r["event_id"]: (r["attempts"], r["applied_now"]) for r in C.apply_once(received, spark.createDataFrame([("b",)], "event_id string"), "at").collect()}
    assert got == {"a": (2, 1), "b": (1, 0)}


def test_state_does_not_depend_on_batching(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.choice(["insert", "update", "delete"]), n, n % 3, n * 10) for n in range(60)]
    df = spark.createDataFrame(rows, "id string, operation string, pos long, sequence_number int, total long")
    whole = C.materialize(None, df, ["id"], F.col("pos"), ["total"]).collect()
    state = None
    parts = [df.where(F.col("pos") % 4 == n) for n in (2, 0, 3, 1)]
    for part in parts:
        state = C.materialize(state, part, ["id"], F.col("pos"), ["total"])
    assert sorted(state.collect()) == sorted(whole)
    alive = C.latest_image(df, ["id"], F.col("pos"), ["total"])
    assert {r["id"] for r in alive.collect()} == {r["id"] for r in whole if not r["deleted"]}


def test_payments(spark):
    orders = spark.createDataFrame([(1, "paid"), (2, "paid"), (3, "pending")], "order_id long, status string")
    payments = spark.createDataFrame([(1, "captured", 10), (2, "reversed", -5), (1, "reversed", 10), (1, "captured", 0)], "order_id long, status string, amount_cents long")
    assert [r["order_id"] for r in C.unreconciled_payments(orders, payments).collect()] == [2]
    got = {r["order_id"]: tuple(r)[1:] for r in C.payment_balance(payments).collect()}
    assert got == {1: (10, 10, 20, 2), 2: (0, -5, -5, 0)}


def test_composite_identity_is_the_same_for_insert_update_delete(spark, events):
    key = {"tenant": "9", "member": '"m"'}
    df = events(*[{"operation": op, "identity": key} for op in ("insert", "update", "delete")], {"transaction_id": "2", "identity": key}, {"transaction_id": "2", "identity": {"tenant": "9"}})
    got = {r["transaction_id"]: (r["same_identity"], r["fewest_columns"], r["events"]) for r in C.check_identity(df, ["transaction_id"]).collect()}
    assert got == {"1": (True, 2, 3), "2": (False, 1, 2)}


@pytest.mark.parametrize("heavy", [1, 7, 100000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_plain_one(spark, heavy, how):
    many = spark.range(3000).select(F.when(F.col("id") % 10 > 1, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("n"))
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k40", 3), ("gone", 4)], "k string, v int")
    got, want = few.salted_join(many, small, ["k"], "n", how, heavy), many.join(small, ["k"], how)
    assert sorted(got.select("k", "n", "v").collect()) == sorted(want.select("k", "n", "v").collect())


def test_large_sides_are_neither_copied_nor_broadcast_by_their_file_size(spark, monkeypatch):
    monkeypatch.setattr(few.spread_join, "__defaults__", ("inner", 0))
    rows = spark.range(3000).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("k"))
    names = spark.range(20).select(F.col("id").alias("k"), F.concat(F.lit("name of "), F.col("id").cast("string")).alias("name"))
    joined = few.spread_join(rows, names, ["k"], by="seq", how="left")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 3000
    assert joined.where("name = concat('name of ', k)").count() == 2700
    assert "rightHint=(strategy=merge)" in plan
    stored = few.store(names, "names")
    assert "BroadcastHashJoin" not in rows.join(stored.where("k > 1"), "k")._jdf.queryExecution().executedPlan().toString()


def test_the_facts_of_a_catalog_are_joined_by_shuffle(spark):
    def table(text, *rows):
        return spark.createDataFrame(list(rows), text)

    facts = PR.publication_facts(
        table("publication string, schema_name string, table_name string", ("p", "s", "t"), ("p", "s", "u")),
        table("publication string, publishes_update boolean, publishes_delete boolean", ("p", True, False)),
        table("relation_id long, schema_name string, table_name string, replica_identity string", (1, "s", "t", "d"), (2, "s", "u", "f"), (3, "s", "v", "f")),
        table("relation_id long, ordinal int, attnum int, is_primary boolean, is_replident boolean, is_valid boolean, is_ready boolean, is_live boolean", (1, 2, 1, True, False, True, True, True), (1, 1, 2, True, False, True, True, True)),
        table("relation_id long, attnum int, column_name string, dropped boolean", (1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, "d", True), (3, 1, "e", False)))
    assert {(r["relation_id"], tuple(r["replica_identity_columns"]), r["primary_key_usable"]) for r in facts.collect()} == {(1, ("b", "a"), True), (2, ("c",), False)}
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 4
