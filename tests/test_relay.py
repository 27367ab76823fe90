"""The relay over state tables: batching, restarts, replays and hot transactions."""

import glob
import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from changeflow import config
from changeflow.operators import progress as PG
from changeflow.operators import project as P
from changeflow.operators.preflight import PreflightError
from changeflow.plans import relay as plan
from changeflow.plans.relay import Relay
from changeflow.schemas import CHANGE_EVENT
from changeflow.session import run_folder, shared_folder
from changeflow.sources.feeds import stream_change_feed
from changeflow.streaming.stream import run_relay

# Tasks cannot import this file, so its receiver travels as a value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TARGETS = config.destinations({
    "retry": {"max_attempts": 2, "schedule_seconds": [1]},
    "destinations": [
        {"name": "all"},
        {"name": "orders", "route": {"tables": ["orders"]}, "payload_policy": {"rules": [{"action": "mask", "columns": ["email"]}]}},
        {"name": "off", "enabled": False},
    ],
})


class Receiver:
    """In-process receiver. It keeps each body it is sent in a folder, as the tasks run in other processes."""

    def __init__(self, folder, refuse=()):
        self.folder, self.refuse = folder, refuse
        os.makedirs(folder, exist_ok=True)

    def __call__(self, destination, key, chunks, headers, timeout):
        body = b"".join(chunks).decode()
        number = json.loads(body)["transaction_id"]
        with open(os.path.join(self.folder, f"{os.urandom(8).hex()}"), "w") as out:
            out.write(f"{destination} {key}\n{body}")
        return 500 if str(number) in self.refuse else 200

    def bodies(self):
        return [open(os.path.join(self.folder, name)).read().split("\n", 1) for name in os.listdir(self.folder)]


def feed(events, transactions=6, size=3):
    """Interleaved transactions, each ended by a commit row; the first event of each is about orders."""
    rows, seq = [], 0
    for step in range(size):
        for t in range(transactions):
            rows.append({"seq": seq, "transaction_id": str(t), "sequence_number": None, "entity": "orders" if step == 0 and t % 2 == 0 else "users",
                         "commit_lsn": f"0/{t + 1}", "transport_lsn": f"1/{t + 1}", "new_values": {"id": str(seq), "email": '"a@b"'}})
            seq += 1
    for t in range(transactions):
        rows.append({"seq": seq, "operation": "commit", "transaction_id": str(t), "transport_lsn": f"1/{t + 1}"})
        seq += 1
    return events(*rows)


def relay(spark, tmp_path, name, refuse=(), unit="transaction"):
    return Relay(spark, run_folder(spark, name), TARGETS, Receiver(str(tmp_path / name), refuse), unit=unit)


def summary(relay):
    rows = relay.state.read("outcomes").select("idempotency_key", "status", "reason", "attempts").collect()
    return sorted(map(tuple, rows), key=repr)


def stored_bodies(relay):
    return sorted(map(tuple, relay.state.read("prepared").select("idempotency_key", "part", "body").collect()))


@pytest.mark.parametrize("cuts", [(7,), (3, 11, 18, 20)])
def test_batching_does_not_change_what_is_delivered(spark, events, tmp_path, cuts):
    df = feed(events)
    whole = relay(spark, tmp_path, "whole", refuse=("2",))
    whole.process(df, 0)
    cut = relay(spark, tmp_path, "cut", refuse=("2",))
    bounds = [0, *cuts, 10**6]
    for batch in range(len(bounds) - 1):
        cut.process(df.where(F.col("seq").between(bounds[batch], bounds[batch + 1] - 1)), batch)
    assert summary(cut) == summary(whole)
    assert stored_bodies(cut) == stored_bodies(whole)
    marks = [PG.latest_checkpoints(r.state.read("checkpoints"), "batch_id").first()["last_lsn"] for r in (whole, cut)]
    assert marks == ["1/6", "1/6"]


def test_outcomes_ledger_and_letters(spark, events, tmp_path):
    r = relay(spark, tmp_path, "one", refuse=("2",))
    r.process(feed(events), 0)
    status = {row["idempotency_key"]: (row["status"], row["reason"], row["attempts"]) for row in r.state.read("outcomes").collect()}
    assert status["shop:s:all:transaction:2:0/3"] == ("dead_lettered", None, 2)
    assert status["shop:s:orders:transaction:1:0/2"] == ("skipped", "route_mismatch", 0)
    assert status["shop:s:off:transaction:0:0/1"] == ("skipped", "disabled", 0)
    assert r.state.read("ledger").count() == 7
    letters = {row["destination"]: json.loads(row["payload_json"]) for row in r.state.read("dead_letters").collect()}
    assert set(letters) == {"all", "orders"}
    assert letters["all"]["events"][0]["data"]["email"] == "a@b" and letters["all"]["metadata"] == {}
    assert letters["orders"]["events"][0]["data"]["email"] == "[REDACTED]"
    assert letters["orders"]["metadata"]["payload_policy"]["fingerprint"] == TARGETS[1].policy.fingerprint


def test_running_a_batch_again_gives_the_same_state(spark, events, tmp_path):
    r = relay(spark, tmp_path, "again", refuse=("2",))
    df = feed(events)
    r.process(df.where("seq < 10"), 0)
    r.process(df.where("seq >= 10"), 1)
    before = summary(r), r.state.read("ledger").count(), r.state.read("dead_letters").count()
    r.process(df.where("seq >= 10"), 1)
    assert (summary(r), r.state.read("ledger").count(), r.state.read("dead_letters").count()) == before


def test_replayed_work_is_not_delivered_again(spark, events, tmp_path):
    r = relay(spark, tmp_path, "twice")
    r.process(feed(events), 0)
    sent = len(r.transport.bodies())
    r.process(feed(events).withColumn("seq", F.col("seq") + 1000), 1)
    assert len(r.transport.bodies()) == sent
    assert {row["reason"] for row in r.state.read("outcomes", since=1).collect()} == {"duplicate", "route_mismatch", "disabled"}
    r.process(feed(events), 2)  # the very rows of batch 0 are known as such before they become work
    assert len(r.transport.bodies()) == sent and r.state.read("outcomes", since=2).count() == 0


def test_replay_resolves_or_stays_pending_with_a_new_letter(spark, events, tmp_path):
    r = relay(spark, tmp_path, "replay", refuse=("2", "4"))
    r.process(feed(events), 0)
    assert r.letters().where("status = 'pending'").count() == 4
    r.transport.refuse = ("4",)
    outcomes = r.replay(r.letters().where("status = 'pending'"), 1)
    assert sorted(row["status"] for row in outcomes.collect()) == ["dead_lettered", "dead_lettered", "delivered", "delivered"]
    assert r.letters().groupBy("status").count().orderBy("status").collect() == [("pending", 4), ("resolved", 2)]
    r.transport.refuse = ()
    third = r.replay(r.letters().where("status = 'pending'"), 2)
    assert sorted((row["status"], row["skip_reason"] or "") for row in third.collect()) == [
        ("delivered", ""), ("delivered", ""), ("skipped", "duplicate"), ("skipped", "duplicate")]
    assert r.letters().where("status = 'pending'").count() == 0
    assert r.state.read("ledger").groupBy("idempotency_key").count().where("count > 1").count() == 0


def test_a_replay_copies_only_payloads_that_fail_again(spark, events, tmp_path):
    r = relay(spark, tmp_path, "copies", refuse=("2", "3"))
    r.process(feed(events), 0)
    letters = {row["idempotency_key"]: row["payload_json"] for row in r.letters().collect()}
    r.transport.refuse = ("3",)
    known = set(glob.glob(f"{shared_folder(spark)}/replayed-*"))
    r.replay(r.letters(), 1)
    (folder,) = set(glob.glob(f"{shared_folder(spark)}/replayed-*")) - known
    kept = {row["idempotency_key"]: row["payload_json"] for row in spark.read.parquet(folder).collect()}
    assert {key: text for key, text in kept.items() if text} == {key: text for key, text in letters.items() if ":3:" in key} and len(kept) == 3
    again = r.state.read("dead_letters", since=1).collect()
    assert {row["idempotency_key"]: row["payload_json"] for row in again if row["writer"] == "replay"} == {key: text for key, text in letters.items() if ":3:" in key}


def test_replay_sends_the_stored_body_unchanged(spark, events, tmp_path):
    r = relay(spark, tmp_path, "same", refuse=("2",))
    r.process(feed(events), 0)
    stored = {row["payload_json"] for row in r.letters().collect()}
    r.destinations = config.destinations({"destinations": [{"name": n} for n in ("all", "orders")]})
    r.transport.refuse = ()
    seen = len(r.transport.bodies())
    r.replay(r.letters(), 1)
    bodies = [body for _, body in r.transport.bodies()]
    assert len(bodies) - seen == 2 and all(bodies.count(text) == 3 for text in stored)


def test_bare_events_are_delivered_one_by_one(spark, events, tmp_path):
    r = relay(spark, tmp_path, "bare")
    r.process(events(*[{"seq": n, "transaction_id": None, "sequence_number": None, "commit_lsn": "0/1", "transport_lsn": f"1/{n}", "entity": "orders",
                         "new_values": {"id": str(n)}} for n in range(1, 4)]), 0)
    assert r.state.read("ledger").groupBy("destination").count().orderBy("destination").collect() == [("all", 3), ("orders", 3)]


def test_event_unit_routes_and_redacts_each_event(spark, events, tmp_path):
    r = relay(spark, tmp_path, "events", refuse=("2",), unit="event")
    r.process(feed(events), 0)
    ledger = r.state.read("ledger")
    assert ledger.groupBy("destination").count().orderBy("destination").collect() == [("all", 15), ("orders", 2)]
    assert {row["delivery_unit"] for row in ledger.collect()} == {"event"}
    bodies = [json.loads(body) for head, body in r.transport.bodies() if head.startswith("orders")]
    assert {b["data"]["email"] for b in bodies} == {"[REDACTED]"} and all("payload_policy" in b["metadata"] for b in bodies)
    letters = r.letters().collect()
    assert len(letters) == 4 and {row["operation"] for row in letters} == {"insert"} and {row["namespace"] for row in letters} == {"public"}
    assert PG.latest_checkpoints(r.state.read("checkpoints"), "batch_id").first()["last_lsn"] == "1/6"
    r.transport.refuse = ()
    assert {row["status"] for row in r.replay(r.letters(), 1).collect()} == {"delivered"}
    assert r.state.read("ledger").select("idempotency_key").distinct().count() == 21


def test_hot_transaction_arrives_whole(spark, events, tmp_path):
    size = 2 * P.PART_EVENTS + 10
    one = events({"transport_lsn": "1/1", "commit_lsn": "0/1", "new_values": {"id": "1", "email": '"x"'}, "sequence_number": None})
    changes = one.drop("seq").crossJoin(spark.range(size).withColumnRenamed("id", "seq"))
    rows = changes.unionByName(events({"seq": size, "operation": "commit", "transport_lsn": "1/1"}))
    r = relay(spark, tmp_path, "hot", refuse=("1",))
    r.process(rows.where(f"seq < {size // 2}"), 0)
    r.process(rows.where(f"seq >= {size // 2}"), 1)
    got = {head.split(" ")[0]: json.loads(body) for head, body in r.transport.bodies()}
    assert set(got) == {"all", "orders"}
    assert all(body["event_count"] == len(body["events"]) == size for body in got.values())
    assert len({e["event_id"] for e in got["all"]["events"]}) == size
    letters = r.letters()
    assert letters.where("payload_json IS NULL").count() == 2 and r.state.read("dead_letter_parts").count() == 6
    r.transport.refuse = ()
    assert {row["status"] for row in r.replay(letters, 2).collect()} == {"delivered"}
    assert r.letters().where("status = 'resolved'").count() == 2


def test_a_batch_leaves_no_shuffle_files(spark, events, tmp_path):
    """What is stored was shuffled for once: its shuffle files go with the write and not when the driver collects its garbage."""
    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name.split("_")[1] for name in blocks.mkString(" ").split() if name.startswith("shuffle_")}

    r = relay(spark, tmp_path, "files", refuse=("2",))
    batch = r.state.begin(0)
    groups, changes = r.assemble(feed(events), batch)
    before = shuffles()
    prepared = r.prepare(groups, changes, batch)
    r.send(prepared, batch)
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert all(name["file"].endswith(".zstd.parquet") for files in batch.adds.values() for name in files)


def test_bodies_are_shuffled_only_as_rows(spark, events, tmp_path):
    """Events and envelopes meet by one shuffle each; the text made of them stays where it is."""
    r = relay(spark, tmp_path, "shuffles")
    r.process(feed(events), 0)
    bodies = r._transaction_bodies(r.state.read("assembled"), r.state.read("pairs").where("skip_reason IS NULL"), F.lit(True))
    assert bodies._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("unit", ["transaction", "event"])
def test_slices_give_what_the_whole_gives(spark, events, tmp_path, monkeypatch, unit):
    rows = feed(events).unionByName(events({"seq": 90, "operation": "commit", "transaction_id": "empty", "transport_lsn": "1/9", "commit_lsn": "0/9"}))
    whole = relay(spark, tmp_path, "at_once", ("2",), unit)
    whole.process(rows, 0)
    monkeypatch.setattr(plan, "SLICE_EVENTS", 5)
    monkeypatch.setattr(plan, "SLICE_BYTES", 4000)
    cut = relay(spark, tmp_path, "in_slices", ("2",), unit)
    cut.process(rows, 0)
    assert len({x["file"].split("/")[1] for x in cut.state.snapshot().tables["prepared"]}) > 1
    assert stored_bodies(cut) == stored_bodies(whole) and summary(cut) == summary(whole)
    tries = [sorted(map(tuple, r.state.read("attempts").select("idempotency_key", "attempt", "status_code", "round").collect())) for r in (whole, cut)]
    assert tries[0] == tries[1] and max(number for _, number, _, _ in tries[0]) == 2


def test_stream_equals_batch_and_restart_adds_nothing(spark, events, tmp_path):
    df = feed(events)
    folder = run_folder(spark, "files")
    for low, high in ((0, 8), (8, 15), (15, 99)):
        df.where(F.col("seq").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
    r, whole = relay(spark, tmp_path, "stream", refuse=("2",)), relay(spark, tmp_path, "batch", refuse=("2",))

    def run():
        run_relay(stream_change_feed(spark, folder, CHANGE_EVENT, files_per_batch=1, names="*.parquet"), r)

    run()
    whole.process(df, 0)
    assert summary(r) == summary(whole) and stored_bodies(r) == stored_bodies(whole)
    sent, ledger = len(r.transport.bodies()), r.state.read("ledger").count()
    run()
    assert (len(r.transport.bodies()), r.state.read("ledger").count()) == (sent, ledger)


def test_a_start_is_held_against_the_relays_own_checkpoint(spark, events, tmp_path):
    r = relay(spark, tmp_path, "resume")
    r.process(feed(events), 0)
    newest = PG.latest_checkpoints(r.state.read("checkpoints"), "batch_id").first()
    facts = {
        "source_name": newest["source_name"], "slot_name": newest["slot_name"], "database": "app", "slot_type": "logical", "plugin": "pgoutput", "present": True,
        "active": False, "temporary_slot": False, "auto_create_slot": False, "conflicting": False, "wal_status": "reserved", "invalidation_reason": "",
        "restart_lsn": "0/1", "confirmed_flush_lsn": newest["last_lsn"], "configured_start": ""}
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in facts.items())
    slots = lambda **changed: spark.createDataFrame([tuple((facts | changed).values())], schema)
    row = r.starts(slots(), "app").first()
    assert (row["resume_lsn"], row["verdict"]) == (newest["last_lsn"], None)
    assert r.starts(slots(configured_start="0/2"), "app").first()["verdict"] == "resume position is no longer retained"
    for changed, why in (({"restart_lsn": "FF/0"}, "no longer retained"), ({"present": False, "auto_create_slot": True}, "missing slot must not"), ({"active": True}, "already active"),
                         ({"temporary_slot": True}, "temporary slot"), ({"confirmed_flush_lsn": "x"}, "unreadable")):
        with pytest.raises(PreflightError, match=why):
            run_relay(None, r, slots=slots(**changed), database="app")
    with pytest.raises(PreflightError, match="different database"):
        run_relay(None, r, slots=slots(), database="other")
    with pytest.raises(ValueError, match="database"):
        run_relay(None, r, slots=slots())


def test_unsafe_slot_stops_the_start(spark, tmp_path):
    verdicts = spark.createDataFrame([("s", "already active")], "slot_name string, verdict string")
    with pytest.raises(PreflightError, match="already active"):
        run_relay(None, relay(spark, tmp_path, "unsafe"), verdicts=verdicts)
