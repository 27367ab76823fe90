"""The log of committed batches, and what the relay makes of rows that come again, empty transactions and long letters."""

import json

import pytest
from pyspark.sql import functions as F
from test_relay import TARGETS, Receiver, feed, relay, summary

from changeflow import config
from changeflow.operators import deadletters as DL
from changeflow.operators import project as P
from changeflow.operators import progress as PG
from changeflow.session import run_folder
from changeflow.sources import state as S

LETTER = "dead_letter_id string, status string, updated_at timestamp"


def change(spark, *ids):
    return spark.createDataFrame([(x, "pending", None) for x in ids], LETTER)


def ids(rows):
    return sorted(row["dead_letter_id"] for row in rows.select("dead_letter_id").collect())


def delivered(spark, *rows):
    return spark.createDataFrame([(key, position) for key, position in rows], "idempotency_key string, source_position string").selectExpr(
        "idempotency_key", "'a' AS source_name", "'s' AS slot_name", "'d' AS destination", "'transaction' AS delivery_unit", "'1' AS transaction_id",
        "source_position", "CAST(NULL AS TIMESTAMP) AS delivered_at")


def test_only_committed_batches_count(spark):
    state = S.StateTables(spark, run_folder(spark, "log"))
    broken = state.begin(0)
    assert ids(broken.write("dead_letter_status", change(spark, "lost"))) == ["lost"]
    assert ids(state.read("dead_letter_status")) == []
    assert state.write("dead_letter_status", change(spark, "a", "b"), 0)
    assert not state.write("dead_letter_status", change(spark, "again"), 0)
    with pytest.raises(S.Conflict):
        broken.commit()
    assert ids(S.StateTables(spark, state.root).read("dead_letter_status")) == ["a", "b"]


def test_writers_beside_each_other(spark):
    state, other = (S.StateTables(spark, root) for root in [run_folder(spark, "log")] * 2)
    stream, replay = state.begin(0), other.begin(0, "replay")
    replay.write("ledger", delivered(spark, ("k1", "0/1"), ("k2", "0/2")))
    stream.write("ledger", delivered(spark, ("k2", "0/2"), ("k3", "0/3")))
    replay.commit({"ledger": "idempotency_key"})
    stream.commit({"ledger": "idempotency_key"})
    rows = [(row["idempotency_key"], row["writer"]) for row in state.read("ledger").collect()]
    assert sorted(rows) == [("k1", "replay"), ("k2", "replay"), ("k3", "main")]
    assert state.next_batch("replay") == state.next_batch("main") == 1


def test_snapshots_from_the_written_state(spark, monkeypatch):
    monkeypatch.setattr(S, "CHECKPOINT_EVERY", 3)
    state = S.StateTables(spark, run_folder(spark, "log"))
    for number in range(8):
        state.write("dead_letter_status", change(spark, f"a{number}"), number)
    fresh = S.StateTables(spark, state.root)
    asked = []
    monkeypatch.setattr(S._Files, "read", lambda self, name, read=S._Files.read: asked.append(name) or read(self, name))
    assert fresh.snapshot().version == 7 and len(asked) == 5  # the pointer, the state, two entries, and the one that is not there
    assert len(ids(fresh.read("dead_letter_status"))) == 8 and ids(fresh.read("dead_letter_status", since=6, before=7)) == ["a6"]


def test_compaction_keeps_rows_and_what_is_committed_meanwhile(spark):
    state = S.StateTables(spark, run_folder(spark, "log"))
    for number in range(6):
        state.write("ledger", delivered(spark, (f"k{number}", f"0/{number + 1}0"), (f"x{number}", None)), number, writer="replay" if number % 2 else "main")
    slow = state.begin(9)
    state.compact("ledger", rows_per_file=4)
    slow.write("ledger", delivered(spark, ("k9", "0/FF")))
    slow.commit({"ledger": "idempotency_key"})
    assert state.read("ledger").count() == 13 and state.read("ledger", writer="replay").count() == 6 and state.read("ledger", since=4, before=5).count() == 2
    batch = state.begin(10)
    assert batch.read_range("ledger", 0x1000, 0x2000, unknown=False) is None
    near = batch.read_range("ledger", 0x10, 0x20, unknown=False)
    assert {"k0", "k1"} <= {row["idempotency_key"] for row in near.collect()} and near.count() < 13
    assert {row["idempotency_key"] for row in batch.read_range("ledger", None, None).collect()} >= {f"x{n}" for n in range(6)}


def commit_row(seq, transaction, lsn, **more):
    return {"seq": seq, "operation": "commit", "transaction_id": transaction, "transport_lsn": lsn, "sequence_number": None, "entity": None, "namespace": None, **more}


def change_row(seq, transaction, lsn="1/1", **more):
    return {"seq": seq, "transaction_id": transaction, "transport_lsn": lsn, "commit_lsn": "0/1", "sequence_number": None, "new_values": {"id": str(seq)}, **more}


def test_rows_that_come_again_count_once(spark, events, tmp_path):
    a = [change_row(1, "1"), change_row(2, "1"), change_row(3, "2"), change_row(4, None, "1/0")]
    ends = [commit_row(5, "1", "1/5"), commit_row(6, "1", "1/6")]
    r = relay(spark, tmp_path, "again")
    r.process(events(*a, *a, *ends, ends[0]), 0)
    r.process(events(*a, *ends, commit_row(7, "2", "1/7")), 1)
    r.process(events(a[2], commit_row(7, "2", "1/7"), change_row(8, "2"), commit_row(9, "2", "1/9")), 2)
    rows = sorted((row["batch_id"], row["seq"], row["sequence_number"]) for row in r.state.read("assembled").collect())
    assert rows == [(0, 1, 0), (0, 2, 1), (0, 4, 0), (1, 3, 0), (2, 8, 0)]
    groups = sorted((row["batch_id"], row["group_seq"], row["group_lsn"]) for row in r.state.read("groups").collect())
    assert groups == [(0, 4, "1/0"), (0, 5, "1/5"), (1, 7, "1/7"), (2, 9, "1/9")]
    assert r.state.read("opened", since=2).count() == 0
    assert max(json.loads(body)["event_count"] for _, body in r.transport.bodies()) == 2


@pytest.mark.parametrize("unit", ["transaction", "event"])
def test_empty_transactions_and_commit_facts(spark, events, tmp_path, unit):
    r = relay(spark, tmp_path, f"facts-{unit}", unit=unit)
    time = F.to_timestamp(F.lit("2026-06-17T01:02:03Z"))
    rows = events(change_row(1, "1"), commit_row(2, "1", "1/A", commit_lsn="0/ABC", metadata={"event_id": '"tx-event-1"', "tenant": '"acme"'}), commit_row(3, "2", "1/B"))
    r.process(rows.withColumn("occurred_at", F.when(F.col("operation") == "commit", time)), 0)
    assert PG.latest_checkpoints(r.state.read("checkpoints"), "batch_id").first()["last_lsn"] == "1/B"
    bodies = [json.loads(body) for _, body in r.transport.bodies()]
    if unit == "event":
        assert len(bodies) == 2
        return
    assert {(b["event_id"], b["source_position"], b["commit_lsn"], b["committed_at"], b["metadata"]["tenant"]) for b in bodies} == {
        ("tx-event-1", "0/ABC", "0/ABC", "2026-06-17T01:02:03Z", "acme")}
    empty = r.state.read("outcomes").where("transaction_id = '2'").collect()
    assert {(row["destination"], row["status"], row["reason"]) for row in empty} == {
        ("all", "skipped", "route_mismatch"), ("orders", "skipped", "route_mismatch"), ("off", "skipped", "disabled")}


def letters_by_key(r):
    return {row["idempotency_key"]: row.asDict(recursive=True) for row in r.letters().collect()}


def test_letters_of_many_parts_are_like_letters_of_one(spark, events, tmp_path, monkeypatch):
    refuse = ("0", "2")
    whole = relay(spark, tmp_path, "whole", refuse=refuse)
    whole.process(feed(events, size=5), 0)
    monkeypatch.setattr(P, "PART_EVENTS", 2)
    cut = relay(spark, tmp_path, "cut", refuse=refuse)
    cut.process(feed(events, size=5), 0)
    assert summary(whole) == summary(cut)
    one, many = letters_by_key(whole), letters_by_key(cut)
    assert set(one) == set(many) and {x["parts"] for x in one.values()} == {1} and {x["parts"] for x in many.values()} == {3}
    for key, letter in one.items():
        other = many[key]
        assert other["payload_json"] is None and other["body_digest"] != letter["body_digest"] and other["policy_fingerprint"] == letter["policy_fingerprint"]
        assert sorted(map(str, other["touched"])) == sorted(map(str, letter["touched"]))
        shown = DL.show_dead_letter(cut.letters(), other["dead_letter_id"], cut.state.read("dead_letter_parts"))
        assert shown.select("payload_json").first()[0] == letter["payload_json"]
        assert shown.select(F.variant_get("payload", "$.event_count", "int")).first()[0] == 5
        restored = P.restore_prepared(cut.letters().where(F.col("dead_letter_id") == other["dead_letter_id"]), "payload_policy").first()
        assert restored["policy_fingerprint"] == letter["policy_fingerprint"]
    assert len({x["dead_letter_id"] for x in many.values()}) == len(many)
    narrow = config.destinations({"destinations": [{"name": "all", "route": {"tables": ["users"], "operations": ["delete"]}}, {"name": "orders", "route": {"tables": ["ORDERS"]}}]})
    for r in (whole, cut):
        r.destinations, r.transport.refuse = narrow, ()
        plan = r.replay(r.letters()).collect()
        assert sorted((x["destination"], x["status"], x["skip_reason"] or "") for x in plan) == [
            ("all", "skipped", "route_mismatch")] * 2 + [("orders", "delivered", "")] * 2
    assert sorted(body for head, body in whole.transport.bodies()) == sorted(body for head, body in cut.transport.bodies())


def test_replay_between_batches_of_one_number(spark, events, tmp_path):
    df = feed(events)
    r = relay(spark, tmp_path, "beside", refuse=("2",))
    r.process(df.where("transaction_id < '3'"), 0)
    r.transport.refuse = ()
    pending = r.letters().where("status = 'pending'")
    assert {row["status"] for row in r.replay(pending, 1).collect()} == {"delivered"}
    r.transport.refuse = ("4",)
    r.process(df.where("transaction_id >= '3'"), 1)
    assert r.state.read("ledger").count() == 7 and r.letters().groupBy("status").count().orderBy("status").collect() == [("pending", 2), ("resolved", 2)]
    with pytest.raises(ValueError, match="replay 1"):
        r.replay(r.letters(), 1)
    assert isinstance(r.transport, Receiver) and TARGETS[0].name == "all"
