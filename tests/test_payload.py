"""Projection of events and transactions."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changeflow.functions import payload as PF
from changeflow.functions import text as T
from changeflow.operators import project as P


def changes(df):
    return [tuple(c) for c in P.project_events(df).first()["changes"]]


def test_complete_update_lists_only_what_changed(events):
    df = events({"operation": "update", "old_values": {"id": "1", "status": '"pending"'}, "new_values": {"id": "1", "status": '"paid"'}})
    assert changes(df) == [("status", '"pending"', '"paid"')]


def test_update_with_incomplete_old_row_has_no_changes(events):
    df = events({"operation": "update", "old_values": {"id": "1"}, "new_values": {"id": "1", "status": '"paid"'}})
    assert changes(df) == []


def test_update_without_old_row_has_no_changes(events):
    assert changes(events({"operation": "update", "new_values": {"id": "1"}})) == []


def test_insert_and_delete_have_one_side(events):
    assert changes(events({"new_values": {"id": "1", "note": None}})) == [("id", None, "1")]
    assert changes(events({"operation": "delete", "old_values": {"id": "1"}})) == [("id", "1", None)]


def test_explicit_empty_changes_win(events):
    df = events({"operation": "update", "old_values": {"id": "1"}, "new_values": {"id": "2"}, "explicit_changes": []})
    assert changes(df) == []


def test_ids_differ_by_sequence_and_type_of_value(events):
    rows = P.project_events(events(
        {"sequence_number": 1, "new_values": {"a": "1"}}, {"sequence_number": 2, "new_values": {"a": "1"}},
        {"sequence_number": 1, "new_values": {"a": '"1"'}},
    )).collect()
    ids = [r["event_id"] for r in rows]
    assert len(set(ids)) == 3
    assert all(i.startswith("evt_") and len(i) == 68 for i in ids)


def test_ids_do_not_depend_on_column_order(events):
    rows = P.project_events(events(
        {"sequence_number": 0, "new_values": {"a": "1", "b": "2"}}, {"sequence_number": 0, "new_values": {"b": "2", "a": "1"}},
    )).collect()
    assert rows[0]["event_id"] == rows[1]["event_id"]


def test_explicit_id_and_source(events):
    row = P.project_events(events({"metadata": {"event_id": '"e\\"1"', "source": '"mysql"'}})).first()
    assert (row["event_id"], row["source"]) == ('e"1', "mysql")
    assert P.project_events(events({})).first()["source"] == "postgresql"


def test_missing_time_falls_back_to_stored_ingest_time(events):
    df = events({"ingested_at": datetime(2026, 7, 19, 12)}, {"occurred_at": datetime(2026, 1, 1), "ingested_at": datetime(2026, 7, 19)})
    assert [r["occurred_at"] for r in P.project_events(df).orderBy("seq").collect()] == ["2026-07-19T12:00:00Z", "2026-01-01T00:00:00Z"]


def test_body_keeps_types_and_escapes(events):
    data = {"id": "7", "name": '"a\\"b"', "tab\tkey": "null", "none": None}
    row = P.event_bodies(P.project_events(events({"new_values": data, "identity": None, "transaction_id": "42"}))).first()
    body = json.loads(row["body"])
    assert list(body) == ["event_id", "source", "operation", "namespace", "entity", "identity", "source_position",
                          "transaction_id", "occurred_at", "data", "changes", "metadata"]
    assert body["data"] == {"id": 7, "name": 'a"b', "tab\tkey": None, "none": None}
    assert body["identity"] is None and body["transaction_id"] == 42


@pytest.mark.parametrize("text", ["plain", 'quote"', "back\\slash", "line\nbreak", "[]", "ümlaut", "", "\u0001"])
def test_json_string_matches_a_json_writer(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(T.json_string(F.col("t"))).first()[0]
    assert json.loads(got) == text


def test_envelope_position_is_the_last_childs(events, headers):
    df = events({"commit_lsn": "0/001"}, {"commit_lsn": "0/002"}, {"commit_lsn": None})
    row = P.project_transactions(P.project_events(df), headers({})).first()
    assert (row["source_position"], row["commit_lsn"], row["event_count"]) == ("0/002", "0/002", 3)


def test_envelope_position_of_its_own_wins(events, headers):
    row = P.project_transactions(P.project_events(events({"commit_lsn": "0/001"})), headers({"commit_lsn": "0/9"})).first()
    assert row["source_position"] == "0/9"


def test_empty_envelope(spark, events, headers):
    none = P.project_events(events({}).limit(0))
    bodies = P.transaction_bodies(P.project_transactions(none, headers({"transaction_id": "t"})), P.event_parts(none))
    body = json.loads(bodies.first()["body"])
    assert (body["event_count"], body["events"], body["source"], body["type"]) == (0, [], "postgresql", "transaction.committed")


def test_large_transaction_is_split_into_parts_that_join_to_one_body(spark, events, headers):
    count = 2 * P.PART_EVENTS + 5
    one = events({"new_values": {"id": "1"}})
    df = one.crossJoin(spark.range(count).withColumnRenamed("id", "n")).withColumn("sequence_number", F.col("n").cast("int")).drop("n")
    projected = P.project_events(df.repartition(7))
    bodies = P.transaction_bodies(P.project_transactions(projected, headers({})), P.event_parts(projected)).orderBy("part").collect()
    assert [r["part"] for r in bodies] == [0, 1, 2]
    whole = json.loads("".join(r["body"] for r in bodies))
    assert whole["event_count"] == len(whole["events"]) == count
    ordered = [r["event_id"] for r in projected.orderBy("sequence_number").collect()]
    assert [e["event_id"] for e in whole["events"]] == ordered


def test_transaction_id_depends_on_child_order_not_on_partitions(events, headers):
    a = [{"sequence_number": n, "metadata": {"event_id": f'"e{n}"'}} for n in range(4)]
    b = [{**row, "sequence_number": 3 - n} for n, row in enumerate(a)]

    def txn_id(rows, parts):
        return P.project_transactions(P.project_events(events(*rows).repartition(parts)), headers({})).first()["event_id"]

    assert txn_id(a, 1) == txn_id(a, 3) != txn_id(b, 1)


def test_unwrap_marks_the_last_event_and_every_bare_event(events):
    df = events({"transaction_id": "1"}, {"transaction_id": "1"}, {"transaction_id": None, "sequence_number": None}, {"transaction_id": None})
    assert [r["group_end"] for r in P.unwrap_to_events(df).orderBy("seq").collect()] == [False, True, True, True]


def test_parts_without_events_leave_no_gap(events, headers):
    df = P.project_events(events({"sequence_number": P.PART_EVENTS + 1, "new_values": {"id": "1"}}, {"sequence_number": 9 * P.PART_EVENTS, "new_values": {"id": "2"}}))
    bodies = P.transaction_bodies(P.project_transactions(df, headers({})), P.event_parts(df)).orderBy("part").collect()
    whole = json.loads("".join(r["body"] for r in bodies))
    assert [r["part"] for r in bodies] == [1, 9] and [e["data"] for e in whole["events"]] == [{"id": 1}, {"id": 2}]


def test_wrap_keeps_bare_events_apart_and_shows_event_id_or_position(events):
    df = events({"transaction_id": "9"}, {"transaction_id": None, "metadata": {"event_id": '"e"'}, "commit_lsn": "0/1"},
                {"transaction_id": None, "commit_lsn": "0/1", "entity": "a"}, {"transaction_id": None, "commit_lsn": "0/1", "entity": "b"})
    got = P.wrap_as_transactions(df).orderBy("seq").collect()
    assert [r["shown_transaction_id"] for r in got] == ["9", "e", "0/1", "0/1"]
    assert [r["transaction_id"] for r in got][:2] == ["9", "e"] and len({r["transaction_id"] for r in got}) == 4


def test_transaction_id_is_bare_only_when_it_is_a_number(spark):
    got = spark.createDataFrame([("42",), ("tx-1",), ("042",), (None,)], "t string").select(PF.transaction_id_json(F.col("t"))).collect()
    assert [r[0] for r in got] == ["42", '"tx-1"', '"042"', "null"]
