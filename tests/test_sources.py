"""Payload files, catalog snapshots, state tables and sending."""

import hmac
import json

import pytest
from pyspark.sql import functions as F

from changeflow import config
from changeflow.operators import project as P
from changeflow.session import run_folder
from changeflow.sources import payload_files as PL
from changeflow.sources import sinks
from changeflow.sources.catalog import read_publication_tables, read_slot_status
from changeflow.sources import sinks
from changeflow.sources.sinks import deliver_batch
from changeflow.sources.state import StateTables


def read(spark, *payloads):
    rows = [(n, p if isinstance(p, str) else json.dumps(p)) for n, p in enumerate(payloads)]
    return PL.read_event_payloads(spark.createDataFrame(rows, "n int, payload_json string")).orderBy("n")


BASE = {"operation": "update", "namespace": "public", "entity": "orders"}


def test_aliases(spark):
    row = read(spark, {"operation": "update", "schema": "s", "table": "t", "primary_key": {"id": 1}, "source_position": "0/5"}).first()
    assert (row["namespace"], row["entity"], row["identity"], row["commit_lsn"]) == ("s", "t", {"id": "1"}, "0/5")
    row = read(spark, {**BASE, "schema": "x", "table": "y", "commit_lsn": 16, "source_position": "0/5"}).first()
    assert (row["namespace"], row["entity"], row["commit_lsn"]) == ("public", "orders", "16")


def test_data_becomes_old_for_delete_and_explicit_rows_win(spark):
    rows = read(spark, {**BASE, "operation": "delete", "data": {"id": 1}}, {**BASE, "data": {"id": 1}},
                {**BASE, "data": {"id": 1}, "old_values": {"id": 2}, "new_values": {"id": 3}}).collect()
    assert [(r["old_values"], r["new_values"]) for r in rows] == [({"id": "1"}, None), (None, {"id": "1"}), ({"id": "2"}, {"id": "3"})]


def test_strings_numbers_and_nulls_stay_apart(spark):
    data = read(spark, {**BASE, "data": {"a": "1", "b": 1, "c": None, "d": {"x": [1, "y"]}}}).first()["new_values"]
    assert data == {"a": '"1"', "b": "1", "c": None, "d": '{"x":[1,"y"]}'}


def test_column_order_survives(spark):
    text = read(spark, {**BASE, "data": {"z": 1, "a": 2, "m": 3, "b": 4, "y": 5, "c": 6}}).select(F.to_json("new_values")).first()[0]
    assert list(json.loads(text)) == ["z", "a", "m", "b", "y", "c"]


def test_present_keys_are_copied_into_metadata_even_when_null(spark):
    row = read(spark, {**BASE, "event_id": None, "changes": None, "source": "s", "metadata": {"event_id": "old", "k": 1}}).first()
    assert row["metadata"] == {"event_id": None, "changes": None, "source": '"s"', "k": "1"}
    assert row["explicit_changes"] == []
    assert read(spark, BASE).first()["explicit_changes"] is None


def test_explicit_changes_are_read(spark):
    row = read(spark, {**BASE, "changes": [{"name": "a", "old_value": None, "new_value": "x"}]}).first()
    assert [tuple(c) for c in row["explicit_changes"]] == [("a", None, '"x"')]


@pytest.mark.parametrize(("payload", "reason"), [
    ("{broken", "not a JSON object"), ("[1]", "not a JSON object"), ({"namespace": "p", "entity": "e"}, "missing operation"),
    ({"operation": "x", "entity": "e"}, "missing namespace"), ({"operation": "x", "namespace": "p"}, "missing entity"),
    ({**BASE, "occurred_at": "yesterday"}, "unreadable occurred_at"), ({**BASE, "data": 5}, "wrong shape"), (BASE, None),
    ({**BASE, "data": None}, None),
])
def test_quarantine_reason(spark, payload, reason):
    assert read(spark, payload).first()["error_reason"] == reason


def test_fail_mode_raises(spark):
    good, bad = PL.quarantine_malformed(read(spark, BASE, "{broken"), mode="fail")
    assert bad is None
    with pytest.raises(Exception, match="not a JSON object"):
        good.collect()


def test_transaction_children_are_numbered_and_empty_envelopes_kept(spark):
    rows = [(1, json.dumps({"transaction_id": 42, "commit_lsn": "0/1", "committed_at": "2026-07-19T12:00:00Z", "events": [BASE, {**BASE, "sequence_number": 9}]})),
            (2, json.dumps({"transaction_id": "t", "events": []})), (3, json.dumps({"events": []}))]
    got = PL.read_transaction_payloads(spark.createDataFrame(rows, "n int, payload_json string")).orderBy("n", "sequence_number").collect()
    assert [(r["n"], r["envelope_transaction_id"], r["sequence_number"], r["error_reason"]) for r in got] == [
        (1, "42", 0, None), (1, "42", 9, None), (2, "t", None, None), (3, None, None, "missing transaction_id")]


def test_a_broken_child_rejects_its_envelope(spark):
    rows = [(1, json.dumps({"transaction_id": 1, "events": [BASE, {"namespace": "p", "entity": "e"}]})), (2, json.dumps({"transaction_id": 2, "events": [BASE]}))]
    got = PL.read_transaction_payloads(spark.createDataFrame(rows, "n int, payload_json string")).orderBy("n").collect()
    assert [(r["n"], r["error_reason"]) for r in got] == [(1, "broken event: missing operation")] * 2 + [(2, None)]


def test_payload_round_trip(spark, events):
    bodies = P.event_bodies(P.project_events(events(
        {"operation": "update", "old_values": {"id": "1", "s": '"a"'}, "new_values": {"id": "1", "s": '"b"'}, "commit_lsn": "0/1"})))
    again = PL.read_event_payloads(bodies.select(F.col("body").alias("payload_json")))
    columns = again.withColumns({"source_name": F.lit("shop"), "slot_name": F.lit("s"), "seq": F.lit(0), "transport_lsn": F.lit(None).cast("string"),
                                 "ingested_at": F.current_timestamp()})
    before, after = bodies.first(), P.project_events(columns).first()
    for column in ("event_id", "source", "operation", "namespace", "entity", "identity", "source_position", "data", "changes"):
        assert before[column] == after[column]


def test_union_ignores_missing_feeds(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "q")], "x int, y string")
    assert sorted(PL.union_feeds(a, None, b).collect()) == [(1, None), (2, "q")]


def test_catalog_snapshots_tolerate_missing_columns(spark):
    slots = read_slot_status(spark.createDataFrame([("s", "logical"), ("gone", None)], "slot_name string, slot_type string"))
    assert [(r["present"], r["conflicting"], r["safe_wal_size"]) for r in slots.orderBy("slot_type").collect()] == [(False, None, None), (True, None, None)]
    tables = read_publication_tables(spark.createDataFrame([(1, "t", '["a","b"]')], "relation_id long, publishes_updates string, replica_identity_columns string"))
    row = tables.first()
    assert (row["publishes_updates"], row["replica_identity_columns"], row["publishes_deletes"]) == (True, ["a", "b"], None)


def test_state_batches_replace_themselves_and_readers_see_earlier_ones(spark):
    state = StateTables(spark, run_folder(spark, "state"))
    row = [("d", "pending", None)]
    frame = spark.createDataFrame(row, "dead_letter_id string, status string, updated_at timestamp")
    assert state.read("dead_letter_status").count() == 0
    for batch in (0, 1, 1):
        state.write("dead_letter_status", frame, batch)
    assert state.read("dead_letter_status").count() == 2
    assert state.read("dead_letter_status", before=1).count() == 1
    assert state.read("dead_letter_status", since=1).count() == 1


def prepared(spark):
    rows = [(f"k{n}", "d", part, f"{n}-{part};") for n in range(50) for part in range(3)]
    return spark.createDataFrame(rows, "idempotency_key string, destination string, part long, body string").repartition(5)


def test_each_body_is_one_request_with_its_parts_in_order(spark):
    def transport(destination, key, chunks):
        n = key[1:]
        return 200 if b"".join(chunks).decode() == f"{n}-0;{n}-1;{n}-2;" else 500

    got = deliver_batch(prepared(spark), transport, 4).collect()
    assert len(got) == 50 and {r["status_code"] for r in got} == {200}


def test_errors_and_unread_bodies(spark):
    def transport(destination, key, chunks):
        n = int(key[1:])
        if n % 3 == 0:
            raise ConnectionResetError("gone")
        next(chunks)
        return 204 if n % 3 == 1 else 503

    got = {r["idempotency_key"]: (r["status_code"], r["error_class"]) for r in deliver_batch(prepared(spark), transport, 3).collect()}
    assert len(got) == 50
    assert (got["k0"], got["k1"], got["k2"]) == ((0, "ConnectionResetError"), (204, None), (503, "DeliveryError"))


def test_other_exceptions_stop_the_job(spark):
    def transport(destination, key, chunks):
        raise ValueError("a bug in the transport")

    with pytest.raises(Exception, match="a bug in the transport"):
        deliver_batch(prepared(spark), transport, 2).collect()


def test_signed_requests_carry_headers_and_the_signature_of_the_whole_body(spark):
    targets = config.destinations({"destinations": [
        {"name": "d", "timeout_seconds": 7, "headers": {"X-Static": "s"}, "header_env": {"Authorization": "TOKEN"}, "signing": {"secret_env": "KEY"}}, {"name": "plain"}]})

    def transport(destination, key, chunks, headers, timeout):
        body = b"".join(chunks)
        wanted = {"Content-Type": "application/json"}
        if destination == "d":
            digest = hmac.new(b"secret of KEY", headers["X-Timestamp"].encode() + b"." + body, "sha256").hexdigest()
            wanted |= {"X-Static": "s", "Authorization": "secret of TOKEN", "X-Timestamp": headers["X-Timestamp"], "X-Signature": f"sha256={digest}"}
        n = key[1:]
        return 200 if headers == wanted and timeout == (7 if destination == "d" else 5) and body.decode() == f"{n}-0;{n}-1;{n}-2;" else 500

    rows = prepared(spark).unionByName(prepared(spark).withColumn("destination", F.lit("plain")))
    got = deliver_batch(rows, transport, 4, 1, targets, "secret of {}".format).collect()
    assert len(got) == 100 and {r["status_code"] for r in got} == {200}


def test_a_secret_that_is_missing_stops_the_job(spark):
    targets = config.destinations({"destinations": [{"name": "d", "header_env": {"A": "NOT_SET_ANYWHERE"}}]})
    with pytest.raises(Exception, match="missing environment variable NOT_SET_ANYWHERE"):
        deliver_batch(prepared(spark), lambda *_: 200, 2, 1, targets).collect()
    for broken in ({"algorithm": "md5", "secret_env": "S"}, {"signature_header": "X"}):
        with pytest.raises(config.ConfigError):
            config.destinations({"destinations": [{"name": "d", "signing": broken}]})
    with pytest.raises(config.ConfigError, match="timeout"):
        config.destinations({"destinations": [{"name": "d", "timeout_seconds": 0}]})


def test_long_signed_bodies_wait_outside_memory():
    chunks = [bytes([65 + n]) * (5 << 20) for n in range(4)]
    signature, again = sinks.signed("k", "t", iter(chunks))
    whole = b"".join(again)
    assert whole == b"".join(chunks) and signature == "sha256=" + hmac.new(b"k", b"t." + whole, "sha256").hexdigest()


def test_webhooks_post_in_chunks(monkeypatch):
    sent = []

    class Connection:
        def __init__(self, host, port, timeout):
            sent.append((host, port, timeout))

        def request(self, method, target, body, headers, encode_chunked):
            sent.append((method, target, list(body), headers, encode_chunked))

        def getresponse(self):
            if len(sent) > 3:
                raise sinks.http.client.BadStatusLine("?")
            return type("Answer", (), {"status": 204})

        def close(self):
            sent.append("closed")

    monkeypatch.setattr(sinks.http.client, "HTTPSConnection", Connection)
    hook = sinks.Webhooks({"d": "https://example.com:8443/in?x=1"})
    assert hook("d", "k", iter([b"a", b"b"]), {"H": "1"}, 3) == 204
    assert sent == [("example.com", 8443, 3), ("POST", "/in?x=1", [b"a", b"b"], {"H": "1", "Transfer-Encoding": "chunked"}, True), "closed"]
    with pytest.raises(ConnectionError):
        hook("d", "k", iter([]), {}, 3)


def test_a_connection_sorts_its_bodies_in_slices_and_sends_each_body_once(spark, tmp_path):
    """Many bodies of three parts over two connections: at most two tasks, and each body comes whole, in order and once."""
    rows = spark.range(300).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("idempotency_key"), F.lit("d").alias("destination"), F.explode(F.expr("sequence(2L, 0L, -1L)")).alias("part"))
    rows = rows.withColumn("body", F.concat("idempotency_key", F.lit("."), F.col("part").cast("string"), F.lit(";")))

    def transport(destination, key, chunks):
        return 200 if b"".join(chunks).decode() == "".join(f"{key}.{n};" for n in range(3)) else 500

    sent = deliver_batch(rows, transport, 2)
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and f", {2 * sinks.SLICES}" in plan
    assert sent.rdd.getNumPartitions() == 2
    got = sent.collect()
    assert len(got) == 300 and {r["status_code"] for r in got} == {200}
