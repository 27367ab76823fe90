"""Cases in which operator and answer once agreed on a wrong result."""

from pyspark.sql import functions as F

from changeflow.functions import lsn, payload
from changeflow.operators import attempts, consume, metrics


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_positions_of_any_length(spark):
    assert one(spark, "1000000000000000000", "string", lsn.lsn_to_number) == 10**18
    assert one(spark, "000000000000000000000001/0000000000A", "string", lsn.lsn_to_number) == 2**32 + 10
    assert one(spark, "99999999999999999999", "string", lsn.lsn_to_number) is None
    assert one(spark, "99999999999999999999", "string", lsn.lsn_valid)
    assert one(spark, "FFFFFFFFFFFFFFFFFFF/0", "string", lsn.lsn_to_number) is None
    assert not one(spark, "1/", "string", lsn.lsn_valid)


def test_long_transaction_ids_stay_bare(spark):
    assert one(spark, "1234567890123456789", "string", payload.transaction_id_json) == "1234567890123456789"
    assert one(spark, "007", "string", payload.transaction_id_json) == '"007"'


def test_unfinished_work_is_open_and_only_started(spark):
    assert one(spark, "in_progress", "string", attempts.processor_result) == "open"
    counted = metrics.dispatch_counters(spark.createDataFrame([("open", "a"), ("success", "a")], "result string, destination string"), ["destination"])
    assert {row["name"]: row["value"] for row in counted.collect()} == {"dispatch_started_total": 2, "dispatch_succeeded_total": 1}


def test_no_ratio_without_both_sizes(spark):
    rows = spark.createDataFrame([(1, 5000, None), (2, None, 10), (3, 10, 30)], "n int, retained_wal_bytes long, safe_wal_size long")
    assert {row["n"]: row["r"] for row in rows.select("n", metrics.wal_budget_ratio().alias("r")).collect()} == {1: None, 2: None, 3: 0.25}


def test_an_event_without_identity_is_no_match(spark):
    rows = spark.createDataFrame([(1, {"id": "1"}), (1, None), (2, {"id": "1"}), (2, {"id": "1"}), (3, None)], "t int, identity map<string,string>")
    found = {row["t"]: (row["same_identity"], row["fewest_columns"]) for row in consume.check_identity(rows, ["t"]).collect()}
    assert found == {1: (False, 0), 2: (True, 1), 3: (False, 0)}
