"""Headline timings as one JSON line. Each query runs once to warm up and then three times; the median counts.

The clock covers building the DataFrame in Python, planning and running. The share of building, which
does not depend on the data except where an operator runs a job of its own, is reported beside it.

The inputs an engine would find stored (change feed, headers, ledger, attempt log, dead letters, slot
samples, payload files) are derived from the driver's tables and written before the clock starts. A
timed run reads them, computes every row and column, and writes to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from changeflow import config  # noqa: E402
from changeflow.functions import signing  # noqa: E402
from changeflow.functions.lsn import lsn_to_number  # noqa: E402
from changeflow.operators import attempts as A  # noqa: E402
from changeflow.operators import consume as C  # noqa: E402
from changeflow.operators import deadletters as DL  # noqa: E402
from changeflow.operators import ledger as L  # noqa: E402
from changeflow.operators import metrics as M  # noqa: E402
from changeflow.operators import preflight as PR  # noqa: E402
from changeflow.operators import progress as PG  # noqa: E402
from changeflow.operators import project as P  # noqa: E402
from changeflow.operators import redact as RD  # noqa: E402
from changeflow.operators import route as R  # noqa: E402
from changeflow.plans import feed as FD  # noqa: E402
from changeflow.session import build_session, run_folder  # noqa: E402
from changeflow.sources.payload_files import read_event_payloads  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
FOURFOLD = ("transactions", "policy")
THREE = ["status", "total_cents", "customer_email"]


def policy(action: str) -> config.Policy:
    return config.Policy.parse({"rules": [{"action": action, "columns": THREE}]})


def explicit_ids(feed):
    return feed.withColumn("metadata", F.map_concat(
        F.map_filter("metadata", lambda k, _v: k != "event_id"),
        F.create_map(F.lit("event_id"), F.concat(F.lit('"e'), F.col("seq").cast("string"), F.lit('"'))),
    ))


def fourfold(rows, *whole_numbers):
    """Four copies with their own numbers: sf0.1 has 25 000 transactions of four events, the published
    transaction and policy figures are for 100 000."""
    shift = F.col("copy") * 1_000_000_000
    copied = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))
    return copied.withColumns({
        "transaction_id": (F.col("transaction_id").cast("bigint") + shift).cast("string"),
        **{name: F.col(name) + shift for name in whole_numbers},
    }).drop("copy")


class Inputs:
    """Stored inputs, one folder each, in as many files as there are cores."""

    def __init__(self, spark):
        self.spark, self.root = spark, run_folder(spark, "bench")
        feed = FD.change_feed(spark, SF)
        self.add("feed", feed)
        self.add("feed_explicit", explicit_ids(feed))
        self.add("projected", P.project_events(self.get("feed")))
        whole = FD.headers(spark, SF).where("transaction_id NOT LIKE 'empty%'")
        self.add("feed_x4", fourfold(self.get("feed"), "seq"))
        self.add("feed_explicit_x4", explicit_ids(self.get("feed_x4")))
        self.add("headers_x4", fourfold(whole, "group_seq"))
        self.add("projected_x4", P.project_events(self.get("feed_x4")))
        pairs = FD.transaction_pairs(spark, SF)
        self.add("pairs", pairs)
        self.add("ledger", FD.earlier_ledger(self.get("pairs")))
        self.add("attempts", FD.attempt_log(self.get("pairs")))
        self.add("letters", FD.dead_letters(spark, SF))
        self.add("letter_log", FD.dead_letter_log(self.get("letters")))
        self.add("slots", FD.slot_samples(spark, SF))
        self.add("payloads", FD.persisted_payloads(spark, SF))
        self.add("bodies", P.event_bodies(self.get("projected")).select("seq", "occurred_at", "body"))
        items = FD.registered_items(spark, SF)
        self.add("items", items)
        self.add("item_outcomes", FD.item_outcomes(items))

    def add(self, name: str, rows) -> None:
        rows.repartition(CPUS).write.parquet(f"{self.root}/{name}")

    def get(self, name: str):
        return self.spark.read.parquet(f"{self.root}/{name}")


def transactions(events, headers):
    return P.transaction_bodies(P.project_transactions(events, headers), P.event_parts(events))


def letters(i: Inputs):
    return DL.current(i.get("letters"), i.get("letter_log"))


def latest_rows(i: Inputs):
    changes = i.get("feed").select(
        "namespace", "entity", F.col("identity")["id"].alias("id"), "operation", "sequence_number", "transport_lsn",
        F.col("new_values")["total_cents"].alias("total_cents"),
    )
    return C.materialize(None, changes, ["namespace", "entity", "id"], lsn_to_number(F.col("transport_lsn")), ["total_cents"])


QUERIES = {
    "project_explicit_id": lambda i: P.project_events(i.get("feed_explicit")),
    "project_hashed_id": lambda i: P.project_events(i.get("feed")),
    "event_bodies": lambda i: P.event_bodies(P.project_events(i.get("feed"))),
    "transactions_explicit_id": lambda i: transactions(P.project_events(i.get("feed_explicit_x4")), i.get("headers_x4")),
    "transactions_hashed_id": lambda i: transactions(P.project_events(i.get("feed_x4")), i.get("headers_x4")),
    "policy_inactive": lambda i: RD.apply_policy(i.get("projected_x4"), config.Policy()),
    "policy_remove": lambda i: RD.apply_policy(i.get("projected_x4"), policy("remove")),
    "policy_mask": lambda i: RD.apply_policy(i.get("projected_x4"), policy("mask")),
    "route_redact_audit": lambda i: RD.redaction_audit(
        RD.redact_for_destinations(R.route_events(i.get("projected"), FD.DESTINATIONS), FD.DESTINATIONS), FD.PROTECTED),
    "route_transactions": lambda i: R.route_transactions(i.get("feed"), FD.DESTINATIONS),
    "ledger_duplicate_check": lambda i: L.undelivered(i.get("pairs"), i.get("ledger"), "work"),
    "ledger_write": lambda i: L.record_delivered(i.get("ledger"), i.get("pairs").select(L.KEY, "destination", "work"), "work"),
    "watermark": lambda i: PG.contiguous_watermark(PG.group_states(PG.attach_outcomes(i.get("items"), i.get("item_outcomes")))),
    "resolve_attempts": lambda i: A.resolve_attempts(i.get("attempts"), FD.DESTINATIONS),
    "replay_plan": lambda i: DL.replay_plan(letters(i).where("status = 'pending'"), FD.DESTINATIONS, i.get("ledger")),
    "metrics_snapshot": lambda i: M.delivery_gauges(letters(i), i.get("ledger"), FD.DESTINATIONS),
    "slot_gauges": lambda i: M.slot_gauges(PR.slot_health(i.get("slots"))),
    "read_payloads": lambda i: read_event_payloads(i.get("payloads")),
    "sign_payload": lambda i: i.get("bodies").select("seq", signing.sign_payload("a-secret", F.col("occurred_at"), F.col("body"))),
    "current_state": latest_rows,
    "receive_attempts": lambda i: C.receive_attempts(i.get("feed").select("seq", F.col("identity")["id"].alias("delivery_key")), "seq"),
}

# What a query counts by, where it is not events.
COUNTED = {
    "ledger_duplicate_check": "pairs", "ledger_write": "pairs", "resolve_attempts": "attempts", "replay_plan": "letters",
    "metrics_snapshot": "letters", "slot_gauges": "slots", "read_payloads": "payloads",
}


def timed(inputs: Inputs, build) -> tuple[float, float]:
    start = time.perf_counter()
    rows = build(inputs)
    built = time.perf_counter()
    rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, built - start


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", CPUS)
    inputs = Inputs(spark)
    seconds, building = {}, {}
    for name in sys.argv[1:] or list(QUERIES):
        timed(inputs, QUERIES[name])
        runs = sorted(timed(inputs, QUERIES[name]) for _ in range(3))
        seconds[name], building[name] = round(runs[1][0], 3), round(runs[1][1], 3)
        print(name, seconds[name], building[name], file=sys.stderr)
    sizes = {name: inputs.get(name).count() for name in ("feed", "pairs", "attempts", "letters", "slots", "payloads")}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), "cores": CPUS, "rows": sizes, "build_seconds": building,
        "rows_per_second": {
            name: round(sizes[COUNTED.get(name, "feed")] * (4 if name.startswith(FOURFOLD) else 1) / value) for name, value in seconds.items()
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
