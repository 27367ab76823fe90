"""Structured Streaming around the batch relay.

foreachBatch writes outcomes and then the checkpoint, and Spark commits the source offsets after it
returns, so the durable mark is always written before the source is acknowledged.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from changeflow.operators.preflight import require_ready
from changeflow.plans.relay import Relay


def run_finite(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that is there now, in batches of the source's size, then stop."""
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_relay(
    stream: DataFrame, relay: Relay, interval: str | None = None, verdicts: DataFrame | None = None, slots: DataFrame | None = None, database: str | None = None,
) -> StreamingQuery:
    """Start the relay. With `slots`, their facts as they are now, each is held against where the relay's own checkpoints and the
    configured starts resume; a slot that cannot resume safely stops the start. `verdicts` are those of further checks.

    Without an interval the run is finite; with one it goes on until stopped.
    """
    if verdicts is not None:
        require_ready(verdicts)
    if slots is not None:
        if database is None:
            raise ValueError("slots are checked against the name of their database")
        require_ready(relay.starts(slots, database))
    checkpoint = os.path.join(relay.root, "offsets")
    if interval is None:
        return run_finite(stream, relay.process, checkpoint)
    return (
        stream.writeStream.foreachBatch(relay.process)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval).start()
    )
