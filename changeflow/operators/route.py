"""Which destination gets which work. Destinations are configuration, so routes compile to expressions and
fan-out is an explode of a literal array: nothing is joined or broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.config import Destination, Route
from changeflow.operators.project import PART, part_number
from changeflow.schemas import TXN_KEYS


def _selected(values: tuple[str, ...], column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit(""))).isin(*values)


def route_matches(route: Route) -> Column:
    """Each configured list must hold the lower-cased value; an empty list matches everything."""
    match = F.lit(True)
    for values, column in ((route.schemas, "namespace"), (route.tables, "entity"), (route.operations, "operation")):
        if values:
            match = match & _selected(values, column)
    return match


def fan_out(work: DataFrame, destinations: list[Destination]) -> DataFrame:
    """Every work item for every destination."""
    return work.withColumn("destination", F.explode(F.array(*[F.lit(d.name) for d in destinations])))


def by_destination(destinations: list[Destination], value) -> Column:
    """A per-destination setting as one expression on the `destination` column."""
    result = F.when(F.col("destination") == destinations[0].name, value(destinations[0]))
    for destination in destinations[1:]:
        result = result.when(F.col("destination") == destination.name, value(destination))
    return result


def enabled(destinations: list[Destination]) -> Column:
    return by_destination(destinations, lambda d: F.lit(d.enabled))


def _explode_matches(work: DataFrame, flags: list[tuple[Destination, Column]]) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(flag, F.lit(d.name)) for d, flag in flags]))
    return work.withColumn("destination", F.explode(names))


def route_events(events: DataFrame, destinations: list[Destination]) -> DataFrame:
    """Event unit: one row per event and matching destination."""
    return _explode_matches(events, [(d, route_matches(d.route)) for d in destinations])


def event_matches(events: DataFrame, destinations: list[Destination]) -> DataFrame:
    """One row per event and destination, `matched` when the event fits the destination's route."""
    pairs = F.array(*[
        F.struct(F.lit(d.name).alias("destination"), route_matches(d.route).alias("matched")) for d in destinations
    ])
    return events.select("*", F.inline(pairs))


def transaction_matches(events: DataFrame, destinations: list[Destination]) -> DataFrame:
    """One row per transaction and destination, `matched` when any child matches the destination's route.

    Partial aggregation settles a hot transaction before the shuffle.
    """
    flags = {f"_match_{n}": d for n, d in enumerate(destinations)}
    verdicts = events.groupBy(*TXN_KEYS).agg(
        F.max(part_number()).alias("last_part"),
        F.count(F.lit(1)).alias("event_count"),
        *[F.bool_or(route_matches(d.route)).alias(name) for name, d in flags.items()],
    )
    pairs = F.array(*[F.struct(F.lit(d.name).alias("destination"), F.col(name).alias("matched")) for name, d in flags.items()])
    return verdicts.select(*TXN_KEYS, "last_part", "event_count", F.inline(pairs))


def transaction_verdicts(events: DataFrame, destinations: list[Destination]) -> DataFrame:
    """The (transaction, destination) pairs that take the whole envelope. An empty envelope has no rows
    here, so it matches nothing, even an empty route."""
    return transaction_matches(events, destinations).where("matched").drop("matched")


def route_transactions(events: DataFrame, destinations: list[Destination]) -> DataFrame:
    """All events of every kept envelope, per destination. The verdict is matched per part, so a hot
    transaction is joined on as many keys as it has parts."""
    verdicts = transaction_verdicts(events, destinations).select(*TXN_KEYS, "last_part", "destination")
    spread = verdicts.withColumn(PART, F.explode(F.sequence(F.lit(0), F.col("last_part").cast("bigint"))))
    return events.withColumn(PART, part_number().cast("bigint")).join(spread.drop("last_part"), [*TXN_KEYS, PART]).drop(PART)
