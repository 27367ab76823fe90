"""Destination-scoped removal and masking. Runs after routing and the ledger check, which use canonical values,
so redaction can never change who receives what and skipped work is never redacted."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.config import Destination, Policy, Rule
from changeflow.functions import text as T
from changeflow.operators.route import by_destination, route_matches
from changeflow.schemas import CHANGES

STAMP = "payload_policy"


def _listed(name: Column, columns: tuple[str, ...]) -> Column:
    """Column names are compared exactly."""
    return name.isin(*columns)


def _present(changes: Column) -> Column:
    return F.coalesce(changes, F.array().cast(CHANGES))


def remove_columns(data: Column, identity: Column, changes: Column, columns: tuple[str, ...]) -> tuple[Column, ...]:
    return (
        F.map_filter(data, lambda k, _v: ~_listed(k, columns)),
        F.map_filter(identity, lambda k, _v: ~_listed(k, columns)),
        F.filter(_present(changes), lambda c: ~_listed(c["name"], columns)),
    )


def mask_columns(
    data: Column, identity: Column, changes: Column, columns: tuple[str, ...], replacement: str
) -> tuple[Column, ...]:
    """NULL values stay NULL. The mask is stored as a JSON string literal, as every row value is."""
    mask = F.lit(json.dumps(replacement, ensure_ascii=False))

    def masked(values: Column) -> Column:
        return F.transform_values(values, lambda k, v: F.when(_listed(k, columns) & v.isNotNull(), mask).otherwise(v))

    def masked_change(change: Column) -> Column:
        hit = _listed(change["name"], columns)
        return F.struct(
            change["name"].alias("name"),
            F.when(hit & change["old_value"].isNotNull(), mask).otherwise(change["old_value"]).alias("old_value"),
            F.when(hit & change["new_value"].isNotNull(), mask).otherwise(change["new_value"]).alias("new_value"),
        )

    return masked(data), masked(identity), F.transform(_present(changes), masked_change)


def _apply_rule(rule: Rule, data: Column, identity: Column, changes: Column) -> tuple[Column, ...]:
    if rule.action == "remove":
        return remove_columns(data, identity, changes, rule.columns)
    return mask_columns(data, identity, changes, rule.columns, rule.replacement)


def apply_policy(events: DataFrame, policy: Policy, when: Column | None = None) -> DataFrame:
    """Rules in order, each seeing the result of the one before. No rules: the rows come back untouched."""
    for rule in policy.rules:
        match = route_matches(rule.selector)
        if when is not None:
            match = when & match
        before = [F.col("data"), F.col("identity"), F.col("changes")]
        after = _apply_rule(rule, *before)
        events = events.withColumns({
            name: F.when(match, new).otherwise(old)
            for name, new, old in zip(("data", "identity", "changes"), after, before, strict=True)
        })
    return events


def stamp(fingerprint: str, metadata: Column | None = None, key: str = STAMP) -> Column:
    """Metadata of the outer payload with the fingerprint; missing metadata becomes an object."""
    values = F.col("metadata") if metadata is None else metadata
    return T.put(values, key, F.lit(json.dumps({"fingerprint": fingerprint}, separators=(",", ":"))))


def stamp_policy(payloads: DataFrame, policy: Policy, key: str = STAMP) -> DataFrame:
    return payloads.withColumn("metadata", stamp(policy.fingerprint, key=key)) if policy.active else payloads


def redact_for_destinations(pairs: DataFrame, destinations: list[Destination]) -> DataFrame:
    """Each (event, destination) row under its own destination's policy, in one pass."""
    for destination in destinations:
        if destination.policy.active:
            pairs = apply_policy(pairs, destination.policy, F.col("destination") == destination.name)
    return pairs


def stamp_for_destinations(payloads: DataFrame, destinations: list[Destination], key: str = STAMP) -> DataFrame:
    """Every outer payload of a destination with an active policy, even when no rule matched."""
    if not any(d.policy.active for d in destinations):
        return payloads
    return payloads.withColumn("metadata", by_destination(
        destinations,
        lambda d: stamp(d.policy.fingerprint, key=key) if d.policy.active else F.col("metadata"),
    ))


def policy_fingerprint(destinations: list[Destination]) -> Column:
    return by_destination(destinations, lambda d: F.lit(d.policy.fingerprint))


def _open(rule: Rule, number: int, rules: tuple[Rule, ...]) -> Column:
    """Whether a payload that this rule applies to still shows what the rule is there to take away."""
    listed = F.array(*[F.lit(c) for c in rule.columns])
    if rule.action == "remove":
        shown = [F.exists(F.map_keys(field), lambda k: _listed(k, rule.columns)) for field in ("data", "identity")]
        shown.append(F.exists("changes", lambda c: _listed(c["name"], rule.columns)))
    else:
        # A later rule may mask the same column once more.
        masks = [json.dumps(r.replacement, ensure_ascii=False) for r in rules[number:] if r.action == "mask"]

        def unmasked(field: str) -> Column:
            return F.exists(listed, lambda k: ~F.try_element_at(field, k).isin(*masks))

        shown = [unmasked("data"), unmasked("identity")]
        shown.append(F.exists("changes", lambda c: _listed(c["name"], rule.columns) & (
            F.coalesce(~c["old_value"].isin(*masks), F.lit(False)) | F.coalesce(~c["new_value"].isin(*masks), F.lit(False)))))
    return reduce(Column.__or__, (F.coalesce(x, F.lit(False)) for x in shown))


def policy_audit(payloads: DataFrame, destinations: list[Destination]) -> DataFrame:
    """Per destination and rule: the payloads that the rule applies to, and those that are open all the same.

    A removed column must be absent, a masked one absent, NULL or its mask, in the row, the identity and the changes.
    """
    rules = [(d, n, rule) for d in destinations for n, rule in enumerate(d.policy.rules)]
    if not rules:
        return payloads.sparkSession.createDataFrame([], "destination string, rule int, action string, payloads bigint, open_rows bigint")
    sums = []
    for place, (d, n, rule) in enumerate(rules):
        applies = (F.col("destination") == d.name) & route_matches(rule.selector)
        sums += [F.count_if(applies).alias(f"_n{place}"), F.count_if(applies & _open(rule, n, d.policy.rules)).alias(f"_open{place}")]
    lines = [F.struct(
        F.lit(d.name).alias("destination"), F.lit(n).alias("rule"), F.lit(rule.action).alias("action"),
        F.col(f"_n{place}").alias("payloads"), F.col(f"_open{place}").alias("open_rows"),
    ) for place, (d, n, rule) in enumerate(rules)]
    return payloads.agg(*sums).select(F.inline(F.array(*lines)))


def redaction_audit(payloads: DataFrame, protected: tuple[str, ...]) -> DataFrame:
    """Rows per destination in which a protected column still has an open value."""
    opened = F.lit(False)
    for column in protected:
        for field in ("data", "identity"):
            opened = opened | F.coalesce(F.try_element_at(field, F.lit(column)).isNotNull(), F.lit(False))
    named = F.exists("changes", lambda c: c["name"].isin(*protected))
    return payloads.groupBy("destination").agg(
        F.count(F.lit(1)).alias("payloads"),
        F.count_if(opened).alias("open_rows"),
        F.count_if(F.coalesce(named, F.lit(False))).alias("rows_naming_changes"),
    )
