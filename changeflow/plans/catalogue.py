"""All checked queries; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changeflow.operators import redact as RD
from changeflow.operators import route as R
from changeflow.plans import checks_delivery, checks_ingest, checks_payload, checks_reports  # noqa: F401
from changeflow.plans import feed as FD
from changeflow.plans.registry import ANSWERS, QUERIES

__all__ = ["ANSWERS", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Project, route, redact and audit the whole feed per destination and rule."""
    routed = R.route_events(FD.projected(spark, sf), FD.DESTINATIONS)
    return RD.policy_audit(RD.redact_for_destinations(routed, FD.DESTINATIONS), FD.DESTINATIONS)
