"""One day from raw calls to corroborated issues, over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import catalog, dedupe, extraction, issues, routing, segmentation
from voxloom.session import stored


def daily_observations(calls: DataFrame, products: DataFrame, day: str) -> DataFrame:
    """Observations of the calls of ``day``: segments, products by the customer's words or the hint, relevance, extraction.

    Stage borders that are read twice are stored; everything else is one plan.
    """
    once = calls.dropDuplicates(["call_id"])
    segments = segmentation.segment_calls(once).withColumn("day", F.lit(day))
    first = dedupe.within_day(segments).select("segment_id")
    hints = once.select("call_id", "product_hint")
    segments = stored(segments.join(first, "segment_id", "left_semi").join(hints, "call_id", "left"))
    named = catalog.identify_products(segments, products, fuzzy=True)
    whole = stored(routing.with_versions(segments.drop("product_hint").join(named, "segment_id"), products))
    kept = routing.relevance(whole).filter("reason IN ('relevance', 'both')").select("segment_id")
    found = extraction.rule_observations(whole.join(kept, "segment_id", "left_semi"), products)
    return found.join(whole.select("segment_id", "call_id", "customer_id", "region", "timestamp", "attribution_confidence"), "segment_id")


def check_run(calls: int, segments: int) -> None:
    """Refuse a day on which calls came in and nothing came out."""
    if calls and not segments:
        raise ValueError(f"{calls} calls gave no segment")


def daily_issues(calls: DataFrame, products: DataFrame, day: str) -> DataFrame:
    """Corroborated issues of the calls of ``day``."""
    return issues.issue_aggregate(daily_observations(calls, products, day))
