"""Relevance of segments from lexical evidence and from the product they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import customer_lines, injection_signatures, speaker_lines
from voxloom.operators.catalog import resolve_versions

#: Term sets (tested as substrings), openings of small talk, weights and threshold.
PROBLEM_TERMS = (
    *("crash", "crashes", "crashing", "reboot", "reboots", "disconnect", "disconnects", "disconnecting", "drop", "drops", "dropping", "fail", "fails", "failing", "error"),
    *("broken", "bug", "timeout", "times out", "hot", "overheat", "overheating", "slow", "loses", "lost", "stuck", "freeze", "frozen", "wrong", "missing"),
)
REQUEST_TERMS = ("add", "support for", "could you", "feature", "wish", "would like", "request")
SPEC_TERMS = ("spec", "spec sheet", "datasheet", "documentation", "manual", "says", "advertised")
SMALL_TALK = r"^(hi|hello|thanks|thank you|sure|okay|ok|no problem|have a great|good morning)\b"
THRESHOLD = 0.35


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    out = text.contains(terms[0])
    for t in terms[1:]:
        out = out | text.contains(t)
    return out


def with_versions(segments: DataFrame, products: DataFrame) -> DataFrame:
    """Segments with ``version_known``: whether the customer names a version of the product."""
    rows = segments.filter("product_id IS NOT NULL").select(F.col("segment_id").alias("key"), "product_id", customer_lines(F.col("text")).alias("text"))
    known = resolve_versions(rows, products).select(F.col("key").alias("segment_id")).distinct()
    return segments.join(known.withColumn("version_known", F.lit(True)), "segment_id", "left").fillna(False, ["version_known"])


def relevance(segments: DataFrame) -> DataFrame:
    """(segment_id, relevance, signatures, reason) from ``text``, ``product_id``, ``product_confidence``.

    Without customer speech or product the relevance is 0. Where the column
    ``version_known`` is missing no version counts; ``with_versions`` adds it.
    """
    spoken = F.array_join(speaker_lines(F.col("text")), " ")
    low = F.lower(F.trim(spoken))
    version = F.when(F.col("version_known"), 0.15).otherwise(0.0) if "version_known" in segments.columns else F.lit(0.0)
    part = lambda test, w: F.when(test, w).otherwise(0.0)
    raw = 0.45 * F.coalesce("product_confidence", F.lit(0.0)) + part(_any(low, PROBLEM_TERMS), 0.35) + part(_any(low, REQUEST_TERMS), 0.20) + part(_any(low, SPEC_TERMS), 0.15) + version - part(low.rlike(SMALL_TALK), 0.20)
    score = F.when((low == "") | F.col("product_id").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    out = segments.select("segment_id", F.round(score + 1e-9, 6).alias("relevance"), injection_signatures(F.col("text")).alias("signatures"))
    keep, odd = F.col("relevance") >= THRESHOLD, F.size("signatures") > 0
    return out.withColumn("reason", F.when(keep & odd, "both").when(keep, "relevance").when(odd, "injection").otherwise("none"))
