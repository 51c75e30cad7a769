"""Structured observations from what customers say, by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.text import injection_risk, sentence_around, speaker_lines
from voxloom.operators.catalog import VERSION_PATTERN, resolve_products, resolve_versions

#: Fixed values: (issue, type, severity, summary, pattern) in order; the first that fits an utterance counts.
ISSUE_PATTERNS = (
    ("VPN_DISCONNECT", "bug_report", "high", "VPN tunnel disconnects intermittently", r"(?i)vpn.{0,40}(disconnect|drop|tunnel drops)|tunnel.{0,20}drop"),
    ("SPONTANEOUS_REBOOT", "bug_report", "critical", "Device reboots without operator action", r"(?i)(reboot|restart)s? (on its own|by itself|randomly|at night|spontaneously)"),
    ("ROUTE_LOSS", "bug_report", "high", "Static routes lost across power cycle", r"(?i)(lose|loses|losing|lost).{0,30}(static )?routes?"),
    ("EXPORT_TIMEOUT", "bug_report", "medium", "Report export times out", r"(?i)(times? out|timeout).{0,40}(export|report)|export.{0,30}times? out"),
    ("OVERHEATING", "bug_report", "high", "Device runs abnormally hot", r"(?i)(overheat\w*|runs (extremely |very )?hot|too hot to touch)"),
    ("BULK_EXPORT", "feature_request", "low", "Bulk CSV export requested", r"(?i)(bulk|batch).{0,20}(csv )?export|export.{0,20}in bulk"),
    ("SFP_PORT_COUNT", "spec_correction", "medium", "Shipped SFP port count differs from spec", r"(?i)spec.{0,40}(port|sfp)|(sfp|port).{0,30}spec sheet"),
    ("STABILITY_PRAISE", "praise", "low", "Customer reports the release is stable", r"(?i)(rock solid|has been (great|solid|stable)|no issues since)"),
)
FIX_CLAIM = r"(?i)\b(fixed|resolved|solved|cleared up|no longer)\b"


def _pick(text: Column, field: int) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for p in ISSUE_PATTERNS:
        out = out.when(text.rlike(p[4]), p[field])
    return out


def _sentence(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for p in ISSUE_PATTERNS:
        out = out.when(text.rlike(p[4]), sentence_around(text, p[4]))
    return out


def rule_observations(segments: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """At most one observation a segment: the most confident utterance, the earliest of equals.

    Needs ``segment_id``, ``text``, ``product_id``, ``product_confidence`` and
    ``attribution_confidence``; segments without product give none. With ``products``
    the product is the one that the same utterance names, and the segment's only where
    it names none. The evidence is the sentence that holds the issue.
    """
    said = segments.filter("product_id IS NOT NULL").select("segment_id", "product_id", "product_confidence", "attribution_confidence", F.posexplode(speaker_lines(F.col("text"))).alias("pos", "said"))
    t = F.col("said")
    found = said.withColumn("issue_key", _pick(t, 0)).filter("issue_key IS NOT NULL")
    if products is not None:
        found = found.withColumn("key", F.concat_ws("#", "segment_id", "pos"))
        own = resolve_products(found.select("key", t.alias("text")), products).toDF("key", "own_id", "own_confidence")
        found = found.join(own, "key", "left").withColumns({"product_id": F.coalesce("own_id", "product_id"), "product_confidence": F.when(F.col("own_id").isNotNull(), F.col("own_confidence")).otherwise(F.col("product_confidence"))})
    fixed = t.rlike(FIX_CLAIM)
    base = F.round(F.least(F.lit(0.97), 0.55 + 0.4 * F.coalesce("product_confidence", F.lit(0.0))), 3)
    rows = found.select(
        "segment_id", "product_id", "pos", "issue_key",
        F.when(fixed & (_pick(t, 1) == "bug_report"), "praise").otherwise(_pick(t, 1)).alias("type"),
        F.when(fixed, "low").otherwise(_pick(t, 2)).alias("severity"),
        F.when(fixed, F.concat(F.lit("RESOLVED CLAIM: "), _pick(t, 3))).otherwise(_pick(t, 3)).alias("summary"),
        F.round(base * (1 - injection_risk(t)) * F.coalesce("attribution_confidence", F.lit(1.0)) + 1e-9, 3).alias("confidence"),
        F.substring(_sentence(t), 1, 400).alias("evidence"),
        F.nullif(F.regexp_extract(t, VERSION_PATTERN, 1), F.lit("")).alias("said_version"),
    )
    best = rows.groupBy("segment_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("segment_id", "pos")]), F.struct("confidence", -F.col("pos"))).alias("b"))
    observation = F.concat(F.lit("O"), F.substring(F.sha1(F.concat_ws(":", "segment_id", "b.issue_key")), 1, 14))
    out = best.select(observation.alias("observation_id"), "segment_id", "b.*")
    if products is None:
        return out.drop("said_version")
    known = resolve_versions(out.select(F.col("observation_id").alias("key"), "product_id", F.col("said_version").alias("text")), products).select(F.col("key").alias("observation_id"), F.col("version").alias("product_version"))
    return out.drop("said_version").join(known, "observation_id", "left")


#: Name of an issue that the vocabulary lacks, and the prefix of its proposed name.
NEW_ISSUE, NEW_PREFIX = "NEW_ISSUE", "NEW__"


def normalised_payloads(payloads: DataFrame, products: DataFrame) -> DataFrame:
    """Observations from JSON payloads (segment_id, payload, product_id, attribution_confidence) of an outside extractor.

    Issue names become upper case with underscores, at most 60 signs; a new issue gets
    the proposed label behind NEW_PREFIX; a product that the catalog lacks gives way to
    the segment's. Unreadable payloads and those without a signal give no row.
    """
    schema = "is_product_signal boolean, product_id string, product_version string, type string, issue_key string, new_issue_label string, summary string, severity string, evidence string, confidence double"
    p = payloads.withColumn("p", F.from_json("payload", schema)).filter("p.is_product_signal")
    plain = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9_]", "_")
    named = F.substring(plain(F.coalesce("p.issue_key", F.lit(""))), 1, 60)
    fresh = F.substring(F.concat(F.lit(NEW_PREFIX), plain(F.coalesce(F.nullif(F.col("p.new_issue_label"), F.lit("")), F.lit("UNLABELLED")))), 1, 60)
    key = F.when(named == NEW_ISSUE, fresh).otherwise(named)
    known = products.select(F.col("product_id").alias("known_id")).distinct()
    return p.join(known, F.col("p.product_id") == F.col("known_id"), "left").select(
        F.concat(F.lit("O"), F.substring(F.sha1(F.concat_ws(":", "segment_id", key)), 1, 14)).alias("observation_id"),
        "segment_id",
        F.coalesce("known_id", "product_id", F.lit("")).alias("product_id"),
        F.col("p.product_version").alias("product_version"),
        F.coalesce("p.type", F.lit("")).alias("type"),
        key.alias("issue_key"),
        F.substring(F.coalesce("p.summary", F.lit("")), 1, 200).alias("summary"),
        F.coalesce("p.severity", F.lit("")).alias("severity"),
        F.substring(F.coalesce("p.evidence", F.lit("")), 1, 400).alias("evidence"),
        F.round(F.coalesce("p.confidence", F.lit(0.0)) * F.coalesce("attribution_confidence", F.lit(1.0)) + 1e-9, 6).alias("confidence"),
    )


def known_issue_keys(spark: SparkSession, issues: DataFrame) -> DataFrame:
    """(issue_key): the vocabulary, from the rules and what is stored, and NEW_ISSUE."""
    own = spark.createDataFrame([(p[0],) for p in ISSUE_PATTERNS] + [(NEW_ISSUE,)], "issue_key string")
    return own.unionByName(issues.select("issue_key").filter("issue_key IS NOT NULL")).distinct()


#: What an observation may hold.
TYPES = ("bug_report", "feature_request", "usage_question", "spec_correction", "praise")
SEVERITIES = ("low", "medium", "high", "critical")


def schema_errors(observations: DataFrame) -> DataFrame:
    """Each observation with the list of rules that it breaks; an empty list passes the gate."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "type": F.col("type").isin(*TYPES),
        "severity": F.col("severity").isin(*SEVERITIES),
        "confidence": F.col("confidence").between(0, 1),
        "product_id": F.col("product_id").rlike(r"^[A-Z0-9_\-]{2,40}$"),
        "issue_key": F.col("issue_key").rlike(r"^[A-Z0-9_]{3,60}$"),
        "evidence": F.length("evidence") <= 400,
        "speaker": F.col("speaker") == "customer",
        "attribution_confidence": F.coalesce("attribution_confidence", F.lit(1.0)).between(0, 1),
    }
    return observations.withColumn("errors", F.array_compact(F.array(*(F.when(~ok(test), F.lit(name)) for name, test in rules.items()))))
