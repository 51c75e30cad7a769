"""Calls to topic segments, as one fold over the turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that open a new topic; characters after which a segment is closed.
TOPIC_MARKERS = ("another thing", "also", "separately", "one more", "by the way", "different issue", "unrelated", "second problem")
SEGMENT_CHARS = 1200


def transcript(turns: Column, speaker: str | None = None) -> Column:
    """Turns as lines ``speaker: text``."""
    kept = turns if speaker is None else F.filter(turns, lambda t: t["speaker"] == speaker)
    return F.array_join(F.transform(kept, lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), "\n")


def _folded(turns: Column, kind: str) -> Column:
    empty = F.array().cast(kind)
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), empty.alias("open"), F.lit(0).alias("size"))

    def step(acc: Column, t: Column) -> Column:
        marked = F.lit(False)
        for m in TOPIC_MARKERS:
            marked = marked | F.lower(t["text"]).contains(m)
        cut = (t["speaker"] == "customer") & (F.size(acc["open"]) > 0) & marked
        done = F.when(cut, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        grown = F.when(cut, F.array(t)).otherwise(F.concat(acc["open"], F.array(t)))
        # The length goes along, so that no turn is measured twice.
        size = F.when(cut, F.length(t["text"])).otherwise(acc["size"] + F.length(t["text"]))
        full = size > SEGMENT_CHARS
        return F.struct(F.when(full, F.concat(done, F.array(grown))).otherwise(done).alias("done"), F.when(full, empty).otherwise(grown).alias("open"), F.when(full, 0).otherwise(size).alias("size"))

    return F.aggregate(turns, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda g: F.size(g) > 0))


def segment_calls(calls: DataFrame) -> DataFrame:
    """One row per topic segment of each call, with text, speaker mix and attribution.

    A customer turn with a topic marker opens a segment; a segment longer than
    SEGMENT_CHARS is closed. Null turns give no segment; null texts count as empty;
    confidence that is null counts as 1, a segment without customer has 0.
    """
    clean = F.transform("turns", lambda t: F.struct(F.coalesce(t["speaker"], F.lit("")).alias("speaker"), F.coalesce(t["text"], F.lit("")).alias("text"), t["speaker_confidence"].alias("speaker_confidence")))
    kind = "array<struct<speaker: string, text: string, speaker_confidence: double>>"
    groups = calls.withColumn("__t", clean).select("call_id", "customer_id", "timestamp", "region", F.posexplode(_folded(F.col("__t"), kind)).alias("pos", "g"))
    mine = F.filter("g", lambda t: t["speaker"] == "customer")
    speakers = F.array_sort(F.array_distinct(F.transform("g", lambda t: t["speaker"])))
    count = lambda s: F.size(F.filter("g", lambda t: t["speaker"] == s))
    return groups.select(
        F.concat("call_id", F.lit("-S"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("segment_id"),
        "call_id",
        "customer_id",
        "timestamp",
        "region",
        transcript(F.col("g")).alias("text"),
        F.map_from_arrays(speakers, F.transform(speakers, count)).alias("speaker_mix"),
        F.size(mine).alias("customer_turns"),
        F.when(F.size(mine) > 0, F.array_min(F.transform(mine, lambda t: F.coalesce(t["speaker_confidence"], F.lit(1.0))))).otherwise(0.0).alias("attribution_confidence"),
        F.sha1(transcript(F.col("g"))).alias("content_hash"),
    )
