"""Joins and windows over time spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: A time mark at the start of a text, and the seconds a character above which a call's times are milliseconds.
TIME_MARK = r"^\s*(?:[\[(<]?(?:(\d{1,2}):)?(\d{1,3}):(\d{2})(?:[.,](\d{1,3}))?[\])>]?|[\[(<]?(\d{1,3})m\s?(\d{1,2})s[\])>]?)"
SLOWEST = 5.0


def in_seconds(turns: DataFrame) -> DataFrame:
    """Turns (call_id, id, text, start, ...) that have a time, with ``start`` in seconds; ``text`` is left out.

    The median quotient of times and marks of a call tells its unit. Without marks
    the median pace does: no talk takes SLOWEST seconds a character, and none in
    milliseconds takes less. A call with neither stays as stored.
    """
    part = lambda k: F.regexp_extract("text", TIME_MARK, k).try_cast("double")
    fraction = F.concat(F.lit("0."), F.nullif(F.regexp_extract("text", TIME_MARK, 4), F.lit(""))).try_cast("double")
    clock = F.coalesce(part(1), F.lit(0.0)) * 3600 + part(2) * 60 + part(3) + F.coalesce(fraction, F.lit(0.0))
    mark = F.coalesce(clock, part(5) * 60 + part(6))
    call = Window.partitionBy("call_id")
    rows = turns.filter("start IS NOT NULL AND NOT isnan(start) AND abs(start) < double('Infinity')")
    rows = rows.withColumn("quotient", F.when((mark > 0) & (F.col("start") >= 0), F.col("start") / mark))
    rows = rows.withColumn("pace", (F.lead("start").over(call.orderBy("start", "id")) - F.col("start")) / F.nullif(F.length("text"), F.lit(0)))
    rows = rows.withColumn("quotient", F.median("quotient").over(call)).withColumn("pace", F.median("pace").over(call))
    milli = F.coalesce((F.col("quotient") > 300) & (F.col("quotient") < 3000), F.col("pace") > SLOWEST, F.lit(False))
    return rows.withColumn("start", F.when(milli, F.col("start") / 1000).otherwise(F.col("start"))).drop("quotient", "pace", "text")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: float = 60.0) -> DataFrame:
    """Pairs of spans (id, start, end) of equal ``keys`` that overlap, with the seconds they share.

    Spans are listed under every bucket of ``width`` that they touch and joined on
    bucket and keys; a pair counts in the first bucket both touch, so it comes once.
    """
    buckets = lambda s, e: F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))
    a = left.select(*keys, F.col("id").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end")).filter("a_start < a_end")
    b = right.select(*keys, F.col("id").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end")).filter("b_start < b_end")
    a, b = a.withColumn("bucket", F.explode(buckets("a_start", "a_end"))), b.withColumn("bucket", F.explode(buckets("b_start", "b_end")))
    both = a.join(b, [*keys, "bucket"]).filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    both = both.filter(F.col("bucket") == F.floor(F.greatest("a_start", "b_start") / width))
    return both.select(*keys, "a_id", "b_id", F.round(F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1e-9, 6).alias("shared"))


def speaker_at(points: DataFrame, spans: DataFrame, keys: list[str], width: float = 60.0) -> DataFrame:
    """(keys, id, speaker) of points (id, at): the first span (start, end, speaker) that holds each; points in none are left out."""
    p = points.select(*keys, "id", "at", F.floor(F.col("at") / width).alias("bucket"))
    s = spans.select(*keys, "start", "end", "speaker").filter("start < end").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    held = p.join(s, [*keys, "bucket"]).filter((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end")))
    return held.groupBy(*keys, "id").agg(F.min(F.struct("start", "end", "speaker")).alias("s")).select(*keys, "id", "s.speaker")


def smoothed(rows: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Each label replaced by the majority of itself and its neighbours; without one it stays."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    return rows.withColumn("smoothed", F.when(before.isNotNull() & (before == after), before).otherwise(F.col(label)))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events with less than ``gap`` between them."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("value"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts and sums by type in fixed windows."""
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "events", "value")
