"""Exact duplicates within a day and across days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import small, stored

KEY = ("customer_id", "content_hash")


def within_day(segments: DataFrame) -> DataFrame:
    """The earliest segment of each (day, customer, hash) by instant; ties go to the smaller id, unreadable times come first.

    A minimum over structs rather than a window: copies are combined where they
    lie, so a text that fills a third of a day is no hot group.
    """
    first = F.min(F.struct(F.col("timestamp").try_cast("timestamp").alias("at"), "segment_id", "timestamp"))
    return segments.groupBy("day", *KEY).agg(first.alias("f"), F.count(F.lit(1)).alias("copies")).select("day", *KEY, "f.segment_id", "f.timestamp", "copies")


def across_days(segments: DataFrame) -> DataFrame:
    """Survivors of their day whose text no earlier day has seen."""
    today = within_day(segments)
    first_day = segments.groupBy(*KEY).agg(F.min("day").alias("first_day"))
    seen = first_day.withColumnRenamed("first_day", "seen_day")
    return today.join(seen, [*(today[k].eqNullSafe(seen[k]) for k in KEY), seen["seen_day"] < today["day"]], "left_anti")


def seen_hashes(segments: DataFrame) -> DataFrame:
    return segments.select(*KEY, "day").distinct()


def previous_turns(turns: DataFrame) -> DataFrame:
    """Each customer turn with the customer's turn before it in the call."""
    w = Window.partitionBy("call_id").orderBy("pos")
    return turns.filter("speaker = 'customer'").withColumn("previous", F.lag("text").over(w))


def without_repeats(rows: DataFrame, *key: str) -> DataFrame:
    """Rows without exact repeats: keys that have several are found by hashes; only their rows are exchanged whole."""
    mark = rows.select(*key, F.xxhash64(*rows.columns).alias("__h"))
    again = mark.groupBy(*key, "__h").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*key).distinct()
    again = small(stored(again.dropna()))
    known, null = rows.dropna(subset=list(key)), rows.filter(reduce(Column.__or__, (F.col(k).isNull() for k in key))).distinct()
    return known.join(again, list(key), "left_anti").unionByName(known.join(again, list(key), "left_semi").distinct()).unionByName(null)
