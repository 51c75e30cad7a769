"""Structured Streaming forms of the daily stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from voxloom.operators.segmentation import segment_calls
from voxloom.sources.calls import CALL
from voxloom.sources.sinks import exists


def call_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Calls from JSON files as they land."""
    return spark.readStream.schema(CALL).option("maxFilesPerTrigger", files_per_batch).json(folder)


def segment_stream(calls: DataFrame, late: str = "2 days") -> DataFrame:
    """Segments, each text of a customer once within the watermark: state stays bounded."""
    rows = segment_calls(calls).withColumn("at", F.col("timestamp").try_cast("timestamp"))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["customer_id", "content_hash"])


def _instants(events: DataFrame) -> DataFrame:
    """Watermarks need instants: times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by type in fixed windows; rows later than the watermark are dropped."""
    rows = _instants(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select("window.start", "window.end", "event_type", "events", "value")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = _instants(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("events")).select("user_id", "w.start", "w.end", "events")


def distinct_customers(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and different users by type in fixed windows, exactly: a user counts by the first event of a window, later ones are dropped in state."""
    rows = _instants(events).withWatermark("ts", late).withColumn("w", F.window("ts", width))
    first = rows.dropDuplicates(["w", "event_type", "user_id"])
    return first.groupBy("w", "event_type").agg(F.count(F.lit(1)).alias("users")).select("w.start", "w.end", "event_type", "users")


STATE = "last timestamp, calls long"


def repeat_callers(events: DataFrame, quiet: str = "30 minutes") -> DataFrame:
    """(user_id, ts, calls) of events that come at least ``quiet`` after the user's last one that was let through.

    State for each user is one row: when the last event was let through and how many came since.
    """
    pause = pd.Timedelta(quiet)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, calls = state.get if state.exists else (None, 0)
        out = []
        times = sorted(t for f in frames for t in f["ts"] if not pd.isna(t))
        for t in times:
            calls += 1
            if last is None or t - pd.Timestamp(last) >= pause:
                out.append((key[0], t, calls))
                last, calls = t, 0
        state.update((pd.Timestamp(last).to_pydatetime() if last is not None else None, calls))
        yield pd.DataFrame(out, columns=["user_id", "ts", "calls"])

    kind = events.schema["user_id"].dataType.simpleString()
    return _instants(events).groupBy("user_id").applyInPandasWithState(step, f"user_id {kind}, ts timestamp, calls long", STATE, "append", "NoTimeout")


def once(sink: Callable[[DataFrame], None], spark: SparkSession, marks: str) -> Callable[[DataFrame, int], None]:
    """A sink that takes each batch number once: the number is marked when the batch is written, and a batch that comes again is skipped."""

    def take(df: DataFrame, number: int) -> None:
        mark = f"{marks}/batch={number}"
        if not exists(spark, mark):
            sink(df)
            spark.range(1).write.mode("overwrite").parquet(mark)

    return take


def late_rows(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """What a watermark has dropped, for the next day's run: rows whose keys no earlier day has seen."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the sink must be idempotent by batch number."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
