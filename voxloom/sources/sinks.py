"""Idempotent writes to partitioned Parquet tables.

Each sink leaves the table as if the run had happened once. Upserts join old and new
in full and write beside the table; the new state counts from the moment at which its
name is written into the table's pointer file, so a lost executor or driver leaves
either the old or the new state. Days are folders of their own, replaced one at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _paths(spark, path)
    return fs.exists(p)


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a day's new folder in the place of the old; a run that stops in between is repaired by the next, which writes the day anew."""
    fs, p, new_path = _paths(spark, path)
    old = new_path(f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(new_path(fresh), p)
    fs.delete(old, True)


def replace_day(df: DataFrame, path: str, day: str) -> None:
    """The rows of ``day`` become those of ``df`` (without its ``day`` column); an empty frame clears the day."""
    spark = df.sparkSession
    fs, _, new_path = _paths(spark, path)
    fresh = f"{path}/_fresh-{uuid.uuid4().hex}"
    df.drop("day").write.parquet(fresh)
    target = f"{path}/day={day}"
    _swap(spark, fresh, target)
    if spark.read.parquet(target).isEmpty():
        fs.delete(new_path(target), True)


_POINTER = "_current"


def _current(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the state of an upserted table."""
    fs, p, new_path = _paths(spark, f"{path}/{_POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return f"{path}/{name}"


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of an upserted table, or nothing if there is none yet."""
    place = _current(spark, path)
    return None if place is None else spark.read.parquet(place)


def _point(spark: SparkSession, path: str, name: str) -> None:
    """Name the new state: one small file, overwritten in one step; states before the last one are deleted."""
    fs, p, new_path = _paths(spark, f"{path}/{_POINTER}")
    before = _current(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(name.encode()))
    out.close()
    for status in fs.listStatus(new_path(path)):
        place = status.getPath()
        if place.getName().startswith("state-") and place.getName() != name and (before is None or not before.endswith(place.getName())):
            fs.delete(place, True)


def upsert(updates: DataFrame, path: str, keys: list[str], merge: dict[str, Column] | None = None) -> None:
    """Insert or update by ``keys``.

    ``merge`` gives for a column the expression over ``old.c`` and ``new.c`` that an
    update keeps; other columns take the new value. Of updates with equal keys one
    must be chosen before.
    """
    spark = updates.sparkSession
    merge = merge or {}
    fresh = f"state-{uuid.uuid4().hex}"
    rows, old = updates, read_state(spark, path)
    if old is not None:
        old, new = old.withColumn("__o", F.lit(True)).alias("old"), updates.withColumn("__n", F.lit(True)).alias("new")
        on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
        both, fresh_row = F.col("old.__o") & F.col("new.__n"), F.col("new.__n")
        columns = [F.when(both, merge.get(c, F.col(f"new.{c}"))).when(fresh_row, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in updates.columns]
        rows = old.join(new, on, "full_outer").select(*columns)
    rows.write.parquet(f"{path}/{fresh}")
    _point(spark, path, fresh)


def widest(*names: str) -> dict[str, Column]:
    """Merge rules for a span: the first named column keeps the least, the second the greatest."""
    low, high = names
    return {low: F.least(f"old.{low}", f"new.{low}"), high: F.greatest(f"old.{high}", f"new.{high}")}


def kept(*names: str) -> dict[str, Column]:
    """Merge rules for columns that an update must not touch."""
    return {n: F.col(f"old.{n}") for n in names}


def append_metrics(metrics: dict[str, float], path: str, run_id: str, day: str, spark: SparkSession) -> None:
    """One row (run_id, day, metric, value) for each numeric metric; booleans are left out."""
    rows = [(run_id, day, k, float(v)) for k, v in sorted(metrics.items()) if isinstance(v, (int, float)) and not isinstance(v, bool)]
    spark.createDataFrame(rows, "run_id string, day string, metric string, value double").write.mode("append").parquet(path)


def never_demoted(column: str, best: str) -> dict[str, Column]:
    """Merge rule for a status: once it is ``best`` it stays."""
    return {column: F.when(F.col(f"old.{column}") == best, F.lit(best)).otherwise(F.col(f"new.{column}"))}


def merge_issues(issues: DataFrame, path: str) -> None:
    """Issues by product and issue_key: spans only grow, a confirmed status stays."""
    upsert(issues, path, ["product_id", "issue_key"], widest("first_seen", "last_seen") | never_demoted("status", "confirmed"))


def merge_queue(items: DataFrame, path: str) -> None:
    """Review items by product and issue_key: reason and payload are renewed, age and status stay."""
    upsert(items, path, ["product_id", "issue_key"], kept("created_at", "status"))


def evidence_rows(observations: DataFrame, run_id: str) -> DataFrame:
    """The evidence table's projection of observations."""
    columns = ("observation_id", "product_id", "issue_key", "call_id", "segment_id", "customer_id", "region")
    return observations.select(*columns, F.col("evidence").alias("quote"), "confidence", "extractor", F.col("timestamp").alias("observed_at"), F.lit(run_id).alias("run_id"), "day")


def write_evidence(observations: DataFrame, path: str, run_id: str, day: str) -> None:
    replace_day(evidence_rows(observations.filter(F.col("day") == day), run_id), path, day)


#: Events that the audit table takes.
AUDITED = ("policy_decision", "tool_executed", "run_started", "run_finished", "publish", "review_enqueued", "injection_detected")


def append_audit(events: DataFrame, path: str) -> None:
    """Whitelisted events (ts, event, ...) appended by day of ``ts``."""
    events.filter(F.col("event").isin(*AUDITED)).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def append_labels(labels: DataFrame, path: str) -> None:
    """Judgements as JSON lines; nothing is ever changed."""
    labels.write.mode("append").json(path)


def label_export(labels: DataFrame) -> DataFrame:
    """(item_id, value) of labels (item_id, annotator, value) that nobody contests."""
    of = labels.groupBy("item_id").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    return of.filter("n = 1").select("item_id", "value")


def create_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table of the declared schema, unless there is one."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)


def save_index(docs: DataFrame, path: str, signature: str) -> None:
    """Index rows (doc_id, hash, vec, ...) by doc_id under the signature of their vector space; changed documents replace their old rows."""
    upsert(docs.withColumn("signature", F.lit(signature)), path, ["doc_id"])


def load_index(spark: SparkSession, path: str, signature: str) -> DataFrame | None:
    """The index, of which rows of another vector space count as absent."""
    state = read_state(spark, path)
    return None if state is None else state.filter(F.col("signature") == signature)


def evolve(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the declared columns in their order: missing ones null, extra ones after them."""
    declared = df.sparkSession.createDataFrame([], schema).schema
    have = {f.name: f.dataType for f in df.schema}
    columns = [(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in declared]
    names = {f.name for f in declared}
    return df.select(*columns, *[F.col(f"`{c}`") for c in df.columns if c not in names])
