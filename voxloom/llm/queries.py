"""Queries of the text operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm import history, leaks, mapping, pii, quality, splitting, tokenizing, turns
from voxloom.operators.dedupe import without_repeats
from voxloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    columns = ["segment_id", "customer_id", "timestamp", "text"]
    found = history.repeated_segments(table(spark, d, "segments", *columns), table(spark, d, "segments_incoming", *columns, "batch_no"))
    pair = F.array_sort(F.array("segment_id", "repeats"))
    return found.select(pair[0].alias("segment_id_a"), pair[1].alias("segment_id_b")).distinct()


def _free_texts(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segments", "segment_id", "text").toDF("rec_id", "text")
    return segments.unionByName(table(spark, d, "evidence", "observation_id", "quote").toDF("rec_id", "text"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    once = without_repeats(_free_texts(spark, d), "rec_id")
    return pii.mentions(once).select("rec_id", F.col("redacted").alias("text"), F.size("found").alias("pii_redactions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.mentions(_free_texts(spark, d)).select("rec_id", F.explode("found").alias("m"))
    return found.select("rec_id", "m.pii_kind", "m.start_at").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_pieces(table(spark, d, "segments", "segment_id", "text"), table(spark, d, "calls", "call_id", "turns"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.oversized_pieces(table(spark, d, "segments", "segment_id", "text"), table(spark, d, "calls", "call_id", "turns"), once=False)
    return pieces.filter("piece_no = 1").select("rec_id", "turn_pos").distinct()


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For each long item what its pieces add up to: its length, and whether they quote it whole, in order, within the limits."""
    items = table(spark, d, "segments", "segment_id", "text").select(F.col("segment_id").alias("rec_id"), F.lit(-1).alias("turn_pos"), "text")
    turns_ = table(spark, d, "calls", "call_id", "turns").select(F.col("call_id").alias("rec_id"), F.posexplode("turns").alias("turn_pos", "t")).select("rec_id", "turn_pos", F.col("t.text").alias("text"))
    long = items.unionByName(turns_).filter(F.length("text") > splitting.LIMIT).distinct()
    pieces = splitting.split_column(long, ["rec_id", "turn_pos", "text"])
    w = Window.partitionBy("rec_id", "turn_pos", F.md5("text")).orderBy("piece_no")
    before = F.lag("end_at").over(w)
    ok = pieces.select(
        "rec_id", "turn_pos", F.md5("text").alias("h"), "piece_no", "end_at",
        (F.substring(F.col("text"), F.col("start_at") + 1, F.col("end_at") - F.col("start_at")) == F.col("piece")).alias("quoted"),
        (F.length("piece") <= splitting.LIMIT).alias("within"),
        F.when(before.isNull(), F.col("start_at") == 0).otherwise((F.col("start_at") < before) & (before - F.col("start_at") <= splitting.OVERLAP) & (F.col("end_at") > before)).alias("joined"),
    )
    return ok.groupBy("rec_id", "turn_pos", "h").agg(F.max("end_at").alias("n_chars"), F.bool_and("quoted").alias("quoted"), F.bool_and("within").alias("within"), F.bool_and("joined").alias("joined")).drop("h").distinct()


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.clean_turns(table(spark, d, "calls", "call_id", "landed_at", "turns"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_turns(spark, d).select("call_id", "turn_no", "speaker")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mapping.map_hints(table(spark, d, "calls", "call_id", "product_hint"), table(spark, d, "product_catalog"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "item_text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).filter(F.col("passage_share") >= leaks.SHARE).select("doc_id", "item_id").distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_quality(table(spark, d, "documents", "doc_id", "text"))


def p10_figures(spark: SparkSession, d: str) -> DataFrame:
    """The plain figures of each document, rounded."""
    figures = ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")
    return p10_statistics(spark, d).select("doc_id", F.col("n_words").cast("long").alias("n_words"), *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in figures)).distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).filter("doc_class <> 'prose'").select("doc_id", "doc_class").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_coverage": p3_coverage,
    "p4_found": p4_found,
    "p4_turns": p4_turns,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_figures": p10_figures,
    "p10_statistics": p10_statistics,
}
