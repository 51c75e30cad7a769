"""From issues to what is served: merged issues, their documents, and an index of which only changed parts are made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import retrieval, serving
from voxloom.session import stored
from voxloom.sources import sinks


def publish_issues(issues: DataFrame, products: DataFrame, place: str, signature: str = "hashed-256") -> DataFrame:
    """Merge issues into ``place`` and bring documents and index up to date; gives the documents that changed.

    Run again with the same issues it changes nothing and gives no row.
    """
    spark = issues.sparkSession
    sinks.merge_issues(issues.withColumn("status", F.lit("observed")), f"{place}/issues")
    state = sinks.read_state(spark, f"{place}/issues")
    docs = serving.issue_documents(state).drop("status").join(state.select("product_id", F.concat(F.lit("doc::"), "product_id", F.lit("::"), "issue_key").alias("doc_id"), "status"), ["product_id", "doc_id"])
    docs = stored(docs.unionByName(serving.overview_documents(products)).withColumn("text", F.col("body")))
    index = sinks.load_index(spark, f"{place}/index", signature)
    dirty = docs if index is None else docs.join(retrieval.stale_documents(docs, index, signature).select("doc_id"), "doc_id", "left_semi")
    dirty = stored(dirty)
    hashed = F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    vectors = retrieval.hashed_vectors(dirty.select("doc_id", F.concat_ws(" ", "title", "text").alias("text")))
    sinks.save_index(dirty.select("doc_id", hashed.alias("hash")).join(vectors, "doc_id"), f"{place}/index", signature)
    return dirty.drop("text")
