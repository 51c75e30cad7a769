"""Products, issues, versions and regions as a graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut


def edges(observations: DataFrame) -> DataFrame:
    """Distinct typed edges (src, dst, kind): product HAS issue, issue SEEN_IN version, issue SEEN_FROM region."""
    issue = F.concat(F.lit("issue:"), F.col("product_id"), F.lit("/"), F.col("issue_key"))
    each = [
        F.struct(F.concat(F.lit("product:"), F.col("product_id")).alias("src"), issue.alias("dst"), F.lit("has").alias("kind")),
        F.struct(issue.alias("src"), F.concat(F.lit("version:"), F.col("product_version")).alias("dst"), F.lit("seen_in").alias("kind")),
        F.struct(issue.alias("src"), F.concat(F.lit("region:"), F.col("region")).alias("dst"), F.lit("seen_from").alias("kind")),
    ]
    keys = observations.select("product_id", "issue_key", "product_version", "region").distinct()
    return keys.select(F.explode(F.array(*each)).alias("e")).select("e.*").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def degree_by_kind(graph: DataFrame) -> DataFrame:
    nodes = graph.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.groupBy(F.substring_index("node", ":", 1).alias("node_kind")).agg(F.count(F.lit(1)).alias("nodes"))


def shared_modes(observations: DataFrame) -> DataFrame:
    """Issue keys that more than one product has."""
    out = observations.groupBy("issue_key").agg(F.count_distinct("product_id").alias("products"), F.sort_array(F.collect_set("product_id")).alias("product_ids"))
    return out.filter("products > 1")


def blast_radius(graph: DataFrame, node_kind: str) -> DataFrame:
    """For each node of a kind, how many products reach it over issues."""
    leaf = graph.filter(F.col("dst").startswith(f"{node_kind}:")).select(F.col("dst").alias("node"), F.col("src").alias("issue"))
    owner = graph.filter("kind = 'has'").select(F.col("dst").alias("issue"), F.col("src").alias("product"))
    return leaf.join(owner, "issue").groupBy("node").agg(F.count_distinct("product").alias("products"), F.count_distinct("issue").alias("issues"))


def hops_from(graph: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """(node, hops): nodes within ``most`` undirected steps, or all that are reached; each round joins the frontier only."""
    both = cut(graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = cut(both.select(F.col("src").alias("node")).filter(F.col("node") == start).distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for k in count(1) if most is None else range(1, most + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def shortest_path(graph: DataFrame, start: str, end: str) -> list[str]:
    """The nodes of a shortest undirected path, the smallest names of equals; empty if there is none."""
    seen = hops_from(graph, start)
    both = graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = seen.filter(F.col("node") == end).first()
    if found is None:
        return []
    path = [end]
    for k in range(found["hops"] - 1, -1, -1):
        before = both.filter(F.col("dst") == path[-1]).join(seen.filter(F.col("hops") == k), F.col("src") == F.col("node"))
        path.append(before.agg(F.min("node")).first()[0])
    return path[::-1]
