"""What answers are served from: derived documents, listings, questions, and gates on statements and destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.text import contains_secret
from voxloom.operators.catalog import resolve_products

#: Questions that count; what a statement must begin with and must not hold; sentences of provenance; certainty of a product in a question.
COUNTING = r"(?i)\b(how many|count|number of|total|top \d+|most reported|how much)\b"
SELECT_ONLY = r"(?is)^\s*select\b"
CHANGES = r"(?is)\b(insert|update|delete|drop|alter|truncate|create|attach|pragma|vacuum)\b"
PROVENANCE = ("reported by", "severity ", "status ", "first seen", "last seen")
NAMED = 0.85
#: Private, loopback and link-local addresses of IPv4 and IPv6.
INSIDE = r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)[\d.]+$|^\[?(?:::1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]?$"


def overview_documents(products: DataFrame) -> DataFrame:
    """(doc_id, product_id, title, body, source, status): one document for each product of the catalog."""
    said = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    body = F.concat("canonical_name", F.lit(" is part of the "), "family", F.lit(" line. Supported firmware versions: "), said(F.col("versions")), F.lit(". Known aliases used by customers: "), said(F.col("aliases")), F.lit("."))
    return products.select(F.concat(F.lit("doc::"), "product_id", F.lit("::overview")).alias("doc_id"), "product_id", F.concat("canonical_name", F.lit(" - product overview")).alias("title"), body.alias("body"), F.lit("product_doc").alias("source"), F.lit("published").alias("status"))


def issue_documents(issues: DataFrame, status: str = "observed") -> DataFrame:
    """The same columns for each corroborated issue; times are written in UTC."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    versions = F.coalesce(F.nullif(F.array_join("versions", ", "), F.lit("")), F.lit("unspecified"))
    body = F.concat_ws(
        "", "summary", F.lit(". Reported by "), F.col("distinct_customers").cast("string"), F.lit(" distinct customers across "), F.array_join("regions", ", "), F.lit(" on versions "), versions,
        F.lit(". Severity "), "severity", F.lit(f". Status {status}. First seen "), at("first_seen"), F.lit(", last seen "), at("last_seen"), F.lit("."),
    )
    title = F.concat("product_id", F.lit(" "), F.initcap(F.replace("issue_key", F.lit("_"), F.lit(" "))))
    return issues.select(F.concat(F.lit("doc::"), "product_id", F.lit("::"), "issue_key").alias("doc_id"), "product_id", title.alias("title"), body.alias("body"), F.lit("validated_issue").alias("source"), F.lit(status).alias("status"))


def claim_view(title: Column, body: Column, size: int = 400) -> Column:
    """What a document claims: its sentences without those that say where they come from."""
    low = lambda s: F.lower(s)
    told = lambda s: F.exists(F.array(*map(F.lit, PROVENANCE)), lambda p: F.startswith(low(s), p))
    parts = F.filter(F.transform(F.split(body, r"\. "), lambda s: F.trim(s)), lambda s: (s != "") & ~told(s))
    return F.substring(F.concat(title, F.lit(". "), F.array_join(parts, ". ")), 1, size)


def is_counting(question: Column) -> Column:
    return F.coalesce(question.rlike(COUNTING), F.lit(False))


def is_read_only(statement: Column) -> Column:
    """Whether a statement is one SELECT and changes nothing."""
    body = F.substring(F.trim(statement), F.lit(1), F.greatest(F.length(F.trim(statement)) - 1, F.lit(0)))
    return F.coalesce(statement.rlike(SELECT_ONLY) & ~statement.rlike(CHANGES) & ~body.contains(";"), F.lit(False))


def host_of(url: Column) -> Column:
    """The host of an address with or without a scheme, in lower case; empty if there is none."""
    whole = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.lower(F.coalesce(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@\[\]]*)", 1), F.lit("")))


def egress_decision(url: Column, payload: Column, allowed: tuple[str, ...]) -> Column:
    """Why a destination is refused, or ``allowed``; the first reason counts."""
    host = host_of(url)
    listed = F.lit(False)
    for a in allowed:
        listed = listed | (host == a) | host.endswith("." + a)
    return F.when(host == "", "unparseable").when(host.rlike(INSIDE), "private address").when(~listed, "not in allowlist").when(contains_secret(payload), "secret in payload").otherwise("allowed")


def funnel_cap(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """At most ``most`` rows in the order of a column: a spending limit, not a sample."""
    return rows if most is None else rows.orderBy(order).limit(most)


def top_issues(issues: DataFrame, n: int = 10, by: str = "distinct_customers") -> DataFrame:
    """The ``n`` issues with the most customers or mentions; ties by product and issue."""
    return issues.orderBy(F.desc(by), "product_id", "issue_key").limit(n)


def status_listing(issues: DataFrame, decided: DataFrame) -> DataFrame:
    """Issues with the status that ``decided`` (product_id, issue_key, status) gives them, ``observed`` where it gives none."""
    named = issues.join(decided, ["product_id", "issue_key"], "left")
    return named.select("product_id", "issue_key", "severity", F.coalesce("status", F.lit("observed")).alias("status"), F.col("distinct_customers").alias("customers"), "mentions")


def routing_accuracy(questions: DataFrame, found: DataFrame) -> DataFrame:
    """One row of (query_id, query, route, answerable): questions routed as expected, and unanswerable ones for which the search, rightly, found nothing.

    ``route`` is sql or rag; ``found`` has query_id for every hit of the search.
    """
    took = F.when(is_counting(F.col("query")), "sql").otherwise("rag")
    hit = found.select("query_id").distinct().withColumn("hit", F.lit(True))
    rows = questions.join(hit, "query_id", "left")
    open_ = ~F.coalesce("answerable", F.lit(True))
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.count_if(took == F.col("route")).alias("routed"), F.count_if(open_).alias("unanswerable"), F.count_if(open_ & F.col("hit").isNull()).alias("abstained"))


def asked_issues(questions: DataFrame, issues: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, product_id, issue_key, customers, mentions, place): answers to counting questions (query_id, query) from the issues.

    A product that the question surely names and the issue with most of its words
    narrow the answer; customers order it where the question speaks of them or of
    reports, mentions otherwise.
    """
    named = resolve_products(questions.toDF("key", "text"), products).filter(F.col("confidence") >= NAMED).select(F.col("key").alias("query_id"), F.col("product_id").alias("asked_product"))
    words = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"[a-z]{4,}"), F.lit(0)))).alias("word"))
    parts = issues.select("issue_key").distinct().select("issue_key", F.explode(F.array_distinct(F.split(F.lower("issue_key"), "_"))).alias("word")).filter("length(word) >= 4")
    shared = words.join(parts, "word").groupBy("query_id", "issue_key").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("query_id").agg(F.min_by("issue_key", F.struct(-F.col("n"), F.col("issue_key"))).alias("asked_issue"))
    asked = questions.select("query_id", F.col("query").rlike(r"(?i)\bcustomer|report").alias("by_customers")).join(named, "query_id", "left").join(best, "query_id", "left")
    rows = issues.select("product_id", "issue_key", F.col("distinct_customers").alias("customers"), "mentions")
    # Three equality joins, one for each way a question can be narrowed; questions that name nothing share one list.
    both = asked.filter("asked_product IS NOT NULL AND asked_issue IS NOT NULL").join(rows, (F.col("asked_product") == F.col("product_id")) & (F.col("asked_issue") == F.col("issue_key")))
    product = asked.filter("asked_product IS NOT NULL AND asked_issue IS NULL").join(rows, F.col("asked_product") == F.col("product_id"))
    issue = asked.filter("asked_product IS NULL AND asked_issue IS NOT NULL").join(rows, F.col("asked_issue") == F.col("issue_key"))
    score = F.when(F.col("by_customers"), F.col("customers")).otherwise(F.col("mentions"))
    tops = [rows.orderBy(F.desc(by), "product_id", "issue_key").limit(n).withColumn("by_customers", F.lit(by == "customers")) for by in ("customers", "mentions")]
    general = asked.filter("asked_product IS NULL AND asked_issue IS NULL").join(tops[0].unionByName(tops[1]), "by_customers")
    every = both.unionByName(product).unionByName(issue).unionByName(general)
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc(score), "product_id", "issue_key")
    return every.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("query_id", "product_id", "issue_key", "customers", "mentions", "place")


def query(spark: SparkSession, statement: str, args: list | dict | None = None) -> DataFrame:
    """A parameterised statement over the session's views; anything but one SELECT is refused."""
    gate = spark.range(1).select(is_read_only(F.lit(statement)).alias("ok")).first()
    if not gate["ok"]:
        raise PermissionError("only a single read-only SELECT is permitted")
    return spark.sql(statement, args=args)


def ask(spark: SparkSession, question: str, issues: DataFrame, docs: DataFrame, products: DataFrame) -> tuple[str, DataFrame]:
    """(route, rows) of one question: counts from the issues, everything else from the documents."""
    from voxloom.operators.retrieval import hybrid_search

    one = spark.createDataFrame([("q", question)], "query_id string, query string")
    if one.select(is_counting(F.col("query")).alias("c")).first()["c"]:
        return "sql", asked_issues(one, issues, products)
    return "rag", hybrid_search(docs, one, products)
