"""Core queries, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.operators import catalog, dedupe, drift, evaluation, extraction, graph, intervals, issues, retrieval, routing, sampling, segmentation, serving, skew
from voxloom.oracles import ORACLES
from voxloom.plans import daily
from voxloom.session import cut, scratch, small, stored
from voxloom.sources import calls as raw_calls
from voxloom.sources import sinks
from voxloom.sources.tables import table
from voxloom.streaming import stages

#: Names that a renamed field goes back to.
SEGMENT_FIELDS = (
    *("segment_id", "call_id", "customer_id", "timestamp", "region", "centre", "channel", "product_hint", "trust", "product_confidence", "relevance"),
    *("pii_redactions", "content_hash", "route_reason", "injection_signatures", "customer_turns", "desk_no"),
    *("turns.speaker", "turns.text", "turns.start_time", "turns.speaker_confidence", "turns.lang"),
)
KEYS = ["product_id", "issue_key"]


def _deliveries(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The calls as delivered, exact repeats aside."""
    return dedupe.without_repeats(table(spark, d, "calls", "call_id", *columns, "turns"), "call_id")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "observations", *KEYS, "customer_id", "timestamp", "confidence")
    return skew.skewed_key_profile(rows, KEYS, distinct_col="customer_id", time_col="timestamp", mean_col="confidence")


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    named = _profile(spark, d).withColumnsRenamed({"n_distinct": "customers", "mean_value": "mean_confidence"})
    return named.withColumn("mean_confidence", F.round(F.col("mean_confidence") + 1e-9, 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "observations", "product_id").count()
    return skew.heavy_keys(_profile(spark, d), total).select(*KEYS)


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_feed", "feed_name", "file_no", "line_no", "payload")


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.file_changes(drift.file_headers(_feed(spark, d)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_changes(spark, d).select("feed_name", "file_no", "change_kind", "field_path", "new_path").distinct()


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    headers = cut(drift.file_headers(_feed(spark, d)))
    names, types = drift.union_schema(headers, drift.file_changes(headers), SEGMENT_FIELDS)
    return drift.consistent_table(_feed(spark, d), names, types)


def p5_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return drift.quarantine(_feed(spark, d))


def issue_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return issues.issue_aggregate(table(spark, d, "observations"))


def issue_evidence(spark: SparkSession, d: str) -> DataFrame:
    return issues.issue_evidence(table(spark, d, "observations", *KEYS, "observation_id"))


def candidates_with_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = issues.issue_aggregate(table(spark, d, "observations")).select(*KEYS, "mentions")
    return issues.candidates_with_evidence(found, table(spark, d, "evidence"))


def corroboration_report(spark: SparkSession, d: str) -> DataFrame:
    return issues.corroboration_report(table(spark, d, "observations", *KEYS, "customer_id"))


def issue_rollup(spark: SparkSession, d: str) -> DataFrame:
    return issues.issue_rollup(table(spark, d, "observations", *KEYS, "customer_id"))


def evidence_top(spark: SparkSession, d: str) -> DataFrame:
    return issues.evidence_top(table(spark, d, "evidence"))


def dedupe_within_day(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.within_day(table(spark, d, "segments", "day", *dedupe.KEY, "timestamp", "segment_id"))


def dedupe_across_days(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.across_days(table(spark, d, "segments", "day", *dedupe.KEY, "timestamp", "segment_id"))


def seen_hashes(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.seen_hashes(table(spark, d, "segments", "day", *dedupe.KEY))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments", "segment_id", "text").select("segment_id", F.sha1("text").alias("hash")).distinct()


def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "segments", "segment_id", "text")
    return docs.select("segment_id", *(T.dlp_count(F.col("text"), k).alias(k) for k, _, _ in T.DLP_PATTERNS)).distinct()


def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence", "observation_id", "quote").select("observation_id", T.redact_patterns(F.col("quote")).alias("redacted")).distinct()


def secret_predicate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.contains_secret(F.col("text")).alias("has_secret"))


def injection_scan(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "segments", "segment_id", "text").select("segment_id", T.injection_signatures(t).alias("signatures"), T.injection_risk(t).alias("risk")).distinct()


def injection_excerpts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments", "segment_id", "text").select("segment_id", F.explode(T.injection_excerpts(F.col("text"))).alias("x"))
    return rows.select("segment_id", "x.name", "x.excerpt").distinct()


def customer_channel(spark: SparkSession, d: str) -> DataFrame:
    lines = T.speaker_lines(F.col("text"))
    return dedupe.without_repeats(table(spark, d, "segments", "segment_id", "text"), "segment_id").select("segment_id", F.array_join(lines, " ").alias("spoken"), F.size(lines).alias("lines"))


def catalog_unambiguous(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "product_catalog")
    both = catalog.unambiguous(c, "generic_aliases").withColumn("kind", F.lit("generic"))
    return both.unionByName(catalog.unambiguous(c, "versions").withColumn("kind", F.lit("version")))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments", "segment_id", "text").toDF("key", "text")


def product_resolution(spark: SparkSession, d: str) -> DataFrame:
    return catalog.resolve_products(_keyed(spark, d), table(spark, d, "product_catalog"))


def identify_product(spark: SparkSession, d: str) -> DataFrame:
    return catalog.identify_products(table(spark, d, "segments", "segment_id", "text", "product_hint"), table(spark, d, "product_catalog")).distinct()


def product_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    hints = table(spark, d, "calls", "call_id", "product_hint").filter("product_hint <> ''").distinct().toDF("key", "text")
    return catalog.fuzzy_products(hints, table(spark, d, "product_catalog"))


def version_resolution(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments", "segment_id", "product_id", "text").filter("product_id IS NOT NULL").toDF("key", "product_id", "text")
    return catalog.resolve_versions(rows, table(spark, d, "product_catalog")).distinct()


def relevance_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments", "segment_id", "text", "product_id", "product_confidence")
    return routing.relevance(routing.with_versions(rows, table(spark, d, "product_catalog"))).distinct()


def rule_observations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments", "segment_id", "text", "product_id", "product_confidence", "attribution_confidence")
    return extraction.rule_observations(dedupe.without_repeats(rows, "segment_id"), table(spark, d, "product_catalog"))


def schema_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = extraction.schema_errors(table(spark, d, "observations"))
    return rows.select(F.explode_outer("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n_rows"))


def call_transcripts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turns")
    return table(spark, d, "calls", "call_id", "turns").select("call_id", F.md5(segmentation.transcript(t)).alias("whole"), F.md5(segmentation.transcript(t, "customer")).alias("customer"), F.size(t).alias("n_turns")).distinct()


def segment_calls(spark: SparkSession, d: str) -> DataFrame:
    made = segmentation.segment_calls(_deliveries(spark, d, "customer_id", "timestamp", "region"))
    # As text, for maps have no order.
    mix = F.transform(F.array_sort(F.map_entries("speaker_mix")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made.withColumn("speaker_mix", F.array_join(mix, ","))


def turn_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _deliveries(spark, d).select("call_id", F.posexplode("turns").alias("pos", "t")).select("call_id", "pos", F.col("t.speaker").alias("speaker"), F.col("t.text").alias("text"))
    return dedupe.previous_turns(rows).select("call_id", "pos", F.md5("previous").alias("previous"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _deliveries(spark, d).select("call_id", F.posexplode("turns").alias("id", "t"))
    starts = intervals.in_seconds(rows.select("call_id", "id", F.col("t.speaker").alias("speaker"), F.col("t.text").alias("text"), F.col("t.start_time").alias("start")))
    w = Window.partitionBy("call_id").orderBy("start", "id")
    return starts.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("start") + 10.0))


def interval_attribution(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d)
    last = spans.groupBy("call_id").agg(F.max("end").alias("stop"))
    tiles = last.select("call_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("stop") / 20).cast("int"))).alias("id")).select("call_id", "id", (F.col("id") * 20.0).alias("start"), (F.col("id") * 20.0 + 20.0).alias("end"))
    return intervals.overlaps(spans.select("call_id", "id", "start", "end"), tiles, ["call_id"])


def label_smoothing(spark: SparkSession, d: str) -> DataFrame:
    rows = _deliveries(spark, d).select("call_id", F.posexplode("turns").alias("pos", "t")).select("call_id", "pos", F.col("t.speaker").alias("speaker"))
    return intervals.smoothed(rows, ["call_id"], "pos", "speaker").select("call_id", "pos", "smoothed")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return intervals.sessions(table(spark, d, "events", "user_id", "ts", "value"))


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return intervals.tumbling(table(spark, d, "events", "ts", "event_type", "value"))


def metrics_unpivot(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "observations", "day", "input_tokens", "output_tokens").groupBy("day").agg(F.count(F.lit(1)).alias("observations"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return by.unpivot("day", ["observations", "input_tokens", "output_tokens"], "metric", "value")


def metrics_pivot(spark: SparkSession, d: str) -> DataFrame:
    return metrics_unpivot(spark, d).groupBy("day").pivot("metric", ["observations", "input_tokens", "output_tokens"]).max("value")


def usage_by_extractor(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "observations", "extractor", "input_tokens", "output_tokens")
    return rows.groupBy("extractor").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("input_tokens") > 0).alias("metered"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("tokens_out"))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_type", "props").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("k").alias("kinds"), F.max("k").alias("top"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL")


def _product_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_catalog", "product_id", "canonical_name").toDF("query_id", "query")


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(_docs(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_docs(spark, d), _product_queries(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding").toDF("doc_id", "vec")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    return retrieval.dense(vectors, vectors.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = _docs(spark, d), _product_queries(spark, d)
    lexical = retrieval.bm25(docs, asked)
    hashed = retrieval.hashed_vectors(asked.toDF("doc_id", "text")).toDF("query_id", "vec")
    return retrieval.fuse((lexical, 3.0), (retrieval.dense(retrieval.hashed_vectors(docs), hashed, keep=20), 1.0), keep=15)


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = _docs(spark, d), _product_queries(spark, d)
    legs = retrieval.bm25(docs, asked), retrieval.bm25(docs, asked.withColumn("query", F.substring_index("query", " ", 2)))
    return retrieval.fuse((legs[0], 1.0), (legs[1], 3.0), keep=15)


def leg_weights(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.leg_weights(table(spark, d, "calls", "call_id", "product_hint").filter("product_hint IS NOT NULL").distinct().toDF("query_id", "query"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """One question for each product, of which every other names it."""
    c = table(spark, d, "product_catalog", "product_id", "canonical_name", "family")
    asks = F.when(F.pmod(F.length("product_id") + F.ascii(F.reverse("product_id")), F.lit(2)) == 0, F.concat(F.lit("how many reports of crashes on the "), "canonical_name")).otherwise(F.concat(F.lit("which guides explain exporting a report "), F.lower("family")))
    return c.select(F.col("product_id").alias("query_id"), asks.alias("query"))


def topical_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = _docs(spark, d), _questions(spark, d)
    return retrieval.coverage(docs, asked, retrieval.bm25(docs, asked), table(spark, d, "product_catalog"))


def _search_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "product_id", "status", "text")


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid_search(_search_docs(spark, d), _questions(spark, d), table(spark, d, "product_catalog"), mode="bm25").drop("similarity")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid_search(_search_docs(spark, d), _questions(spark, d), table(spark, d, "product_catalog"))


def counting_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = _questions(spark, d).unionByName(table(spark, d, "documents", "doc_id", "title").filter("title IS NOT NULL").select(F.col("doc_id").cast("string").alias("query_id"), F.col("title").alias("query")))
    return asked.select("query_id", serving.is_counting(F.col("query")).alias("counting")).distinct()


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return issues.issue_aggregate(table(spark, d, "observations"))


def asked_issues(spark: SparkSession, d: str) -> DataFrame:
    return serving.asked_issues(_questions(spark, d), stored(_issues(spark, d)), table(spark, d, "product_catalog"))


def top_issues(spark: SparkSession, d: str) -> DataFrame:
    return serving.top_issues(_issues(spark, d)).select(*KEYS, "distinct_customers", "mentions")


def status_listing(spark: SparkSession, d: str) -> DataFrame:
    """Issues with a status decided elsewhere: confirmed from a hundred mentions on."""
    found = stored(_issues(spark, d))
    return serving.status_listing(found, found.filter("mentions >= 100").select(*KEYS, F.lit("confirmed").alias("status")))


def routing_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Questions of which every second counts, and as many that no document answers."""
    asked = _questions(spark, d).withColumn("route", F.when(F.col("query").startswith("how many"), "sql").otherwise("rag")).withColumn("answerable", F.lit(True))
    odd = asked.select(F.concat(F.lit("x-"), "query_id").alias("query_id"), F.lit("zyzzyva quuxfrob plugh").alias("query"), F.lit("rag").alias("route"), F.lit(False).alias("answerable"))
    every = stored(asked.unionByName(odd))
    return serving.routing_accuracy(every, retrieval.hybrid_search(_search_docs(spark, d), every.select("query_id", "query"), table(spark, d, "product_catalog"), mode="bm25"))


def ranking_by_family(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ranking_by_category(ranking_measures(spark, d), table(spark, d, "product_catalog", "product_id", "family").toDF("query_id", "category"))


def issue_documents(spark: SparkSession, d: str) -> DataFrame:
    return serving.issue_documents(_issues(spark, d))


def overview_documents(spark: SparkSession, d: str) -> DataFrame:
    return serving.overview_documents(table(spark, d, "product_catalog"))


def claim_views(spark: SparkSession, d: str) -> DataFrame:
    docs = serving.overview_documents(table(spark, d, "product_catalog")).unionByName(serving.issue_documents(_issues(spark, d)))
    return docs.select("doc_id", serving.claim_view(F.col("title"), F.col("body")).alias("claim"))


def egress_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Destinations of many forms, made from the ids of calls, with turns as payload."""
    calls = table(spark, d, "calls", "call_id", "region", "turns").select("call_id", F.col("turns")[0]["text"].alias("payload"), F.abs(F.xxhash64("call_id")).alias("h")).distinct()
    forms = ("https://hooks.example.com/x", "api.example.com:8443/v1", "http://10.0.0.7/meta", "http://169.254.169.254/latest", "https://example.com.evil.test/", "ftp://user@files.example.org/a", "http://[::1]/x", "", "https://192.168.1.4", "notexample.com")
    url = F.element_at(F.array(*map(F.lit, forms)), (F.ascii(F.reverse("call_id")) % len(forms) + 1).cast("int"))
    return calls.select("call_id", serving.host_of(url).alias("host"), serving.egress_decision(url, F.col("payload"), ("example.com", "example.org")).alias("decision")).distinct()


def read_only_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements around the titles of documents: some select, some try more."""
    rows = table(spark, d, "documents", "doc_id", "title").filter("title IS NOT NULL").distinct()
    forms = ("SELECT '{}' AS t", "  select 1 -- {}", "DROP TABLE issues -- {}", "SELECT 1; DELETE FROM issues", "SELECT '{}';", "WITH x AS (SELECT 1) SELECT * FROM x")
    said = F.element_at(F.array(*map(F.lit, forms)), (F.pmod("doc_id", F.lit(len(forms))) + 1).cast("int"))
    return rows.select("doc_id", serving.is_read_only(F.replace(said, F.lit("{}"), F.col("title"))).alias("allowed"))


def ranking_measures(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.bm25(_docs(spark, d), _product_queries(spark, d))
    relevant = table(spark, d, "documents", "doc_id", "product_id").filter("product_id IS NOT NULL").select(F.col("product_id").alias("query_id"), "doc_id")
    return evaluation.ranking_measures(ranked, relevant)


def stale_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "title", "text", "status")
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    index = docs.filter("status = 'published'").select("doc_id", F.sha2(text, 256).alias("hash"), F.lit("hashed-256").alias("signature"))
    return retrieval.stale_documents(docs, index, "hashed-256")


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments", "relevance", "route_reason").select(F.col("relevance").alias("score"), F.coalesce(F.col("route_reason").isin("relevance", "both"), F.lit(False)).cast("int").alias("label"))
    return evaluation.threshold_sweep(rows)


def _routed(spark: SparkSession, d: str) -> DataFrame:
    reason, attack = F.col("route_reason"), F.col("injection_signatures")
    return table(spark, d, "segments", "region", "relevance", "route_reason", "injection_signatures").select(
        F.col("region").alias("category"), F.col("relevance").alias("score"), F.coalesce(reason.isin("relevance", "both"), F.lit(False)).cast("int").alias("label"),
        F.coalesce(F.length(attack) > 2, F.lit(False)).alias("attack"), F.coalesce(reason.isin("injection", "both"), F.lit(False)).alias("seen"),
    )


def router_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.router_metrics(_routed(spark, d))


def errors_by_category(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.errors_by_category(_routed(spark, d))


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_threshold(threshold_sweep(spark, d))


def silver_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments", "day", "pii_redactions", "route_reason", "injection_signatures")
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("pii_redactions"), F.lit(0)).alias("redactions"), F.count_if(F.length("injection_signatures") > 2).alias("injections"), F.count_if(F.col("route_reason").isin("relevance", "both")).alias("to_model"))


def region_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the partitions of a day, merged."""
    parts = table(spark, d, "calls", "day", "region", "centre", "turns").groupBy("day", "region", "centre").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce(F.size("turns"), F.lit(0))).alias("turns"))
    return parts.groupBy("region").agg(F.sum("calls").alias("calls"), F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("partitions"))


def count_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Days on which the segments sent to the model and those with an observation differ in number."""
    sent = table(spark, d, "segments", "segment_id", "day", "route_reason").filter("route_reason IN ('relevance', 'both')").groupBy("day").agg(F.count_distinct("segment_id").alias("routed"))
    out = table(spark, d, "observations", "segment_id", "day").groupBy("day").agg(F.count_distinct("segment_id").alias("extracted"))
    return sent.join(out, "day", "full_outer").fillna(0).filter("routed <> extracted")


def unlabelled_pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments", "segment_id", "relevance").distinct().join(table(spark, d, "observations", "segment_id").distinct(), "segment_id", "left_anti")


def contamination(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "calls", "call_id", "turns").select("call_id", F.explode("turns").alias("t")).filter("lower(trim(t.speaker)) = 'agent'").select("call_id", F.col("t.text").alias("claim"))
    return evaluation.contamination(table(spark, d, "observations", "observation_id", "segment_id", "issue_key", "attribution_confidence"), claims, table(spark, d, "segments", "segment_id", "call_id", "text"))


def identifier_top1(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = _docs(spark, d), _product_queries(spark, d)
    legs = {"whole": retrieval.bm25(docs, asked), "short": retrieval.bm25(docs, asked.withColumn("query", F.substring_index("query", " ", 2)))}
    expected = table(spark, d, "documents", "doc_id", "product_id").filter("product_id IS NOT NULL").select(F.col("product_id").alias("query_id"), "doc_id")
    return evaluation.top1_by_leg(legs, expected)


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences")).distinct()


def known_issue_keys(spark: SparkSession, d: str) -> DataFrame:
    return extraction.known_issue_keys(spark, table(spark, d, "observations", "issue_key"))


def payload_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations written as an extractor's JSON and read back."""
    o = table(spark, d, "observations", "segment_id", "product_id", "issue_key", "type", "summary", "severity", "evidence", "confidence", "attribution_confidence").distinct()
    fields = F.struct(
        (F.col("confidence") >= 0.3).alias("is_product_signal"), F.concat(F.lit("X"), "product_id").alias("product_id"), "type", F.when(F.col("severity") == "low", "NEW_ISSUE").otherwise(F.lower(F.replace("issue_key", F.lit("_"), F.lit("-")))).alias("issue_key"),
        F.col("issue_key").alias("new_issue_label"), "summary", "severity", "evidence", "confidence",
    )
    return extraction.normalised_payloads(o.select("segment_id", "product_id", "attribution_confidence", F.to_json(fields).alias("payload")), table(spark, d, "product_catalog")).distinct()


def label_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.label_summary(_labels(spark, d))


def label_export(spark: SparkSession, d: str) -> DataFrame:
    """Judgements appended as JSON lines, read back, contested ones left out."""
    place = scratch(spark, "labels")
    sinks.append_labels(_labels(spark, d), place)
    return sinks.label_export(raw_calls.read_jsonl(spark, place, "item_id string, annotator string, value string"))


def evidence_sink(spark: SparkSession, d: str) -> DataFrame:
    """Every day of evidence written twice and read back: replacing a day changes nothing."""
    place = scratch(spark, "evidence")
    rows = stored(sinks.evidence_rows(table(spark, d, "observations").filter("day IS NOT NULL"), "run"))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    for _ in range(2):
        rows.write.mode("overwrite").partitionBy("day").parquet(place)
    spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    back = spark.read.schema(rows.schema).parquet(place)
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("observation_id").alias("observations"))


def merged_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the first half of the days merged with those of all: spans grow, confirmed ones stay confirmed."""
    place, rows = scratch(spark, "issues"), table(spark, d, "observations")
    made = lambda o, status: issues.issue_aggregate(o).select(*KEYS, "mentions", "first_seen", "last_seen").withColumn("status", status)
    middle = F.lit("2026-03-08")
    sinks.merge_issues(made(rows.filter(F.col("day") < middle), F.when(F.col("mentions") > 20, "confirmed").otherwise("observed")), place)
    sinks.merge_issues(made(rows, F.lit("observed")), place)
    return sinks.read_state(spark, place)


def metrics_sink(spark: SparkSession, d: str) -> DataFrame:
    """One run's numbers appended as rows of name and value."""
    place = scratch(spark, "metrics")
    n = table(spark, d, "observations").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("customer_id").alias("customers"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).first().asDict()
    sinks.append_metrics(n | {"ok": True}, place, "run", "all", spark)
    return spark.read.parquet(place).select("metric", "value")


def audit_sink(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to the audit table, of which only audited kinds come back, by day."""
    place = scratch(spark, "audit")
    kinds = F.create_map(*(F.lit(x) for kv in (("click", "policy_decision"), ("view", "tool_executed"), ("purchase", "publish")) for x in kv))
    sinks.append_audit(table(spark, d, "events", "ts", "event_type", "user_id").select("ts", F.coalesce(kinds[F.col("event_type")], F.col("event_type")).alias("event"), F.col("user_id").cast("string").alias("actor")), place)
    return spark.read.parquet(place).groupBy(F.col("day").cast("string").alias("day"), "event").agg(F.count(F.lit(1)).alias("n_events"))


def index_update(spark: SparkSession, d: str) -> DataFrame:
    """An index of published documents, then of all: unchanged ones are not embedded again, and each stands once."""
    place = scratch(spark, "index")
    docs = table(spark, d, "documents", "doc_id", "title", "text", "status")
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    hashed = docs.select("doc_id", F.sha2(text, 256).alias("hash"), "status")
    sinks.save_index(hashed.filter("status = 'published'").withColumn("round", F.lit(1)).select("doc_id", "hash", "round"), place, "hashed-256")
    stale = retrieval.stale_documents(docs, sinks.load_index(spark, place, "hashed-256"), "hashed-256").select("doc_id", "hash").withColumn("round", F.lit(2))
    sinks.save_index(stale, place, "hashed-256")
    return sinks.load_index(spark, place, "hashed-256").select("doc_id", "hash", "round")


def audit_tail(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events", "ts", "event_type", "event_id").withColumnRenamed("event_type", "event")
    return log.filter("event = 'click'").orderBy(F.desc("ts"), "event_id").limit(20)


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a stream by day and type, upserted batch by batch, as they stand at the end."""
    place, source = scratch(spark, "windows"), scratch(spark, "source")
    table(spark, d, "events").repartition(3).write.parquet(source)
    events = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    keep = stages.once(lambda df: sinks.upsert(df.select("start", "event_type", "events"), place, ["start", "event_type"]), spark, scratch(spark, "marks"))
    stages.run_available(stages.windowed_counts(events, "1 day", "60 days"), keep, scratch(spark, "progress"), "update")
    return sinks.read_state(spark, place)


def speaker_at(spark: SparkSession, d: str) -> DataFrame:
    """Who speaks in the middle of each tile of twenty seconds."""
    spans = stored(_spans(spark, d).select("call_id", "start", "end", "speaker"))
    last = spans.groupBy("call_id").agg(F.max("end").alias("stop"))
    points = last.select("call_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("stop") / 20).cast("int"))).alias("id")).withColumn("at", F.col("id") * 20.0 + 10.0)
    return intervals.speaker_at(points, spans.filter("speaker IS NOT NULL"), ["call_id"])


def cluster_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The smoothed label that most turns under each raw label of a call have."""
    rows = _deliveries(spark, d).select("call_id", F.posexplode("turns").alias("pos", "t")).select("call_id", "pos", F.col("t.speaker").alias("cluster"))
    smooth = intervals.smoothed(rows, ["call_id"], "pos", "cluster").withColumnRenamed("smoothed", "truth").filter("cluster IS NOT NULL")
    return evaluation.majority_mapping(smooth, ["call_id"])


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations", "call_id", "extractor", "issue_key").toDF("item_id", "annotator", "value")


def annotator_kappa(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.cohen_kappa(_labels(spark, d), "rules-2", "model-a")


def contested_items(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.contested(_labels(spark, d))


def groundedness(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "evidence", "observation_id", "segment_id", "quote").distinct()
    held = dedupe.without_repeats(table(spark, d, "segments", "segment_id", "text"), "segment_id")
    return evaluation.groundedness(quotes.join(held, "segment_id", "left").select(F.col("observation_id").alias("claim_id"), F.col("quote").alias("claim"), F.col("text").alias("source")))


def word_error_rate(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "evidence", "observation_id", "quote").distinct().join(table(spark, d, "observations", "observation_id", "evidence").distinct(), "observation_id")
    return evaluation.word_error_rate(found.toDF("key", "hypothesis", "reference"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(table(spark, d, "segments", "segment_id", "relevance").distinct().toDF("id", "score"), 200)


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_by_kind(graph.edges(table(spark, d, "observations")))


def graph_shared_modes(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_modes(table(spark, d, "observations", *KEYS))


def graph_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return graph.blast_radius(graph.edges(table(spark, d, "observations")), "version")


def graph_hops(spark: SparkSession, d: str) -> DataFrame:
    return graph.hops_from(graph.edges(table(spark, d, "observations")), "region:EUR")


def corpus_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "source", "lang", "status", "n_chars")
    return rows.cube("source", "status").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


def star_join(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n, *c: table(spark, d, n, *c)
    lines = t("lineitem", "l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag")
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderpriority")
    where = t("customer", "c_custkey", "c_nationkey").join(t("nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(where, F.col("o_custkey") == F.col("c_custkey")).join(t("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    money = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(18,4)"))
    return rows.groupBy("p_brand", "r_name").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("l_returnflag") == "R").alias("denying"), F.round(F.sum(money).cast("double"), 2).alias("volume"))


def daily_issues(spark: SparkSession, d: str) -> DataFrame:
    return daily.daily_issues(table(spark, d, "calls"), table(spark, d, "product_catalog"), "all")


QUERIES = {
    f.__name__: f
    for f in (
        *(issue_aggregate, issue_evidence, candidates_with_evidence, corroboration_report, issue_rollup, evidence_top, dedupe_within_day, dedupe_across_days, seen_hashes, content_hashes),
        *(pii_counts, pii_redact, secret_predicate, injection_scan, injection_excerpts, customer_channel, catalog_unambiguous, product_resolution, identify_product, product_fuzzy, version_resolution),
        *(relevance_signals, rule_observations, schema_gate, call_transcripts, segment_calls, turn_windows, interval_attribution, label_smoothing),
        *(sessions, tumbling, metrics_unpivot, metrics_pivot, usage_by_extractor, event_counts, document_frequency, bm25_scores, dense_topk, hybrid_fusion, rank_fusion),
        *(leg_weights, topical_coverage, ranking_measures, stale_documents, threshold_sweep, annotator_kappa, contested_items, groundedness, word_error_rate),
        *(stratified_sample, graph_degrees, graph_shared_modes, graph_blast_radius, graph_hops, corpus_languages, star_join, daily_issues),
        *(lexical_search, hybrid_search, counting_questions, asked_issues, top_issues, status_listing, routing_accuracy, ranking_by_family, issue_documents, overview_documents, claim_views, egress_decisions, read_only_statements),
        *(router_metrics, errors_by_category, best_threshold, silver_totals, region_totals, count_mismatch, unlabelled_pool, contamination, identifier_top1, sentence_counts),
        *(known_issue_keys, payload_observations, label_summary, label_export, evidence_sink, merged_issues, metrics_sink, audit_sink, index_update, audit_tail, stream_windows),
        *(speaker_at, cluster_mapping),
        *(p5_found, p5_changes, p5_table, p5_quarantine, p6_found, p6_profile),
    )
}
