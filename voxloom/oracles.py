"""DuckDB statements that must give the rows of the core queries of the same names."""

from __future__ import annotations

from voxloom.functions.text import DLP_PATTERNS, FUNCTION_WORDS, INJECTION_SIGNATURES, SECRET_KINDS, SEVERITY_WEIGHT, STOPWORDS
from voxloom.operators.catalog import VERSION_PATTERN
from voxloom.operators.extraction import FIX_CLAIM, ISSUE_PATTERNS, SEVERITIES, TYPES
from voxloom.operators.retrieval import IDENTIFIER, B, K1
from voxloom.operators.routing import PROBLEM_TERMS, REQUEST_TERMS, SMALL_TALK, SPEC_TERMS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(map(_q, values))


_PATTERN = {k: p for k, _, p in DLP_PATTERNS}
_TOKENS = lambda x: f"list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9\\.\\-_]*'), lambda t: trim(t, '.-_')), lambda t: length(t) > 1 AND t NOT IN ({_in(STOPWORDS)}))"
_CONTENT = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9.\\-]*')), lambda t: length(t) > 1 AND t NOT IN ({_in(FUNCTION_WORDS)}))"
_LINES = "list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'customer:')), lambda x: trim(substring(x, 10)))"
_NORM = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g')"
_ANY = lambda terms: "(" + " OR ".join(f"contains(low, {_q(t)})" for t in terms) + ")"
_STEM = lambda t: "CASE " + " ".join(f"WHEN length({t}) > {len(s) + 3} AND ends_with({t}, '{s}') THEN left({t}, length({t}) - {len(s)})" for s in ("ing", "ed", "es", "s")) + f" ELSE {t} END"

#: Card numbers of a text that pass the check: from the right, every second digit counts twice, with its digits added.
_LUHN = lambda m: f"list_sum(list_transform(range(1, length({m}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({m})[i] AS INTEGER) ELSE CASE WHEN CAST(reverse({m})[i] AS INTEGER) > 4 THEN 2 * CAST(reverse({m})[i] AS INTEGER) - 9 ELSE 2 * CAST(reverse({m})[i] AS INTEGER) END END)) % 10 = 0"
_DIGITS = lambda m: f"regexp_replace({m}, '[^0-9]', '', 'g')"
_CARDS = lambda x: f"list_filter(regexp_extract_all({x}, {_q(_PATTERN['credit_card'])}), lambda m: length({_DIGITS('m')}) >= 13 AND {_LUHN(_DIGITS('m'))})"

_BM25_PARTS = f"""
    docs AS (SELECT doc_id, {_TOKENS('text')} AS t FROM documents WHERE text IS NOT NULL),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs),
    posting AS (SELECT token, doc_id, any_value(length) AS length, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS token FROM docs) GROUP BY token, doc_id),
    df AS (SELECT token, count(*) AS df FROM posting GROUP BY token)
"""


def _bm25(query: str, name: str, keep: int = 20, source: str = "(SELECT *, product_id AS query_id FROM product_catalog)") -> str:
    return f"""
    {name}_q AS (SELECT query_id, unnest({_TOKENS(query)}) AS token FROM {source}),
    {name}_s AS (
        SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * length / mean))), 6) AS score
        FROM {name}_q JOIN posting USING (token) JOIN df USING (token), stats GROUP BY query_id, doc_id
    ),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM {name}_s) WHERE place <= {keep})
    """


_QUESTIONS = """
    questions AS (
        SELECT product_id AS query_id, CASE WHEN (length(product_id) + ascii(right(product_id, 1))) % 2 = 0 THEN 'how many reports of crashes on the ' || canonical_name ELSE 'which guides explain exporting a report ' || lower(family) END AS query
        FROM product_catalog
    )
"""
#: Covered share of the pairs in ``a``: stems of a question's words that are in at most half of the documents and in no name of a product.
_COVERAGE = f"""
    {_bm25('query', 'a', 20, 'questions')},
    names AS (SELECT DISTINCT unnest({_TOKENS('p')}) AS token FROM (SELECT unnest([product_id, canonical_name] || coalesce(aliases, []) || coalesce(generic_aliases, [])) AS p FROM product_catalog)),
    asked AS (SELECT DISTINCT query_id, token FROM a_q WHERE token NOT IN (SELECT token FROM names)),
    good AS (SELECT query_id, {_STEM('token')} AS stem FROM asked LEFT JOIN df USING (token), stats WHERE coalesce(df, 0) <= 0.5 * n),
    terms AS (SELECT query_id, list(stem) AS terms FROM good GROUP BY query_id), held AS (SELECT doc_id, list_distinct(list_transform(t, lambda w: {_STEM('w')})) AS stems FROM docs),
    covered AS (SELECT query_id, doc_id, CASE WHEN terms IS NULL THEN 1.0 ELSE len(list_filter(terms, lambda x: list_contains(stems, x))) / len(terms) END AS coverage FROM a_s LEFT JOIN terms USING (query_id) JOIN held USING (doc_id))
"""


def _resolve(texts: str) -> str:
    return f"""
    texts AS ({texts}),
    cat AS (SELECT product_id, {_NORM('product_id')} AS sku, {_NORM('canonical_name')} AS name, list_transform(aliases, lambda a: {_NORM('a')}) AS aliases, versions, generic_aliases FROM product_catalog),
    generic AS (SELECT term, any_value(product_id) AS product_id FROM (SELECT product_id, {_NORM('unnest(generic_aliases)')} AS term FROM cat) GROUP BY term HAVING count(*) = 1),
    version AS (SELECT term, any_value(product_id) AS product_id FROM (SELECT product_id, unnest(versions) AS term FROM cat) GROUP BY term HAVING count(*) = 1),
    norm AS (SELECT key, text, {_NORM('text')} AS n FROM texts),
    found AS (
        SELECT key, product_id, 0.99 AS c FROM norm, cat WHERE contains(' ' || n || ' ', ' ' || sku || ' ') OR contains(n, name)
        UNION ALL SELECT key, product_id, 0.90 FROM norm, (SELECT product_id, unnest(aliases) AS a FROM cat) WHERE contains(' ' || n || ' ', ' ' || a || ' ')
        UNION ALL SELECT key, product_id, 0.60 FROM norm, generic WHERE contains(' ' || n || ' ', ' ' || term || ' ')
        UNION ALL SELECT key, product_id, 0.70 FROM (SELECT key, unnest(list_distinct(regexp_extract_all(text, {_q(VERSION_PATTERN)}, 1))) AS term FROM texts) JOIN version USING (term)
    )
    , resolved AS (SELECT key, product_id, CAST(c AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, product_id) AS r FROM (SELECT DISTINCT * FROM found)) WHERE r = 1)
"""

_SPANS = """
    rows AS (SELECT call_id, unnest(turns) AS t, generate_subscripts(turns, 1) - 1 AS id FROM (SELECT DISTINCT call_id, turns FROM calls)),
    timed AS (
        SELECT call_id, id, t.speaker AS speaker, t.start_time AS s, length(t.text) AS n,
               regexp_extract(t.text, '^\\s*[\\[(<]?(?:([0-9]{1,2}):)?([0-9]{1,3}):([0-9]{2})(?:[.,]([0-9]{1,3}))?', ['h', 'm', 's', 'f']) AS c, regexp_extract(t.text, '^\\s*[\\[(<]?([0-9]{1,3})m\\s?([0-9]{1,2})s', ['m', 's']) AS d
        FROM rows WHERE t.start_time IS NOT NULL AND isfinite(t.start_time)
    ), marked AS (
        SELECT *, coalesce(coalesce(TRY_CAST(c.h AS DOUBLE), 0) * 3600 + TRY_CAST(c.m AS DOUBLE) * 60 + TRY_CAST(c.s AS DOUBLE) + coalesce(TRY_CAST('0.' || nullif(c.f, '') AS DOUBLE), 0), TRY_CAST(d.m AS DOUBLE) * 60 + TRY_CAST(d.s AS DOUBLE)) AS mark,
               (lead(s) OVER (PARTITION BY call_id ORDER BY s, id) - s) / nullif(n, 0) AS pace FROM timed
    ), units AS (
        SELECT call_id, CASE WHEN median(CASE WHEN mark > 0 AND s >= 0 THEN s / mark END) BETWEEN 300.0000001 AND 2999.9999999 OR (median(CASE WHEN mark > 0 AND s >= 0 THEN s / mark END) IS NULL AND median(pace) > 5) THEN 1000.0 ELSE 1.0 END AS unit
        FROM marked GROUP BY call_id
    ), starts AS (SELECT call_id, id, speaker, s / unit AS s FROM timed JOIN units USING (call_id)),
    spans AS (SELECT call_id, id, speaker, s, coalesce(lead(s) OVER (PARTITION BY call_id ORDER BY s, id), s + 10.0) AS e FROM starts)
"""
_EDGES = """
    keys AS (SELECT DISTINCT product_id, issue_key, product_version, region FROM observations),
    edges AS (
        SELECT DISTINCT 'product:' || product_id AS src, 'issue:' || product_id || '/' || issue_key AS dst, 'has' AS kind FROM keys
        UNION SELECT 'issue:' || product_id || '/' || issue_key, 'version:' || product_version, 'seen_in' FROM keys WHERE product_version IS NOT NULL
        UNION SELECT 'issue:' || product_id || '/' || issue_key, 'region:' || region, 'seen_from' FROM keys WHERE region IS NOT NULL
    )
"""
_CUSTOMER = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'customer:')), chr(10))"
_ISSUES = """
    o AS (SELECT *, coalesce(starts_with(summary, 'RESOLVED CLAIM:'), false) AS deny, CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE -1 END AS rank FROM observations),
    k AS (
        SELECT product_id, issue_key, count(*) AS mentions, count(DISTINCT customer_id) FILTER (WHERE coalesce(attribution_confidence, 1.0) >= 0.5) AS customers,
               array_to_string(list_sort(list_distinct(list(region) FILTER (WHERE region IS NOT NULL))), ', ') AS regions,
               coalesce(array_to_string(list_sort(list_distinct(list(product_version) FILTER (WHERE product_version IS NOT NULL))), ', '), '') AS versions,
               min(TRY_CAST(timestamp AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS first_seen, max(TRY_CAST(timestamp AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS last_seen,
               count(*) FILTER (WHERE NOT deny) < count(*) FILTER (WHERE deny) AS denied FROM o GROUP BY product_id, issue_key
    ),
    v AS (SELECT o.product_id, o.issue_key, max({'r': rank, 'severity': severity, 'summary': summary}) AS top FROM o JOIN k ON o.product_id = k.product_id AND o.issue_key = k.issue_key AND o.deny = k.denied GROUP BY ALL),
    issues AS (SELECT k.*, top.severity AS severity, top.summary AS summary FROM k JOIN v USING (product_id, issue_key))
"""
_OVERVIEW = """
    SELECT 'doc::' || product_id || '::overview' AS doc_id, product_id, canonical_name || ' - product overview' AS title,
           canonical_name || ' is part of the ' || family || ' line. Supported firmware versions: ' || array_to_string(coalesce(versions, []), ', ') || '. Known aliases used by customers: ' || array_to_string(coalesce(aliases, []), ', ') || '.' AS body,
           'product_doc' AS source, 'published' AS status FROM product_catalog
"""
_ISSUE_DOCS = """
    SELECT 'doc::' || product_id || '::' || issue_key AS doc_id, product_id,
           product_id || ' ' || array_to_string(list_transform(string_split(issue_key, '_'), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') AS title,
           coalesce(summary, '') || '. Reported by ' || customers || ' distinct customers across ' || regions || ' on versions ' || CASE WHEN versions = '' THEN 'unspecified' ELSE versions END || '. Severity ' || coalesce(severity, '')
           || '. Status observed. First seen ' || strftime(first_seen, '%Y-%m-%d %H:%M:%S') || ', last seen ' || strftime(last_seen, '%Y-%m-%d %H:%M:%S') || '.' AS body, 'validated_issue' AS source, 'observed' AS status FROM issues
"""
#: The scored rows of the router: attacks are those with any signature.
_ROUTED = """
    SELECT region AS category, coalesce(relevance >= 0.35, false) AS keep, coalesce(route_reason IN ('relevance', 'both'), false) AS good, coalesce(length(injection_signatures) > 2, false) AS attack,
           coalesce(route_reason IN ('injection', 'both'), false) AS seen FROM segments
"""
_LABELS = "(SELECT call_id AS item_id, extractor AS annotator, issue_key AS value FROM observations)"

ORACLES = {
    "issue_aggregate": """
        WITH o AS (
            SELECT *, coalesce(starts_with(summary, 'RESOLVED CLAIM:'), false) AS deny,
                   CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE -1 END AS rank
            FROM observations
        ), k AS (
            SELECT product_id, issue_key, count(*) AS mentions,
                   count(DISTINCT customer_id) FILTER (WHERE coalesce(attribution_confidence, 1.0) >= 0.5) AS distinct_customers,
                   list_sort(list_distinct(list(region) FILTER (WHERE region IS NOT NULL))) AS regions,
                   coalesce(list_sort(list_distinct(list(product_version) FILTER (WHERE product_version IS NOT NULL))), []) AS versions,
                   min(TRY_CAST(timestamp AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS first_seen, max(TRY_CAST(timestamp AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS last_seen,
                   count(*) FILTER (WHERE NOT deny) AS affirming, count(*) FILTER (WHERE deny) AS denying
            FROM o GROUP BY product_id, issue_key
        ), v AS (
            SELECT o.product_id, o.issue_key, CAST(sum(CAST(confidence AS DECIMAL(18, 9))) AS DOUBLE) / count(confidence) AS mean,
                   max({'r': rank, 'severity': severity, 'summary': summary, 'type': type}) AS top
            FROM o JOIN k ON o.product_id = k.product_id AND o.issue_key = k.issue_key AND o.deny = (k.affirming < k.denying)
            GROUP BY o.product_id, o.issue_key
        )
        SELECT k.*, round(mean + 1e-9, 6) AS mean_confidence, top.severity AS severity, top.summary AS summary, top.type AS type,
               CASE WHEN affirming > 0 AND denying > 0 THEN least(affirming, denying) || '/' || mentions || ' reports claim the issue is resolved' END AS conflict
        FROM k JOIN v USING (product_id, issue_key)
    """,
    "corroboration_report": """
        SELECT product_id, issue_key, count(*) AS mentions, count(DISTINCT customer_id) AS distinct_customers,
               round(count(*) / count(DISTINCT customer_id) + 1e-9, 2) AS mentions_per_customer
        FROM observations GROUP BY product_id, issue_key
    """,
    "issue_rollup": """
        SELECT product_id, issue_key, CAST(grouping(product_id, issue_key) AS INTEGER) AS level, count(*) AS mentions, count(DISTINCT customer_id) AS customers
        FROM observations GROUP BY ROLLUP (product_id, issue_key)
    """,
    "evidence_top": """
        SELECT product_id, issue_key, observation_id, quote, confidence, place FROM (
            SELECT *, row_number() OVER (PARTITION BY product_id, issue_key ORDER BY confidence DESC, observation_id) AS place
            FROM (SELECT DISTINCT product_id, issue_key, observation_id, quote, confidence FROM evidence)
        ) WHERE place <= 3
    """,
    "dedupe_within_day": """
        SELECT day, customer_id, content_hash, segment_id, timestamp, copies FROM (
            SELECT *, row_number() OVER (PARTITION BY day, customer_id, content_hash ORDER BY TRY_CAST(timestamp AS TIMESTAMPTZ) NULLS FIRST, segment_id) AS r,
                   count(*) OVER (PARTITION BY day, customer_id, content_hash) AS copies FROM segments
        ) WHERE r = 1
    """,
    "dedupe_across_days": """
        WITH w AS (
            SELECT *, row_number() OVER (PARTITION BY day, customer_id, content_hash ORDER BY TRY_CAST(timestamp AS TIMESTAMPTZ) NULLS FIRST, segment_id) AS r,
                   count(*) OVER (PARTITION BY day, customer_id, content_hash) AS copies FROM segments
        )
        SELECT day, customer_id, content_hash, segment_id, timestamp, copies FROM w
        WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.customer_id = w.customer_id AND s.content_hash = w.content_hash AND s.day < w.day)
    """,
    "seen_hashes": "SELECT DISTINCT customer_id, content_hash, day FROM segments",
    "content_hashes": "SELECT DISTINCT segment_id, sha1(text) AS hash FROM segments",
    "pii_counts": "SELECT segment_id, "
    + ", ".join(f"CAST(len({_CARDS('text')}) AS INTEGER) AS {k}" if k == "credit_card" else f"CAST(len(regexp_extract_all(text, {_q(_PATTERN[k])})) AS INTEGER) AS {k}" for k in _PATTERN)
    + " FROM (SELECT DISTINCT segment_id, text FROM segments)",
    "secret_predicate": "SELECT doc_id, coalesce(" + " OR ".join(f"regexp_matches(text, {_q(_PATTERN[k])})" for k in SECRET_KINDS) + ", false) AS has_secret FROM documents",
    "injection_scan": "SELECT segment_id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, {_q(p)}) THEN '{n}' END" for n, _, p in INJECTION_SIGNATURES)
    + "], lambda x: x IS NOT NULL) AS signatures, least(1.0, round("
    + " + ".join(f"CASE WHEN regexp_matches(text, {_q(p)}) THEN CAST({SEVERITY_WEIGHT[s]} AS DOUBLE) ELSE 0 END" for _, s, p in INJECTION_SIGNATURES)
    + ", 6)) AS risk FROM (SELECT DISTINCT segment_id, text FROM segments)",
    "customer_channel": f"SELECT segment_id, array_to_string({_LINES}, ' ') AS spoken, CAST(len({_LINES}) AS INTEGER) AS lines FROM (SELECT DISTINCT segment_id, text FROM segments)",
    "catalog_unambiguous": f"""
        SELECT term, any_value(product_id) AS product_id, 'generic' AS kind FROM (SELECT product_id, {_NORM('unnest(generic_aliases)')} AS term FROM product_catalog) GROUP BY term HAVING count(*) = 1
        UNION ALL
        SELECT term, any_value(product_id), 'version' FROM (SELECT product_id, unnest(versions) AS term FROM product_catalog) GROUP BY term HAVING count(*) = 1
    """,
    "product_resolution": f"WITH {_resolve('SELECT DISTINCT segment_id AS key, text FROM segments')} SELECT key, product_id, confidence FROM resolved",
    "version_resolution": f"""
        WITH said AS (SELECT DISTINCT segment_id AS key, product_id, regexp_extract(text, {_q(VERSION_PATTERN)}, 1) AS version, text FROM segments WHERE product_id IS NOT NULL)
        SELECT key, product_id, version FROM said JOIN product_catalog USING (product_id)
        WHERE version <> '' AND len(list_filter(versions, lambda v: starts_with(v, version) OR starts_with(version, v))) > 0
    """,
    "relevance_signals": f"""
        WITH s AS (SELECT *, {_LINES} AS l FROM (SELECT DISTINCT segment_id, text, product_id, product_confidence FROM segments)),
        t AS (SELECT *, lower(trim(array_to_string(l, ' '))) AS low FROM s),
        r AS (
            SELECT segment_id, text, CASE WHEN low = '' OR t.product_id IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0,
                CAST(0.45 AS DOUBLE) * coalesce(product_confidence, 0.0) + CASE WHEN {_ANY(PROBLEM_TERMS)} THEN CAST(0.35 AS DOUBLE) ELSE 0 END
                + CASE WHEN {_ANY(REQUEST_TERMS)} THEN CAST(0.20 AS DOUBLE) ELSE 0 END + CASE WHEN {_ANY(SPEC_TERMS)} THEN CAST(0.15 AS DOUBLE) ELSE 0 END
                + CASE WHEN said <> '' AND len(list_filter(versions, lambda v: starts_with(v, said) OR starts_with(said, v))) > 0 THEN CAST(0.15 AS DOUBLE) ELSE 0 END
                - CASE WHEN regexp_matches(low, {_q(SMALL_TALK)}) THEN CAST(0.20 AS DOUBLE) ELSE 0 END)) END AS raw
            FROM (SELECT *, regexp_extract(array_to_string(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'customer:')), chr(10)), {_q(VERSION_PATTERN)}, 1) AS said FROM t) t
            LEFT JOIN product_catalog USING (product_id)
        ), g AS (
            SELECT segment_id, round(raw + 1e-9, 6) AS relevance, list_filter([{", ".join(f"CASE WHEN regexp_matches(text, {_q(p)}) THEN '{n}' END" for n, _, p in INJECTION_SIGNATURES)}], lambda x: x IS NOT NULL) AS signatures FROM r
        )
        SELECT *, CASE WHEN relevance >= 0.35 AND len(signatures) > 0 THEN 'both' WHEN relevance >= 0.35 THEN 'relevance' WHEN len(signatures) > 0 THEN 'injection' ELSE 'none' END AS reason FROM g
    """,
    "schema_gate": f"""
        WITH e AS (
            SELECT list_filter([
                CASE WHEN NOT coalesce(type IN ({_in(TYPES)}), false) THEN 'type' END, CASE WHEN NOT coalesce(severity IN ({_in(SEVERITIES)}), false) THEN 'severity' END,
                CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence' END, CASE WHEN NOT coalesce(regexp_matches(product_id, '^[A-Z0-9_\\-]{{2,40}}$'), false) THEN 'product_id' END,
                CASE WHEN NOT coalesce(regexp_matches(issue_key, '^[A-Z0-9_]{{3,60}}$'), false) THEN 'issue_key' END, CASE WHEN NOT coalesce(length(evidence) <= 400, false) THEN 'evidence' END,
                CASE WHEN NOT coalesce(speaker = 'customer', false) THEN 'speaker' END, CASE WHEN NOT coalesce(attribution_confidence, 1.0) BETWEEN 0 AND 1 THEN 'attribution_confidence' END
            ], lambda x: x IS NOT NULL) AS errors FROM observations
        )
        SELECT error, count(*) AS n_rows FROM (SELECT unnest(CASE WHEN len(errors) = 0 THEN [NULL] ELSE errors END) AS error FROM e) GROUP BY error
    """,
    "call_transcripts": """
        SELECT call_id, md5(array_to_string(list_transform(turns, lambda t: t.speaker || ': ' || t.text), chr(10))) AS whole,
               md5(array_to_string(list_transform(list_filter(turns, lambda t: t.speaker = 'customer'), lambda t: t.speaker || ': ' || t.text), chr(10))) AS customer,
               CAST(len(turns) AS INTEGER) AS n_turns FROM (SELECT DISTINCT call_id, turns FROM calls)
    """,
    "turn_windows": """
        WITH r AS (SELECT call_id, unnest(turns) AS t, generate_subscripts(turns, 1) - 1 AS pos FROM (SELECT DISTINCT call_id, turns FROM calls))
        SELECT call_id, CAST(pos AS INTEGER) AS pos, md5(lag(t.text) OVER (PARTITION BY call_id ORDER BY pos)) AS previous FROM r WHERE t.speaker = 'customer'
    """,
    "interval_attribution": f"""
        WITH {_SPANS}, stops AS (SELECT call_id, max(e) AS stop FROM spans GROUP BY call_id),
        tiles AS (SELECT call_id, unnest(range(0, CAST(floor(stop / 20) AS BIGINT) + 1)) AS id FROM stops)
        SELECT call_id, CAST(spans.id AS INTEGER) AS a_id, CAST(tiles.id AS INTEGER) AS b_id, round(least(e, tiles.id * 20.0 + 20.0) - greatest(s, tiles.id * 20.0) + 1e-9, 6) AS shared
        FROM spans JOIN tiles USING (call_id) WHERE s < e AND s < tiles.id * 20.0 + 20.0 AND tiles.id * 20.0 < e
    """,
    "label_smoothing": """
        WITH r AS (SELECT call_id, unnest(turns).speaker AS speaker, generate_subscripts(turns, 1) - 1 AS pos FROM (SELECT DISTINCT call_id, turns FROM calls)),
        n AS (SELECT *, lag(speaker) OVER w AS b, lead(speaker) OVER w AS a FROM r WINDOW w AS (PARTITION BY call_id ORDER BY pos))
        SELECT call_id, CAST(pos AS INTEGER) AS pos, CASE WHEN b IS NOT NULL AND b = a THEN b ELSE speaker END AS smoothed FROM n
    """,
    "sessions": """
        WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
        SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE), 4) AS value
        FROM g GROUP BY user_id, s
    """,
    "tumbling": """
        SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS "start", event_type, count(*) AS events, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE), 4) AS value
        FROM events GROUP BY 1, 2
    """,
    "metrics_unpivot": """
        WITH d AS (SELECT day, count(*) AS observations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM observations GROUP BY day)
        SELECT day, metric, value FROM d UNPIVOT INCLUDE NULLS (value FOR metric IN (observations, input_tokens, output_tokens))
    """,
    "metrics_pivot": "SELECT day, count(*) AS observations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM observations GROUP BY day",
    "usage_by_extractor": """
        SELECT extractor, count(*) AS n_rows, count(*) FILTER (WHERE input_tokens > 0) AS metered, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS tokens_in,
               CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS tokens_out FROM observations GROUP BY extractor
    """,
    "event_counts": """
        SELECT event_type, count(*) AS n_events, count(DISTINCT k) AS kinds, max(k) AS top
        FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type
    """,
    "document_frequency": f"WITH {_BM25_PARTS} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posting GROUP BY token",
    "bm25_scores": f"WITH {_BM25_PARTS}, {_bm25('canonical_name', 'a')} SELECT query_id, doc_id, score, CAST(place AS INTEGER) AS place FROM a",
    "rank_fusion": f"""
        WITH {_BM25_PARTS}, {_bm25('canonical_name', 'a')}, {_bm25("split_part(canonical_name, ' ', 1) || ' ' || split_part(canonical_name, ' ', 2)", 'b')},
        v AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + place) AS vote FROM a UNION ALL SELECT query_id, doc_id, 3.0::DOUBLE / (60 + place) FROM b),
        s AS (SELECT query_id, doc_id, round(sum(vote), 9) AS score FROM v GROUP BY query_id, doc_id)
        SELECT query_id, doc_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 15
    """,
    "dense_topk": """
        WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM n),
        s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])), 6) AS score FROM u q, u d WHERE q.vec_id % 100 = 0)
        SELECT query_id, doc_id, score, CAST(place AS INTEGER) AS place
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) WHERE place <= 10
    """,
    "leg_weights": f"SELECT call_id AS query_id, CASE WHEN regexp_matches(product_hint, {_q(IDENTIFIER)}) THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS lexical, 1.0::DOUBLE AS dense FROM (SELECT DISTINCT call_id, product_hint FROM calls WHERE product_hint IS NOT NULL)",
    "topical_coverage": f"""
        WITH {_BM25_PARTS}, {_QUESTIONS}, {_COVERAGE} SELECT query_id, doc_id, round(coverage + 1e-9, 6) AS coverage FROM a JOIN covered USING (query_id, doc_id)
    """,
    "ranking_measures": f"""
        WITH {_BM25_PARTS}, {_bm25('canonical_name', 'a')}, rel AS (SELECT DISTINCT product_id AS query_id, doc_id FROM documents WHERE product_id IS NOT NULL),
        total AS (SELECT query_id, count(*) AS total FROM rel GROUP BY query_id),
        hits AS (SELECT query_id, count(*) FILTER (WHERE place <= 5) AS hits, min(place) AS first, sum(CASE WHEN place <= 5 THEN 1 / log2(place + 1.0) ELSE 0 END) AS dcg FROM a JOIN rel USING (query_id, doc_id) GROUP BY query_id)
        SELECT query_id, round(coalesce(hits, 0) / total + 1e-9, 6) AS recall, round(coalesce(1 / first, 0.0) + 1e-9, 6) AS rr,
               round(coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(total, 5) + 1), lambda i: 1 / log2(i + 1.0))) + 1e-9, 6) AS ndcg FROM total LEFT JOIN hits USING (query_id)
    """,
    "stale_documents": """
        SELECT doc_id, sha256(coalesce(title, '') || chr(10) || coalesce(text, '')) AS hash, 'hashed-256' AS signature FROM documents
        WHERE status IS DISTINCT FROM 'published'
    """,
    "threshold_sweep": """
        WITH s AS (SELECT coalesce(relevance, -1) AS score, CASE WHEN route_reason IN ('relevance', 'both') THEN 1 ELSE 0 END AS label FROM segments),
        c AS (SELECT k, count(*) FILTER (WHERE label = 1 AND floor(score * 20 + 1e-9) >= k) AS tp, count(*) FILTER (WHERE label = 0 AND floor(score * 20 + 1e-9) >= k) AS fp,
                     count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM s, range(0, 21) t(k) GROUP BY k)
        SELECT round(k / 20, 4) AS threshold, tp, fp, p - tp AS fn, n - fp AS tn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END + 1e-9, 6) AS precision,
               round(CASE WHEN p = 0 THEN 1.0 ELSE tp / p END + 1e-9, 6) AS recall, round(CASE WHEN p + n = 0 THEN 0.0 ELSE (tp + fp) / (p + n) END + 1e-9, 6) AS kept_share FROM c
    """,
    "annotator_kappa": f"""
        WITH one AS (SELECT item_id, min(value) FILTER (WHERE annotator = 'rules-2') AS a, min(value) FILTER (WHERE annotator = 'model-a') AS b FROM {_LABELS} GROUP BY item_id),
        pairs AS (SELECT * FROM one WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT count(*) AS items, count(*) FILTER (WHERE a = b) AS agreed FROM pairs),
        m AS (SELECT sum(x.n * y.n) AS m FROM (SELECT a AS v, count(*) AS n FROM pairs GROUP BY a) x JOIN (SELECT b AS v, count(*) AS n FROM pairs GROUP BY b) y USING (v))
        SELECT items, agreed, round(agreed / items + 1e-9, 6) AS observed, round(coalesce(m, 0)::DOUBLE / (items * items) + 1e-9, 6) AS expected,
               round((agreed / items - coalesce(m, 0)::DOUBLE / (items * items)) / (1 - coalesce(m, 0)::DOUBLE / (items * items)) + 1e-9, 6) AS kappa FROM n, m
    """,
    "contested_items": f"SELECT item_id, count(DISTINCT value) AS n_values, count(DISTINCT annotator) AS annotators FROM {_LABELS} GROUP BY item_id HAVING count(DISTINCT value) > 1",
    "groundedness": f"""
        WITH q AS (SELECT DISTINCT observation_id, segment_id, quote FROM evidence), s AS (SELECT DISTINCT segment_id, text FROM segments),
        b AS (SELECT observation_id, {_CONTENT('quote')} AS w, CASE WHEN text IS NULL THEN NULL ELSE {_CONTENT('text')} END AS h, text FROM q LEFT JOIN s USING (segment_id))
        SELECT observation_id AS claim_id, bool_or(CASE WHEN text IS NULL THEN false WHEN len(w) = 0 THEN true ELSE len(list_intersect(w, h)) / len(w) >= 0.6 - 1e-9 END) AS supported FROM b GROUP BY 1
    """,
    "stratified_sample": """
        WITH m AS (
            SELECT segment_id AS id, md5(segment_id) AS h, CASE WHEN abs(coalesce(relevance, 0.0) - 0.35) <= 0.05 THEN 'boundary' WHEN abs(coalesce(relevance, 0.0) - 0.35) <= 0.20 THEN 'near'
                   WHEN relevance >= 0.35 THEN 'keep' ELSE 'drop' END AS stratum FROM (SELECT DISTINCT segment_id, relevance FROM segments)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, id) <= CASE stratum WHEN 'boundary' THEN 90 WHEN 'near' THEN 60 WHEN 'keep' THEN 30 ELSE 20 END AS chosen FROM m)
        SELECT id, stratum FROM r ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, h, id LIMIT 200
    """,
    "graph_degrees": f"WITH {_EDGES} SELECT split_part(node, ':', 1) AS node_kind, count(*) AS nodes FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) GROUP BY 1",
    "graph_shared_modes": """
        SELECT issue_key, count(DISTINCT product_id) AS products, list_sort(list_distinct(list(product_id))) AS product_ids FROM observations GROUP BY issue_key HAVING count(DISTINCT product_id) > 1
    """,
    "graph_blast_radius": f"""
        WITH {_EDGES} SELECT l.dst AS node, count(DISTINCT o.src) AS products, count(DISTINCT l.src) AS issues
        FROM edges l JOIN edges o ON o.kind = 'has' AND o.dst = l.src WHERE starts_with(l.dst, 'version:') GROUP BY l.dst
    """,
    "corpus_languages": """
        SELECT source, status, CAST(grouping(source, status) AS INTEGER) AS level, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY CUBE (source, status)
    """,
    "star_join": """
        SELECT p_brand, r_name, count(*) AS mentions, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE l_returnflag = 'R') AS denying,
               round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4)) * (1 - CAST(l_discount AS DECIMAL(18, 4)))) AS DOUBLE), 2) AS volume
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY p_brand, r_name
    """,
    "p5_quarantine": """
        SELECT feed_name, file_no, line_no, payload FROM segment_feed WHERE NOT coalesce(json_valid(payload), false) OR left(ltrim(payload, ' ' || chr(9) || chr(10) || chr(13)), 1) <> '{'
    """,
    "issue_evidence": "SELECT DISTINCT product_id, issue_key, observation_id FROM observations",
    "candidates_with_evidence": """
        WITH i AS (SELECT product_id, issue_key, count(*) AS mentions FROM observations GROUP BY ALL), e AS (
            SELECT *, row_number() OVER (PARTITION BY product_id, issue_key ORDER BY confidence DESC, observation_id) AS place
            FROM (SELECT DISTINCT product_id, issue_key, observation_id, quote, confidence FROM evidence)
        ) SELECT product_id, issue_key, mentions, observation_id, quote, confidence, CAST(place AS INTEGER) AS place FROM i LEFT JOIN (SELECT * FROM e WHERE place <= 3) USING (product_id, issue_key)
    """,
    "pii_redact": "WITH a AS (SELECT DISTINCT observation_id, quote AS original, quote AS t FROM evidence)"
    + "".join(
        f", a{n} AS (SELECT observation_id, original, "
        + (f"list_reduce({_CARDS('original')}, lambda x, m: replace(x, m, '[REDACTED:CREDIT_CARD]'), t)" if k == "credit_card" else f"regexp_replace(t, {_q(p)}, '[REDACTED:{k.upper()}]', 'g')")
        + f" AS t FROM a{n - 1 if n else ''})"
        for n, (k, _, p) in enumerate(DLP_PATTERNS)
    )
    + f" SELECT DISTINCT observation_id, t AS redacted FROM a{len(DLP_PATTERNS) - 1}",
    "injection_excerpts": "WITH t AS (SELECT DISTINCT segment_id, text FROM segments) "
    + " UNION ".join(
        f"SELECT segment_id, '{n}' AS name, CASE WHEN length(b) < 20 THEN b ELSE right(b, 20) END || m || left(substring(text, length(b) + length(m) + 1), 20) AS excerpt "
        f"FROM (SELECT segment_id, text, regexp_extract(text, {_q('(?s)^(.*?)(?-s:' + p + ')')}, 1) AS b, regexp_extract(text, {_q(p)}, 0) AS m FROM t WHERE regexp_matches(text, {_q(p)}))"
        for n, _, p in INJECTION_SIGNATURES
    ),
    "identify_product": f"""
        WITH {_resolve(f'SELECT DISTINCT segment_id AS key, {_CUSTOMER} AS text FROM segments')}
        SELECT DISTINCT segment_id, coalesce(r.product_id, nullif(s.product_hint, '')) AS product_id, coalesce(r.confidence, CASE WHEN nullif(s.product_hint, '') IS NOT NULL THEN 0.75 END, 0.0) AS product_confidence
        FROM segments s LEFT JOIN resolved r ON r.key = s.segment_id
    """,
    "rule_observations": f"""
        WITH RECURSIVE s AS (SELECT DISTINCT segment_id, text, product_id, product_confidence, attribution_confidence FROM segments WHERE product_id IS NOT NULL),
        said AS (SELECT *, unnest({_LINES}) AS t, generate_subscripts({_LINES}, 1) - 1 AS pos FROM s),
        hit AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(t, {_q(p[4])}) THEN {n}" for n, p in enumerate(ISSUE_PATTERNS))} END AS rule FROM said),
        {_resolve("SELECT segment_id || '#' || pos AS key, t AS text FROM hit WHERE rule IS NOT NULL")},
        own AS (SELECT hit.* EXCLUDE (product_id, product_confidence, text), coalesce(r.product_id, hit.product_id) AS product_id, CASE WHEN r.product_id IS NULL THEN hit.product_confidence ELSE r.confidence END AS pc FROM hit LEFT JOIN resolved r ON r.key = segment_id || '#' || pos WHERE rule IS NOT NULL),
        cut AS (
            SELECT *, CASE rule {" ".join(f"WHEN {n} THEN regexp_extract(t, {_q('^(.*?)(?:' + p[4] + ')')}, 1)" for n, p in enumerate(ISSUE_PATTERNS))} END AS b,
                   CASE rule {" ".join(f"WHEN {n} THEN regexp_extract(t, {_q(p[4])}, 0)" for n, p in enumerate(ISSUE_PATTERNS))} END AS m,
                   regexp_matches(t, {_q(FIX_CLAIM)}) AS fixed,
                   least(1.0, round({" + ".join(f"CASE WHEN regexp_matches(t, {_q(p)}) THEN CAST({SEVERITY_WEIGHT[sv]} AS DOUBLE) ELSE 0 END" for _, sv, p in INJECTION_SIGNATURES)}, 6)) AS risk FROM own
        ), made AS (
            SELECT segment_id, product_id, pos, t, fixed, CASE rule {" ".join(f"WHEN {n} THEN '{p[0]}'" for n, p in enumerate(ISSUE_PATTERNS))} END AS issue_key,
                   CASE rule {" ".join(f"WHEN {n} THEN '{p[1]}'" for n, p in enumerate(ISSUE_PATTERNS))} END AS type, CASE rule {" ".join(f"WHEN {n} THEN '{p[2]}'" for n, p in enumerate(ISSUE_PATTERNS))} END AS severity,
                   CASE rule {" ".join(f"WHEN {n} THEN {_q(p[3])}" for n, p in enumerate(ISSUE_PATTERNS))} END AS summary,
                   round(round(least(CAST(0.97 AS DOUBLE), CAST(0.55 AS DOUBLE) + CAST(0.4 AS DOUBLE) * coalesce(pc, 0.0)), 3) * (1 - risk) * coalesce(attribution_confidence, 1.0) + 1e-9, 3) AS confidence,
                   left(trim(regexp_extract(b, '[^.?!]*$', 0) || m || regexp_extract(substring(t, length(b) + length(m) + 1), '^[^.?!]*[.?!]?', 0)), 400) AS evidence FROM cut
        ), best AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY confidence DESC, pos) AS r FROM made)
        SELECT 'O' || left(sha1(segment_id || ':' || issue_key), 14) AS observation_id, segment_id, best.product_id AS product_id, issue_key, CASE WHEN fixed AND type = 'bug_report' THEN 'praise' ELSE type END AS type,
               CASE WHEN fixed THEN 'low' ELSE severity END AS severity, CASE WHEN fixed THEN 'RESOLVED CLAIM: ' ELSE '' END || summary AS summary, confidence, evidence,
               CASE WHEN regexp_extract(t, {_q(VERSION_PATTERN)}, 1) <> '' AND len(list_filter(c.versions, lambda v: starts_with(v, regexp_extract(t, {_q(VERSION_PATTERN)}, 1)) OR starts_with(regexp_extract(t, {_q(VERSION_PATTERN)}, 1), v))) > 0 THEN regexp_extract(t, {_q(VERSION_PATTERN)}, 1) END AS product_version
        FROM best LEFT JOIN product_catalog c ON c.product_id = best.product_id WHERE r = 1
    """,
    "segment_calls": """
        WITH RECURSIVE c AS (SELECT DISTINCT call_id, customer_id, timestamp, region, turns FROM calls),
        one AS (SELECT *, row_number() OVER () AS rid FROM c),
        t AS (SELECT rid, unnest(turns) AS t, generate_subscripts(turns, 1) AS pos FROM one),
        u AS (
            SELECT rid, pos, coalesce(t.speaker, '') AS speaker, coalesce(t.text, '') AS text, t.speaker_confidence AS sure,
                   coalesce(t.speaker, '') = 'customer' AND len(list_filter(['another thing', 'also', 'separately', 'one more', 'by the way', 'different issue', 'unrelated', 'second problem'], lambda m: contains(lower(coalesce(t.text, '')), m))) > 0 AS marked FROM t
        ),
        walk AS (
            SELECT rid, pos, 0 AS g, length(text) AS size, length(text) > 1200 AS full FROM u WHERE pos = 1
            UNION ALL
            SELECT u.rid, u.pos, CASE WHEN w.full OR u.marked THEN w.g + 1 ELSE w.g END, CASE WHEN w.full OR u.marked THEN length(u.text) ELSE w.size + length(u.text) END,
                   CASE WHEN w.full OR u.marked THEN length(u.text) ELSE w.size + length(u.text) END > 1200
            FROM walk w JOIN u ON u.rid = w.rid AND u.pos = w.pos + 1
        ),
        grouped AS (
            SELECT rid, g, string_agg(speaker || ': ' || text, chr(10) ORDER BY pos) AS text, count(*) FILTER (WHERE speaker = 'customer') AS n, min(coalesce(sure, 1.0)) FILTER (WHERE speaker = 'customer') AS least, list(speaker) AS who
            FROM walk JOIN u USING (rid, pos) GROUP BY rid, g
        )
        SELECT call_id || '-S' || CASE WHEN g < 10 THEN '0' ELSE '' END || g AS segment_id, call_id, customer_id, timestamp, region, text,
               array_to_string(list_transform(list_sort(list_distinct(who)), lambda s: s || '=' || len(list_filter(who, lambda x: x = s))), ',') AS speaker_mix,
               CAST(n AS INTEGER) AS customer_turns, coalesce(least, 0.0) AS attribution_confidence, sha1(text) AS content_hash
        FROM grouped JOIN one USING (rid)
    """,
    "graph_hops": f"""
        WITH RECURSIVE {_EDGES}, ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
        walk AS (SELECT 'region:EUR' AS node, 0 AS hops WHERE EXISTS (SELECT 1 FROM ways WHERE src = 'region:EUR') UNION SELECT dst, hops + 1 FROM walk JOIN ways ON src = node WHERE hops < 12)
        SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY node
    """,
    "word_error_rate": """
        WITH RECURSIVE p AS (
            SELECT DISTINCT e.observation_id AS key, list_filter(regexp_split_to_array(lower(coalesce(o.evidence, '')), '\\s+'), lambda w: w <> '') AS r, list_filter(regexp_split_to_array(lower(coalesce(e.quote, '')), '\\s+'), lambda w: w <> '') AS h
            FROM (SELECT DISTINCT observation_id, quote FROM evidence) e JOIN (SELECT DISTINCT observation_id, evidence FROM observations) o USING (observation_id)
        ), n AS (SELECT *, row_number() OVER () AS rid FROM p),
        rows AS (
            SELECT rid, 0 AS i, range(0, len(h) + 1) AS d FROM n
            UNION ALL
            SELECT rid, i + 1, list_reduce(range(1, len(h) + 1), lambda a, j: list_append(a, least(a[len(a)] + 1, d[j + 1] + 1, d[j] + CASE WHEN r[i + 1] = h[j] THEN 0 ELSE 1 END)), [CAST(i + 1 AS BIGINT)])
            FROM rows JOIN n USING (rid) WHERE i < len(r)
        )
        SELECT key, CAST(d[len(d)] AS INTEGER) AS errors, CAST(len(r) AS INTEGER) AS words, round(d[len(d)] / greatest(len(r), 1) + 1e-9, 6) AS wer FROM rows JOIN n USING (rid) WHERE i = len(r)
    """,
    "lexical_search": f"""
        WITH {_BM25_PARTS}, {_QUESTIONS}, {_COVERAGE}, {_resolve('SELECT query_id AS key, query AS text FROM questions')},
        narrowed AS (SELECT s.query_id, s.doc_id, s.score FROM a_s s JOIN documents d USING (doc_id) LEFT JOIN (SELECT * FROM resolved WHERE confidence >= 0.85) r ON r.key = s.query_id WHERE r.product_id IS NULL OR r.product_id = d.product_id),
        leg AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM narrowed),
        fused AS (SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + place), 9) AS score FROM leg WHERE place <= 15),
        words AS (SELECT query_id, list_distinct({_TOKENS('query')}) AS w FROM questions),
        scored AS (
            SELECT query_id, doc_id, round(score * 10 + len(list_intersect(w, t)) / greatest(len(w), 1) + CASE status WHEN 'confirmed' THEN 0.15 WHEN 'published' THEN 0.10 WHEN 'observed' THEN 0.05 ELSE 0.0 END + 1e-9, 4) AS score, round(coverage + 1e-9, 3) AS coverage
            FROM fused JOIN covered USING (query_id, doc_id) JOIN words USING (query_id) JOIN docs USING (doc_id) JOIN (SELECT doc_id, status FROM documents) USING (doc_id) WHERE coverage > 0
        )
        SELECT query_id, doc_id, score, coverage, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM scored) WHERE place <= 5
    """,
    "counting_questions": f"""
        WITH {_QUESTIONS} SELECT DISTINCT query_id, regexp_matches(query, '(?i)(^|[^a-z0-9_])(how many|count|number of|total|top [0-9]+|most reported|how much)($|[^a-z0-9_])') AS counting
        FROM (SELECT query_id, query FROM questions UNION ALL SELECT CAST(doc_id AS VARCHAR), title FROM documents WHERE title IS NOT NULL)
    """,
    "asked_issues": f"""
        WITH {_QUESTIONS}, {_ISSUES}, {_resolve('SELECT query_id AS key, query AS text FROM questions')},
        words AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z]{{4,}}'))) AS word FROM questions),
        parts AS (SELECT DISTINCT issue_key, unnest(string_split(lower(issue_key), '_')) AS word FROM issues),
        best AS (SELECT query_id, issue_key FROM (SELECT query_id, issue_key, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, issue_key) AS r FROM words JOIN parts USING (word) GROUP BY query_id, issue_key) WHERE r = 1),
        asked AS (SELECT q.query_id, query, r.product_id AS p, b.issue_key AS i FROM questions q LEFT JOIN (SELECT * FROM resolved WHERE confidence >= 0.85) r ON r.key = q.query_id LEFT JOIN best b USING (query_id)),
        every AS (
            SELECT query_id, product_id, issue_key, customers, mentions, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN regexp_matches(query, '(?i)\bcustomer|report') THEN customers ELSE mentions END DESC, product_id, issue_key) AS place
            FROM asked, issues WHERE (p IS NULL OR product_id = p) AND (i IS NULL OR issue_key = i)
        ) SELECT query_id, product_id, issue_key, customers, mentions, CAST(place AS INTEGER) AS place FROM every WHERE place <= 10
    """,
    "top_issues": f"WITH {_ISSUES} SELECT product_id, issue_key, customers AS distinct_customers, mentions FROM issues ORDER BY customers DESC, product_id, issue_key LIMIT 10",
    "issue_documents": f"WITH {_ISSUES} {_ISSUE_DOCS}",
    "overview_documents": _OVERVIEW,
    "claim_views": f"""
        WITH {_ISSUES}, docs AS ({_OVERVIEW} UNION ALL {_ISSUE_DOCS})
        SELECT doc_id, left(title || '. ' || array_to_string(list_filter(list_transform(string_split(body, '. '), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(lower(s), '^(reported by|severity |status |first seen|last seen)')), '. '), 400) AS claim FROM docs
    """,
    "egress_decisions": f"""
        WITH c AS (SELECT DISTINCT call_id, coalesce(turns[1].text, '') AS payload, ascii(right(call_id, 1)) % 10 AS k FROM calls)
        SELECT DISTINCT call_id, ['hooks.example.com', 'api.example.com', '10.0.0.7', '169.254.169.254', 'example.com.evil.test', 'files.example.org', '[::1]', '', '192.168.1.4', 'notexample.com'][k + 1] AS host,
               CASE WHEN k = 7 THEN 'unparseable' WHEN k IN (2, 3, 6, 8) THEN 'private address' WHEN k IN (4, 9) THEN 'not in allowlist' WHEN {" OR ".join(f"regexp_matches(payload, {_q(_PATTERN[p])})" for p in SECRET_KINDS)} THEN 'secret in payload' ELSE 'allowed' END AS decision FROM c
    """,
    "read_only_statements": r"""
        SELECT doc_id, doc_id % 6 IN (0, 1, 4) AND NOT regexp_matches(title, '(?i)(insert|update|delete|drop|alter|truncate|create|attach|pragma|vacuum)') AND NOT contains(title, ';') AS allowed
        FROM (SELECT DISTINCT doc_id, title FROM documents WHERE title IS NOT NULL)
    """,
    "router_metrics": f"""
        WITH r AS ({_ROUTED}), c AS (
            SELECT count(*) FILTER (WHERE good AND keep) AS tp, count(*) FILTER (WHERE NOT good AND keep AND NOT attack) AS fp, count(*) FILTER (WHERE good AND NOT keep) AS fn, count(*) FILTER (WHERE NOT good AND NOT keep AND NOT attack) AS tn,
                   count(*) FILTER (WHERE NOT good AND attack AND keep) AS ak, count(*) FILTER (WHERE attack) AS attacks, count(*) FILTER (WHERE attack AND seen) AS hit, count(*) AS n FROM r
        ) SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END + 1e-9, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END + 1e-9, 6) AS recall,
                 round(CASE WHEN tp = 0 THEN CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 ELSE 0.0 END ELSE 2 * tp / (2 * tp + fp + fn) END + 1e-9, 6) AS f1, round(CASE WHEN attacks = 0 THEN 1.0 ELSE hit / attacks END + 1e-9, 6) AS attack_recall,
                 round(CASE WHEN tp + fp + ak = 0 THEN 1.0 ELSE tp / (tp + fp + ak) END + 1e-9, 6) AS precision_charging_attacks, round(CASE WHEN n = 0 THEN 0.0 ELSE (tp + fp + ak) / n END + 1e-9, 6) AS kept_share FROM c
    """,
    "errors_by_category": f"SELECT category, count(*) FILTER (WHERE CASE WHEN attack THEN NOT seen ELSE keep <> good END) AS errors, count(*) AS total FROM ({_ROUTED}) GROUP BY category",
    "silver_totals": """
        SELECT day, count(*) AS segments, CAST(coalesce(sum(pii_redactions), 0) AS BIGINT) AS redactions, count(*) FILTER (WHERE length(injection_signatures) > 2) AS injections,
               count(*) FILTER (WHERE route_reason IN ('relevance', 'both')) AS to_model FROM segments GROUP BY day
    """,
    "region_totals": "SELECT region, count(*) AS calls, CAST(sum(coalesce(len(turns), 0)) AS BIGINT) AS turns, count(DISTINCT coalesce(day, '-') || '|' || coalesce(centre, '<null>')) AS partitions FROM calls GROUP BY region",
    "count_mismatch": """
        WITH r AS (SELECT day, count(DISTINCT segment_id) AS routed FROM segments WHERE route_reason IN ('relevance', 'both') GROUP BY day), e AS (SELECT day, count(DISTINCT segment_id) AS extracted FROM observations GROUP BY day)
        SELECT day, coalesce(routed, 0) AS routed, coalesce(extracted, 0) AS extracted FROM r FULL JOIN e USING (day) WHERE coalesce(routed, 0) <> coalesce(extracted, 0)
    """,
    "unlabelled_pool": "SELECT DISTINCT segment_id, relevance FROM segments WHERE segment_id NOT IN (SELECT segment_id FROM observations WHERE segment_id IS NOT NULL)",
    "identifier_top1": f"""
        WITH {_BM25_PARTS}, {_bm25('canonical_name', 'a')}, {_bm25("split_part(canonical_name, ' ', 1) || ' ' || split_part(canonical_name, ' ', 2)", 'b')},
        rel AS (SELECT DISTINCT product_id AS query_id, doc_id FROM documents WHERE product_id IS NOT NULL), q AS (SELECT count(DISTINCT query_id) AS queries FROM rel),
        r AS (SELECT 'whole' AS leg, count(*) AS n FROM a JOIN rel USING (query_id, doc_id) WHERE place = 1 UNION ALL SELECT 'short', count(*) FROM b JOIN rel USING (query_id, doc_id) WHERE place = 1)
        SELECT leg, queries, n AS "right", round(n / queries + 1e-9, 6) AS accuracy FROM r, q
    """,
    "sentence_counts": r"""
        SELECT DISTINCT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[^.?!]+[.?!]*|[.?!]+'), lambda s: trim(s, ' ') <> '')) AS INTEGER) AS sentences FROM documents
    """,
    "known_issue_keys": "SELECT issue_key FROM observations WHERE issue_key IS NOT NULL UNION SELECT unnest(["
    + ", ".join(f"'{p[0]}'" for p in ISSUE_PATTERNS)
    + ", 'NEW_ISSUE'])",
    "payload_observations": """
        WITH o AS (SELECT DISTINCT segment_id, product_id, issue_key, type, summary, severity, evidence, confidence, attribution_confidence FROM observations WHERE confidence >= 0.3),
        k AS (SELECT *, CASE WHEN severity = 'low' THEN left('NEW__' || regexp_replace(upper(CASE WHEN coalesce(issue_key, '') = '' THEN 'UNLABELLED' ELSE issue_key END), '[^A-Z0-9_]', '_', 'g'), 60) ELSE left(regexp_replace(upper(coalesce(issue_key, '')), '[^A-Z0-9_]', '_', 'g'), 60) END AS key FROM o)
        SELECT DISTINCT 'O' || left(sha1(segment_id || ':' || key), 14) AS observation_id, segment_id, coalesce(product_id, '') AS product_id, CAST(NULL AS VARCHAR) AS product_version, coalesce(type, '') AS type, key AS issue_key, left(coalesce(summary, ''), 200) AS summary,
               coalesce(severity, '') AS severity, left(coalesce(evidence, ''), 400) AS evidence, round(coalesce(confidence, 0.0) * coalesce(attribution_confidence, 1.0) + 1e-9, 6) AS confidence FROM k
    """,
    "label_summary": f"""
        WITH l AS (SELECT * FROM {_LABELS}), odd AS (SELECT item_id FROM l GROUP BY item_id HAVING count(DISTINCT value) > 1)
        SELECT annotator, count(*) AS judgements, count(DISTINCT item_id) AS items, count(DISTINCT CASE WHEN item_id IN (SELECT item_id FROM odd) THEN item_id END) AS contested FROM l GROUP BY annotator
    """,
    "label_export": f"SELECT item_id, min(value) AS value FROM {_LABELS} GROUP BY item_id HAVING count(DISTINCT value) = 1",
    "evidence_sink": "SELECT day, count(*) AS n_rows, count(DISTINCT observation_id) AS observations FROM observations WHERE day IS NOT NULL GROUP BY day",
    "merged_issues": """
        WITH e AS (SELECT product_id, issue_key, count(*) AS n FROM observations WHERE day < '2026-03-08' GROUP BY ALL)
        SELECT o.product_id, o.issue_key, count(*) AS mentions, min(TRY_CAST(timestamp AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS first_seen, max(TRY_CAST(timestamp AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS last_seen,
               CASE WHEN any_value(e.n) > 20 THEN 'confirmed' ELSE 'observed' END AS status
        FROM observations o LEFT JOIN e ON e.product_id IS NOT DISTINCT FROM o.product_id AND e.issue_key IS NOT DISTINCT FROM o.issue_key GROUP BY o.product_id, o.issue_key
    """,
    "metrics_sink": """
        SELECT metric, value FROM (SELECT CAST(count(*) AS DOUBLE) AS observations, CAST(count(DISTINCT customer_id) AS DOUBLE) AS customers, round(avg(confidence), 6) AS mean_confidence FROM observations)
        UNPIVOT (value FOR metric IN (observations, customers, mean_confidence))
    """,
    "audit_sink": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'click' THEN 'policy_decision' WHEN 'view' THEN 'tool_executed' WHEN 'purchase' THEN 'publish' ELSE event_type END AS event, count(*) AS n_events
        FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL
    """,
    "index_update": """
        SELECT doc_id, sha256(coalesce(title, '') || chr(10) || coalesce(text, '')) AS hash, CASE WHEN status = 'published' THEN 1 ELSE 2 END AS round FROM documents
    """,
    "audit_tail": "SELECT ts, event_type AS event, event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 20",
    "stream_windows": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS \"start\", event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "speaker_at": f"""
        WITH {_SPANS}, stops AS (SELECT call_id, max(e) AS stop FROM spans GROUP BY call_id), points AS (SELECT call_id, unnest(range(0, CAST(floor(stop / 20) AS BIGINT) + 1)) AS id FROM stops),
        held AS (SELECT p.call_id, p.id, speaker, row_number() OVER (PARTITION BY p.call_id, p.id ORDER BY s, e, speaker) AS r FROM points p JOIN spans ON spans.call_id = p.call_id AND s <= p.id * 20.0 + 10.0 AND p.id * 20.0 + 10.0 < e WHERE speaker IS NOT NULL)
        SELECT call_id, CAST(id AS INTEGER) AS id, speaker FROM held WHERE r = 1
    """,
    "cluster_mapping": """
        WITH r AS (SELECT call_id, unnest(turns).speaker AS cluster, generate_subscripts(turns, 1) AS pos FROM (SELECT DISTINCT call_id, turns FROM calls)),
        n AS (SELECT *, lag(cluster) OVER w AS b, lead(cluster) OVER w AS a FROM r WINDOW w AS (PARTITION BY call_id ORDER BY pos)),
        m AS (SELECT call_id, cluster, CASE WHEN b IS NOT NULL AND b = a THEN b ELSE cluster END AS speaker, count(*) AS n FROM n WHERE cluster IS NOT NULL GROUP BY ALL)
        SELECT call_id, cluster, speaker, n AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY call_id, cluster ORDER BY n DESC, speaker) AS k FROM m WHERE speaker IS NOT NULL) WHERE k = 1
    """,
    "best_threshold": """
        WITH s AS (SELECT coalesce(relevance, -1) AS score, CASE WHEN route_reason IN ('relevance', 'both') THEN 1 ELSE 0 END AS label FROM segments),
        c AS (SELECT k, count(*) FILTER (WHERE label = 1 AND floor(score * 20 + 1e-9) >= k) AS tp, count(*) FILTER (WHERE label = 0 AND floor(score * 20 + 1e-9) >= k) AS fp,
                     count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM s, range(0, 21) t(k) GROUP BY k)
        SELECT round(k / 20, 4) AS threshold, tp, fp, p - tp AS fn, n - fp AS tn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END + 1e-9, 6) AS precision,
               round(CASE WHEN p = 0 THEN 1.0 ELSE tp / p END + 1e-9, 6) AS recall, round(CASE WHEN p + n = 0 THEN 0.0 ELSE (tp + fp) / (p + n) END + 1e-9, 6) AS kept_share FROM c
        WHERE p = 0 OR tp / p >= 0.9 ORDER BY kept_share, threshold DESC LIMIT 1
    """,
    "contamination": f"""
        WITH claims AS (SELECT DISTINCT call_id, trim(regexp_replace(lower(t.text), '\\s+', ' ', 'g')) AS claim FROM (SELECT call_id, unnest(turns) AS t FROM calls) WHERE lower(trim(t.speaker)) = 'agent' AND trim(regexp_replace(lower(t.text), '\\s+', ' ', 'g')) <> ''),
        lines AS (SELECT segment_id, call_id, trim(regexp_replace(lower(unnest({_LINES})), '\\s+', ' ', 'g')) AS line FROM (SELECT DISTINCT segment_id, call_id, text FROM segments)),
        tainted AS (SELECT DISTINCT segment_id FROM lines JOIN claims USING (call_id) WHERE line <> '' AND (contains(line, claim) OR contains(claim, line))),
        o AS (SELECT DISTINCT observation_id, segment_id, issue_key, attribution_confidence FROM observations)
        SELECT issue_key, count(*) AS observations, count(*) FILTER (WHERE attribution_confidence < 0.5) AS weak, count(*) FILTER (WHERE segment_id IN (SELECT segment_id FROM tainted)) AS contaminated FROM o GROUP BY issue_key
    """,
    "status_listing": f"WITH {_ISSUES} SELECT product_id, issue_key, severity, CASE WHEN mentions >= 100 THEN 'confirmed' ELSE 'observed' END AS status, customers, mentions FROM issues",
    "routing_accuracy": """
        SELECT 2 * count(*) AS questions, 2 * count(*) AS routed, count(*) AS unanswerable, count(*) AS abstained FROM product_catalog
    """,
    "ranking_by_family": f"""
        SELECT family AS category, count(*) AS queries, round(avg(recall) + 1e-9, 6) AS recall, round(avg(rr) + 1e-9, 6) AS rr, round(avg(ndcg) + 1e-9, 6) AS ndcg FROM (WITH {_BM25_PARTS}, {_bm25('canonical_name', 'a')}, rel AS (SELECT DISTINCT product_id AS query_id, doc_id FROM documents WHERE product_id IS NOT NULL),
        total AS (SELECT query_id, count(*) AS total FROM rel GROUP BY query_id),
        hits AS (SELECT query_id, count(*) FILTER (WHERE place <= 5) AS hits, min(place) AS first, sum(CASE WHEN place <= 5 THEN 1 / log2(place + 1.0) ELSE 0 END) AS dcg FROM a JOIN rel USING (query_id, doc_id) GROUP BY query_id)
        SELECT query_id, round(coalesce(hits, 0) / total + 1e-9, 6) AS recall, round(coalesce(1 / first, 0.0) + 1e-9, 6) AS rr,
               round(coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(total, 5) + 1), lambda i: 1 / log2(i + 1.0))) + 1e-9, 6) AS ndcg FROM total LEFT JOIN hits USING (query_id)) m JOIN product_catalog ON product_id = query_id GROUP BY family
    """,
    "p6_found": """
        SELECT product_id, issue_key FROM observations GROUP BY ALL
        HAVING count(*) > 0.01 * (SELECT count(*) FROM observations)
    """,
    "p6_profile": """
        SELECT product_id, issue_key, count(*) AS mentions, count(DISTINCT customer_id) AS customers,
               min(CAST(timestamp AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS first_at,
               max(CAST(timestamp AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS last_at,
               round(CAST(sum(CAST(confidence AS DECIMAL(18, 9))) AS DOUBLE) / count(confidence) + 1e-9, 6) AS mean_confidence
        FROM observations GROUP BY product_id, issue_key
    """,
}
