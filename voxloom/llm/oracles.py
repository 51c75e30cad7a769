"""DuckDB statements that must give the rows of the queries of the same names."""

from voxloom.llm.mapping import _fold_tables
from voxloom.llm.quality import COMMON_WORDS

_OLD, _NEW = _fold_tables()


def _fold(x: str) -> str:
    return f"lower(translate({x}, '{_OLD}', '{_NEW}'))"


def _only(x: str, kept: str) -> str:
    return f"regexp_replace({x}, '[^{kept}]+', '', 'g')"


#: Every distinct hint against every reference string: no segments, no index.
_P7 = f"""
    WITH named AS (
        SELECT product_id, {_fold('canonical_name')} AS name, coalesce(aliases, []) AS aliases FROM product_catalog
    ), parts AS (
        SELECT *, split_part(name, ' ', 1) AS brand, split_part(name, ' ', 2) AS model, split_part(name, ' ', -1) AS kind FROM named
    ), every AS (
        SELECT product_id, {_fold('product_id')} AS ref FROM parts
        UNION ALL SELECT product_id, name FROM parts
        UNION ALL SELECT product_id, {_fold('unnest(aliases)')} FROM parts
        UNION ALL SELECT product_id, regexp_replace({_fold('unnest(aliases)')}, '^the ', '') FROM parts
        UNION ALL SELECT product_id, left(brand, n) || model FROM parts, range(3, 40) r(n) WHERE n <= length(brand)
        UNION ALL SELECT product_id, brand || model || kind FROM parts
        UNION ALL SELECT product_id, kind || brand || model FROM parts
    ), refs AS (
        SELECT DISTINCT product_id, {_only('ref', 'a-z0-9')} AS ref FROM every
    ), hints AS (
        SELECT DISTINCT product_hint, regexp_replace(regexp_replace({_fold('product_hint')}, '\\p{{M}}+', '', 'g'),
            '\\([^)]*\\)|\\bcustomer\\W?s\\b|\\bsku\\b|\\bqty\\b\\W*[0-9]+|\\b(?:fw|firmware|version|v)\\b\\W*[0-9][0-9.]*', ' ', 'g') AS t
        FROM calls WHERE product_hint <> ''
    ), models AS (
        SELECT product_hint, {_only('t', 'a-z0-9')} AS whole,
               regexp_extract(t || ' ', '([a-z]+)[^a-z0-9]*([0-9][0-9oil][0-9oil])[^a-z0-9]', ['a', 'm']) AS near,
               regexp_extract({_only('t', 'a-z0-9')}, '^([a-z]+)([0-9][0-9oil][0-9oil])$', ['a', 'm']) AS spelled
        FROM hints
    ), keys AS (
        SELECT product_hint, whole AS key FROM models
        UNION SELECT product_hint, near.a || translate(near.m, 'oil', '011') FROM models
        UNION SELECT product_hint, spelled.a || translate(spelled.m, 'oil', '011') FROM models
    ), close AS (
        SELECT product_hint, product_id, levenshtein(key, ref) AS edits FROM keys, refs
        WHERE key <> '' AND {_only('key', '0-9')} = {_only('ref', '0-9')}
          AND levenshtein(key, ref) <= CASE WHEN length({_only('ref', 'a-z')}) >= 6 THEN 2 ELSE 0 END
    ), best AS (
        SELECT product_hint, max(product_id) AS product_id
        FROM (SELECT *, rank() OVER (PARTITION BY product_hint ORDER BY edits) AS r FROM close)
        WHERE r = 1 GROUP BY product_hint HAVING count(DISTINCT product_id) = 1
    )
    SELECT DISTINCT call_id, coalesce(product_id, 'UNMATCHED') AS product_id
    FROM calls LEFT JOIN best USING (product_hint) WHERE product_hint <> ''
"""

_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in COMMON_WORDS)
#: Lines as Python cuts them, blank ones left out; what is no letter parts words.
_P10 = f"""
    WITH l AS (
        SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: NOT regexp_full_match(x, '[\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}\\x{{0b}}]*'))) AS x
        FROM (SELECT DISTINCT doc_id, text FROM documents)
    ), f AS (
        SELECT doc_id, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{M}}]+') AS w, length(x) AS chars, length(regexp_replace(x, '[^\\p{{N}}]', '', 'g')) AS digits, length(regexp_replace(x, '[^\\s]', '', 'g')) AS spaces,
               regexp_matches(x, '[.!?…:;,]["''”’»)\\]]*\\s*$') AS ended FROM l
    ), s AS (
        SELECT doc_id, sum(len(w)) AS n, sum(list_sum(list_transform(w, lambda t: length(t)))) AS letters, count(*) AS lines, count(*) FILTER (WHERE ended) AS ended, sum(len(list_filter(w, lambda t: t IN ({_COMMON})))) AS common,
               sum(greatest(chars - coalesce(list_sum(list_transform(w, lambda t: length(t))), 0) - digits - spaces, 0)) AS symbols, sum(chars - spaces) AS solid FROM f GROUP BY doc_id
    )
    SELECT DISTINCT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(CASE WHEN n > 0 THEN letters / n ELSE 0.0 END + 1e-9, 6) AS mean_word_length, round(CASE WHEN solid > 0 THEN symbols / solid ELSE 0.0 END + 1e-9, 6) AS symbol_ratio,
           round(CASE WHEN lines > 0 THEN ended / lines ELSE 0.0 END + 1e-9, 6) AS punctuated_lines, round(CASE WHEN n > 0 THEN common / n ELSE 0.0 END + 1e-9, 6) AS common_words
    FROM documents LEFT JOIN s USING (doc_id)
"""

ORACLES = {
    "p10_figures": _P10,
    "p3_coverage": """
        SELECT DISTINCT rec_id, CAST(turn_pos AS INTEGER) AS turn_pos, CAST(length(text) AS INTEGER) AS n_chars, true AS quoted, true AS within, true AS joined FROM (
            SELECT segment_id AS rec_id, -1 AS turn_pos, text FROM segments
            UNION ALL SELECT call_id, pos - 1, turn.text FROM (SELECT call_id, unnest(turns) AS turn, generate_subscripts(turns, 1) AS pos FROM calls)
        ) WHERE length(text) > 1200
    """,
    "p3_found": """
        SELECT DISTINCT segment_id AS rec_id, CAST(-1 AS INTEGER) AS turn_pos FROM segments WHERE length(text) > 1200
        UNION
        SELECT DISTINCT call_id, CAST(pos - 1 AS INTEGER)
        FROM (SELECT call_id, unnest(turns) AS turn, generate_subscripts(turns, 1) AS pos FROM calls)
        WHERE length(turn.text) > 1200
    """,
    "p7_found": _P7,
}
