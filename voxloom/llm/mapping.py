"""Free-entered product hints mapped to the catalog, in SQL only.

Partition-based pigeonhole join. A reference string that may be missed by k edits
is cut into k+1 segments; whatever lies within k edits of it holds one of them
unchanged, at most k places off. So an equality join of segments with positional
substrings of the keys finds every candidate, which the built-in ``levenshtein``
then verifies; what stays without a product comes out of an anti-join.

Digits are never edited: a model number is right or another model. Distinct hints
are mapped once and joined back, so a hint that fills a third of the calls costs
one row in the search.

Defined results: null and empty hints give no row; a hint that fits two products
equally well, or only a kind of device, is UNMATCHED; repeated calls give one row
per product; an empty catalog leaves all hints UNMATCHED.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

UNMATCHED = "UNMATCHED"
#: Edits allowed in a reference string with at least LONG letters; shorter ones must be equal.
EDITS = 2
LONG = 6
#: Shortest abbreviation of a product family, as in "Quor. 250".
PREFIX = 3


def _fold_tables() -> tuple[str, str]:
    """Characters that stand for one ASCII character (wide forms, accented Latin), by rule."""
    pairs = {}
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x3000, *range(0xFF01, 0xFF5F)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and len(plain) == 1 and plain.isascii() and plain not in "'\\":
            pairs[c] = plain
    return "".join(pairs), "".join(pairs.values())


def _folded(x: str) -> str:
    old, new = _fold_tables()
    return f"regexp_replace(lower(translate({x}, '{old}', '{new}')), '\\\\p{{M}}+', '')"


def _compact(x: str) -> str:
    return f"regexp_replace({x}, '[^a-z0-9]+', '')"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]+', '')"


def _repaired(x: str) -> str:
    """Letters typed for digits inside a model number."""
    return f"translate({x}, 'oil', '011')"


def _run(spark: SparkSession, statement: str, **frames: DataFrame) -> DataFrame:
    """A statement whose only placeholders are the names of ``frames``; other braces are text."""
    text = statement.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(text, **frames)


def references_sql() -> str:
    """Keys by which a product may be named: (product_id, ref, k, ref_len)."""
    name, words = _folded("canonical_name"), f"split(trim({_folded('canonical_name')}), '[^a-z0-9]+')"
    return f"""
        WITH named AS (
            SELECT product_id, {name} AS name, {words} AS words,
                   transform(coalesce(aliases, array()), a -> {_folded('a')}) AS aliases
            FROM {{catalog}} WHERE product_id IS NOT NULL
        ), every AS (
            SELECT product_id, explode(concat(
                array({_folded('product_id')}, name),
                aliases,
                transform(aliases, a -> regexp_replace(a, '^the ', '')),
                CASE WHEN size(words) > 1 AND words[1] RLIKE '^[0-9]+$' THEN concat(
                    transform(sequence({PREFIX}, greatest({PREFIX}, length(words[0]))), n -> concat(left(words[0], n), words[1])),
                    array(concat(words[0], words[1], element_at(words, -1)), concat(element_at(words, -1), words[0], words[1]))
                ) ELSE array() END
            )) AS ref
            FROM named
        ), keyed AS (
            SELECT DISTINCT product_id, {_compact('ref')} AS ref FROM every
        )
        SELECT product_id, ref, length(ref) AS ref_len,
               CASE WHEN length(ref) - length({_digits('ref')}) >= {LONG} THEN {EDITS} ELSE 0 END AS k
        FROM keyed WHERE ref <> ''
    """


def keys_sql() -> str:
    """Keys of each distinct hint: the whole of it, and a name with its model number."""
    clean = (
        f"regexp_replace({_folded('product_hint')}, "
        r"'\\([^)]*\\)|\\bcustomer\\W?s\\b|\\bsku\\b|\\bqty\\b\\W*[0-9]+|\\b(?:fw|firmware|version|v)\\b\\W*[0-9][0-9.]*', ' ')"
    )
    model = r"([a-z]+)[^a-z0-9]*([0-9][0-9oil]{2})(?![a-z0-9])"
    spelled = r"^([a-z]+)([0-9][0-9oil]{2})$"
    return f"""
        WITH hints AS (
            SELECT DISTINCT product_hint FROM {{calls}} WHERE product_hint <> ''
        ), cleaned AS (
            SELECT product_hint, {clean} AS t FROM hints
        ), every AS (
            SELECT product_hint, explode(array(
                {_compact('t')},
                concat(regexp_extract({_compact('t')}, '{spelled}', 1), {_repaired(f"regexp_extract({_compact('t')}, '{spelled}', 2)")}),
                concat(regexp_extract(t, '{model}', 1), {_repaired(f"regexp_extract(t, '{model}', 2)")})
            )) AS key
            FROM cleaned
        )
        SELECT DISTINCT product_hint, key, length(key) AS key_len FROM every WHERE key <> ''
    """


def matches_sql() -> str:
    """The product of each distinct hint that has exactly one nearest."""
    seg_start, seg_end = "(ref_len * s) DIV (k + 1)", "(ref_len * (s + 1)) DIV (k + 1)"
    return f"""
        WITH pieces AS (
            SELECT product_id, ref, ref_len, k, s, substring(ref, {seg_start} + 1, {seg_end} - {seg_start}) AS piece
            FROM {{refs}} LATERAL VIEW explode(sequence(0, k)) AS s
        ), lengths AS (
            SELECT DISTINCT ref_len, k FROM {{refs}}
        ), aimed AS (
            SELECT product_hint, key, key_len, ref_len, k, s, shift
            FROM (SELECT product_hint, key, key_len, explode(sequence(key_len - {EDITS}, key_len + {EDITS})) AS ref_len FROM {{keys}})
            JOIN lengths USING (ref_len)
            LATERAL VIEW explode(sequence(0, k)) AS s
            LATERAL VIEW explode(sequence(-k, k)) AS shift
            WHERE abs(key_len - ref_len) <= k
        ), probes AS (
            SELECT DISTINCT product_hint, key, ref_len, k, s,
                   substring(key, {seg_start} + shift + 1, {seg_end} - {seg_start}) AS piece
            FROM aimed WHERE {seg_start} + shift >= 0 AND {seg_end} + shift <= key_len
        ), verified AS (
            SELECT DISTINCT product_hint, product_id, levenshtein(key, ref, k) AS edits
            FROM probes JOIN pieces USING (ref_len, k, s, piece)
            WHERE {_digits('key')} = {_digits('ref')} AND levenshtein(key, ref, k) >= 0
        ), nearest AS (
            SELECT product_hint, min(edits) AS edits FROM verified GROUP BY product_hint
        )
        SELECT product_hint, max(product_id) AS product_id
        FROM verified JOIN nearest USING (product_hint, edits)
        GROUP BY product_hint HAVING count(DISTINCT product_id) = 1
    """


def map_hints(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """``call_id``, ``product_id`` of each call with a hint; UNMATCHED where the catalog has none."""
    spark = calls.sparkSession
    calls = calls.select("call_id", "product_hint")
    refs = _run(spark, references_sql(), catalog=catalog)
    keys = _run(spark, keys_sql(), calls=calls)
    matches = _run(spark, matches_sql(), refs=refs, keys=keys)
    return _run(
        spark,
        f"""
        SELECT DISTINCT c.call_id, m.product_id FROM {{calls}} c JOIN {{matches}} m USING (product_hint)
        UNION
        SELECT DISTINCT c.call_id, '{UNMATCHED}' AS product_id
        FROM {{calls}} c LEFT ANTI JOIN {{matches}} m ON c.product_hint = m.product_hint
        WHERE c.product_hint <> ''
        """,
        calls=calls,
        matches=matches,
    )
