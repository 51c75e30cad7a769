"""Products named in text: unambiguous terms, tiers of evidence, versions."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import customer_lines, normalised

#: Confidence of each tier of evidence, and the ratio above which a fuzzy match counts.
EXACT, ALIAS, VERSION, GENERIC, FUZZY, FUZZY_FLOOR = 0.99, 0.90, 0.70, 0.60, 0.7, 0.62
VERSION_PATTERN = r"(?i)\b(?:v|version|firmware|release|build)?\s*(\d+\.\d+(?:\.\d+)?)\b"


def unambiguous(catalog: DataFrame, column: str) -> DataFrame:
    """Values of an array column that exactly one product has: (term, product_id)."""
    terms = catalog.select("product_id", F.explode(column).alias("raw")).select("product_id", (normalised(F.col("raw")) if column == "generic_aliases" else F.col("raw")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("owners"), F.first("product_id").alias("product_id")).filter("owners = 1").select("term", "product_id")


def _terms(catalog: DataFrame) -> DataFrame:
    """(product_id, kind, term, confidence): everything a text may hold of a product, but versions."""
    names = catalog.select("product_id", F.lit("sku").alias("kind"), normalised(F.col("product_id")).alias("term"), F.lit(EXACT).alias("confidence"))
    canonical = catalog.select("product_id", F.lit("name").alias("kind"), normalised(F.col("canonical_name")).alias("term"), F.lit(EXACT).alias("confidence"))
    aliases = catalog.select("product_id", F.lit("alias").alias("kind"), F.explode("aliases").alias("a")).select("product_id", "kind", normalised(F.col("a")).alias("term"), F.lit(ALIAS).alias("confidence"))
    generic = unambiguous(catalog, "generic_aliases").select("product_id", F.lit("generic").alias("kind"), "term", F.lit(GENERIC).alias("confidence"))
    return names.unionByName(canonical).unionByName(aliases).unionByName(generic)


#: Distinct first words of catalog terms that are sent with the plan; with more the words are joined without looking ahead.
MOST_LEADS = 10_000


def resolve_products(texts: DataFrame, catalog: DataFrame, *, fuzzy: bool = False) -> DataFrame:
    """(key, product_id, confidence) of each text by its best tier; texts without any are left out.

    The first word of every term is looked up among the text's words, so candidates
    come from an equality join, not from text times catalog; the whole term is then
    checked in place. Of equally good products the earlier of the catalog wins; its
    order is that of ``product_id`` here. ``fuzzy`` adds the last tier where nothing
    better than a generic noun is found.
    """
    norm = texts.select("key", normalised(F.col("text")).alias("norm"), "text")
    terms = _terms(catalog).withColumn("lead", F.split(F.trim("term"), " +")[0])
    said = F.array_distinct(F.split(F.trim("norm"), " +"))
    leads = [r[0] for r in terms.select("lead").distinct().limit(MOST_LEADS + 1).collect()]
    # Only words that begin a term are exploded, so a text is not copied for each of its words.
    words = norm.select("key", "norm", F.explode(F.array_intersect(said, F.lit(leads).cast("array<string>")) if len(leads) <= MOST_LEADS else said).alias("lead"))
    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    whole = padded.contains(F.concat(F.lit(" "), F.col("term"), F.lit(" "))) | (F.col("kind") == "name") & F.col("norm").contains(F.col("term"))
    by_term = words.join(terms, "lead").filter(whole).select("key", "product_id", "confidence")
    said = norm.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(VERSION_PATTERN), F.lit(1)))).alias("term"))
    by_version = said.join(unambiguous(catalog, "versions"), "term").select("key", "product_id", F.lit(VERSION).alias("confidence"))
    found = _best(by_term.unionByName(by_version))
    if not fuzzy:
        return found
    # A fuzzy match reaches FUZZY at most, and ties go to the better evidence.
    sure = found.filter(F.col("confidence") >= FUZZY).select("key")
    return _best(found.unionByName(fuzzy_products(texts.join(sure, "key", "left_anti"), catalog)))


def _best(found: DataFrame) -> DataFrame:
    best = found.groupBy("key").agg(F.min_by(F.struct("product_id", "confidence"), F.struct(-F.col("confidence"), F.col("product_id"))).alias("b"))
    return best.select("key", "b.product_id", "b.confidence")


def fuzzy_products(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """The fuzzy tier alone: (key, product_id, confidence) where some alias resembles the first 60 characters.

    Ratcliff-Obershelp has no built-in form. The catalog is the small side and is
    refused, not cut, beyond 10,000 products; each distinct beginning is matched once,
    and only with aliases that its length leaves a chance.
    """
    rows = catalog.select("product_id", F.transform("aliases", lambda a: normalised(a)).alias("aliases")).orderBy("product_id").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the fuzzy tier is for catalogs of at most 10,000 products")
    known = [(r["product_id"], a) for r in rows for a in r["aliases"] or []]
    longest = max((len(a) for _, a in known), default=0)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size = sorted(known, key=lambda k: len(k[1]))
        for b in batches:
            out = []
            for head in b["head"]:
                best = (0.0, "")
                for pid, alias in by_size:
                    # No more than the shorter of both can agree.
                    if 2 * min(len(alias), len(head)) <= FUZZY_FLOOR * (len(alias) + len(head)):
                        if len(alias) > len(head):
                            break
                        continue
                    ratio = SequenceMatcher(None, alias, head).ratio()
                    if ratio > FUZZY_FLOOR and (ratio > best[0] or ratio == best[0] and pid < best[1]):
                        best = (ratio, pid)
                if best[1]:
                    out.append((head, best[1], round(best[0] * FUZZY, 3)))
            yield pd.DataFrame(out, columns=["head", "product_id", "confidence"])

    heads = texts.select("key", F.substring(normalised(F.col("text")), 1, 60).alias("head"))
    heads = heads.filter((F.col("head") != "") & (F.length("head") * FUZZY_FLOOR < (2 - FUZZY_FLOOR) * F.lit(longest)))
    matched = heads.select("head").distinct().mapInPandas(match, "head string, product_id string, confidence double")
    return heads.join(matched, "head").select("key", "product_id", "confidence")


#: Fixed value: confidence of a product that only the call's hint names.
HINT = 0.75


def identify_products(segments: DataFrame, catalog: DataFrame, *, fuzzy: bool = False) -> DataFrame:
    """(segment_id, product_id, product_confidence) of each row (segment_id, text, product_hint).

    What the customer says comes first, then the hint; the agent's words never count.
    """
    said = segments.select(F.col("segment_id").alias("key"), customer_lines(F.col("text")).alias("text"))
    named = resolve_products(said, catalog, fuzzy=fuzzy).toDF("segment_id", "said_id", "said_confidence")
    hint = F.nullif(F.col("product_hint"), F.lit(""))
    return segments.select("segment_id", "product_hint").join(named, "segment_id", "left").select(
        "segment_id",
        F.coalesce("said_id", hint).alias("product_id"),
        F.coalesce("said_confidence", F.when(hint.isNotNull(), HINT), F.lit(0.0)).alias("product_confidence"),
    )


def resolve_versions(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, product_id, version): first version said that is, or begins, one of the product's, or the other way round."""
    said = texts.select("key", "product_id", F.regexp_extract("text", VERSION_PATTERN, 1).alias("version")).filter("version <> ''")
    known = catalog.select("product_id", "versions")
    fits = F.exists("versions", lambda v: v.startswith(F.col("version")) | F.col("version").startswith(v))
    return said.join(known, "product_id").filter(fits).select("key", "product_id", "version")
