"""Measures over predictions, rankings, annotators and quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.text import content_words, speaker_lines


def _ratio(a: str, b: str, empty: float) -> F.Column:
    return F.round(F.when(F.col(b) == 0, empty).otherwise(F.col(a) / F.col(b)) + 1e-9, 6)


def threshold_sweep(scored: DataFrame, steps: int = 20) -> DataFrame:
    """Confusion counts and rates of (score, label) at every threshold k / steps, in one pass.

    Scores are counted by the number of thresholds they reach; running sums from
    above give every cut, so rows are not multiplied by thresholds.
    """
    reach = F.greatest(F.lit(-1), F.least(F.lit(steps), F.floor(F.col("score") * steps + 1e-9).cast("int")))
    cells = scored.select(F.coalesce(reach, F.lit(-1)).alias("k"), F.coalesce("label", F.lit(0)).cast("int").alias("label")).groupBy("k").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    every = scored.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("k"))
    filled = every.join(cells, "k", "left").fillna(0)
    above = Window.orderBy(F.desc("k"))  # at most steps + 2 rows
    whole = Window.partitionBy()
    out = filled.select("k", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n")).filter("k >= 0")
    out = out.withColumns({"kept": F.col("tp") + F.col("fp"), "rows": F.col("p") + F.col("n")})
    return out.select(F.round(F.col("k") / steps, 4).alias("threshold"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"), _ratio("tp", "kept", 1.0).alias("precision"), _ratio("tp", "p", 1.0).alias("recall"), _ratio("kept", "rows", 0.0).alias("kept_share"))


def best_threshold(sweep: DataFrame, floor: float = 0.9) -> DataFrame:
    """The threshold that keeps least with a recall of at least ``floor``; the higher of equals."""
    good = sweep.filter(F.col("recall") >= floor)
    return good.orderBy("kept_share", F.desc("threshold")).limit(1)


def ranking_measures(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Recall@k, reciprocal rank and nDCG@k of every query with a relevant document."""
    rel = relevant.select("query_id", "doc_id").distinct()
    total = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    hits = ranked.join(rel, ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.count(F.when(F.col("place") <= k, 1)).alias("hits"),
        F.min("place").alias("first"),
        F.sum(F.when(F.col("place") <= k, 1 / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    both = total.join(hits, "query_id", "left").fillna(0, ["hits", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return both.select("query_id", F.round(F.col("hits") / F.col("total") + 1e-9, 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)) + 1e-9, 6).alias("rr"), F.round(F.col("dcg") / ideal + 1e-9, 6).alias("ndcg"))


def ranking_by_category(measures: DataFrame, categories: DataFrame) -> DataFrame:
    """Means of the measures of queries by their category (query_id, category)."""
    by = measures.join(categories, "query_id").groupBy("category")
    mean = lambda c: F.round(F.avg(c) + 1e-9, 6).alias(c)
    return by.agg(F.count(F.lit(1)).alias("queries"), mean("recall"), mean("rr"), mean("ndcg"))


def cohen_kappa(labels: DataFrame, first: str, second: str) -> DataFrame:
    """Observed and expected agreement, and kappa, of two annotators over the items both labelled.

    ``labels`` has item_id, annotator, value; of several values of one annotator for
    an item the smallest counts.
    """
    one = labels.filter(F.col("annotator").isin(first, second)).groupBy("item_id").agg(
        F.min(F.when(F.col("annotator") == first, F.col("value"))).alias("a"), F.min(F.when(F.col("annotator") == second, F.col("value"))).alias("b")
    )
    both = one.filter("a IS NOT NULL AND b IS NOT NULL")
    sides = both.select(F.explode(F.array(F.struct(F.lit(1).alias("s"), F.col("a").alias("v")), F.struct(F.lit(2).alias("s"), F.col("b").alias("v")))).alias("x"))
    share = sides.groupBy("x.v").agg(F.count_if(F.col("x.s") == 1).alias("na"), F.count_if(F.col("x.s") == 2).alias("nb"))
    chance = share.agg(F.sum(F.col("na") * F.col("nb")).alias("m"))
    n = both.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("a") == F.col("b")).alias("agreed"))
    joined = n.join(F.broadcast(chance))  # one row each
    po, pe = F.try_divide(F.col("agreed"), F.col("items")), F.try_divide(F.coalesce("m", F.lit(0)), F.col("items") * F.col("items"))
    return joined.select("items", "agreed", F.round(po + 1e-9, 6).alias("observed"), F.round(pe + 1e-9, 6).alias("expected"), F.round(F.try_divide(po - pe, 1 - pe) + 1e-9, 6).alias("kappa"))


def contested(labels: DataFrame) -> DataFrame:
    """Items with more than one value."""
    return labels.groupBy("item_id").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("annotator").alias("annotators")).filter("n_values > 1")


def groundedness(claims: DataFrame, share: float = 0.6) -> DataFrame:
    """(claim_id, supported) of (claim_id, claim, source): enough content words of the claim are in one source.

    A claim without content words is supported; one without any source is not.
    """
    words, held = content_words(F.col("claim")), content_words(F.col("source"))
    rate = F.size(F.array_intersect(words, held)) / F.size(words)
    ok = F.when(F.col("source").isNull(), False).when(F.size(words) == 0, True).otherwise(rate >= share - 1e-9)
    return claims.groupBy("claim_id").agg(F.bool_or(ok).alias("supported"))


def word_error_rate(pairs: DataFrame) -> DataFrame:
    """(key, errors, words, wer) of (key, reference, hypothesis) by edit distance over words.

    Each different word of a pair becomes one character of a private numbering, so that
    the built-in edit distance of characters is that of words.
    """
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    rows = pairs.select("key", split(F.col("reference")).alias("r"), split(F.col("hypothesis")).alias("h"))
    rows = rows.withColumn("known", F.array_distinct(F.concat("r", "h")))

    def letter(word: F.Column) -> F.Column:
        c = F.array_position("known", word).cast("int") + 0x10000
        six = lambda shift: F.shiftright(c, shift).bitwiseAND(63)
        utf8 = F.lit(0xF0808080) + six(18) * (1 << 24) + six(12) * (1 << 16) + six(6) * (1 << 8) + six(0)
        return F.unhex(F.hex(utf8)).cast("string")

    spelled = lambda words: F.array_join(F.transform(words, letter), "")
    done = rows.select("key", F.levenshtein(spelled("r"), spelled("h")).alias("errors"), F.size("r").alias("words"))
    return done.withColumn("wer", F.round(F.col("errors") / F.greatest("words", F.lit(1)) + 1e-9, 6))


#: Score from which a segment is kept.
KEEP = 0.35


def router_metrics(scored: DataFrame, threshold: float = KEEP) -> DataFrame:
    """One row of counts and rates of (score, label, attack): attacks are a class of their own, to be forwarded whatever their score."""
    keep, attack, label = F.coalesce(F.col("score") >= threshold, F.lit(False)), F.coalesce("attack", F.lit(False)), F.coalesce("label", F.lit(0)) == 1
    only = attack & ~label
    n = lambda test, name: F.count_if(test).alias(name)
    c = scored.agg(n(~only & label & keep, "tp"), n(~only & ~label & keep, "fp"), n(~only & label & ~keep, "fn"), n(~only & ~label & ~keep, "tn"), n(only & keep, "attacks_scored"), n(attack, "attacks"), n(attack & F.coalesce("seen", F.lit(False)), "attacks_seen"), F.count(F.lit(1)).alias("n_rows"))
    c = c.withColumns({"kept": F.col("tp") + F.col("fp"), "good": F.col("tp") + F.col("fn"), "charged": F.col("tp") + F.col("fp") + F.col("attacks_scored")})
    p, r = F.when(F.col("kept") == 0, 1.0).otherwise(F.col("tp") / F.col("kept")), F.when(F.col("good") == 0, 1.0).otherwise(F.col("tp") / F.col("good"))
    return c.select("tp", "fp", "fn", "tn", _ratio("tp", "kept", 1.0).alias("precision"), _ratio("tp", "good", 1.0).alias("recall"), F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)) + 1e-9, 6).alias("f1"), _ratio("attacks_seen", "attacks", 1.0).alias("attack_recall"), _ratio("tp", "charged", 1.0).alias("precision_charging_attacks"), _ratio("charged", "n_rows", 0.0).alias("kept_share"))


def errors_by_category(scored: DataFrame, threshold: float = KEEP) -> DataFrame:
    """(category, errors, total) of (category, score, label, attack, seen): an attack is an error if it is not seen, else a wrong side of the threshold is."""
    wrong = F.when(F.coalesce("attack", F.lit(False)), ~F.coalesce("seen", F.lit(False))).otherwise(F.coalesce(F.col("score") >= threshold, F.lit(False)) != (F.coalesce("label", F.lit(0)) == 1))
    return scored.groupBy("category").agg(F.count_if(wrong).alias("errors"), F.count(F.lit(1)).alias("total"))


def top1_by_leg(legs: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """(leg, queries, right, accuracy): how often the first place of a leg is among the expected documents of a query.

    ``expected`` has query_id, doc_id; queries without any are not counted.
    """
    wanted = expected.select("query_id", "doc_id").distinct()
    queries = wanted.select("query_id").distinct()
    out = None
    for name, leg in legs.items():
        hit = leg.filter("place = 1").join(wanted, ["query_id", "doc_id"], "left_semi").select("query_id").withColumn("hit", F.lit(1))
        one = queries.join(hit, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), F.count("hit").alias("right")).withColumn("leg", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("leg", "queries", "right", _ratio("right", "queries", 1.0).alias("accuracy"))


def contamination(observations: DataFrame, claims: DataFrame, segments: DataFrame, floor: float = 0.5) -> DataFrame:
    """Per issue_key: observations, weakly attributed ones, and those whose segment holds the agent's claim on a customer's line.

    ``claims`` has call_id, claim: an agent's sentence; calls without any are clean.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    lines = F.transform(speaker_lines(F.col("text")), plain)
    held = claims.select("call_id", plain(F.col("claim")).alias("claim")).filter("claim <> ''").distinct()
    of = segments.select("segment_id", "call_id", lines.alias("lines")).join(held, "call_id")
    reached = F.exists("lines", lambda x: (x != "") & (x.contains(F.col("claim")) | F.col("claim").contains(x)))
    tainted = of.filter(reached).select("segment_id").distinct().withColumn("tainted", F.lit(True))
    rows = observations.select("observation_id", "segment_id", "issue_key", "attribution_confidence").distinct().join(tainted, "segment_id", "left")
    return rows.groupBy("issue_key").agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("attribution_confidence") < floor).alias("weak"), F.count_if("tainted").alias("contaminated"))


def label_summary(labels: DataFrame) -> DataFrame:
    """(annotator, judgements, items, contested): of an annotator's items, how many others judge otherwise."""
    odd = contested(labels).select("item_id").withColumn("odd", F.lit(True))
    return labels.join(odd, "item_id", "left").groupBy("annotator").agg(F.count(F.lit(1)).alias("judgements"), F.count_distinct("item_id").alias("items"), F.count_distinct(F.when(F.col("odd"), F.col("item_id"))).alias("contested"))


def majority_mapping(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each cluster (keys, cluster) the truth that most of its rows have, the smaller of equals."""
    n = rows.filter("truth IS NOT NULL").groupBy(*keys, "cluster", "truth").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys, "cluster").agg(F.min_by("truth", F.struct(-F.col("n"), F.col("truth"))).alias("speaker"), F.max("n").alias("n_rows"))
