"""New batches against everything accepted before, by a forest of sorted signatures.

Texts are compared as spoken words (case, accents, fillers, labels and number
spelling aside). A text's signature is TREES * DEPTH min-hashes over word pairs, one
byte each. Permutation k of the forest orders all texts by one number, its ``code``:
customer and k in the upper half, DEPTH min-hashes below. Texts that resemble each
other share a prefix of their codes in some permutation, and the texts with a prefix
are one range of the sorted codes.

A ``Run`` keeps this on disk: the permutations, sorted by code and bucketed by the
shortest prefix that a search may need, and beside them what verifying a candidate
takes. A batch is signed alone and looked up in the ranges of the runs; a run is
neither signed nor shuffled again. ``extended`` makes a run of what a batch had
accepted, ``merge_runs`` merges runs into one. Prefixes of a few hot ranges are
spread over SALTS buckets, for which their lookups are repeated.

Against the runs all of a batch searches by the prefix that reaches RECALL, for every
partner is asked for. Within the batch, prefixes widen step by step: first each text
meets only the earliest of its range at full depth, a star, so that a group of
near-copies costs one link a text and permutation; texts that no link settles search
by shorter prefixes until RECALL is reached. What is rejected then meets the accepted
texts of the batch, so that all of its partners are named. Candidates are verified by
the longest common subsequence of their words.

Acceptance follows the order (batch, instant, id): a text is accepted unless an
earlier accepted text of the same customer is repeated by it.

Defined results: rows with null text, customer or id repeat nothing; a segment id
that is stored twice counts once; texts without any word compare by their characters;
an unreadable timestamp sorts first in its batch; of equal accepted texts only the
first is named; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.wording import spoken_words
from voxloom.session import cut, scratch, small, stored

TREES, DEPTH = 28, 4
#: Share of the words that must be common in order, and share of such pairs that a search must find.
SAME, RECALL = 0.8, 0.95
#: Share of equal min-hashes below which a candidate is not compared word by word (more than 3 deviations below the least similar repeat).
SKETCH_FLOOR = 0.3
#: Bytes of one side of all candidate pairs that may be broadcast; more are shuffled.
SMALL_BYTES = 16_000_000
#: Texts in the sample that hot ranges are recognised by, the share of it that makes one, and buckets for each. Layout only.
HOT_SAMPLE, HOT_SHARE, SALTS = 20_000, 0.01, 16
#: Rows of a permutation in one bucket.
BUCKET_ROWS = 500_000


def pair_similarity(same: float = SAME) -> float:
    """Least Jaccard similarity of word pairs when each word is kept with probability ``same``."""
    return same**2 / (2 - same**2)


def widening(recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """Prefix lengths from the longest down to the first by which a pair just similar enough meets with probability ``recall``."""
    s = pair_similarity()
    enough = [d for d in range(depth, 0, -1) if 1 - (1 - s**d) ** trees >= recall]
    return list(range(depth, (enough[0] if enough else 1) - 1, -1))


REACH = widening()[-1]
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(1, 2**32, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x85EBCA6B)
    h = h ^ (h >> np.uint32(13))
    return h * np.uint32(0xC2B2AE35)


def signatures(words: list[np.ndarray]) -> np.ndarray:
    """(texts, TREES * DEPTH) bytes of min-hashes over the pairs of neighbouring words; texts must have a word."""
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate(words).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before = np.concatenate([[0], flat[:-1]]).astype(np.uint32)
    before[starts] = 0
    pair = _mixed(before << np.uint32(16) | flat)
    out = np.empty((len(words), TREES * DEPTH), np.uint32)
    h = np.empty_like(pair)
    for k in range(TREES * DEPTH):
        np.multiply(pair, _MUL[k], out=h)
        h += _ADD[k]
        h ^= h >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(h, starts)
    return (_mixed(out) >> np.uint32(24)).astype(np.uint8)


def codes(customers: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """(texts, TREES) sortable numbers: hash of customer and permutation, then the min-hashes of the permutation."""
    tree = np.arange(TREES, dtype=np.uint32) * np.uint32(0x9E3779B1)
    owner = _mixed(customers.astype(np.int64).view(np.uint64).astype(np.uint32)[:, None] ^ _mixed(tree)[None, :])
    digits = np.ascontiguousarray(sketches.reshape(-1, TREES, DEPTH)).view(">u4")[:, :, 0]
    return (owner.astype(np.uint64) << np.uint64(32) | digits.astype(np.uint64)).view(np.int64)


def common_in_order(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over the first sequence."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for w in b:
        u = row & places.get(w, 0)
        row = row + u | row - u
    return len(a) - (row & every).bit_count()


def _numbers_of(token: str) -> tuple[int, ...]:
    return tuple(int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=2).digest(), "little") for w in spoken_words(token))


def _word_numbers(text: str, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The spoken words of a text as numbers. Nothing about a word depends on what is beyond white space, so each written form is read once."""
    out: list[int] = []
    for token in text.split():
        n = known.get(token)
        if n is None:
            n = known[token] = _numbers_of(token)
        out += n
    return np.array(out, np.uint16)


def entries(rows: DataFrame) -> DataFrame:
    """Of rows (segment_id, customer_id, text, batch, at): words, their hash and sketch. A text without words has the sketch of its hash."""
    rows = rows.select("segment_id", "customer_id", "batch", "at", "text").dropna(subset=["segment_id", "customer_id", "text"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                b = whole.slice(k, 2000)
                texts = b.column(4).to_pylist()
                words = [_word_numbers(t, known) for t in texts]
                if len(known) > 500_000:
                    known.clear()
                digest = [hashlib.blake2b(w.tobytes() if len(w) else t.encode("utf-8", "replace"), digest_size=16).digest() for w, t in zip(words, texts, strict=True)]
                full = [i for i, w in enumerate(words) if len(w)]
                sketches = [(d * TREES)[: TREES * DEPTH] for d in digest]
                if full:
                    for i, s in zip(full, signatures([words[i] for i in full]), strict=True):
                        sketches[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:4], pa.array(digest, pa.binary()), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(sketches, pa.binary())],
                    ["segment_id", "customer_id", "batch", "at", "digest", "words", "sketch"],
                )

    return rows.mapInArrow(sign, "segment_id string, customer_id string, batch int, at timestamp, digest binary, words binary, sketch binary")


_ORDER = ("batch", "at", "segment_id")


@dataclass(frozen=True)
class Signed:
    """Signed rows: ``rows`` (all, with ``doc``), ``copies`` (doc, original) and ``heads``, the first of each equal text of a customer."""

    rows: DataFrame
    copies: DataFrame
    heads: DataFrame


def _stored_in(df: DataFrame, place: str | None) -> DataFrame:
    if place is None:
        return stored(df)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def signed(rows: DataFrame, first_doc: int = 0, place: str | None = None) -> Signed:
    """Sign rows once and store them; ``doc`` numbers start at ``first_doc``."""
    rows = _stored_in(entries(rows).withColumn("doc", F.monotonically_increasing_id() + F.lit(first_doc)), place)
    keyed = rows.select("doc", "customer_id", "digest", F.struct(*_ORDER, "doc").alias("ord"))
    first = keyed.groupBy("customer_id", "digest").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = stored(keyed.join(first, ["customer_id", "digest"]).select("doc", F.col("first.doc").alias("original")).filter("doc <> original"))
    return Signed(rows, copies, rows.join(small(copies.select("doc")), "doc", "left_anti"))


def permuted(texts: DataFrame) -> DataFrame:
    """(code, doc): the code of each text in each permutation."""

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4000):
                b = whole.slice(k, 4000)
                code = codes(b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.repeat(b.column(0).to_numpy(), TREES))], ["code", "doc"])

    source = texts.select("doc", F.xxhash64("customer_id").alias("customer"), "sketch")
    return source.mapInArrow(permute, "code bigint, doc bigint")


def _stem(code: str) -> F.Column:
    return F.shiftright(code, 8 * (DEPTH - REACH))


def _slot(stem: F.Column, part: F.Column, hot: list[int]) -> F.Column:
    return F.when(stem.isin(hot), F.xxhash64(stem, part)).otherwise(stem) if hot else stem


@dataclass(frozen=True)
class Run:
    """One persisted run of accepted texts.

    ``texts`` holds what signing gave; ``forest`` (slot, code, doc) the permutations,
    sorted by code in buckets by ``slot``, the prefix at REACH or a part of a hot one.
    """

    place: str
    texts: DataFrame
    forest: DataFrame
    hot: list[int]
    next_doc: int


_FOREST = "slot BIGINT, code BIGINT, doc BIGINT"


def _opened(spark: SparkSession, place: str, buckets: int, hot: list[int], next_doc: int) -> Run:
    name = f"forest_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({_FOREST}) USING parquet CLUSTERED BY (slot) SORTED BY (slot, code) INTO {buckets} BUCKETS LOCATION '{place}/forest'")
    return Run(place, spark.read.parquet(f"{place}/texts"), spark.table(name), hot, next_doc)


def open_run(spark: SparkSession, place: str) -> Run:
    """A run that an earlier application has built in ``place``."""
    return _opened(spark, place, **json.loads(spark.read.text(f"{place}/about", wholetext=True).first()[0]))


def _close_run(spark: SparkSession, place: str, rows: DataFrame, next_doc: int) -> Run:
    """Write the forest of ``rows`` (code, doc) and what is to be known of it."""
    texts = spark.read.parquet(f"{place}/texts")
    n = texts.count()
    every = max(1, n // HOT_SAMPLE)
    sample = permuted(texts.filter(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0)).groupBy(_stem("code").alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    hot = [r[0] for r in sample.filter(F.col("n") > max(100, round(HOT_SHARE * n / every))).select("stem").collect()]
    buckets = 2 ** max(3, math.ceil(math.log2(max(1, n * TREES / BUCKET_ROWS))))
    placed = rows.select(_slot(_stem("code"), F.pmod("doc", F.lit(SALTS)), hot).alias("slot"), "code", "doc")
    # The exchange hashes as the buckets do, so each bucket is one sorted file.
    made = f"forest_{uuid.uuid4().hex}"
    ordered = placed.repartition(buckets, "slot").sortWithinPartitions("slot", "code")
    ordered.write.format("parquet").option("path", f"{place}/forest").option("compression", "zstd").bucketBy(buckets, "slot").sortBy("slot", "code").saveAsTable(made)
    spark.sql(f"DROP TABLE {made}")
    about = {"buckets": buckets, "hot": hot, "next_doc": next_doc}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{place}/about")
    return _opened(spark, place, **about)


def _new_place(spark: SparkSession, place: str | None) -> str:
    return place or scratch(spark, "run")


def _numbered(rows: DataFrame, batch: F.Column) -> DataFrame:
    return rows.select("segment_id", "customer_id", "text", batch.alias("batch"), F.col("timestamp").try_cast("timestamp").alias("at"))


def build_run(accepted: DataFrame, place: str | None = None) -> Run:
    """Sign and persist accepted rows (segment_id, customer_id, text, timestamp), in ``place`` or else in the shared folder."""
    spark = accepted.sparkSession
    place = _new_place(spark, place)
    made = signed(_numbered(accepted, F.lit(0)), 0, f"{place}/texts")
    return _close_run(spark, place, permuted(made.heads), 1 << 54)


def merge_runs(*runs: Run, place: str | None = None) -> Run:
    """One run of several: their sorted permutations are merged as they are, nothing is signed again."""
    spark = runs[0].texts.sparkSession
    place = _new_place(spark, place)
    texts, rows = runs[0].texts, runs[0].forest
    for r in runs[1:]:
        texts, rows = texts.unionByName(r.texts), rows.unionByName(r.forest)
    texts.write.option("compression", "zstd").parquet(f"{place}/texts")
    return _close_run(spark, place, rows.select("code", "doc"), max(r.next_doc for r in runs))


def lookup(texts: DataFrame, run: Run, depth: int) -> DataFrame:
    """(a, b): texts (doc, customer_id, sketch) with all texts of the run in one of their ranges at ``depth``.

    The run is read bucket by bucket as it lies; only the batch is exchanged.
    """
    below = 8 * (DEPTH - depth)
    low = F.shiftleft(F.shiftright("code", below), below)
    parts = F.when(_stem("code").isin(run.hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if run.hot else F.array(F.lit(0))
    asked = permuted(texts).select("doc", low.alias("low"), (low + F.lit((1 << below) - 1)).alias("high"), _stem("code").alias("stem"), F.explode(parts).alias("part"))
    asked = asked.select(F.col("doc").alias("a"), "low", "high", _slot(F.col("stem"), F.col("part").cast("bigint"), run.hot).alias("slot"))
    met = asked.join(run.forest.withColumnRenamed("doc", "b"), "slot").filter(F.col("code").between(F.col("low"), F.col("high")))
    return met.select("a", "b").distinct()


def star_links(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(a, b): each text with the earliest text of every range it is in."""
    ranges = permuted(texts).withColumn("range", F.shiftright("code", 8 * (DEPTH - depth)))
    ranges = ranges.join(texts.select("doc", F.struct(*_ORDER, "doc").alias("ord")), "doc")
    earliest = ranges.groupBy("range").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return ranges.join(earliest, "range").select(F.col("doc").alias("a"), F.col("first.doc").alias("b")).filter("a <> b").distinct()


def wide_candidates(searching: DataFrame, texts: DataFrame, depth: int) -> DataFrame:
    """(a, b): texts of ``searching`` with all of ``texts`` in one of their ranges at ``depth``."""
    mine, others = (permuted(x).select(F.col("doc").alias(n), F.shiftright("code", 8 * (DEPTH - depth)).alias("range")) for x, n in ((searching, "a"), (texts, "b")))
    return mine.join(others, "range").filter("a <> b").select("a", "b").distinct()


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs (a of ``left``, b of ``right``) whose words agree in order, as (a, b) with the later text first."""
    near = pairs.join(left.select(F.col("doc").alias("a"), F.col("sketch").alias("x")), "a").join(right.select(F.col("doc").alias("b"), F.col("sketch").alias("y")), "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, TREES * DEPTH) for k in (2, 3))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= SKETCH_FLOOR))

    near = stored(near.select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint"))
    held = lambda t, s: t.select(F.col("doc").alias(s), F.struct("words", "digest", "customer_id", F.struct(*_ORDER, "doc").alias("ord")).alias(f"_{s}"))
    # Few pairs meet the stored words where these are scanned; many are shuffled with them.
    with_a = stored(held(left, "a").join(small(near), "a"))
    size = with_a.agg(F.sum(F.length("_a.words") + 160)).first()[0] or 0
    both = held(right, "b").join(F.broadcast(with_a) if size <= SMALL_BYTES else with_a, "b").filter("_a.customer_id = _b.customer_id")
    later = F.col("_a.ord") > F.col("_b.ord")
    turned = both.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("b"), F.col("_a.words").alias("x"), F.col("_b.words").alias("y"), (F.col("_a.digest") == F.col("_b.digest")).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, same in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                x, y = memoryview(x).cast("H").tolist(), memoryview(y).cast("H").tolist()
                n = max(len(x), len(y))
                keep.append(same or n > 0 and min(len(x), len(y)) >= SAME * n and common_in_order(x, y) >= SAME * n)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return turned.mapInArrow(compare, "a bigint, b bigint").distinct()


def settle(links: DataFrame) -> DataFrame:
    """(doc, accepted) of all texts in links (a later, b earlier): accepted unless linked to an earlier accepted text.

    Rounds: who has an accepted earlier partner is rejected, who has only rejected
    ones is accepted. The earliest undecided text is decided in every round.
    """
    later = links.select(F.col("a").alias("doc")).distinct().withColumn("later", F.lit(True))
    both = links.select(F.col("b").alias("doc")).unionByName(later.select("doc")).distinct()
    state = cut(both.join(later, "doc", "left").select("doc", F.when(F.col("later").isNull(), True).alias("accepted")))
    while not state.filter("accepted IS NULL").isEmpty():
        seen = links.join(state.select(F.col("doc").alias("b"), F.col("accepted").alias("ok")), "b")
        said = seen.groupBy(F.col("a").alias("doc")).agg(F.max("ok").alias("any"), F.count_if(F.col("ok").isNull()).alias("open"))
        verdict = F.when(F.col("any"), False).when(F.col("open") == 0, True)
        state = cut(state.join(said, "doc", "left").select("doc", F.coalesce("accepted", verdict).alias("accepted")))
    return state


def _within(fresh: DataFrame, late: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, rejected docs) among the heads of a batch: ``fresh`` repeat nothing older, ``late`` are rejected already."""
    texts = fresh.unionByName(late)
    links = None
    for depth in widening()[:-1] or [REACH]:
        met = star_links(fresh, depth) if links is None else star_links(fresh, depth).join(links, ["a", "b"], "left_anti")
        one = verified(met, fresh, fresh)
        links = stored(one if links is None else links.unionByName(one).distinct())
    todo = fresh.join(small(stored(links.select(F.col("a").alias("doc")).distinct())), "doc", "left_anti")
    searched = state = None
    while state is None or not todo.isEmpty():
        links = stored(links.unionByName(verified(wide_candidates(todo, fresh, REACH), fresh, fresh)).distinct())
        state = settle(links)
        searched = todo.select("doc") if searched is None else searched.unionByName(todo.select("doc"))
        # Accepted only because the few links it has lead to rejected texts: it has to search for itself.
        unsure = stored(state.filter("accepted").select("doc").join(searched, "doc", "left_anti"))
        todo = fresh.join(small(unsure), "doc", "left_semi")
    rejected = stored(state.filter("NOT accepted").select("doc"))
    # Rejected texts have met the earliest of their ranges or older texts, not all accepted ones of the batch.
    # Which texts are accepted is settled, so these links name more partners and change no verdict.
    partly = texts.join(small(stored(rejected.unionByName(late.select("doc")).join(searched, "doc", "left_anti"))), "doc", "left_semi")
    goal = fresh.join(small(rejected), "doc", "left_anti")
    more = verified(wide_candidates(partly, goal, REACH), texts, goal)
    return stored(links.unionByName(more).distinct()), rejected


@dataclass(frozen=True)
class Checked:
    """A checked batch: ``found`` (segment_id, repeats), and the accepted heads that a run can be made of."""

    found: DataFrame
    accepted: DataFrame
    next_doc: int


def check_batch(incoming: DataFrame, *runs: Run) -> Checked:
    """Check rows (segment_id, customer_id, text, timestamp, batch_no) against all runs and each other."""
    first_doc = max((r.next_doc for r in runs), default=0)
    new = signed(_numbered(incoming, F.coalesce("batch_no", F.lit(1)).cast("int")), first_doc)
    heads = new.heads
    older = [stored(verified(lookup(heads, r, REACH), heads, r.texts)) for r in runs]
    links_old = None
    for o in older:
        links_old = o if links_old is None else links_old.unionByName(o)
    gone = stored((links_old.select(F.col("a").alias("doc")) if older else heads.select("doc").limit(0)).distinct())
    fresh, late = heads.join(small(gone), "doc", "left_anti"), heads.join(small(gone), "doc", "left_semi")
    links, rejected = _within(fresh, late)

    order = F.struct(*_ORDER)
    out = rejected.unionByName(gone)
    originals = new.copies.select(F.col("original").alias("doc")).distinct().join(out, "doc", "left_anti")
    # A text accepted later than its rejected partner is repeated by the copies that follow it.
    both_ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    inner = both_ways.join(out.withColumnRenamed("doc", "b"), "b", "left_anti").select("a", "b").unionByName(originals.select(F.col("doc").alias("a"), F.col("doc").alias("b")))
    named = [(new.rows, inner), *((r.texts, o) for r, o in zip(runs, older, strict=True))]
    targets = None
    for texts, pairs in named:
        t = texts.select(F.col("doc").alias("b"), F.col("segment_id").alias("repeats"), order.alias("ord_b")).join(small(stored(pairs.distinct())), "b")
        targets = t if targets is None else targets.unionByName(t)
    members = new.rows.select("doc", "segment_id", order.alias("ord")).join(small(new.copies), "doc", "left")
    members = members.withColumn("a", F.coalesce("original", "doc"))
    found = members.join(targets, "a").filter((F.col("ord_b") < F.col("ord")) & (F.col("segment_id") != F.col("repeats")))
    accepted = heads.join(out, "doc", "left_anti")
    return Checked(found.select("segment_id", "repeats").distinct(), accepted, first_doc + (1 << 54))


def extended(checked: Checked, place: str | None = None) -> Run:
    """What a batch had accepted, as a run of accepted texts; nothing is signed again."""
    spark = checked.accepted.sparkSession
    place = _new_place(spark, place)
    checked.accepted.withColumn("batch", F.lit(0)).write.option("compression", "zstd").parquet(f"{place}/texts")
    return _close_run(spark, place, permuted(spark.read.parquet(f"{place}/texts")), checked.next_doc)


def repeated_segments(accepted: DataFrame, incoming: DataFrame) -> DataFrame:
    """``segment_id``, ``repeats``: each incoming segment and the accepted segments that it repeats."""
    return check_batch(incoming, build_run(accepted)).found
