"""Held-out passages inside corpus documents, by greedy string tiling.

Words of the test items become small numbers; a document is the sequence of these
numbers, with one shared number for any word that no item has. Fixed-length seeds
of both sides are hashed with a Karp-Rabin polynomial and joined on the hash; a
(document, item) pair whose seeds cover enough of the item is tiled: of the
remaining matches the longest is marked again and again, never overlapping a
marked one, so reordered and interrupted passages are covered too. Each neighbourhood
of diagonals is also tiled by itself, so that a quotation elsewhere in the document
takes no words from a passage in order; there only words that match count.

The items are the small side: they are cut into blocks of bounded size, each block
is sent to the executors once, and documents stream past it. Documents are never
shuffled and never cut.

Seeds are as long as half of an item that is shorter than two of them, so items of
any length are found. A row is given for each pair of which the tiles in any order or
one passage in order cover at least SHARE of the item; both shares are reported.

Defined results: null, empty and blank texts and items without words give no row;
repeated documents give equal rows once; an empty table on either side gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

WORD = re.compile(r"[^\W_]+")
#: Words in a seed, at most.
SEED = 4
#: Words of items in one block that is sent to the executors (8 bytes a seed).
BLOCK_WORDS = 2_000_000
#: Share of an item's words that a passage must hold, and of words that may be changed in it.
SHARE, CHANGED = 0.5, 0.1
#: Changed words beyond that share, for unevenly spread changes, and words between two tiles of a passage.
SLACK, GAP = 2, 12
#: Share of an item in seeds of one diagonal band from which a pair is tiled: well below what SHARE
#: leaves when each tenth word is changed. Bands are wide against words added or left out.
SEED_COVER, BAND = 0.2, 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin values of every window of ``width`` numbers, modulo 2**64."""
    out = np.zeros(max(0, len(values) - width + 1), np.uint64)
    for k in range(width):
        out = out * BASE + (values[k : k + len(out)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out


def common_seeds(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(place in doc, place in item) of every shared seed, in order of the first."""
    where: dict[int, list[int]] = {}
    for j, h in enumerate(rolling_hash(item, width).tolist()):
        where.setdefault(h, []).append(j)
    return [(i, j) for i, h in enumerate(rolling_hash(doc, width).tolist()) for j in where.get(h, ())]


def greedy_tiles(seeds: list[tuple[int, int]], doc_size: int, item_size: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of maximal non-overlapping matches, longest first.

    Shared seeds of ``shortest`` words that touch on one diagonal are one match;
    marking the longest cuts the others, whose free parts are tried again.
    """
    runs: dict[int, list[list[int]]] = {}
    for i, j in seeds:
        of = runs.setdefault(i - j, [])
        if of and i <= of[-1][0] + of[-1][1] - shortest + 1:
            of[-1][1] = i + shortest - of[-1][0]
        else:
            of.append([i, shortest])
    heap = sorted(((n, i, i - d) for d, of in runs.items() for i, n in of), key=lambda m: (-m[0], m[1], m[2]))
    doc_free, item_free = np.ones(doc_size, bool), np.ones(item_size, bool)
    tiles = []
    while heap:
        n, i, j = heap.pop(0)
        free = doc_free[i : i + n] & item_free[j : j + n]
        if free.all():
            doc_free[i : i + n] = item_free[j : j + n] = False
            tiles.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= shortest:
                heap.append((b - a, i + a, j + a))
        heap.sort(key=lambda m: (-m[0], m[1], m[2]))
    return tiles


def passage(tiles: list[tuple[int, int, int]], doc: np.ndarray, item: np.ndarray, *, changed_too: bool = True) -> int:
    """Words of the item spanned, or those matched, by the best chain of tiles in order with few changed words.

    Between two tiles of a chain the item and the document go on by nearly as many
    words; those of the item count as changed where they differ.
    """
    best = 0
    chains: list[dict[int, int]] = []  # for each tile: start in item -> most words matched since
    tiles = sorted(tiles)
    for k, (i, j, n) in enumerate(tiles):
        own = {j: n}
        for p in range(max(0, k - 12), k):
            pi, pj, pn = tiles[p]
            di, dj = i - pi - pn, j - pj - pn
            if 0 <= di <= GAP and 0 <= dj <= GAP and abs(di - dj) <= 2:
                same = int((doc[pi + pn : i] == item[pj + pn : j]).sum()) if di == dj else 0
                for start, got in chains[p].items():
                    own[start] = max(own.get(start, 0), got + same + n)
        chains.append(own)
        for start, got in own.items():
            span = j + n - start
            if span - got <= CHANGED * span + SLACK:
                best = max(best, span if changed_too else got)
    return best


class ItemBlock:
    """Seed index of some items; plain arrays, so that it can be sent to executors."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        split = [words(t) for t in texts]
        self.vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for s in split for w in s))}
        self.ids = ids
        self.items = [np.array([self.vocabulary[w] for w in s], np.int64) for s in split]
        self.sizes = np.array([len(s) for s in split], np.int64)
        self.widths = np.minimum(SEED, np.maximum(1, np.ceil(SHARE * self.sizes).astype(np.int64)))
        self.index = {}
        for width in sorted(set(self.widths[self.sizes > 0].tolist())):
            owners = np.flatnonzero((self.widths == width) & (self.sizes > 0))
            hashes = [rolling_hash(self.items[k], width) for k in owners]
            owner, place = np.repeat(owners, [len(h) for h in hashes]), np.concatenate([np.arange(len(h)) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            distinct, first = np.unique(flat[order], return_index=True)
            self.index[width] = (distinct, first, np.diff(np.append(first, len(flat))), owner[order], place[order])

    def find(self, docs: list[tuple[object, str | None]]) -> Iterator[tuple[object, object, float, float]]:
        """(doc id, item id, share covered by tiles in any order, share of the passage in order) where either reaches SHARE."""
        get = self.vocabulary.get
        for doc_id, text in docs:
            seq = np.array([get(w, 0) for w in words(text)], np.int64)
            for width in self.index:
                yield from ((doc_id, *r) for r in self._pairs(seq, width))

    def _pairs(self, seq: np.ndarray, width: int) -> Iterator[tuple[object, float, float]]:
        distinct, first, count, owners, places = self.index[width]
        h = rolling_hash(seq, width)
        at = np.minimum(np.searchsorted(distinct, h), len(distinct) - 1)
        hit = np.flatnonzero(distinct[at] == h)
        if not len(hit):
            return
        at = at[hit]
        n = count[at]
        rows = np.repeat(first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        owner, place = owners[rows], places[rows]
        # A passage in order lies on neighbouring diagonals: seeds are counted in overlapping bands of them.
        spot = np.repeat(hit, n)
        diagonal = spot - place + int(self.sizes.max())
        bands: dict[int, list[tuple[int, int]]] = {}
        for shift in (0, BAND // 2):
            band = owner << 40 | (diagonal + shift) // BAND
            keys, seeds = np.unique(band, return_counts=True)
            for key in keys[seeds >= np.maximum(SEED_COVER * self.sizes[keys >> 40] - width, 1)].tolist():
                bands.setdefault(key >> 40, []).append((shift, key & (1 << 40) - 1))
        # Pieces in any order: tiles cover at most what seeds cover.
        seeded = np.unique(owner << 40 | place)
        covered = np.minimum(np.append(np.diff(seeded), width), width)
        reached, start = np.unique(seeded >> 40, return_index=True)
        spread = reached[np.add.reduceat(covered, start) >= SHARE * self.sizes[reached]].tolist()
        for k in sorted({*bands, *spread}):
            own = np.flatnonzero(owner == k)
            size = int(self.sizes[k])
            pairs = list(zip(spot[own].tolist(), place[own].tolist(), strict=True))
            tiles = greedy_tiles(pairs, len(seq), size, width)
            cover, span = sum(t[2] for t in tiles), passage(tiles, seq, self.items[k])
            for shift, band in bands.get(k, ()):
                if span >= SHARE * size:
                    break
                near = own[(diagonal[own] + shift) // BAND == band]
                if len(near) < len(own):
                    alone = list(zip(spot[near].tolist(), place[near].tolist(), strict=True))
                    span = max(span, passage(greedy_tiles(alone, len(seq), size, width), seq, self.items[k], changed_too=False))
            if max(cover, span) >= SHARE * size:
                yield self.ids[k], float(cover / size), float(span / size)


@lru_cache(maxsize=2)
def _block(ids: tuple, texts: tuple) -> ItemBlock:
    return ItemBlock(list(ids), list(texts))


def _blocks(items: DataFrame) -> Iterator[tuple[tuple, tuple]]:
    """Items in blocks of bounded size; only one block at a time is on the driver."""
    ids, texts, size = [], [], 0
    for item_id, text in items.toLocalIterator():
        ids.append(item_id), texts.append(text)
        size += len(words(text))
        if size >= BLOCK_WORDS:
            yield tuple(ids), tuple(texts)
            ids, texts, size = [], [], 0
    if ids:
        yield tuple(ids), tuple(texts)


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``cover`` (by tiles in any order) and ``passage_share`` where either is at least SHARE."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").filter(F.length("text") > 0)
    items = items.select("item_id", "item_text").dropna().distinct()
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cover double, passage_share double"
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    found = spark.createDataFrame([], schema)
    for ids, texts in _blocks(items):
        sent = spark.sparkContext.broadcast((ids, texts))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = _block(*sent.value)
            for b in batches:
                rows = list(block.find(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                types = [b.schema.field(0).type, item_type, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "cover", "passage_share"])

        found = found.unionByName(docs.mapInArrow(search, schema))
    return found.distinct()
