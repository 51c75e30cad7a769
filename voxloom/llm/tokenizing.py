"""Corpus encoding with a byte-level BPE vocabulary: speculate, verify, repair.

For each distinct pre-token a greedy longest match proposes tokens. Byte-pair
encoding has a local test: a sequence is the encoding of its bytes exactly if
each token is reachable and no adjacent pair would have merged across its border
earlier than the two were built. The test runs for all adjacent pairs of all new
words of a batch at once in numpy; only words with a failing pair are merged
exactly.

Defined results: null and empty texts give an empty list; every row of the input
gives one row; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pre-token pattern of the vocabulary (fixed value).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Between a visible character and a blank or line feed a pre-token always ends.
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space other than these two: such texts are split by PRETOKEN alone.
OTHER_SPACE = regex.compile(r"[^\S \n]")
#: Entries that a worker's cache of chunks may hold before it starts afresh.
CACHE_CHUNKS = 300_000
NO_PAIR = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    """Path of byte_bpe_50k among the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        alphabet[chr(256 + k)] = b
    return alphabet


def _grown(buffer: np.ndarray, used: int, needed: int) -> np.ndarray:
    """The buffer, or one of at least twice its size with what is used of it."""
    if needed <= len(buffer):
        return buffer
    out = np.empty(max(needed, 2 * len(buffer)), buffer.dtype)
    out[:used] = buffer[:used]
    return out


class BytePairCodec:
    """Encoder over one vocabulary file (``tokenizers`` JSON with ``vocab`` and ``merges``)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        n = 256 + len(merges)
        # Internal numbers: bytes first, then merges in order, so that number order is merge order.
        self.public = np.zeros(n, np.int32)
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        number: dict[str, int] = {}
        for c, b in alphabet.items():
            number[c], self.public[b] = b, vocab[c]
        for k, (a, b) in enumerate(merges):
            t = 256 + k
            left[t], right[t] = number[a], number[b]
            number.setdefault(a + b, t)
            self.public[t] = vocab[a + b]
        self.left, self.right = left, right
        keys = left[256:] << 20 | right[256:]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ids = keys[order], order.astype(np.int64) + 256
        self.rank = {(int(a), int(b)): 256 + k for k, (a, b) in reversed(list(enumerate(zip(left[256:], right[256:], strict=True))))}
        apart = self._stay_apart(left[256:], right[256:], first_check=False)
        reachable = np.ones(n, bool)
        for t in range(256, n):
            reachable[t] = apart[t - 256] and reachable[left[t]] and reachable[right[t]]
        self.by_bytes = {as_bytes(s): t for s, t in number.items() if reachable[t]}
        self.longest = max(map(len, self.by_bytes))
        self._reset()

    def _reset(self) -> None:
        """An empty cache: ids of all chunks in one buffer that doubles, with the start and the size of each chunk."""
        self.code: dict[str, int] = {}
        self.flat, self.filled = np.empty(1 << 20, np.int32), 0
        self.start, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    # -- verification -------------------------------------------------------

    def _pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << 20 | y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], NO_PAIR)

    def _stay_apart(self, a: np.ndarray, b: np.ndarray, first_check: bool = True) -> np.ndarray:
        """For each pair, whether nothing merges across its border before a and b are whole.

        Walks back in time: of the two tokens at the border the one that was made
        last is undone, and the pair then facing each other must not have a merge
        that would have come earlier (with equal merges the left one goes first).
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NO_PAIR)
        check = first_check
        while len(live):
            if check:
                bad = self._pair(x, y) < limit
                good[live[bad]] = False
                keep = ~bad & (np.maximum(x, y) >= 256)
            else:
                keep = np.maximum(x, y) >= 256
            check = True
            live, x, y = live[keep], x[keep], y[keep]
            undo_x = x > y
            limit = np.where(undo_x, x, y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    # -- one word -----------------------------------------------------------

    def _speculate(self, word: bytes) -> list[int]:
        out, at, get = [], 0, self.by_bytes.get
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                t = get(word[at:end])
                if t is not None:
                    out.append(t)
                    at = end
                    break
        return out

    def _merge_exactly(self, word: bytes) -> list[int]:
        """Merges in rank order, leftmost first, over a linked list with a heap."""
        token = list(word)
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        rank, end = self.rank.get, len(token)
        heap = [(r, i) for i in range(end - 1) if (r := rank((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if token[i] >= 0 else end
            if j >= end or rank((token[i], token[j])) != r:
                continue
            token[i], token[j] = r, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (s := rank((r, token[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank((token[h], r))) is not None:
                heapq.heappush(heap, (s, h))
        return [t for t in token if t >= 0]

    # -- many words ---------------------------------------------------------

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Internal numbers of each word, and how many words the check sent to exact merging."""
        raw = [w.encode("utf-8", "replace") for w in words]
        proposed = [self._speculate(w) for w in raw]
        flat = np.fromiter(chain.from_iterable(proposed), np.int64)
        owner = np.repeat(np.arange(len(proposed)), [len(p) for p in proposed])
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.empty(0, np.int64)
        failing = np.unique(owner[inner[~self._stay_apart(flat[inner], flat[inner + 1])]])
        for k in failing:
            proposed[k] = self._merge_exactly(raw[k])
        return proposed, len(failing)

    def _learn(self, chunks: set[str]) -> None:
        split = {c: PRETOKEN.findall(c) for c in chunks}
        words = list(dict.fromkeys(chain.from_iterable(split.values())))
        ids = dict(zip(words, self.encode_words(words)[0], strict=True))
        per_chunk = [list(chain.from_iterable(ids[p] for p in parts)) for parts in split.values()]
        fresh = self.public[np.fromiter(chain.from_iterable(per_chunk), np.int64)]
        first, last = len(self.code), len(self.code) + len(per_chunk)
        self.flat = _grown(self.flat, self.filled, self.filled + len(fresh))
        self.start, self.size = _grown(self.start, first, last), _grown(self.size, first, last)
        sizes = np.fromiter(map(len, per_chunk), np.int64, len(per_chunk))
        self.size[first:last] = sizes
        self.start[first:last] = self.filled + np.cumsum(sizes) - sizes
        self.flat[self.filled : self.filled + len(fresh)] = fresh
        self.filled += len(fresh)
        self.code.update(zip(split, range(first, last), strict=True))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, values) of the ids of each text."""
        per_text = [[] if not t else PRETOKEN.findall(t) if OTHER_SPACE.search(t) else CHUNK.findall(t) for t in texts]
        if len(self.code) > CACHE_CHUNKS:
            self._reset()
        if new := set(chain.from_iterable(per_text)).difference(self.code):
            self._learn(new)
        get = self.code.__getitem__
        codes = np.fromiter(map(get, chain.from_iterable(per_text)), np.int64)
        n_chunks = np.fromiter(map(len, per_text), np.int64, len(per_text))
        each = self.size[codes]
        ends = np.cumsum(each)
        values = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[codes] - (ends - each), each)]
        bounds = np.concatenate([[0], np.cumsum(n_chunks)])
        offsets = np.concatenate([[0], ends])[bounds]
        return offsets, values


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def encode_corpus(docs: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", batch: int = 2000) -> DataFrame:
    """One row (``id_col``, ``ids`` array<int>) for each row of ``docs``; no shuffle."""
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                offsets, values = c.encode_batch(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    source = docs.select(id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")
