"""Pieces of bounded length from texts that are too long.

Recursive separator hierarchy: a text falls into sections (speaker turns, blank
lines), these into lines, sentences, words and at last characters, each level only
where a unit is still too long. Units are packed greedily; a piece after the first
starts with the end of the one before, from the most natural place in the first half
of the overlap, or else in the second. All work is on offsets, so pieces always quote the text exactly.

Defined results: null texts and texts within the limit give no pieces; offsets and
lengths count code points; repeated rows of the input give equal rows once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.dedupe import without_repeats

LIMIT = 1200
OVERLAP = 120
#: Places where a unit ends, coarsest first; the end of each match starts the next unit.
SEPARATORS = [
    re.compile(r"\n(?=(?:agent|customer)\b\s*:)|\n\s*\n+"),
    re.compile(r"\n"),
    re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+"),
    re.compile(r"\s+"),
]


def _units(text: str, start: int, end: int, size: int, level: int = 0) -> Iterator[tuple[int, int]]:
    if end - start <= size:
        if end > start:
            yield start, end
    elif level == len(SEPARATORS):
        for at in range(start, end, size):
            yield at, min(at + size, end)
    else:
        at = start
        for m in SEPARATORS[level].finditer(text, start, end):
            if m.end() < end:
                yield from _units(text, at, m.end(), size, level + 1)
                at = m.end()
        yield from _units(text, at, end, size, level + 1)


def _overlap_start(text: str, start: int, end: int, overlap: int) -> int:
    """Where the quotation of the piece [start, end) begins: a natural place if there is one."""
    low = max(start, end - overlap)
    if low == start:
        return low
    # In the first half of what may be quoted if there is such a place, so that quotations are not needlessly short.
    for first, last in ((low, low + overlap // 2), (low + overlap // 2 + 1, end - 1)):
        for sep in SEPARATORS:
            for m in sep.finditer(text, max(start, low - 4), end):
                if first <= m.end() <= last:
                    return m.end()
    return low


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece; the first starts at 0, the last ends with the text.

    Pieces never exceed ``limit``; consecutive pieces share between 1 and
    ``overlap`` characters (none if ``overlap`` is 0).
    """
    if limit <= overlap:
        raise ValueError("limit must exceed overlap")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    pieces: list[tuple[int, int]] = []
    start = done = 0
    for _, unit_end in _units(text, 0, len(text), limit - overlap):
        if unit_end - start > limit:
            pieces.append((start, done))
            start = _overlap_start(text, start, done, overlap)
        done = unit_end
    pieces.append((start, done))
    return pieces


def split_column(items: DataFrame, keys: list[str], *, text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every item longer than ``limit``: ``keys``, ``piece_no`` from 1, ``start_at``, ``end_at``, ``piece``.

    Short items are dropped by the JVM before any text reaches Python.
    """
    long = items.select(*keys, F.col(text_col).alias("__text")).filter(F.length("__text") > limit)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, starts, ends, parts = [], [], [], [], []
            for k, text in enumerate(b.column(len(keys)).to_pylist()):
                for n, (s, e) in enumerate(split_text(text, limit, overlap), 1):
                    row.append(k), no.append(n), starts.append(s), ends.append(e), parts.append(text[s:e])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(at) for i in range(len(keys))), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.string())],
                [*keys, "piece_no", "start_at", "end_at", "piece"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema.fields[:-1])
    return long.mapInArrow(pieces, f"{kinds}, piece_no int, start_at int, end_at int, piece string")


def oversized_pieces(segments: DataFrame, calls: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP, once: bool = True) -> DataFrame:
    """Pieces of long segment texts (``turn_pos`` -1) and of long call turns.

    Repeats are found by hashes, not by texts; without ``once`` they stay.
    """
    from_segments = segments.select(F.col("segment_id").alias("rec_id"), F.lit(-1).alias("turn_pos"), "text")
    from_calls = (
        calls.filter(F.exists("turns", lambda t: F.length(t["text"]) > limit))
        .select(F.col("call_id").alias("rec_id"), F.posexplode("turns").alias("turn_pos", "turn"))
        .select("rec_id", "turn_pos", F.col("turn.text").alias("text"))
        .filter(F.length("text") > limit)
    )
    long = from_segments.filter(F.length("text") > limit).unionByName(from_calls)
    return split_column(without_repeats(long, "rec_id", "turn_pos") if once else long, ["rec_id", "turn_pos"], limit=limit, overlap=overlap)
