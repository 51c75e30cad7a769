"""Quality statistics of documents; prose told from lists, tables and junk line by line.

Each line is reduced to a few discretised statistics. A hidden Markov model with the
states prose, list, table and junk explains the lines of a document in order, so a
line that could be anything takes the state of its surroundings. Emission and
transition tables are fitted on a bounded sample of documents whose lines a set of
plain cues labels, followed by rounds of expectation maximisation over the sample.
Decoding is forward-backward in log space for many documents at once; a document's
shares are its characters weighted by the posteriors of their lines.

Defined results: null, empty and blank texts get statistics of 0 (shares null) and
no class; every input row gives one output row; lines end as ``str.splitlines`` has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("prose", "list", "table", "junk")
#: Documents in the sample that the model is fitted on, and rounds of EM over it.
SAMPLE_DOCS, EM_ROUNDS = 3000, 4
#: Articles and prepositions of English, German, French and Spanish, which noun phrases have too.
PHRASE_WORDS = (
    "a about after an at by for from in into near of off on per the to under with without "
    "am an auf aus bei das dem den der des die ein eine einem einen einer für im in mit nach ohne von vom vor zu zum zur "
    "à au aux avec dans de des du en la le les par pour sans sous sur un une "
    "a al con de del desde el en la las los para por sin sobre un una unas unos"
).split()
#: Pronouns, auxiliaries, conjunctions and adverbs, which make clauses.
CLAUSE_WORDS = (
    "all also although and are as be because been before but can cannot could did do does had has have he her his how i if is it its just "
    "me my no not now or our out please she since so some still than that their then there these they this too up us was we were what when "
    "whenever where which while who will would yet you your "
    "aber alle als auch bis da danach dass denn doch du er es etwa hat haben hatte ich ihr ihre immer ist ja jemand kann kein keine können man "
    "mehr mein nicht noch nun nur ob obwohl oder schon sehr sein seit sich sie sind sobald solange und uns unser unsere während war was wenn "
    "werden wie wir wird wo über "
    "alors avons ce cette comme depuis donc dont elle elles est et être eu fait il ils je lui mais même moi mon ne nos notre nous on ont ou "
    "où pas plus pouvez puis qu quand que qui sa se ses si son sont tant te toujours tout très tu vos votre vous y "
    "algo antes aquí aunque como cuando cual donde dos ella ellos entre era es esta está este esto están fue ha hay han hasta hemos lo luego "
    "más me mi mientras muy nada ni no nos nosotros o pero poco porque pueden que quien se ser si siempre son su sus también tan te tiene "
    "todo todos tras usted y ya"
).split()
COMMON_WORDS = sorted({*PHRASE_WORDS, *CLAUSE_WORDS})
#: Line statistics are cut at these values into bins.
CUTS = {
    "words": [1, 2, 4, 7, 12, 25],
    "clause": [1, 2, 3, 5],
    "length": [12, 25, 40, 55, 75, 120],
    "common": [0.02, 0.1, 0.2, 0.3, 0.45],
    "symbols": [0.02, 0.06, 0.12, 0.25, 0.45],
    "digits": [0.02, 0.08, 0.2, 0.4],
    "cells": [1, 2, 4, 8],
    "marker": [0.5, 1.5],
    "sentence": [0.5, 1.5],
    "word_len": [2.5, 4, 6, 9, 16],
    "odd": [0.05, 0.2, 0.5],
}
TOKEN = r"[\p{L}\p{M}]+(?:['’][\p{L}]+)*"
MARKER = r"^\s*(?:[-*+•◦▪‣·»›–—o]|\[[ xX]?\]|[☐☑✓✔]|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)]|(?:Step|Schritt|Étape|Etape|Paso|No\.|Nr\.|N[º°])\s*\d+\s*[:.)]|#\d+)\s+\S"


def _column(values: pa.Array | np.ndarray) -> np.ndarray:
    return np.asarray(values).astype(np.float64)


def _count(lines: pa.Array, pattern: str) -> np.ndarray:
    return _column(pc.count_substring_regex(lines, pattern))


@dataclass
class Lines:
    """Non-blank lines of many texts: owner text, characters, statistics."""

    owner: np.ndarray
    chars: np.ndarray
    stats: dict[str, np.ndarray]

    def bins(self) -> np.ndarray:
        return np.stack([np.digitize(self.stats[k], cuts, right=False) for k, cuts in CUTS.items()], axis=1)


def _known(lines: int, row: np.ndarray, tokens: pa.Array, words: list[str]) -> np.ndarray:
    known = pc.is_in(tokens, value_set=pa.array(words, tokens.type)).to_numpy(zero_copy_only=False)
    return np.bincount(row[known], minlength=lines).astype(np.float64)


def line_statistics(texts: list[str | None]) -> Lines:
    """Statistics of every non-blank line, computed column by column in Arrow."""
    split = [[x for x in t.splitlines() if x and not x.isspace()] if t else [] for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    lines = pa.array([x for s in split for x in s], pa.large_string())
    chars = _column(pc.utf8_length(lines))
    # Tokens: everything that is no letter becomes a blank, then one split for all lines.
    lowered = pc.utf8_lower(lines)
    tokens = pc.split_pattern(pc.utf8_trim_whitespace(pc.replace_substring_regex(lowered, r"[^\p{L}\p{M}]+", " ")), " ")
    row = pc.list_parent_indices(tokens).to_numpy()
    flat = pc.list_flatten(tokens)
    sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
    keep = sizes > 0
    row, flat, sizes = row[keep], flat.filter(pa.array(keep)), sizes[keep]
    n = len(lines)
    words = np.bincount(row, minlength=n).astype(np.float64)
    letters = np.bincount(row, weights=sizes, minlength=n)
    common = _known(n, row, flat, COMMON_WORDS)
    digits = _count(lines, r"\p{N}")
    spaces = _count(lines, r"\s")
    symbols = np.maximum(chars - letters - digits - spaces, 0)
    # Separators of cells: bars, tabs, semicolons, runs of blanks inside the line; commas only without blank after them.
    cells = _count(lines, r"\S[  ]{2,}\S|\t|[|¦;]|,\S")
    marker = _column(pc.match_substring_regex(lines, MARKER))
    rule = _column(pc.match_substring_regex(lines, r"^[\s|+:=\-_*~#.]{3,}$"))
    ends = _column(pc.match_substring_regex(lines, r"[.!?…:;,][\"'”’»)\]]*\s*$"))
    stops = _column(pc.match_substring_regex(lines, r"[.!?…][\"'”’»)\]]*\s*$"))
    # Words that no language has: long consonant runs, letters mixed with digits or underscores, long unbroken strings.
    mixed = _count(lines, r"[A-Za-z]{2,}_|[A-Za-z]{3,}\d|\d[a-z]\d|[a-z]\d[a-z]|[bcdfghjklmnpqrstvwxz]{5,}|<[/!a-z][^>]*>|&[a-z]+;|\S{30,}|=\S|\\x|\b[0-9a-f]{2} [0-9a-f]{2} [0-9a-f]{2}\b|\x{FFFD}|[\x{80}-\x{9f}]|Ã.|â€")
    some = np.maximum(words, 1)
    pieces = np.maximum(_count(lines, r"\S+"), 1)
    solid = np.maximum(chars - spaces, 1)
    stats = {
        "words": words,
        "clause": _known(n, row, flat, CLAUSE_WORDS),
        "length": chars,
        "common": common / some,
        "symbols": symbols / solid,
        "digits": digits / solid,
        "cells": cells,
        "marker": marker + 2 * rule,
        "sentence": ends + stops,
        "word_len": letters / some,
        "odd": np.minimum(mixed / pieces, 1),
        "raw_common": common,
        "raw_symbols": symbols,
        "raw_letters": letters,
        "raw_solid": chars - spaces,
    }
    return Lines(owner, chars, stats)


def cue_labels(x: Lines) -> np.ndarray:
    """State of each line by plain cues; the first that holds decides."""
    s = x.stats
    junk = (s["odd"] > 0.3) | ((s["symbols"] > 0.45) & (s["cells"] < 2) & (s["marker"] < 1.5)) | ((s["words"] > 12) & (s["common"] < 0.06) & (s["cells"] < 3))
    table = (s["marker"] > 1.5) | ((s["cells"] >= 2) & (s["clause"] < 2)) | ((s["digits"] > 0.4) & (s["words"] < 4))
    listed = ((s["marker"] > 0.5) & (s["sentence"] < 1.5)) | ((s["words"] <= 9) & (s["clause"] < 1))
    return np.select([junk, table, listed], [3, 2, 1], 0)


@dataclass
class LineModel:
    """Log tables: start (4), transitions (4, 4), emissions per statistic (4, bins)."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def line_scores(self, bins: np.ndarray) -> np.ndarray:
        return sum(e[:, bins[:, k]].T for k, e in enumerate(self.emit))

    def posteriors(self, scores: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """P(state) of each line; documents of like length run side by side."""
        out = np.empty_like(scores)
        if not len(scores):
            return out
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(np.append(first, len(owner)))
        for power in np.unique(np.ceil(np.log2(size))):
            of = np.flatnonzero(np.ceil(np.log2(size)) == power)
            at = max(1, 2_000_000 >> int(power))
            for k in range(0, len(of), at):
                self._posteriors(scores, first[of[k : k + at]], size[of[k : k + at]], out)
        return out

    def _posteriors(self, scores: np.ndarray, first: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        longest = int(size.max())
        rows = first[:, None] + np.minimum(np.arange(longest), size[:, None] - 1)
        live = np.arange(longest) < size[:, None]
        step = np.exp(self.move)
        e = scores[rows]
        e = np.exp(e - e.max(axis=2, keepdims=True))
        forward = np.empty_like(e)
        a = np.exp(self.start) * e[:, 0]
        forward[:, 0] = a = a / a.sum(axis=1, keepdims=True)
        for t in range(1, longest):
            a = (a @ step) * e[:, t] + 1e-300
            forward[:, t] = a = a / a.sum(axis=1, keepdims=True)
        back = np.ones((len(first), len(STATES)))
        for t in range(longest - 1, -1, -1):
            p = forward[:, t] * back
            p /= p.sum(axis=1, keepdims=True)
            on = live[:, t]
            out[rows[on, t]] = p[on]
            if t:
                b = (back * e[:, t]) @ step.T
                b /= b.sum(axis=1, keepdims=True)
                back = np.where(on[:, None], b, 1.0)


def fit(x: Lines, rounds: int = EM_ROUNDS) -> LineModel:
    """Tables from cue labels, then refined by EM; add-one smoothing keeps every bin possible."""
    weight = np.eye(len(STATES))[cue_labels(x)]
    bins = x.bins()
    starts = np.append(True, x.owner[1:] != x.owner[:-1]) if len(x.owner) else np.empty(0, bool)
    model = None
    for _ in range(rounds + 1):
        if model is not None:
            # The cues keep half of the say, so that states keep their meaning.
            weight = 0.5 * weight + 0.5 * model.posteriors(model.line_scores(bins), x.owner)
        emit = []
        for k, cuts in enumerate(CUTS.values()):
            table = np.stack([np.bincount(bins[:, k], weights=weight[:, s], minlength=len(cuts) + 1) for s in range(len(STATES))]) + 1.0
            emit.append(np.log(table / table.sum(axis=1, keepdims=True)))
        inner = ~starts[1:] if len(starts) else starts
        move = weight[:-1][inner].T @ weight[1:][inner] + np.eye(len(STATES)) + 1.0
        start = weight[starts].sum(axis=0) + 1.0
        model = LineModel(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), emit)
    return model


def sample_model(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE_DOCS) -> LineModel:
    """Fit on ``sample`` different texts, those with the smallest hashes: a bounded, repeatable choice.

    Hashes are cut so that about twice the sample is left before it is ordered:
    what tasks send to the driver does not grow with their number.
    """
    rows = max(1, docs.count())
    ceiling = min(1.0, 2.0 * sample / rows) * 2.0**63
    some = docs.select(text_col).filter(F.trim(text_col) != "").withColumn("h", F.shiftrightunsigned(F.xxhash64(text_col), 1))
    some = some.filter(F.col("h").cast("double") <= ceiling).dropDuplicates(["h"]).orderBy("h").limit(sample).select(text_col)
    return fit(line_statistics([r[0] for r in some.collect()]))


def document_quality(docs: DataFrame, model: LineModel | None = None, *, batch: int = 4000) -> DataFrame:
    """For each row ``doc_id``, the statistics, the share of characters by state and ``doc_class``."""
    model = model or sample_model(docs)
    source = docs.select("doc_id", "text")
    names = ["n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", *(f"{s}_share" for s in STATES)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                x = line_statistics(part.column(1).to_pylist())
                n, s = part.num_rows, x.stats
                total = lambda v: np.bincount(x.owner, weights=v, minlength=n)  # noqa: B023, E731
                ratio = lambda a, b: np.where(b > 0, a / np.maximum(b, 1e-9), 0.0)
                words, lines, chars = total(s["words"]), total(np.ones(len(x.owner))), total(x.chars)
                p = model.posteriors(model.line_scores(x.bins()), x.owner)
                shares = [ratio(total(p[:, k] * x.chars), chars) for k in range(len(STATES))]
                blank = chars == 0
                kind = np.array(STATES, object)[np.where(shares[0] >= 0.5, 0, 1 + np.argmax(np.stack(shares[1:]), axis=0))]
                columns = [words, ratio(total(s["raw_letters"]), words), ratio(total(s["raw_symbols"]), total(s["raw_solid"])), ratio(total((s["sentence"] > 0).astype(float)), lines), ratio(total(s["raw_common"]), words)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c) for c in columns), *(pa.array(c, mask=blank) for c in shares), pa.array(kind, pa.string(), mask=blank)],
                    ["doc_id", *names, "doc_class"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in names) + ", doc_class string")
