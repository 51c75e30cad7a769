"""Clean speaker turns from raw call transcripts.

Labels are normalised to agent, customer, a numbered voice or nothing, and the voices of
a call to roles by all that they say; time marks, sound notes and fillers leave the
text. Boosted trees decide from labels, gaps and context whether the speaker changes
between two neighbouring utterances. Utterances between two changes are one turn; its
role is the sum of what its utterances say of their speaker - label, voice, words -
with weights by logistic regression. Tokens that may be fillers are classified one by
one from what they are and from their place.

All three models are fitted on a bounded sample of labelled calls, whose labels are
shown, hidden, or replaced by numbered voices; a blank label carries on, by definition.

Defined results: the time of an utterance is ``start_time`` or the mark in its text;
one with neither stays after the one before it (the first stays first). Times of a
call in milliseconds are scaled when its marks show it. Confidence outside [0, 1] is
null. Utterances that are empty, null or only fillers, listening sounds and sound
notes give no turn. A call delivered several times counts once, as last landed. A
call without any turn gives no rows; a null call id gives none either.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.boosting import BoostedTrees
from voxloom.session import small, stored

#: Calls in the sample that the models are fitted on, and texts among it that give filler examples.
SAMPLE_CALLS, EXAMPLE_TEXTS = 3000, 6000
#: What labels of the two roles start with, accents and punctuation aside.
AGENT_LABELS = ("agent", "agente", "agt", "rep", "representative", "support", "support rep", "operator", "operador", "operadora", "conseiller", "conseillère", "conseillere", "mitarbeiter", "mitarbeiterin", "berater", "beraterin", "advisor", "adviser", "asesor", "asesora")
CUSTOMER_LABELS = ("customer", "cust", "cus", "caller", "client", "cliente", "clienta", "kunde", "kundin", "anrufer", "anruferin", "user", "usuario", "appelant", "appelante")
#: Fillers and listening sounds, and phrases that are fillers only in some places.
FILLERS = frozenset("um uh uhm umm uhh er erm ah eh em hm hmm hum mm mmm mhm mm-hm mmhm mm-hmm uh-huh uhuh aha äh ähm öh öhm hm-hm euh heu ben bah hein tja ajá".split())
LOOSE_FILLERS = ("you know", "i mean", "este", "eh bien", "tu vois", "o sea", "sozusagen")
#: Sound notes without brackets do not occur; inside brackets any short note of letters is one.
_SOUND = re.compile(r"[\[(<{*](?!(?:at|dot|call|punto|punkt|point|arroba)[\])>}*])[a-zà-ÿ][a-zà-ÿ' -]{1,30}[\])>}*]")
_MARK = re.compile(r"\s*(?:[\[(<]?(?:(\d{1,2}):)?(\d{1,3}):(\d{2})(?:[.,](\d{1,3}))?[\])>]?|[\[(<]?(\d{1,3})m\s?(\d{1,2})s[\])>]?)\s*(?:-->|->|[-–>|:])?\s*")
_LABELS = {w: 1 for w in AGENT_LABELS} | {w: -1 for w in CUSTOMER_LABELS}
_NAMED = re.compile(r"\s*(" + "|".join(sorted(map(re.escape, _LABELS), key=len, reverse=True)) + r")\.?\s*(?::|>|-(?=\s))\s*", re.IGNORECASE)
_NUMBERED = re.compile(r"(?:speaker|spk|sprecher|locuteur|hablante|s|voice)[ _-]?(\d+)")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_PIECES = re.compile(r"([^\W_]+(?:[-'’][^\W_]+)*|\S)")
_PIECE = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|\S")


def label_role(label: str | None) -> tuple[int, str | None]:
    """(1 agent, -1 customer, 0 not said; name of a numbered voice)."""
    plain = (label or "").strip().lower().rstrip(" :.->").lstrip("[(<")
    if plain in _LABELS:
        return _LABELS[plain], None
    m = _NUMBERED.fullmatch(plain)
    return 0, (m[1] if m else None)


def take_mark(text: str) -> tuple[float | None, str]:
    """Seconds of the time mark at the start of a text, and the text after it."""
    m = _MARK.match(text)
    if not m:
        return None, text
    h, mi, s, frac, m2, s2 = m.groups()
    seconds = int(m2) * 60 + int(s2) if m2 is not None else int(h or 0) * 3600 + int(mi) * 60 + int(s) + (float(f"0.{frac}") if frac else 0.0)
    return seconds, text[m.end() :]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression, the last for the constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class FillerModel:
    """Which tokens of a text are fillers, by the token and its place.

    Fitted on tokens that surely are fillers against other words, and on phrases that
    may be fillers, whose truth is taken from their neighbours: found side by side more
    often than with the phrase between them, or a filler just before. What a sure token
    is stays hidden for a part of them, so that its place has weight of its own.
    """

    pairs: dict[tuple[str, str], int]
    weights: tuple[float, ...]

    @staticmethod
    def fit(texts: list[str], seed: int = 5) -> FillerModel:
        pairs: Counter = Counter()
        pieces = [_PIECE.findall(t.lower()) for t in texts]
        for p in pieces:
            words = [w for w in p if w[0].isalnum() and w not in FILLERS]
            pairs.update(zip(words, words[1:], strict=False))
        model = FillerModel({p: n for p, n in pairs.items() if n > 1}, ())
        rng = np.random.default_rng(seed)
        x, y = [], []
        for p in pieces[:: 1 + len(pieces) // EXAMPLE_TEXTS]:
            for k, w in enumerate(p):
                sure, after_filler = w in FILLERS, k > 0 and p[k - 1] in FILLERS
                for phrase in _LOOSE.get(w, ()):
                    if p[k : k + len(phrase)] == phrase:
                        f = model.features(p, k, k + len(phrase), False, after_filler)
                        x.append(f)
                        y.append(f[3] > 0 or after_filler)
                if sure or w not in _LOOSE and rng.random() < 0.05 and _WORD.match(w):
                    x.append(model.features(p, k, k + 1, sure and rng.random() < 0.7, after_filler))
                    y.append(sure)
        if len(x) > 20 and 0 < sum(y) < len(y):
            model.weights = tuple(_logistic(np.array(x, float), np.array(y, float)).tolist())
        else:
            # Too little to learn from: what surely is a filler, and loose phrases by their neighbours.
            model.weights = (2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 4.0, -1.0)
        return model

    def features(self, p: list[str], start: int, end: int, sure: bool, after_filler: bool) -> tuple[float, ...]:
        before = next((w for w in reversed(p[:start]) if _WORD.match(w)), "")
        after = next((w for w in p[end:] if _WORD.match(w)), "")
        with_it = min(self.pairs.get((before, p[start]), 0), self.pairs.get((p[end - 1], after), 0))
        removable = max(-1.0, min(1.0, math.log1p(self.pairs.get((before, after), 0)) - math.log1p(with_it)))
        loose = float(end - start > 1 or p[start] in _LOOSE)
        return (float(sure), float(p[end : end + 1] in ([","], ["..."], ["…"])), float(p[start - 1 : start] == [","]), removable, float(after_filler), loose, loose * removable)

    def is_filler(self, p: list[str], start: int, end: int, sure: bool, after_filler: bool) -> bool:
        *w, constant = self.weights
        return sum(a * b for a, b in zip(w, self.features(p, start, end, sure, after_filler), strict=True)) + constant > 0

    def clean(self, text: str, candidates: bool = True) -> str:
        """The text without sound notes and fillers; empty if nothing else was said."""
        bare = _SOUND.sub(" ", text) if _OPENS.search(text) else text
        if not candidates:
            return " ".join(bare.split()) if _WORD.search(bare) else ""
        # Gaps and pieces in turn.
        parts = _PIECES.split(bare)
        p = [w.lower() for w in parts[1::2]]
        drop = [False] * len(p)
        for k, w in enumerate(p):
            if drop[k] or w not in _FIRST:
                continue
            if w in FILLERS:
                drop[k] = self.is_filler(p, k, k + 1, True, k > 0 and drop[k - 1])
                continue
            for phrase in _LOOSE[w]:
                end = k + len(phrase)
                if p[k:end] == phrase and self.is_filler(p, k, end, False, k > 0 and drop[k - 1]):
                    drop[k:end] = [True] * len(phrase)
        if not any(drop):
            return " ".join(bare.split()) if _WORD.search(bare) else ""
        for k, gone in enumerate(drop):
            if gone:
                parts[2 * k + 1] = ""
                if k + 1 < len(p) and p[k + 1] in (",", "...", "…") and not (k and p[k - 1] == ","):
                    parts[2 * k + 2] = parts[2 * k + 3] = ""
        kept = re.sub(r"\s+([,.!?;:])", r"\1", " ".join("".join(parts).split()))
        return kept if _WORD.search(kept) else ""


_OPENS = re.compile(r"[\[(<{*]")
_LOOSE: dict[str, list[list[str]]] = {}
for _p in LOOSE_FILLERS:
    _LOOSE.setdefault(_p.split()[0], []).append(_p.split())
_FIRST = FILLERS | frozenset(_LOOSE)
_PHRASES = [frozenset(q) for qs in _LOOSE.values() for q in qs]


def _may_hold_fillers(words: frozenset[str]) -> bool:
    return not words.isdisjoint(FILLERS) or any(q <= words for q in _PHRASES)


@dataclass(slots=True)
class Utterance:
    """One raw turn after normalisation."""

    place: int
    time: float | None
    role: int
    voice: str | None
    blank_label: bool
    text: str
    confidence: float | None
    words: frozenset[str] = frozenset()


_ROLES: dict[str | None, tuple[int, str | None]] = {}


def _role_of(label: str | None) -> tuple[int, str | None]:
    got = _ROLES.get(label)
    if got is None:
        if len(_ROLES) > 100_000:
            _ROLES.clear()
        got = _ROLES[label] = label_role(label)
    return got


def read_turns(speakers: list, texts: list, times: list, confidences: list) -> list[Utterance]:
    """The raw turns of a call, given by their fields, in the order of time."""
    out = []
    marks: list[tuple[float, float]] = []
    for place, (speaker, text, time, confidence) in enumerate(zip(speakers, texts, times, confidences, strict=True)):
        if speaker is None and text is None and time is None and confidence is None:
            continue
        text, mark, named = text or "", None, None
        head = text[:40].lstrip()
        if head[:1].isdigit() or head[:1] in ("[", "(", "<", ""):
            mark, text = take_mark(text)
            head = text[:40]
        role, voice = _role_of(speaker)
        if ":" in head or ">" in head or "-" in head:
            named = _NAMED.match(text)
            if named:
                text = text[named.end() :]
                role, voice = _LABELS[named[1].lower()], None
        if time is not None and not (math.isfinite(time) and time >= 0):
            time = None
        if time is not None and mark:
            marks.append((time, mark))
        if confidence is not None and not 0 <= confidence <= 1:
            confidence = None
        blank = named is None and not (speaker and speaker.strip())
        out.append((place, time, mark, role, voice, blank, text, confidence))
    # Times in another unit than the marks: the median quotient tells.
    quotient = sorted(a / b for a, b in marks)[len(marks) // 2] if marks else 1.0
    unit = 1000.0 if 300 < quotient < 3000 else 1.0
    ordered, last = [], -math.inf
    for place, time, mark, *rest in out:
        own = time / unit if time is not None else mark
        last = own if own is not None else last
        ordered.append((last, place, own, rest))
    ordered.sort(key=lambda x: x[:2])
    return [Utterance(place, own, *rest, frozenset(_WORD.findall(rest[3].lower()))) for _, place, own, rest in ordered]


def read_utterances(turns: list[dict] | None) -> list[Utterance]:
    """The raw turns of a call in the order of time."""
    turns = [t or {} for t in turns or ()]
    return read_turns(*([t.get(f) for t in turns] for f in ("speaker", "text", "start_time", "speaker_confidence")))


FEATURES = 12


@dataclass
class TurnModels:
    """Word log-odds of the roles, weights of an utterance's own signs, the boundary trees, and the fillers."""

    odds: dict[str, float]
    own: tuple[float, ...]
    trees: BoostedTrees
    fillers: FillerModel

    def side(self, words: frozenset[str]) -> float:
        """Log-odds that the agent says these words."""
        get = self.odds.get
        return sum([get(w, 0.0) for w in words])


def voice_sides(us: list[Utterance], sides: list[float]) -> dict[str, float]:
    """Log-odds of the agent for each numbered voice of a call, by all that it says; of two voices one is the agent."""
    voices: dict[str, float] = {}
    for u, s in zip(us, sides, strict=True):
        if u.voice is not None:
            voices[u.voice] = voices.get(u.voice, 0.0) + s
    if len(voices) == 2:
        a, b = voices
        voices = {a: voices[a] - voices[b], b: voices[b] - voices[a]}
    return voices


def role_shown(u: Utterance, voices: dict[str, float]) -> int:
    """The role that a label or a voice says: 1 agent, -1 customer, 0 neither."""
    if u.role or u.voice is None:
        return u.role
    side = voices.get(u.voice, 0.0)
    return (side > 0) - (side < 0)


def roles_shown(us: list[Utterance], voices: dict[str, float]) -> list[int]:
    """The role that the labels of a call say for each utterance; a blank label says what the one before it does."""
    out: list[int] = []
    for u in us:
        out.append(out[-1] if u.blank_label and not u.role and out else role_shown(u, voices))
    return out


def boundary_features(u: Utterance, v: Utterance, su: float, sv: float, ru: int, rv: int) -> tuple[float, ...]:
    """Two neighbours in the order of time, with what their words and their labels say."""
    gap = v.time - u.time if u.time is not None and v.time is not None else -1.0
    n = len(u.text)
    return (
        float(ru == rv) if ru and rv else -1.0,
        float(u.voice == v.voice) if u.voice is not None and v.voice is not None else -1.0,
        float(v.blank_label),
        gap,
        gap / (n + 5.0) if gap >= 0 else -1.0,
        su,
        sv,
        max(-8.0, min(8.0, su)) * max(-8.0, min(8.0, sv)),
        float(u.text.endswith("?")),
        n,
        len(v.text),
        float(v.text[:1].islower()),
    )


def own_signs(u: Utterance, side: float, voices: dict[str, float]) -> tuple[float, float, float]:
    """What an utterance says of its speaker by itself: label, voice, words."""
    shown = role_shown(u, voices)
    return float(u.role), float(0 if u.role else shown), 0.0 if shown else max(-6.0, min(6.0, side))


def _masked(us: list[Utterance], how: int, rng: np.random.Generator) -> list[Utterance]:
    """A labelled call with its labels shown (0), as numbered voices (1), hidden one by one (2) or hidden and blank (3)."""
    out = []
    first = us[0].role if us else 1
    for k, u in enumerate(us):
        role, voice, blank = u.role, u.voice, u.blank_label
        if how == 1 and role:
            role, voice = 0, "1" if u.role == first else "2"
        elif how == 2 and role and rng.random() < 0.5:
            role = 0
        elif how == 3 and role and k and us[k - 1].role == u.role and rng.random() < 0.7:
            role, blank = 0, True
        out.append(Utterance(u.place, u.time, role, voice, blank, u.text, u.confidence, u.words))
    return out


def fit_models(calls: list[list[dict]], seed: int = 7) -> TurnModels:
    """From labelled calls: word odds, weights of own signs, boundary trees, filler model."""
    read = [read_utterances(c) for c in calls]
    words = {1: Counter(), -1: Counter()}
    for us in read:
        for u in us:
            if u.role:
                words[u.role].update(u.words)
    total = {r: sum(c.values()) + 1 for r, c in words.items()}
    odds = {w: math.log((words[1][w] + 0.5) / total[1]) - math.log((words[-1][w] + 0.5) / total[-1]) for w in {*words[1], *words[-1]} if words[1][w] + words[-1][w] > 2}
    models = TurnModels(odds, (0.0,) * 4, BoostedTrees(), FillerModel.fit([_SOUND.sub(" ", u.text) for us in read for u in us]))
    rng = np.random.default_rng(seed)
    x, y, signs, roles = [], [], [], []
    for n, us in enumerate(read):
        # The truth of a blank label is the speaker before it.
        truth: list[int] = []
        for u in us:
            truth.append(truth[-1] if truth and u.blank_label and not u.role else u.role)
        sides = [models.side(u.words) for u in us]
        masked = _masked(us, n % 4, rng)
        voices = voice_sides(masked, sides)
        shown = roles_shown(masked, voices)
        for k, u in enumerate(masked):
            if truth[k] and not u.blank_label:
                signs.append(own_signs(u, sides[k], voices))
                roles.append(truth[k] > 0)
            if k and truth[k] and truth[k - 1]:
                x.append(boundary_features(masked[k - 1], u, sides[k - 1], sides[k], shown[k - 1], shown[k]))
                y.append(truth[k] != truth[k - 1])
    if len(x) >= 10 and 0 < sum(roles) < len(roles):
        models.trees.fit(np.array(x), np.array(y, float))
        models.own = tuple(_logistic(np.array(signs), np.array(roles, float)).tolist())
    else:
        models.trees.cuts = [np.empty(0)] * FEATURES
        models.own = (3.0, 3.0, 1.0, 0.0)
    return models


def decide_speakers(us: list[Utterance], sides: list[float], change: np.ndarray, own: tuple[float, ...], voices: dict[str, float]) -> list[int]:
    """Role of each utterance: the trees say where the speaker changes, the signs of all utterances in between who it is."""
    out: list[int] = []
    run, total = 0, 0.0
    for k, (u, s) in enumerate(zip(us, sides, strict=True)):
        if k and change[k - 1] > 0:
            out += [1 if total >= 0 else -1] * run
            run, total = 0, 0.0
        label, voice, said = own_signs(u, s, voices)
        run += 1
        # The words of a blank label are no sign: by definition it carries on.
        total += own[0] * label + own[1] * voice + (own[2] * said + own[3] if not (label or voice or u.blank_label and run > 1) else 0.0)
    return out + [1 if total >= 0 else -1] * run


Turn = tuple[str, str, "float | None", "float | None"]


def clean_calls(read: list[list[Utterance]], models: TurnModels) -> list[list[Turn]]:
    """(speaker, text, start time, confidence) of the clean turns of each call."""
    sides = [[models.side(u.words) for u in us] for us in read]
    voices = [voice_sides(us, s) for us, s in zip(read, sides, strict=True)]
    shown = [roles_shown(us, v) for us, v in zip(read, voices, strict=True)]
    x = [boundary_features(us[k], us[k + 1], s[k], s[k + 1], r[k], r[k + 1]) for us, s, r in zip(read, sides, shown, strict=True) for k in range(len(us) - 1)]
    change = models.trees.score(np.array(x).reshape(-1, FEATURES))
    out, at = [], 0
    for us, s, v in zip(read, sides, voices, strict=True):
        n = max(0, len(us) - 1)
        roles = decide_speakers(us, s, change[at : at + n], models.own, v) if us else []
        at += n
        turns: list[Turn] = []
        for u, role in zip(us, roles, strict=True):
            text = models.fillers.clean(u.text, _may_hold_fillers(u.words)) if u.words else ""
            if not text:
                continue
            speaker = "agent" if role == 1 else "customer"
            if turns and turns[-1][0] == speaker:
                _, before, start, sure = turns[-1]
                least = sure if u.confidence is None else u.confidence if sure is None else min(u.confidence, sure)
                turns[-1] = (speaker, f"{before} {text}", start, least)
            else:
                turns.append((speaker, text, u.time, u.confidence))
        out.append(turns)
    return out


def sample_models(calls: DataFrame, sample: int = SAMPLE_CALLS) -> TurnModels:
    """Fit on the ``sample`` calls with the smallest hashes of their ids."""
    ceiling = min(1.0, 2.0 * sample / max(1, calls.count())) * 2.0**63
    some = calls.select("call_id", "turns").filter("turns IS NOT NULL AND call_id IS NOT NULL").withColumn("h", F.shiftrightunsigned(F.xxhash64("call_id"), 1))
    some = some.filter(F.col("h").cast("double") <= ceiling).orderBy("h", "call_id").limit(sample)
    return fit_models([[t and t.asDict() for t in r["turns"]] for r in some.collect()])


_TURNS = "turn_no int, speaker string, text string, start_time double, speaker_confidence double"


def clean_turns(calls: DataFrame, models: TurnModels | None = None, *, batch: int = 500) -> DataFrame:
    """(call_id, turn_no, speaker, text, start_time, speaker_confidence), numbered from 1 in order of time.

    Calls delivered once, nearly all, are cleaned where they lie; of those delivered
    again, found by their ids alone, the last delivery is chosen in an exchange.
    """
    models = models or sample_models(calls)
    sent = calls.sparkSession.sparkContext.broadcast(models)
    source = calls.filter("call_id IS NOT NULL").select("call_id", F.col("landed_at").cast("timestamp").alias("landed_at"), "turns")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                turns = b.column(1)
                sizes = pc.fill_null(pc.list_value_length(turns), 0).to_pylist()
                flat = turns.flatten()
                fields = [flat.field(k).to_pylist() if not flat.null_count else pc.struct_field(flat, [k]).to_pylist() for k in range(4)]
                read, start = [], 0
                for n in sizes:
                    read.append(read_turns(*(f[start : start + n] for f in fields)))
                    start += n
                done = clean_calls(read, sent.value)
                of = np.repeat(np.arange(len(done)), [len(t) for t in done])
                rows = [t for call in done for t in call]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                number = [k for call in done for k in range(1, len(call) + 1)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True))],
                    ["call_id", "turn_no", "speaker", "text", "start_time", "speaker_confidence"],
                )

    again = source.groupBy("call_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("call_id")
    again = small(stored(again))
    one = source.join(again, "call_id", "left_anti").select("call_id", "turns")
    many = source.join(again, "call_id", "left_semi").groupBy("call_id").agg(F.max_by("turns", F.struct("landed_at", F.xxhash64("turns"))).alias("turns"))
    return one.unionByName(many).mapInArrow(clean, f"call_id string, {_TURNS}")
