"""Personal information in free text: found by anchors, expanded locally, replaced by typed placeholders.

An Aho-Corasick automaton over the lower-cased text finds anchors in one pass: at-signs
and their spelled forms, cues of identity documents, street words, number words, titles
and introductions before a name, and known names. Around each anchor a small
deterministic parser expands to the borders of a mention, however far they are, and
validates it; digits in phone-like groups are their own anchors, and so are two
capitalised words side by side.

What is a name comes from counts of words over all texts: how often a word stands
behind a title or an introduction, in lower case, behind an article, before a number.
Words that stand where only a name can are known names. Two capitalised words side by
side are a name unless one of them is known as something else, so names that no count
has seen are found too.

Of overlapping mentions the one found by the earlier kind in KINDS stays. Existing
placeholders, network addresses, serial, order, part and ticket numbers are no
mentions.

Defined results: null texts give null and no mention; an empty text stays; offsets
count code points from 0; repeated rows give equal mentions once.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import stored

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
#: Known names and other words that may be sent to the executors. More names are joined to the texts that hold them, and so
#: are the other words but the most frequent.
MOST_NAMES, MOST_OTHERS = 1_000_000, 300_000
#: Digits as words.
DIGIT_WORDS = {
    w: d
    for d, ws in enumerate(("zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"))
    for w in ws.split()
}
#: Number words of spoken house numbers.
HOUSE_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred oh".split()
#: Street words behind the name (English), at the end of it (German), before it (French, Spanish).
STREETS_EN = "street st avenue ave road rd lane ln court ct terrace crescent blvd boulevard drive dr place square way close".split()
STREETS_DE = "straße strasse str weg platz gasse allee ring damm ufer".split()
STREETS_FR = "rue avenue boulevard quai chemin impasse allée place".split()
STREETS_ES = "calle c/ avda avenida plaza paseo".split()
#: Cues of identity numbers, and cues that a number is something else.
IDENTITY_CUES = (
    "social security|national insurance|insurance number|passport|id card|identity card|her social|his social|and his is|printed on the card|the form wants|"
    "ausweis|reisepass|sozialversicherung|auf der karte|personalausweis|carte d'identité|la carte porte|passeport|sécurité sociale|numéro de sécu|"
    "dni|nie es|pasaporte|seguridad social|carné|documento"
).split("|")
OTHER_NUMBER = re.compile(
    r"(?<![^\W_])(?:part|serial|order|ticket|batch|counter|ref|reference|build|rack|port|row|invoice|code|"
    r"bestellung|auftrag|teil|charge|zähler|(?:serien|bestell|auftrags|teile|chargen|ticket|rechnungs)nummer|nummer der|"
    r"commande|série|lot|compteur|pieza|serie|pedido|lote|contador)"
    r"(?:\s+(?:number|no|nr|is|número|numéro|nummer|nº))*[\s.:#]*$"
)
#: Words behind which, nearly always, a name stands: titles, introductions, addressees.
SURE_BEFORE = (
    "mr|mr.|mrs|mrs.|ms.|dr.|my name is|the name is|speaking with|attention|attn|care of|ask for|thank you,|"
    "herr|frau|mein name ist|ich heiße|hier spricht|sprechen mit|fragen sie nach|zu händen|"
    "madame|monsieur|mme|je m'appelle|mon nom est|à l'attention de|"
    "señor|señora|sr.|sra.|don|doña|me llamo|mi nombre es|le atiende|a nombre de"
).split("|")
#: Words behind which a name may stand.
NAME_BEFORE = (*SURE_BEFORE, *"ms|miss|dr|m.|mlle|the name|name is|this is|colleague|contact|dear|regards,|sincerely,|mit freundlichen grüßen|cordialement,|saludos,|soy|hier ist".split("|"))
#: Words that follow a name.
NAME_AFTER = ("speaking, i", "speaking.", "à votre écoute")
#: Articles and their like, behind which a capitalised word is a thing; words behind which it is a place.
DETERMINERS = frozenset(
    "the a an our my your his her its their this that these those each every no any "
    "der die das den dem des ein eine einen einem einer eines unser unsere unserem unseren unserer ihr ihre ihren ihrem ihrer mein meine meinem meinen meiner kein keine keinen dieser diese dieses diesem diesen jede jeder jedes am im zum zur vom beim "
    "le la les un une du des au aux notre nos votre vos mon ma mes son sa ses leur leurs ce cet cette ces l d el los las una unos unas nuestro nuestra nuestros nuestras mi mis su sus este esta estos estas ese esa del al".split()
)
PLACE_BEFORE = frozenset("in near nach aus dans".split())
#: Particles inside a family name.
PARTICLES = ("van der", "van den", "van", "von der", "von", "de la", "de", "del", "di", "da", "ter", "ten", "la", "le")
PARTICLE_WORDS = frozenset(w for p in PARTICLES for w in p.split())
SPELLED_AT = " at | arroba | arobase | chez | klammeraffe |@|(at)|[at]".split("|")

_NAME = r"[^\W\d_]+(?:['’][^\W\d_]+)?(?:-[^\W\d_]+(?:['’][^\W\d_]+)?)*"
_WORD = re.compile(_NAME)
_PLACEHOLDER = re.compile(r"\[redacted:[a-z_]+\]")
_MAIL = re.compile(r"[\w.+%'-]+(?: ?@ ?| ?[(\[]at[)\]] ?)[\w-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[\w-]+)+")
_MAIL_RIGHT = re.compile(r"[\])]? ?[\w-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[\w-]+)+")
_TOKEN = r"[\w+-]+"
_JOINS = frozenset("dot dash minus underscore plus punkt bindestrich unterstrich punto guion guión point tiret".split())
_JOIN = rf"(?: (?:{'|'.join(sorted(_JOINS))}) )"
_SPOKEN_MAIL = re.compile(rf"(?<![\w@]){_TOKEN}(?:{_JOIN}{_TOKEN})* (?:at|arroba|arobase|klammeraffe) {_TOKEN}(?: (?:dash|minus|guion|tiret|bindestrich) {_TOKEN})*(?: (?:dot|punkt|punto|point) {_TOKEN})+")
_SPOKEN_RIGHT = re.compile(rf" ?{_TOKEN}(?: (?:dash|minus|guion|tiret|bindestrich) {_TOKEN})*(?: (?:dot|punkt|punto|point) {_TOKEN})+")
_WHOLE_TOKEN = re.compile(_TOKEN)
_DIGITS = re.compile(r"(?<![\w.:/-])(?:\+|\()?\d(?:[\d().\-/ ]*\d)?(?![\w:]|[.-]\d)")
_LETTER_ID = re.compile(r"(?<![\w.-])(?=[a-z0-9]*\d)[a-z][a-z0-9]{7,8}(?![\w-])|(?<![\w.-])[a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-d](?!\w)|(?<![\w.-])\d{2}\.?\d{3}\.?\d{3}-?[a-z](?!\w)|(?<![\w.-])[xyz]-?\d{7}-?[a-z](?!\w)")
_FRENCH_ID = re.compile(r"(?<!\d)[12] ?\d\d ?(?:0[1-9]|1[0-2]|[2-9]\d) ?\d[\dab] ?\d{3} ?\d{3}(?: ?\d\d)?(?!\d)")
_SSN = re.compile(r"\d{3}([-. ])\d{2}\1\d{4}")
_SPOKEN_DIGITS = re.compile(rf"\b(?:(?:double|triple) )?(?:{'|'.join(DIGIT_WORDS)})(?:,? (?:(?:double|triple) )?(?:{'|'.join(DIGIT_WORDS)})){{6,}}\b")
_HOUSE = rf"(?:\d{{1,5}}[a-z]?|(?:{'|'.join(HOUSE_WORDS)})(?:[ -](?:{'|'.join(HOUSE_WORDS)})){{0,3}})"
_EN = re.compile(rf"\b{_HOUSE} (?:(?:north|south|east|west|n\.|s\.|e\.|w\.) )?{_NAME}(?: {_NAME})? (?:{'|'.join(STREETS_EN)})\b\.?(?: ?(?:#\d+|, ?(?:apt|flat|unit|suite)\.? ?\w+))?")
_DE = re.compile(rf"\b(?:(?:am|im|an der|auf der|zum|zur) )?[^\W\d_]{{3,}}[- ]?(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer) \d{{1,4}}\s?[a-z]?\b")
_FR = re.compile(rf"\b\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:{'|'.join(STREETS_FR)}) (?:(?:de la|de l'|du|des|de|d') ?)?{_NAME}(?: {_NAME})?")
_ES = re.compile(rf"(?<!\w)(?:calle|c/|avda\.?|avenida|plaza|paseo) ?(?:(?:de la|del|de) )?{_NAME}(?: {_NAME})?,? ?(?:n\.º|nº|n\.|núm\.|num\.)? ?\d{{1,4}}(?:, ?\d+\.?[ºª](?: ?[a-z]\b)?)?")


def lower_same(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Names:
    """Known name words: sure ones wherever they stand, doubtful ones (also common words) only beside other evidence.

    ``common`` words are often written in lower case, ``things`` stand behind articles or before numbers.
    """

    sure: frozenset[str] = frozenset()
    doubtful: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    things: frozenset[str] = frozenset()
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> tuple:
        return self.sure, self.doubtful, self.common, self.things

    def __setstate__(self, state: tuple) -> None:
        self.sure, self.doubtful, self.common, self.things = state
        self._machine = None

    @property
    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            words: dict[str, set[str]] = {}
            for kind, of in (
                ("mail", SPELLED_AT),
                ("id", IDENTITY_CUES),
                ("en", STREETS_EN),
                ("de", STREETS_DE),
                ("fr", STREETS_FR),
                ("es", STREETS_ES),
                ("digit", [w for w in DIGIT_WORDS if len(w) > 2]),
                ("before", NAME_BEFORE),
                ("after", NAME_AFTER),
                ("name", self.sure),
                ("maybe", self.doubtful),
            ):
                for w in of:
                    words.setdefault(w, set()).add(kind)
            self._machine = ahocorasick.Automaton()
            for w, kinds in words.items():
                self._machine.add_word(w, (len(w), tuple(kinds)))
            self._machine.make_automaton()
        return self._machine


_BASE = Names()
_CUE_WORDS = frozenset(w.rstrip(".,") for w in NAME_BEFORE if " " not in w)


def _anchors(low: str, names: Names) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    size = len(low)
    for end, (width, kinds) in names.machine.iter(low):
        start, end = end - width + 1, end + 1
        whole = (start == 0 or not low[start].isalnum() or not low[start - 1].isalnum()) and (end == size or not low[end - 1].isalnum() or not low[end].isalnum())
        for kind in kinds:
            # German street words end a compound.
            if whole or kind == "mail" or kind == "de" and not low[end : end + 1].isalnum():
                out.setdefault(kind, []).append((start, end))
    return out


def _spoken_start(low: str, end: int) -> int:
    """Where the spoken part before an "at" begins: a token, and further ones by words such as "dot"."""
    start = low.rfind(" ", 0, end) + 1
    if not _WHOLE_TOKEN.fullmatch(low, start, end):
        return end
    while start > 1:
        join = low.rfind(" ", 0, start - 1) + 1
        if low[join : start - 1] not in _JOINS or not join:
            break
        before = low.rfind(" ", 0, join - 1) + 1
        m = re.search(rf"{_TOKEN}$", low[before : join - 1])
        if not m:
            break
        start = before + m.start()
        if m.start():
            break
    return start


def _mails(low: str, at_signs: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Addresses around each at-sign or word for it, out to their borders; what lies between two at-signs is read once for each."""
    spoken = any(w in low for w in (" dot ", " punkt ", " punto ", " point "))
    for s, e in at_signs:
        if low[s:e].strip().isalpha():
            m = _SPOKEN_RIGHT.match(low, e) if spoken else None
            start = _spoken_start(low, s) if m else s
            if start < s and not (start and (low[start - 1].isalnum() or low[start - 1] in "_@")):
                yield start, m.end(), "email"
            continue
        m = _MAIL_RIGHT.match(low, e)
        start = s - (low[s - 1 : s] == " ")
        while start and (low[start - 1].isalnum() or low[start - 1] in "_.+%'-"):
            start -= 1
        if m and low[start:s].strip():
            yield start + (low[start] in ".'-"), m.end(), "email"


def _phone_like(s: str) -> bool:
    """Whether a run of digits and separators is a telephone number by the plans of the countries served."""
    d = re.sub(r"\D", "", s)
    if s.startswith("+"):
        return 9 <= len(d) <= 15
    if re.fullmatch(r"(?:1[-. ]?)?\(?[2-9]\d\d\)?[-. ]*[2-9]\d\d[-. ]?\d{4}", s):
        return True
    if d.startswith("00"):
        return 11 <= len(d) <= 16
    if d.startswith("0"):  # national forms of Britain, Germany and France
        return 9 <= len(d) <= 12 and not re.fullmatch(r"\d{3}[- .]\d{2}[- .]\d{5}", s)
    return len(d) == 9 and d[0] in "679" and bool(re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{3}|\d{3}[ .-]\d\d[ .-]\d\d[ .-]\d\d", s))


def _numbers(low: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Phones and identity numbers among the digits."""
    # Sentences, as the places where they begin, that name an identity document.
    begins = [0, *(m.end() for m in re.finditer(r"[.?!] |\n", low))] if cues else [0]
    named = {bisect(begins, c) for c, _ in cues}

    def by_card(start: int, end: int) -> bool:
        return bisect(begins, start) in named

    for m in _FRENCH_ID.finditer(low) if cues else ():
        if by_card(m.start(), m.end()):
            yield m.start(), m.end(), "identity_number"
    for m in _LETTER_ID.finditer(low) if cues or "qq" in low else ():
        nino = re.fullmatch(r"[a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-d]", m[0])
        if not OTHER_NUMBER.search(low[max(0, m.start() - 40) : m.start()]) and (by_card(m.start(), m.end()) or nino and m[0].startswith("qq")):
            yield m.start(), m.end(), "identity_number"
    for m in _DIGITS.finditer(low):
        start, run = m.start(), m[0]
        if OTHER_NUMBER.search(low[max(0, start - 40) : start]):
            continue
        if _SSN.fullmatch(run) or len(run) == 9 and run.isdigit() and by_card(start, m.end()):
            yield start, m.end(), "identity_number"
        elif _phone_like(run):
            yield start, m.end(), "phone"
        elif " " in run:
            # Two numbers side by side: try the longest heads and tails that make one.
            parts = list(re.finditer(r"\S+", run))
            for i in range(len(parts)):
                hit = next((j for j in range(len(parts), i, -1) if _phone_like(run[parts[i].start() : parts[j - 1].end()])), None)
                if hit:
                    yield start + parts[i].start(), start + parts[hit - 1].end(), "phone"
                    break


def _spoken_phones(low: str) -> Iterator[tuple[int, int, str]]:
    for m in _SPOKEN_DIGITS.finditer(low):
        if not OTHER_NUMBER.search(low[max(0, m.start() - 40) : m.start()]):
            yield m.start(), m.end(), "phone"


_STREET_NAMES_NOT = frozenset("the a of our your this that switch at in on to for and or is are was".split())


_STREETS = {"en": (_EN, 60, 25), "de": (_DE, 45, 10), "fr": (_FR, 20, 60), "es": (_ES, 5, 70)}


def _addresses(low: str, anchors: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int, str]]:
    for kind, (pattern, left, right) in _STREETS.items():
        for s, e in anchors.get(kind, ()):
            for m in pattern.finditer(low, max(0, s - left), min(len(low), e + right)):
                if m.start() <= s < m.end() and not (kind == "en" and _STREET_NAMES_NOT & set(re.split(r"[ ,]+", m[0]))):
                    yield m.start(), m.end(), "street_address"


def _is_name(text: str, low: str, start: int, end: int, names: Names, cased: bool, cue: bool) -> bool:
    """Whether one word is part of a name here."""
    parts = low[start:end].split("-")
    if any(p in names.sure for p in parts):
        return True
    capital = text[start].isupper()
    if all(p in names.doubtful for p in parts):
        return cue if not cased else capital and (cue or start > 1 and text[start - 1] == " " and text[start - 2] not in ".?!:")
    if not cue or end - start < 2 or low[start:end] in _CUE_WORDS or low[start:end] in names.common or any(ch.isdigit() for ch in text[start:end]):
        return False
    return capital if cased else True


_CAPITAL = r"[A-ZÀ-ÖØ-Þ]['’]?[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_TWO_CAPITALS = re.compile(rf"(?<![\w@.-]){_CAPITAL}(?= (?:(?:{'|'.join(PARTICLES)}) )?{_CAPITAL})")
_NEXT = re.compile(rf"[. \n]{{0,2}}({_NAME})")


class _Taken:
    """Spans that nothing else may overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def free(self, a: int, b: int) -> bool:
        k = bisect(self.starts, a)
        return not (k and self.ends[k - 1] > a) and not (k < len(self.starts) and self.starts[k] < b)

    def add(self, a: int, b: int) -> None:
        k = bisect(self.starts, a)
        self.starts.insert(k, a), self.ends.insert(k, b)


def _opens_sentence(text: str, start: int) -> bool:
    before = text[max(0, start - 3) : start].rstrip(" ")
    return not before or before[-1] in ".?!:…;\n\"“«¿¡"


def _names(text: str, low: str, anchors: dict[str, list[tuple[int, int]]], names: Names, taken: _Taken) -> Iterator[tuple[int, int, str]]:
    cased = text != low and text != text.upper()
    before = {e for _, e in anchors.get("before", ())}
    after = {s for s, _ in anchors.get("after", ())}
    ordinary = lambda w: w in DETERMINERS or w in names.common and w not in names.doubtful or w in names.things
    at = {s for s, _ in anchors.get("name", ())} | {s for s, _ in anchors.get("maybe", ()) if not cased or text[s].isupper()}
    for e in before:
        m = _NEXT.match(low, e)
        if m and not ordinary(m[1]):
            at.add(m.start(1))
    at.update(s - 1 for s in after if s)
    pairs = set()
    if cased and names.common:
        pairs = {m.start() for m in _TWO_CAPITALS.finditer(text) if not ordinary(m[0].lower())}
    places = sorted(at | pairs)
    done = 0
    for k, place in enumerate(places):
        # A name stays within its line; only lines with a place to look at are cut into words.
        if k and place < done:
            continue
        begin = low.rfind("\n", 0, place) + 1
        end = low.find("\n", place)
        done = end = end if end >= 0 else len(low)
        yield from _line_names(text, low, begin, end, [p for p in places[k:] if p < end] if len(places) < 50 else places[k : bisect(places, end)], pairs, before, after, names, taken, cased)


def _line_names(text: str, low: str, begin: int, stop: int, places: list[int], pairs: set[int], before: set[int], after: set[int], names: Names, taken: _Taken, cased: bool) -> Iterator[tuple[int, int, str]]:
    word = [m.span() for m in _WORD.finditer(low, begin, stop)]
    starts = [a for a, _ in word]
    upper = lambda k: text[word[k][0]].isupper()
    said = lambda k: low[word[k][0] : word[k][1]]

    def strange(k: int) -> bool:
        """A capitalised word that nothing is known of, or that is known as a name."""
        w = said(k)
        known = any(p in names.sure for p in w.split("-"))
        return upper(k) and (known or len(w) > 2 and w not in names.common and w not in names.things and w not in _CUE_WORDS and w not in DETERMINERS and not text[word[k][0] : word[k][1]].isupper())

    seeds, paired = set(), set()
    for place in places:
        k = bisect(starts, place) - 1
        if k < 0:
            continue
        if place not in pairs:
            seeds.add(k)
            continue
        last = k + 1
        while last < len(word) and not upper(last):
            last += 1
        if starts[k] != place or last >= len(word) or not (strange(k) and strange(last)) or _opens_sentence(text, place):
            continue
        left = said(k - 1) if k and low[word[k - 1][1] : starts[k]] == " " else ""
        if left not in DETERMINERS and left not in PLACE_BEFORE and not re.match(r" ?\d", low[word[last][1] : word[last][1] + 2]):
            paired.add(k)
            seeds.add(k)
    done = -1
    for k in sorted(seeds):
        start, end = word[k]
        if k < 0 or start <= done or not taken.free(start, end) or start and (low[start - 1].isalnum() or low[start - 1] in "@_/"):
            continue
        if low[end : end + 1] in ("@", "_") or re.match(r"\.[a-z]{2,}", low[end : end + 4] if end + 1 < len(low) else ""):
            continue

        def near_cue(a: int, b: int) -> bool:
            left = a - 1 if a and low[a - 1] in " .\n" else a
            return left in before or a in before or any(low.startswith(x, b) and b + len(x) in after for x in (" ", ", ", "; "))

        first = last = k
        if end - start == 1 and low[end : end + 1] == "." and k + 1 < len(word) and low[end : starts[k + 1]] in (".", ". "):
            if not _is_name(text, low, *word[k + 1], names, cased, near_cue(start, word[k + 1][1])):
                continue
            last = k + 1
        elif k not in paired and not _is_name(text, low, start, end, names, cased, near_cue(start, end)):
            continue
        # Leftwards: words of the same name that were no seed themselves.
        while first:
            j, particle = first - 1, False
            while j and said(j) in PARTICLE_WORDS:
                j, particle = j - 1, True
            between, w = low[word[j][1] : starts[first]], said(j)
            a = starts[j]
            if a <= done or not taken.free(*word[j]) or w in PARTICLE_WORDS or a and (low[a - 1].isalnum() or low[a - 1] == "_"):
                break
            if len(w) == 1 and between == ". " and (not cased or upper(j)):
                first = j
            elif (particle or between in (" ", ", ", "-")) and a not in before and a - 1 not in before and (w in names.sure or all(p in names.sure or p in names.doubtful for p in w.split("-")) and (not cased or upper(j))):
                first = j
            elif (particle or between == " ") and w in names.sure:
                first = j
            else:
                break
        # Rightwards: further words, particles, "Family, First".
        while last + 1 < len(word):
            j = last + 1
            while j + 1 < len(word) and said(j) in PARTICLE_WORDS:
                j += 1
            particle = j > last + 1
            between, comma = low[word[last][1] : starts[j]], low[word[last][1] : word[last][1] + 2] == ", "
            if j == last + 1 and len(said(j)) == 1 and j + 1 < len(word) and between == " " and low[word[j][1] : starts[j + 1]] == ". ":
                j += 1  # a middle initial
            elif not (between in (" ", ", ", "-") or particle and between.startswith(" ") and not set(between) & set(",.;:!?\n")):
                break
            if not taken.free(*word[j]):
                break
            w = said(j)
            parts = w.split("-")
            known = any(p in names.sure for p in parts) or all(p in names.doubtful for p in parts) and (upper(j) or not cased and between == " " and near_cue(starts[first], word[j][1]))
            fresh = not comma and cased and upper(j) and w not in names.common and w not in names.things and len(w) > 2
            if not (known or fresh) or comma and last > first:
                break
            last = j
        yield word[first][0], word[last][1], "person_name"
        done = word[last][1]


def find_mentions(text: str | None, names: Names = _BASE) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every mention, in order, none overlapping."""
    if not text:
        return []
    low = lower_same(text)
    anchors = _anchors(low, names)
    taken = _Taken([m.span() for m in _PLACEHOLDER.finditer(low)] if "[redacted" in low else [])
    found: list[tuple[int, int, str]] = []

    def keep(mentions: Iterator[tuple[int, int, str]]) -> None:
        for a, b, kind in mentions:
            if taken.free(a, b):
                taken.add(a, b)
                found.append((a, b, kind))

    if "mail" in anchors:
        keep(_mails(low, anchors["mail"]))
    if "digit" in anchors:
        keep(_spoken_phones(low))
    keep(_addresses(low, anchors))
    keep(_numbers(low, anchors.get("id", [])))
    keep(_names(text, low, anchors, names, taken))
    return sorted(found)


def redact(text: str | None, mentions: list[tuple[int, int, str]]) -> str | None:
    """The text with ``[REDACTED:KIND]`` for each mention."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in mentions:
        out += [text[at:a], f"[REDACTED:{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


COUNTS = ("lower", "upper", "thing", "runs", "hits")


@lru_cache(maxsize=1)
def _sure_cues() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for w in SURE_BEFORE:
        machine.add_word(w, len(w))
    machine.make_automaton()
    return machine


def _name_places(text: str, low: str) -> Iterator[str]:
    """The words of names that stand behind sure cues, in their written form."""
    for last, width in _sure_cues().iter(low):
        start, end = last - width + 1, last + 1
        if (start == 0 or not low[start - 1].isalnum()) and not low[end : end + 1].isalnum():
            m = _PLACED.match(text, end + (text[end : end + 1] in (" ", "\n")))
            if m:
                yield from (p for g in m.groups() if g for p in g.split("-") if len(p) > 2)


_ONE = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’][^\W\d_]+)?"
_PLACED = re.compile(rf"(?:[A-ZÀ-ÖØ-Þ]\. )?({_ONE}(?:-{_ONE})*)(?:,? (?:(?:{'|'.join(PARTICLES)}) )?({_ONE}(?:-{_ONE})*))?")


def count_words(texts: Iterable[str | None]) -> dict[str, list[int]]:
    """For each word: how often in lower case; capitalised inside a sentence; of these as a thing, and beside another such word; behind sure cues of names."""
    out: dict[str, list[int]] = {}
    lower: Counter = Counter()
    for text in texts:
        if not text:
            continue
        low = lower_same(text)
        if text == low or text.upper() == text:
            continue
        tokens = text.split()
        lower.update([t for t in tokens if t.islower() and t.isalpha()])
        before = -9
        for k in [k for k, t in enumerate(tokens) if t[0].isupper() and k]:
            left = tokens[k - 1]
            if left[-1] in ".?!:;…":
                continue
            t = tokens[k]
            w = t.rstrip(_SIGNS)
            if len(w) < 3 or not w.replace("-", "").replace("'", "").replace("’", "").isalpha() or w.isupper():
                continue
            right = tokens[k + 1] if len(w) == len(t) and k + 1 < len(tokens) else ""
            near = left.lower()
            particle = near in PARTICLE_WORDS and k > 1 and tokens[k - 2].lower() in PARTICLE_WORDS
            # Behind an article, beside a number, behind "in", or with a street word: no name of a person.
            thing = not particle and near in _THING_BEFORE or right[:1].isdigit() or left[0].isdigit() or w.lower() in _STREET_WORDS or right.lower().rstrip(_SIGNS) in _STREET_WORDS
            words = [p.lower() for p in w.split("-") if len(p) > 2]
            run = not thing and before == k - 1
            for p in words:
                c = out.setdefault(p, [0, 0, 0, 0, 0])
                c[1] += 1
                c[2] += thing
                c[3] += run
            if run:
                for p in last:
                    out[p][3] += 1
            before, last = (-9 if thing or len(w) < len(t) else k), words
        for w in _name_places(text, low):
            out.setdefault(w.lower(), [0, 0, 0, 0, 0])[4] += 1
    for w, n in lower.items():
        out.setdefault(w, [0, 0, 0, 0, 0])[0] += n
    return out


_STREET_WORDS = frozenset((*STREETS_EN, *STREETS_DE, *STREETS_FR, *STREETS_ES, "avda.", "blvd."))
_THING_BEFORE = DETERMINERS | PLACE_BEFORE | _STREET_WORDS
_SIGNS = ".,;:!?…\"'”’»)]"


def name_words(n: dict[str, int] | object) -> str | None:
    """What the counts of a word make it: sure or doubtful as a name, common, thing, or nothing."""
    lower, upper, thing, runs, hits = n
    placed = hits >= 2 and hits >= 0.1 * upper
    beside = runs >= 2 and runs >= 0.3 * upper and lower <= 0.1 * upper
    if (placed or beside) and thing <= 0.1 * upper:
        if lower <= 0.3 * hits or beside:
            return "sure"
        if hits >= 3:
            return "doubtful"
    if lower >= 3:
        return "common"
    return "thing" if thing >= 2 and thing >= 0.1 * upper else None


def learn_names(texts: list[str]) -> Names:
    """Names from texts at hand; ``corpus_names`` does the same over a table."""
    kinds: dict[str | None, set[str]] = {}
    for w, n in count_words(texts).items():
        kinds.setdefault(name_words(n), set()).add(w)
    return Names(*(frozenset(kinds.get(k, set()) - (_CUE_WORDS if k in ("sure", "doubtful") else set())) for k in ("sure", "doubtful", "common", "thing")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, lower, upper, thing, hits) over all texts; counts are added up where the texts lie before they are exchanged."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for b in batches:
            for w, n in count_words(b.column(0).to_pylist()).items():
                have = total.setdefault(w, [0] * len(COUNTS))
                for k in range(len(COUNTS)):
                    have[k] += n[k]
            if len(total) > 200_000:
                yield _counted(total)
                total = {}
        yield _counted(total)

    made = texts.select("text").mapInArrow(count, "word string, " + ", ".join(f"`{c}` bigint" for c in COUNTS))
    return made.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _counted(total: dict[str, list[int]]) -> pa.RecordBatch:
    columns = list(zip(*total.values(), strict=True)) or [()] * len(COUNTS)
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["word", *COUNTS])


def _kind() -> F.Column:
    """``name_words`` as an expression."""
    lower, upper, thing, runs, hits = (F.col(c) for c in COUNTS)
    beside = (runs >= 2) & (runs >= 0.3 * upper) & (lower <= 0.1 * upper)
    name = ((hits >= 2) & (hits >= 0.1 * upper) | beside) & (thing <= 0.1 * upper) & ~F.col("word").isin(list(_CUE_WORDS))
    return F.when(name & ((lower <= 0.3 * hits) | beside), "sure").when(name & (hits >= 3), "doubtful").when(lower >= 3, "common").when((thing >= 2) & (thing >= 0.1 * upper), "thing")


def corpus_names(texts: DataFrame) -> tuple[Names, DataFrame | None]:
    """Names of a table of texts, and, if its words are too many to be sent, the table (word, kind) of those that were not.

    Names are sent all or not at all; common words and things, which keep unseen names
    apart from other words, up to the MOST_OTHERS most frequent.
    """
    words = stored(word_counts(texts).withColumn("kind", _kind()).filter("kind IS NOT NULL"))
    size = dict(words.groupBy("kind").count().collect())
    names = words.filter("kind IN ('sure', 'doubtful')").select("word", "kind")
    others = words.filter("kind IN ('common', 'thing')").select("word", "kind", (F.col("lower") + F.col("upper")).alias("n"))
    of: dict[str, set[str]] = {}
    left = []
    if size.get("sure", 0) + size.get("doubtful", 0) > MOST_NAMES:
        left.append(names)
    else:
        for r in names.toLocalIterator():
            of.setdefault(r["kind"], set()).add(r["word"])
    many = size.get("common", 0) + size.get("thing", 0) > MOST_OTHERS
    r = None
    for r in (others.orderBy(F.desc("n"), "word").limit(MOST_OTHERS) if many else others).toLocalIterator():
        of.setdefault(r["kind"], set()).add(r["word"])
    if many:
        # Those behind the last that is sent.
        behind = F.lit(True) if r is None else (F.col("n") < r["n"]) | (F.col("n") == r["n"]) & (F.col("word") > r["word"])
        left.append(others.filter(behind).select("word", "kind"))
    return Names(*(frozenset(of.get(k, ())) for k in ("sure", "doubtful", "common", "thing"))), reduce(DataFrame.unionByName, left) if left else None


_LETTERS = re.compile(r"[^\W\d_]+")
_CHAIN = re.compile(r"[^\W\d_]+(?:['’]+[^\W\d_]+)*")


def _looked_up(text: str, longest: int) -> set[str]:
    """The words of a text that ``find_mentions`` may look up, of at most ``longest`` parts between apostrophes."""
    # Only these letters have a lower case that depends on the text around them.
    out = {m[0].lower() for m in _TWO_CAPITALS.finditer(text)} if "Σ" in text or "İ" in text else set()
    for w in set(_CHAIN.findall(lower_same(text))):
        if w.isalpha():
            out.add(w)
            continue
        cuts = [m.span() for m in _LETTERS.finditer(w)]
        out.update(w[a:b] for k, (a, _) in enumerate(cuts) for _, b in cuts[k : k + longest])
    return out


def _with_known(texts: DataFrame, table: DataFrame, sent: Broadcast) -> DataFrame:
    """Texts with the known words that each holds and that were not sent, as ``known`` (map of word to kind)."""
    keyed = texts.select("rec_id", "text", F.md5("text").alias("h"))
    longest = table.agg(F.max(F.size(F.split("word", "['’]+")))).first()[0] or 0

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        for b in batches:
            of, held = [], []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held += [w for w in _looked_up(text or "", longest) if not (w in every.common or w in every.things or w in every.sure or w in every.doubtful)]
                of += [h] * (len(held) - len(of))
                if len(held) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(held, pa.string())], ["h", "word"])
                    of, held = [], []
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(held, pa.string())], ["h", "word"])

    held = keyed.select("h", "text").mapInArrow(words, "h string, word string")
    known = held.join(table, "word").groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("word", "kind"))).alias("known"))
    return keyed.join(known, "h", "left").select("rec_id", "text", "known")


class _Words:
    """Words that were sent and those joined to one text; empty only if the whole table has none."""

    def __init__(self, sent: frozenset[str], own: frozenset[str], some: bool) -> None:
        self.sent, self.own, self.some = sent, own, some

    def __contains__(self, word: str) -> bool:
        return word in self.sent or word in self.own

    def __bool__(self) -> bool:
        return self.some


def _names_of(every: Names, known: list[tuple[str, str]], common: bool) -> Names:
    """The names that were sent, with the known words joined to one text."""
    if not known and bool(every.common) == common:
        return every
    sure, doubtful, own, things = (frozenset(w for w, kind in known if kind == k) for k in ("sure", "doubtful", "common", "thing"))
    machine = None if sure or doubtful else every.machine
    return Names(sure or every.sure, doubtful or every.doubtful, _Words(every.common, own, common), _Words(every.things, things, True), machine)


def mentions(texts: DataFrame, names: Names | None = None) -> DataFrame:
    """(rec_id, redacted, found array<struct<pii_kind, start_at, end_at>>) of rows (rec_id, text); no shuffle of texts unless known words are too many to be sent."""
    table = None
    if names is None:
        names, table = corpus_names(texts)
    common = bool(names.common) or table is not None and not table.filter("kind = 'common'").isEmpty()
    sent = texts.sparkSession.sparkContext.broadcast(names)
    kind = pa.list_(pa.struct([("pii_kind", pa.string()), ("start_at", pa.int32()), ("end_at", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            if b.num_columns == 2:
                found = [find_mentions(t, every) for t in texts]
            else:
                found = [find_mentions(t, _names_of(every, k or [], common)) for t, k in zip(texts, b.column(2).to_pylist(), strict=True)]
            clean = [redact(t, f) for t, f in zip(texts, found, strict=True)]
            rows = [[{"pii_kind": k, "start_at": s, "end_at": e} for s, e, k in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string()), pa.array(rows, kind)], ["rec_id", "redacted", "found"])

    source = texts.select("rec_id", "text") if table is None else _with_known(texts, table, sent)
    return source.mapInArrow(scan, "rec_id string, redacted string, found array<struct<pii_kind: string, start_at: int, end_at: int>>")
