"""Words of a transcript apart from how they are written."""

from __future__ import annotations

import re
import unicodedata

#: Words that a recogniser adds or leaves out, in the four languages.
FILLERS = frozenset(
    "um uh uhm er erm ah oh hm hmm mm mhm huh like well so okay ok right yeah "
    "äh ähm hm tja also halt naja ach so genau euh ben bah hein bon voilà eh em este pues bueno mm ajá".split()
)
#: Labels of speakers; as words of a text they are left out on both sides.
LABELS = frozenset(
    "agent agt rep representative support operator advisor operadora operador agente conseiller conseillere mitarbeiter berater "
    "customer cust cus caller client cliente clienta kunde kundin anrufer user speaker spk".split()
)
#: Numbers as words.
NUMBERS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "first": "1", "1st": "1", "second": "2", "2nd": "2", "third": "3", "3rd": "3", "fourth": "4", "4th": "4", "fifth": "5", "5th": "5",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "funf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zehn": "10",
    "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "dix": "10",
    "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "diez": "10",
    "zweite": "2", "zweiten": "2", "dritte": "3", "deuxieme": "2", "2e": "2", "2eme": "2", "troisieme": "3", "3e": "3", "segundo": "2", "segunda": "2", "2o": "2", "2a": "2",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "eighty": "80", "hundred": "100",
    "quarante": "40", "cuarenta": "40", "vierzig": "40",
}
_INSIDE = re.compile(r"(?<=\w)[.,'’:](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_FOLDED = frozenset("".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in FILLERS)
_DROPPED = _FOLDED | LABELS


def fold(text: str) -> str:
    """Lower case without accents; wide and composed forms become plain."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c))


def spoken_words(text: str | None) -> list[str]:
    """Folded words without fillers and labels; numbers as digits."""
    if not text:
        return []
    number = NUMBERS.get
    return [number(w, w) for w in _WORD.findall(_INSIDE.sub("", fold(text))) if w not in _DROPPED]
