"""Tokens of rules text: one alternation of named patterns, read left to right."""

from __future__ import annotations

import re
from typing import NamedTuple

# Words that shape a sentence, number words.
STRUCTURAL = frozenset("when whenever at if as unless until instead would choose and or then may target you your each another other this that".split())
NUMBERS = frozenset("a an one two three four five six seven eight nine ten".split())

_REMINDER = r"\((?:[^()\n]|\((?:[^()\n])*\))*\)"
PATTERN = re.compile(
    rf"(?P<newline>\n)|(?P<space>[^\S\n]+)|(?P<symbol>\{{[^}}\n]+\}})|(?P<loyalty>[+−-]\d+(?=\s*:))|(?P<reminder>{_REMINDER})"
    r"|(?P<quoted>\"[^\"\n]*\")|(?P<number>\d+)|(?P<word>[^\W\d_][\w'’-]*)|(?P<punctuation>[.,:;()—•/+*−-])"
)


class Token(NamedTuple):
    kind: str
    text: str
    start: int


def symbol_kind(inner: str) -> str:
    """Kind of a {symbol}: tap, untap, energy, variable, colored, colorless, snow, generic, hybrid and Phyrexian ones."""
    s = inner.upper()
    if s in ("T", "Q", "E"):
        return {"T": "tap", "Q": "untap", "E": "energy"}[s]
    if s in ("X", "Y", "Z"):
        return "variable"
    if s in ("W", "U", "B", "R", "G"):
        return "colored"
    if s in ("C", "S"):
        return {"C": "colorless", "S": "snow"}[s]
    if s.isdigit():
        return "generic"
    for kind, shape in (("hybridPhyrexian", r"[WUBRG]/[WUBRG]/P"), ("phyrexian", r"[WUBRG]/P"), ("hybridGeneric", r"\d+/[WUBRG]"), ("hybrid", r"[WUBRG]/[WUBRG]")):
        if re.fullmatch(shape, s):
            return kind
    return "generic"


def tokenize(text: str) -> list[Token] | None:
    """Tokens without white space; None if a character fits no pattern."""
    out, at = [], 0
    while at < len(text):
        m = PATTERN.match(text, at)
        if not m:
            return None
        kind, value = m.lastgroup, m[0]
        if kind == "symbol":
            kind = symbol_kind(value[1:-1])
        elif kind == "word":
            low = value.lower()
            kind = low if low in STRUCTURAL else "numberWord" if low in NUMBERS else "word"
        elif kind == "loyalty":
            kind = "loyaltyUp" if value[0] == "+" else "loyaltyDown"
        elif kind == "punctuation":
            kind = {".": "period", ",": "comma", ":": "colon", "•": "bullet", "—": "dash"}.get(value, "mark")
        if kind != "space":
            out.append(Token(kind, value, at))
        at = m.end()
    return out
