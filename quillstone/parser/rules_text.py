"""Parsing of cards' rules text.

A text is split into clauses, each clause is classified by the first rule that fits, and the parser of its kind
tries its patterns. What no pattern fits becomes an unparsed ability with one error diagnostic. Results are plain
dictionaries in the JSON shape of the golden cases.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from quillstone.parser.tokens import Token, symbol_kind, tokenize

Json = dict[str, Any]

# Words that name an ability before an em dash.
ABILITY_WORDS = frozenset(w.lower() for w in (
    "Landfall", "Revolt", "Enrage", "Delirium", "Threshold", "Hellbent", "Metalcraft", "Morbid", "Raid", "Spell mastery", "Ferocious", "Formidable",
    "Undergrowth", "Addendum", "Spectacle", "Constellation", "Heroic", "Inspired", "Battalion", "Bloodrush", "Evolve", "Extort", "Overload", "Populate",
    "Scavenge", "Detain", "Unleash", "Radiance", "Kinship", "Domain", "Converge", "Sweep", "Grandeur", "Channel", "Bloodthirst", "Imprint", "Join forces",
    "Tempting offer", "Will of the council", "Council's dilemma", "Parley", "Lieutenant", "Eminence", "Alliance", "Coven", "Pack tactics", "Magecraft", "Adventure"))
# Keywords that stand before a cost.
ACTIVATION_WORDS = frozenset("equip cycling crew fortify reconfigure ninjutsu outlast megamorph morph unearth suspend transfigure transmute boast channel".split())
# Subtypes of tokens that creation effects name.
TOKEN_TYPES = (
    "Saproling Zombie Spirit Goblin Soldier Human Elf Warrior Wolf Dragon Thopter Servo Knight Vampire Cat Bat Bird Insect Squirrel Citizen Rat Angel "
    "Detective Robot Kraken Eldrazi Phyrexian Germ Golem Rebel Hero Ally Orc Army").split()
SUPERTYPES = frozenset("Basic Legendary Ongoing Snow World".split())
COLOR_WORDS = {"white": "W", "blue": "U", "black": "B", "red": "R", "green": "G"}
# Plain keywords and the effect each stands for.
KEYWORDS: dict[str, Json] = {
    "Flying": {"effectType": "evasion", "canBeBlockedBy": {"cardTypes": ["creature"], "characteristics": ["flying", "reach"]}},
    "Vigilance": {"effectType": "vigilance"}, "Trample": {"effectType": "trample"}, "Haste": {"effectType": "haste"}, "Lifelink": {"effectType": "lifelink"}, "Reach": {"effectType": "reach"},
    "Flash": {"effectType": "timingModification", "modification": "Grant", "timing": "Instant"},
    "First strike": {"effectType": "combatDamageTiming", "timing": "First"}, "Double strike": {"effectType": "combatDamageTiming", "timing": "Both"},
    **{f"{land}walk": {"effectType": "evasion", "unblockableCondition": {"conditionType": "DefendingPlayerControls", "permanentFilter": {"subtypes": [land]}}}
       for land in ("Plains", "Island", "Swamp", "Mountain", "Forest")},
}
COSTS = frozenset("tap untap energy variable colored colorless snow generic hybrid hybridGeneric phyrexian hybridPhyrexian".split())
CARD_TYPES = frozenset("creature artifact enchantment instant sorcery planeswalker land".split())


@dataclass
class Clause:
    text: str
    start: int
    tokens: list[Token]
    modal_option: bool = False
    levels: tuple[int, int | None] | None = None


@dataclass
class Kind:
    kind: str
    confidence: float
    ability_word: str | None = None
    loyalty: int | None = None


@dataclass
class Result:
    abilities: list[Json] = field(default_factory=list)
    diagnostics: list[Json] = field(default_factory=list)
    clauses: int = 0

    @property
    def failed(self) -> int:
        return sum(a["kind"] == "unparsed" for a in self.abilities)

    @property
    def status(self) -> str:
        return "FullyParsed" if not self.failed else "Failed" if self.failed == len(self.abilities) else "Partial"


# --- clauses


def split_clauses(text: str | None) -> list[Clause]:
    """A clause per non-empty line; choices split at bullets, level lines at their colon."""
    out: list[Clause] = []
    at = 0

    def add(s: str, start: int, **more) -> None:
        if s:
            out.append(Clause(s, start, tokenize(s) or [], **more))

    for line in (text or "").split("\n"):
        s = line.strip()
        if re.match(r"choose (?:one|two|three|any number|up to)", s, re.I):
            offset = at
            for k, part in enumerate(s.split("•")):
                add(part.strip(), offset, **({"modal_option": True} if k else {}))
                offset += len(part) + 1
        elif levels := re.match(r"level (?:(\d+)\+|(\d+)-(\d+))\s*$", s, re.I):
            # the range alone, so there is no colon to cut at
            add(s, at, levels=(int(levels[1] or levels[2]), int(levels[3]) if levels[3] else None))
        else:
            add(s, at)
        at += len(line) + 1
    return out


def classify(c: Clause) -> Kind:
    t = c.tokens
    if not t:
        return Kind("unparsed", 1.0)
    word = c.text.split("—", 1)[0].strip() if c.text.find("—") > 0 else ""
    named = word if word.lower() in ABILITY_WORDS else None
    if len(t) >= 2 and t[0].kind in ("loyaltyUp", "loyaltyDown"):
        n = int(t[0].text[1:])
        return Kind("activated", 0.98, named, n if t[0].kind == "loyaltyUp" else -n)
    if len(t) >= 2 and t[0].text == "0" and t[1].kind == "colon":
        return Kind("activated", 0.98, named, 0)
    kinds = [x.kind for x in t]
    if kinds[0] in ("when", "whenever", "at"):
        return Kind("triggered", 0.95, named)
    colon = kinds.index("colon") if "colon" in kinds else 0
    before = kinds[:colon]
    if before and not {"when", "whenever", "at"} & set(before) and (COSTS & set(before) or t[colon - 1].text.lower() in ACTIVATION_WORDS):
        return Kind("activated", 0.90, named)
    if "would" in kinds and "instead" in kinds:
        return Kind("static", 0.85, named)
    if kinds[0] == "choose":
        return Kind("modal", 0.95, named)
    weighty = sum(k in ("word", "number", "generic", "colored") for k in kinds)
    plain = all(k in ("word", "number", "generic", "colored", "reminder", "period", "comma") for k in kinds)
    return Kind("static", 0.80 if plain and weighty <= 2 else 0.50, named)


# --- parts


def number_word(text: str) -> int | None:
    """By substring, two to ten first: "stone" is 1 through "one" and "often" 10 through "ten"."""
    low = text.lower()
    for n, w in enumerate("two three four five six seven eight nine ten".split(), 2):
        if w in low:
            return n
    if "one" in low or " a " in low or "an " in low:
        return 1
    m = re.search(r"\b(\d+)\b", text)
    return int(m[1]) if m else None


def literal(n: int | None) -> Json:
    return {"quantityType": "literal", "value": 1 if n is None else n}


def mana_symbol(inner: str) -> tuple[Json, int, bool]:
    """(symbol, mana value, whether variable)."""
    s = inner.upper()
    kind = symbol_kind(s)
    colors = [x for x in s.split("/") if x in COLOR_WORDS.values()]
    if kind == "variable":
        return {"kind": "variable"}, 0, True
    if kind in ("snow", "colorless"):
        return {"kind": kind}, 1, False
    if kind == "hybridGeneric":
        n = int(s.split("/")[0])
        return {"kind": kind, "colors": colors, "genericAmount": n}, n, False
    if kind in ("colored", "hybrid", "phyrexian", "hybridPhyrexian"):
        out: Json = {"kind": "colored" if kind in ("colored", "phyrexian") else "hybrid", "colors": colors}
        if "hyrexian" in kind:
            out["isPhyrexian"] = True
        return out, 1, False
    n = int(s) if s.isdigit() else 0
    return {"kind": "generic", "genericAmount": n}, n, False


def mana_cost(text: str) -> tuple[list[Json], int, bool]:
    found = [mana_symbol(x) for x in re.findall(r"\{([^}]+)\}", text)]
    return [s for s, _, _ in found], sum(n for _, n, _ in found), any(v for _, _, v in found)


def cost(part: str) -> Json | None:
    low = part.lower()
    if "{" in part:
        if part in ("{T}", "{Q}"):
            return {"costType": "tap" if part == "{T}" else "untap"}
        symbols = mana_cost(part)[0]
        if symbols:
            return {"costType": "mana", "symbols": symbols}
    if low.startswith("sacrifice"):
        quantity = {"quantityType": "variable", "variable": "X"} if " x " in low else literal(number_word(part))
        if "creature" in low or "this permanent" in low:
            what: Json = {"cardTypes": ["creature"]} | ({"characteristics": ["another"]} if "another creature" in low else {})
        elif "artifact" in low:
            what = {"cardTypes": ["artifact"]}
        else:
            m = re.search(r"sacrifice (?:a |an |x )?(\w+)", low)
            if not m:
                return None
            what = {"subtypes": [m[1] if m[1] == "this" else m[1].removesuffix("s")]}
        return {"costType": "sacrifice", "filter": what, "quantity": quantity}
    if low.startswith("discard"):
        what = {"supertypes": ["Legendary"], "cardTypes": ["card"]} if "legendary card" in low else {"cardTypes": ["card"]}
        return {"costType": "discard", "filter": what, "quantity": literal(number_word(part))}
    return None


YOU = {"kind": "You"}


def _add_mana(text: str) -> Json | None:
    m = re.match(r"add (.*?)\.?$", text.strip(), re.I | re.S)
    return {"effectType": "addMana", "mana": m[1].strip(), "anyColor": False} if m and "{" in m[1] else None


def _scry(text: str) -> Json | None:
    m = re.match(r"scry\s+(\d+)$", text, re.I)
    return {"effectType": "scry", "count": literal(int(m[1]))} if m else None


def _draw(text: str) -> Json | None:
    if "draw" not in text.lower():
        return None
    return {"effectType": "drawCards", "count": literal(number_word(text)), "player": {"kind": "EachOpponent"} if "each other player" in text.lower() else YOU}


def _discard(text: str) -> Json | None:
    low = text.lower()
    if "discard" not in low:
        return None
    up_to = re.search(r"up to (\w+)", text, re.I)
    out = {"effectType": "discardCards", "count": literal(number_word(up_to[1] if up_to else text)), "player": YOU, "random": False}
    return out | ({"filter": {"supertypes": ["legendary"]}} if "legendary" in low else {})


def _counters(text: str) -> Json | None:
    low = text.lower()
    which = next((c for c in ("+1/+1", "-1/-1") if c in low), None)
    if "put" not in low or "counter" not in low or which is None:
        return None
    target: Json = {"kind": "Self"}
    if "this creature" not in low and "this permanent" not in low and "target creature" in low:
        target = {"kind": "Target", "filter": {"cardTypes": ["creature"]} | ({"controller": "You"} if "target creature you control" in low else {})}
    return {"effectType": "putCounters", "target": target, "counterType": which, "count": literal(number_word(text))}


def _gain(text: str) -> Json | None:
    m = re.search(r"creatures you control gain (\w+)", text, re.I)
    return {"effectType": "gainAbility", "target": {"kind": "Target", "filter": {"cardTypes": ["creature"], "controller": "You"}}, "abilityText": m[1]} if m else None


EFFECTS = (_add_mana, *(lambda text, f=f: f(text.strip().rstrip(".")) for f in (_scry, _draw, _discard, _counters, _gain)))


def create_token(text: str) -> Json | None:
    low = text.lower()
    stats = re.search(r"(\d+|X)/(\d+|X)", text)
    subtypes = [t for t in TOKEN_TYPES if t.lower() in low]
    if "create" not in low or not stats or not subtypes:
        return None
    count = next((n for w, n in (("two ", 2), ("three ", 3), ("four ", 4)) if w in low), 1)
    colors = ["C"] if "colorless" in low else [c for w, c in COLOR_WORDS.items() if w in low]
    return {"effectType": "createToken", "count": literal(count), "token": {"power": stats[1], "toughness": stats[2], "colors": colors, "types": ["creature"], "subtypes": subtypes}}


# --- abilities by kind


def triggered(c: Clause, k: Kind) -> list[Json] | None:
    head, comma, tail = c.text.partition(",")
    low = head.lower()
    event = "Dies" if "dies" in low else "Enters" if "enters" in low else None
    about = any(w in low for w in ("this creature", "a creature", "another creature"))
    effect = create_token(tail.strip())
    if not comma or event is None or not about or effect is None:
        return None
    return [{"kind": "triggered", "trigger": {"timing": c.tokens[0].text.capitalize(), "event": event, "filter": {"cardTypes": ["creature"]}}, "effects": [effect]}]


def activated(c: Clause, k: Kind) -> list[Json] | None:
    head, colon, tail = c.text.partition(":")
    if not colon:
        return None
    costs = [] if k.loyalty is not None else [x for x in (cost(p.strip()) for p in head.split(",")) if x]
    effect = next((e for e in (f(tail.strip()) for f in EFFECTS) if e), None)
    if effect is None or not costs and k.loyalty is None:
        return None
    out = {"kind": "activated", "costs": costs, "effects": [effect], "isManaAbility": effect["effectType"] == "addMana"}
    return [out | ({"loyaltyCost": k.loyalty} if k.loyalty is not None else {}) | ({"abilityWord": k.ability_word} if k.ability_word else {})]


def quality(word: str, singular: bool = False) -> Json:
    low = word.lower()
    if low in ("everything", "all"):
        return {"kind": "Everything"}
    if low in COLOR_WORDS or low == "colorless":
        return {"kind": "Color", "value": low}
    if low in CARD_TYPES or low.removesuffix("s") in CARD_TYPES:
        return {"kind": "CardType", "value": low.removesuffix("s")}
    return {"kind": "Subtype", "value": word}


def static(c: Clause, k: Kind) -> list[Json] | None:
    """Keywords separated by commas; what follows the last one that fits is left aside."""
    t, at, out = c.tokens, 0, []
    while True:
        two = " ".join(x.text for x in t[at : at + 2]).capitalize() if len(t) > at + 1 else ""
        one = t[at].text.capitalize() if len(t) > at else ""
        if two in KEYWORDS:
            name, effect, n = two, KEYWORDS[two], 2
        elif one in KEYWORDS:
            name, effect, n = one, KEYWORDS[one], 1
        elif one == "Protection" and len(t) > at + 2 and t[at + 1].text.lower() == "from" and t[at + 2].kind == "word":
            name, n, qualities = one, 3, [quality(t[at + 2].text)]
            while len(t) > at + n + 2 and [x.text.lower() for x in t[at + n : at + n + 2]] == ["and", "from"] and t[at + n + 2].kind == "word":
                qualities.append(quality(t[at + n + 2].text))
                n += 3
            effect = {"effectType": "protection", "from": qualities}
        else:
            return out or None
        ability: Json = {"kind": "static", "keywordSource": name, "effect": effect}
        at += n
        if len(t) > at and t[at].kind == "reminder":
            ability["reminder"] = {"text": t[at].text}
            at += 1
        out.append(ability)
        if not (len(t) > at and t[at].kind == "comma"):
            return out
        at += 1


# Labels of texts that are known to fail, by the first test that holds.
FAILURES = (
    ("LevelUp", lambda s, c: s.startswith("level up")), ("ClassLevel", lambda s, c: "class level" in s),
    ("Saga", lambda s, c: s.startswith("(as this saga enters") or "read ahead" in s), ("PartnerWith", lambda s, c: s.startswith("partner with")),
    ("NestedAbility", lambda s, c: any(t.kind == "quoted" for t in c.tokens)), ("ComplexTargeting", lambda s, c: "target" in s and "or" in s),
    ("ConditionalEffect", lambda s, c: "if you" in s or "if a" in s), ("VariableEffect", lambda s, c: any(t.kind == "variable" for t in c.tokens)),
)


def unparsed(c: Clause, k: Kind) -> Json:
    low = c.text.lower()
    pattern = next((name for name, test in FAILURES if test(low, c)), None)
    if pattern is None:
        pattern = "UnknownStructure" if k.confidence < 0.5 else "AmbiguousStructure" if k.confidence < 0.7 else f"Unparsed{k.kind.capitalize()}"
    span = {"start": c.start, "length": len(c.text), "end": c.start + len(c.text)}
    message = "Failed to parse Unparsed ability" if k.kind == "unparsed" else f"{k.kind.capitalize()} ability parser not yet implemented"
    out = {"kind": "unparsed", "sourceSpan": span, "rawText": c.text, "diagnostics": [{"severity": "error", "message": message, "location": span, "rawText": c.text, "pattern": pattern}]}
    return out | ({"abilityWord": k.ability_word} if k.ability_word else {})


PARSERS = {"triggered": triggered, "activated": activated, "static": static}


def parse_text(text: str | None) -> Result:
    out = Result()
    for c in split_clauses(text) if text and text.strip() else []:
        out.clauses += 1
        k = classify(c)
        found = PARSERS[k.kind](c, k) if k.kind in PARSERS else None
        found = found or [unparsed(c, k)]
        out.abilities += found
        out.diagnostics += [d for a in found if a["kind"] == "unparsed" for d in a["diagnostics"]]
    return out


# --- cards


def type_line(line: str) -> Json:
    head, tail = (re.split("—|--", line, maxsplit=1) + [""])[:2]
    words, subtypes = head.split(), tail.split()
    out: Json = {"raw": line, "types": [w for w in words if w not in SUPERTYPES]}
    if supertypes := [w for w in words if w in SUPERTYPES]:
        out["supertypes"] = supertypes
    return out | ({"subtypes": subtypes} if subtypes else {})


def stat(raw: str) -> Json:
    s = raw.strip()
    if re.fullmatch(r"[+-]?\d+", s):
        return {"valueType": "fixed", "raw": raw, "value": int(s)}
    rest = re.sub(r"[*+-]", "", s).strip()
    if s != "*" and re.search(r"[+-]", s) and rest.isdigit():
        return {"valueType": "derived", "raw": raw, "baseValue": int(rest)}
    return {"valueType": "variable", "raw": raw}


def attributes(card: Json, identity: bool = True) -> list[Json]:
    have = lambda *names: all((card.get(n) or "").strip() for n in names)
    out: list[Json] = []
    if have("manaCost"):
        symbols, value, variable = mana_cost(card["manaCost"])
        out.append({"kind": "manaCost", "raw": card["manaCost"], "symbols": symbols, "manaValue": value, "isVariable": variable})
    if card.get("colors"):
        out.append({"kind": "colors", "colors": list(card["colors"])})
    letters = "".join(re.findall(r"\{([^}]+)\}", f"{card.get('manaCost') or ''} {card.get('oracleText') or ''}")).upper()
    if identity and (colors := [c for c in "WUBRG" if c in letters]):
        out.append({"kind": "colorIdentity", "colorIdentity": colors})
    if have("power", "toughness"):
        out.append({"kind": "creatureStats", "power": stat(card["power"]), "toughness": stat(card["toughness"])})
    if have("loyalty"):
        s = card["loyalty"].strip()
        out.append({"kind": "loyalty", "raw": card["loyalty"], "startingLoyalty": int(s) if s.isdigit() else None, "isVariable": s.upper() == "X"})
    if identity and have("layout") and card["layout"] != "normal":
        out.append({"kind": "layout", "layout": card["layout"]})
    return out


def parse_card(card: Json) -> tuple[Json, Result]:
    """(output, result of the main text with the faces' diagnostics added); the status is that of the main text."""
    main = parse_text(card.get("oracleText"))
    out: Json = {
        "name": card["name"], "typeLine": type_line(card["typeLine"]), "oracle": {"rawText": card.get("oracleText") or "", "abilities": main.abilities},
        "attributes": attributes(card)}
    faces = []
    for f in card.get("cardFaces") or []:
        r = parse_text(f.get("oracleText"))
        main.diagnostics += r.diagnostics
        faces.append({"name": f["name"], "typeLine": type_line(f["typeLine"]) if f.get("typeLine") else None, "oracle": {"rawText": f.get("oracleText") or "", "abilities": r.abilities}, "attributes": attributes(f, False)})
    return out | ({"faces": faces} if faces else {}), main


# --- keywords by name

EXPANDABLE = ("Flying", "First strike", "Double strike", "Lifelink", "Vigilance", "Protection")


def expand_keyword(name: str, parameter: str | None = None) -> Json:
    known = next((k for k in EXPANDABLE if k.lower() == name.lower()), None)
    if known is None:
        raise KeyError(f"unknown keyword: {name}")
    if known != "Protection":
        return {"kind": "static", "keywordSource": known, "effect": KEYWORDS[known]}
    if not parameter or not parameter.strip():
        raise ValueError("Protection needs a parameter")
    words = re.split(r"\s*,\s*(?:and\s+)?(?:from\s+)?|\s+and\s+(?:from\s+)?", re.sub(r"^\s*from\s+", "", parameter.strip(), flags=re.I))
    return {"kind": "static", "keywordSource": known, "effect": {"effectType": "protection", "from": [quality(w) for w in words if w]}}


def omissible(x: Any) -> bool:
    """What an object may as well leave out: null, false, the integer 0, empty lists, and objects of nothing but a text."""
    return x is None or x is False or type(x) is int and x == 0 or x == [] or isinstance(x, dict) and set(x) == {"text"}


def same_json(a: Any, b: Any) -> bool:
    """Equal but for the order of keys, and for keys of one side only whose value is omissible; numbers of different types differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(same_json(a[k], b[k]) if k in a and k in b else omissible(a.get(k, b.get(k))) for k in {*a, *b})
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same_json, a, b))
    return type(a) is type(b) and a == b
