"""The rules-text parser: golden cards of our own, with a ratchet, and invariants."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.parser import rules_text as R
from quillstone.parser.tokens import tokenize

LITERAL = {"quantityType": "literal", "value": 1}

# text, abilities, and whether it parses today; a case that starts to pass or stops passing has to be recorded here
GOLDEN = [
    ("Flying", [{"kind": "static", "keywordSource": "Flying", "effect": R.KEYWORDS["Flying"]}], True),
    ("First strike, islandwalk (It sneaks.)", [{"kind": "static", "keywordSource": "First strike", "effect": {"effectType": "combatDamageTiming", "timing": "First"}},
     {"kind": "static", "keywordSource": "Islandwalk", "effect": R.KEYWORDS["Islandwalk"], "reminder": {"text": "(It sneaks.)"}}], True),
    ("Protection from white and from artifacts", [{"kind": "static", "keywordSource": "Protection", "effect": {"effectType": "protection", "from": [{"kind": "Color", "value": "white"}, {"kind": "CardType", "value": "artifact"}]}}], True),
    ("{T}, Discard a card: Draw two cards.", [{"kind": "activated", "costs": [{"costType": "tap"}, {"costType": "discard", "filter": {"cardTypes": ["card"]}, "quantity": LITERAL}],
     "effects": [{"effectType": "drawCards", "count": {"quantityType": "literal", "value": 2}, "player": {"kind": "You"}}]}], True),
    ("When this creature enters, create a 1/1 green Squirrel creature token.", [{"kind": "triggered", "trigger": {"timing": "When", "event": "Enters", "filter": {"cardTypes": ["creature"]}},
     "effects": [{"effectType": "createToken", "count": LITERAL, "token": {"power": "1", "toughness": "1", "colors": ["G"], "types": ["creature"], "subtypes": ["Squirrel"]}}]}], True),
    ("Whenever you cast a spell, draw a card.", [{"kind": "triggered", "trigger": {"timing": "Whenever", "event": "SpellCast"}, "effects": []}], False),
]


@pytest.mark.parametrize("text,abilities,passes", GOLDEN)
def test_golden(text, abilities, passes):
    assert R.same_json(R.parse_text(text).abilities, abilities) == passes


def test_classifier():
    kinds = [("+2: Scry 1.", "activated", 0.98), ("0: Draw a card.", "activated", 0.98), ("At the end, draw.", "triggered", 0.95), ("Equip: x", "activated", 0.9), ("If it would die, exile it instead.", "static", 0.85),
             ("Choose one", "modal", 0.95), ("Haste", "static", 0.8), ("All creatures get it.", "static", 0.5), ("~", "unparsed", 1.0)]
    for text, kind, sure in kinds:
        k = R.classify(R.split_clauses(text)[0])
        assert (k.kind, k.confidence) == (kind, sure), text
    assert R.classify(R.split_clauses("Landfall — Whenever it enters, draw.")[0]).ability_word == "Landfall"


def test_splitting():
    c = R.split_clauses("Choose one — • Draw. • Scry 1.\n\n  Flying ")
    assert [(x.text, x.modal_option) for x in c] == [("Choose one —", False), ("Draw.", True), ("Scry 1.", True), ("Flying", False)]
    assert R.split_clauses("LEVEL 1-2\nLEVEL 5+")[1].levels == (5, None)
    assert R.parse_text(None).status == "FullyParsed" and R.parse_text(" \n").clauses == 0


def test_failures_are_labelled():
    for text, pattern in (("Level up {3}", "LevelUp"), ("Partner with X", "PartnerWith"), ("It has \"{T}: Draw.\"", "NestedAbility"), ("Destroy target creature or land.", "ComplexTargeting"),
                          ("Gain 1 if you can.", "ConditionalEffect"), ("Pay {X} to win the whole game now.", "VariableEffect"), ("All of them get bigger.", "AmbiguousStructure"), ("Choose", "UnparsedModal")):
        a = R.parse_text(text).abilities[0]
        assert a["kind"] == "unparsed" and a["diagnostics"][0]["pattern"] == pattern, text


def test_mana_and_stats():
    assert R.mana_cost("{X}{2/W}{G/U/P}{B/P}{S}{C}{10}{?}")[1:] == (2 + 1 + 1 + 1 + 1 + 10, True)
    assert [R.stat(s)["valueType"] for s in ("3", "*", "1+*", "X")] == ["fixed", "variable", "derived", "variable"]
    assert R.number_word("stone") == 1 and R.number_word("often") == 10 and R.number_word("draw 7") == 7 and R.number_word("none left") == 1
    out, _ = R.parse_card({"name": "n", "typeLine": "Legendary Snow Creature — A B", "oracleText": "{R}: Add {G}.", "manaCost": "{W}", "loyalty": "X", "layout": "split", "cardFaces": [{"name": "f", "typeLine": "Land", "oracleText": "nope nope nope"}]})
    assert out["typeLine"]["supertypes"] == ["Legendary", "Snow"] and [a["kind"] for a in out["attributes"]] == ["manaCost", "colorIdentity", "loyalty", "layout"]
    assert out["attributes"][1]["colorIdentity"] == ["W", "R", "G"] and out["faces"][0]["oracle"]["abilities"][0]["kind"] == "unparsed"


def test_keyword_expander():
    assert R.expand_keyword("FLYING")["effect"]["effectType"] == "evasion"
    assert R.expand_keyword("protection", "from Demons and from Dragons")["effect"]["from"] == [{"kind": "Subtype", "value": "Demons"}, {"kind": "Subtype", "value": "Dragons"}]
    assert R.expand_keyword("Protection", "everything")["effect"]["from"] == [{"kind": "Everything"}]
    with pytest.raises(KeyError):
        R.expand_keyword("Banding")
    with pytest.raises(ValueError):
        R.expand_keyword("Protection")


def test_json_equality():
    assert R.same_json({"a": 1, "b": None, "c": [], "d": False}, {"a": 1, "e": 0, "f": {"text": "x"}})
    assert not R.same_json({"a": None}, {"a": False}) and not R.same_json({"a": 0.0}, {}) and not R.same_json(None, 0)
    assert not R.same_json([1, 2], [2, 1]) and not R.same_json({"a": 1}, {"a": 2}) and not R.same_json({"a": "0"}, {})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aW {}:()+−-•—,.\n\"1TXé", max_size=60))
def test_never_fails(text):
    r = R.parse_text(text)
    assert r.clauses <= len(r.abilities) and r.failed == len(r.diagnostics)
    tokens = tokenize(text)
    if tokens is not None:
        assert all(text[t.start : t.start + len(t.text)] == t.text for t in tokens)
