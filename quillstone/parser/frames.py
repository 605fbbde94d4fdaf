"""The parser over DataFrames: cards to abilities, and reports of diagnostics."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.relational import diagnostics as top_diagnostics
from quillstone.operators.relational import sample_n
from quillstone.parser import rules_text as R

PARSED = "status string, clauses int, abilities array<struct<kind:string,keyword:string,effect:string,json:string>>, diagnostics array<struct<severity:string,pattern:string,message:string,raw:string>>, output string"


def parse_cards(cards: DataFrame) -> DataFrame:
    """cards (name, mana_cost, type_line, oracle_text, power, toughness, loyalty) with `parsed`."""

    @F.pandas_udf(PARSED)
    def parse(name: pd.Series, cost: pd.Series, line: pd.Series, text: pd.Series, power: pd.Series, toughness: pd.Series, loyalty: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(name, cost, line, text, power, toughness, loyalty):
            card = dict(zip(("name", "manaCost", "typeLine", "oracleText", "power", "toughness", "loyalty"), row))
            card |= {"name": card["name"] or "", "typeLine": card["typeLine"] or ""}
            ast, r = R.parse_card(card)
            abilities = [{"kind": a["kind"], "keyword": a.get("keywordSource"), "effect": (a.get("effect") or (a.get("effects") or [{}])[0]).get("effectType"), "json": json.dumps(a, sort_keys=True)} for a in r.abilities]
            found = [{"severity": d["severity"], "pattern": d["pattern"], "message": d["message"], "raw": d["rawText"]} for d in r.diagnostics]
            out.append((r.status, r.clauses, abilities, found, json.dumps(ast, sort_keys=True)))
        return pd.DataFrame(out, columns=["status", "clauses", "abilities", "diagnostics", "output"])

    cols = ("name", "mana_cost", "type_line", "oracle_text", "power", "toughness", "loyalty")
    return cards.withColumn("parsed", parse(*[F.col(c).cast("string") for c in cols]))


def line_cases(cards: DataFrame, text: str = "oracle_text", expected: str = "expected") -> DataFrame:
    """One row per line of text that parses to abilities: line (from 1, blank ones not counted), line_text and line_expected.

    expected holds a card's abilities as JSON texts, in the order of the lines; each line takes as many as it parses to, and lines
    for which none are left go, as do cards with a null or empty text or list. All within the row, so nothing is shuffled.
    """

    @F.pandas_udf("array<int>")
    def counts(lines: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [len(R.parse_text(y).abilities) for y in x] for x in lines], dtype=object)

    trimmed = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    with_counts = cards.withColumn("_lines", trimmed).withColumn("_counts", counts("_lines"))
    split = with_counts.select("*", F.posexplode("_lines").alias("_at", "line_text"))
    n, start = F.get("_counts", F.col("_at")), F.aggregate(F.slice("_counts", F.lit(1), F.col("_at")), F.lit(0), lambda a, x: a + x)
    taken = split.withColumn("line", F.col("_at") + 1).withColumn("_n", n).withColumn("_start", start).where((F.col("_n") > 0) & (F.col("_start") < F.size(expected)))
    return taken.withColumn("line_expected", F.slice(expected, F.col("_start") + 1, F.col("_n"))).drop("_lines", "_counts", "_at", "_n", "_start")


def same_json(a: Column, b: Column) -> Column:
    """Whether two JSON texts say the same (`rules_text.same_json`); null if either is null or not JSON."""

    @F.pandas_udf("boolean")
    def same(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_same(x, y) for x, y in zip(left, right)], dtype=object)

    return same(a, b)


def _same(x: str | None, y: str | None) -> bool | None:
    if x is None or y is None:
        return None
    try:
        return R.same_json(json.loads(x), json.loads(y))
    except ValueError:
        return None


def category() -> Column:
    """What a failed line looks like."""
    raw = F.lower("raw")
    trigger = raw.startswith("when") | raw.startswith("at ")
    active = F.col("raw").contains(":") & ~F.col("raw").startswith("(")
    keyed = raw.contains("flying") | raw.contains("trample") | raw.contains("can't") | raw.contains("has ") | raw.contains("have ")
    return F.when(trigger, "triggered").when(active, "activated").when(keyed, "static").otherwise("spell")


def sample_and_analyze(cards: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """A sample with its parse; it succeeded if there is no error."""
    return parse_cards(sample_n(cards, key, n, seed)).withColumn("succeeded", ~F.exists("parsed.diagnostics", lambda d: d["severity"] == "error"))


def summary(parsed: DataFrame) -> DataFrame:
    """One row: cards by outcome, abilities by kind, and the shares parsed."""
    p, n = F.col("parsed"), F.count("*")
    of = lambda k: F.filter("parsed.abilities", lambda a: a["kind"] == k)
    kinds = [F.coalesce(F.sum(F.size(of(k))), F.lit(0)).alias(k) for k in ("static", "triggered", "activated", "unparsed")]
    out = parsed.agg(n.alias("cards"), *[F.count_if(p["status"] == s).alias(a) for s, a in (("FullyParsed", "full"), ("Partial", "partial"), ("Failed", "failed"))], *kinds)
    return out.withColumn("percent", F.when(F.col("cards") > 0, 100.0 * F.col("full") / F.col("cards")).otherwise(0.0))


def report(parsed: DataFrame, key: str, severity: str = "error", top: int = 3, examples: int = 3) -> DataFrame:
    rows = parsed.select(key, F.explode("parsed.diagnostics").alias("d")).select(key, "d.*").where(F.col("severity") == severity)
    return top_diagnostics(rows.withColumn("category", category()), "category", "pattern", "message", "raw", key, top, examples)


def mana_value(cost: Column) -> Column:
    """The mana value of a cost, without Python: digits count as such, X, Y and Z as 0, other symbols as 1."""
    inner = F.regexp_extract_all(F.upper(cost), F.lit(r"\{([^}]+)\}"), F.lit(1))
    one = lambda s: F.when(s.rlike("^[XYZ]$"), 0).when(s.rlike(r"^\d+(/[WUBRG])?(/P)?$"), F.regexp_extract(s, r"^(\d+)", 1).try_cast("int")).when(s.rlike("^(C|S|[WUBRG](/[WUBRG])?(/P)?)$"), 1).otherwise(0)
    return F.aggregate(F.transform(inner, one), F.lit(0), lambda a, x: a + x)


def type_parts(line: Column) -> Column:
    """struct(supertypes, types, subtypes) of a type line, without Python."""
    halves = F.split(line, "—|--", 2)
    words = lambda c: F.filter(F.split(F.trim(c), " +"), lambda w: w != "")
    head = words(halves[0])
    known = sorted(R.SUPERTYPES)
    return F.struct(F.filter(head, lambda w: w.isin(*known)).alias("supertypes"), F.filter(head, lambda w: ~w.isin(*known)).alias("types"), words(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("subtypes"))
