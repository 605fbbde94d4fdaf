"""Headers of pages: the part of YAML and TOML that front matter uses, read in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED = re.compile(r"\A(---|\+\+\+)[ \t]*\r?\n(.*?)(?:\r?\n)?^\1[ \t]*(?:\r?\n|\Z)", re.S | re.M)
PAIR = re.compile(r"(\"[^\"]*\"|'[^']*'|[^\s:=#\-\[{][^:=]*?)\s*(?::(?=\s|$)|=)\s*(.*)\Z", re.S)
#: Keys whose text is a list, parted by commas.
LISTS = frozenset("tags tag aliases alias cssclasses cssclass".split())


def scalar(text: str) -> str | None:
    """A value without its quotes or comment; null of null."""
    text = text.strip()
    if text[:1] == '"' and (m := re.match(r'"((?:[^"\\]|\\.)*)"', text)):
        return re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[1])
    if text[:1] == "'" and (m := re.match(r"'((?:[^']|'')*)'", text)):
        return m[1].replace("''", "'")
    text = re.sub(r"(?:^|\s)#.*", "", text).strip()
    return None if text in ("", "~", "null", "Null", "NULL") else text


def parted(text: str) -> list[str]:
    """Items of a list in brackets; commas within quotes and inner brackets don't part."""
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        if c == "," and not quote and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [v for x in [*out, now] if (v := scalar(x)) is not None]


def fields(head: str) -> dict[str, list[str]]:
    """Values by key; keys of nested maps are joined by dots, and of a key given twice the last counts."""
    out: dict[str, list[str]] = {}
    above: list[tuple[int, str]] = []
    lines = head.splitlines()
    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        if not bare or bare[0] == "#":
            continue
        if m := re.fullmatch(r"\[+([^\[\]]+)\]+", bare):  # a TOML table
            above = [(-1, m[1].strip())]
            continue
        if bare == "-" or bare.startswith("- "):
            while above and above[-1][0] > indent:
                above.pop()
            if above and (v := scalar(bare[1:])) is not None:
                out.setdefault(above[-1][1], []).append(v)
            continue
        m = PAIR.match(bare)
        if not m:
            raise ValueError(f"no field: {bare[:80]}")
        while above and above[-1][0] >= indent:
            above.pop()
        key = ".".join([*(a for _, a in above[-1:]), scalar(m[1]) or ""])
        value = m[2].strip()
        if re.fullmatch(r"[|>][+-]?", value):
            block = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > indent):
                block.append(lines[k].strip())
                k += 1
            out[key] = [("\n" if value[0] == "|" else " ").join(block).strip()]
        elif value[:1] == "[" and "]" in value:
            out[key] = parted(value[1 : value.rindex("]")])
        else:
            v = scalar(value)
            if v is None:
                above.append((indent, key))
            out[key] = [] if v is None else [x.strip() for x in v.split(",") if x.strip()] if key in LISTS else [v]
    return out


def _front(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        m = FENCED.match(t or "")
        try:
            rows.append((fields(m[2]) if m else {}, t[m.end() :] if m else t, None))
        except ValueError as e:
            rows.append(({}, t, str(e)))
    return pd.DataFrame(rows, columns=["fields", "body", "problem"])


def front(text: Column) -> Column:
    """struct(fields: map of lists of text, body, problem): the header between --- (YAML) or +++ (TOML); a bad one is told in problem."""
    return F.pandas_udf(_front, "fields map<string,array<string>>, body string, problem string")(text)


def given(held: Column, *names: str) -> Column:
    """The list of the first name that has a value."""
    return F.coalesce(*[F.when(F.size(F.try_element_at(held, F.lit(n))) > 0, F.try_element_at(held, F.lit(n))) for n in names])


def dates(held: Column, git: Column | None = None, born: Column | None = None, changed: Column | None = None, order: tuple[str, ...] = ("frontmatter", "git", "filesystem")) -> Column:
    """struct(created, modified, published) as text: for each, the first source in order that has it.

    A header gives all three (modified falls back on created), git the last change, and the file system birth and change.
    """
    first = lambda *names: given(held, *names)[0]
    none = F.lit(None).cast("string")
    text = lambda c: none if c is None else F.when(c.cast("string") != "", c.cast("string"))
    sources = {
        "frontmatter": (first("created", "date"), first("modified", "lastmod", "updated", "last-modified", "created", "date"), first("published", "publishDate", "date")),
        "git": (none, text(git), none), "filesystem": (text(born), text(changed), none)}
    return F.struct(*[F.coalesce(*[sources[s][k] for s in order]).alias(n) for k, n in enumerate(("created", "modified", "published"))])
