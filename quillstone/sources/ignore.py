"""Ignore files: ordered rules of paths, compiled to one expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str  # of a whole path, without a slash at either end
    keeps: bool  # a rule with ! takes back what earlier ones ignore
    folders: bool  # only folders match


def parse(text: str) -> list[Rule]:
    """Rules in order. A slash before the end ties a rule to the top; without one it holds at every depth. ** stands for any folders."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)((?:\\\\)*)[ \t]+$", r"\1", line)
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[1:] if keeps else line
        folders, line = line.endswith("/"), line.rstrip("/")
        if not line:
            continue
        tied = "/" in line
        rules.append(Rule(("" if tied else "(?:.*/)?") + expression(line.lstrip("/")), keeps, folders))
    return rules


def expression(glob: str) -> str:
    """A glob as a regular expression that both Java and Python read."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob[i:] == "**" and i and glob[i - 1] == "/":
            return out + ".+"
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))) > 0:
            body = glob[i + 1 : end]
            no = body[0] in "!^"
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if no else body)
            out, i = out + f"(?!/)[{'^' if no else ''}{inner}]", end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def ignored(path: Column, rules: str | list[Rule]) -> Column:
    """Whether the rules leave a file out: the last rule that matches decides, and what is in an ignored folder is out whatever comes after."""
    listed = parse(rules) if isinstance(rules, str) else rules
    if not listed:
        return F.lit(False)

    def verdict(of: Column, folder: bool) -> Column:
        out = None
        for r in reversed(listed):
            if r.folders and not folder:
                continue
            hit = of.rlike(f"(?s)\\A(?:{r.pattern})\\z")
            out = F.when(hit, not r.keeps) if out is None else out.when(hit, not r.keeps)
        return F.lit(False) if out is None else out.otherwise(False)

    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, F.exists(above, lambda p: verdict(p, True))).otherwise(False) | verdict(path, False)
