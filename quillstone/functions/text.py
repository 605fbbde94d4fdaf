"""Text functions. All are Column expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.once import let

from quillstone.functions import paths as P

PARENTHESES = r"\s*\([^)]*\)"
#: What is code or a comment in markdown, as one match each: fenced blocks, to a fence of the same sign that is no shorter or to the end, spans between runs of
#: equally many backticks on a line, and comments.
FENCE = r"(?m:^ {0,3})(?:(?<fence>`{3,})[^`\n]*|(?<tilde>~{3,})[^\n]*)(?:\n(?s:.*?)(?<=\n) {0,3}(?:\k<fence>`*|\k<tilde>~*)[ \t]*(?=\n|\z)|\n(?s:.*)\z|\z)"
SPAN = r"(?<!`)(?<ticks>`+)(?!`)[^\n]*?(?<!`)\k<ticks>(?!`)"
COMMENT = r"(?s:<!--.*?(?:-->|\z))"
CODE = f"{FENCE}|{SPAN}|{COMMENT}"


def normalize(c: Column) -> Column:
    """Curly quotes, dashes and bullets to ASCII."""
    return F.translate(c, "‘’“”–—•", "''\"\"--*")


def strip_parentheticals(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, PARENTHESES, ""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"\s+", "") == "")


def is_keyword_line(c: Column) -> Column:
    """Single words, each with an optional number or {symbol}, separated by commas, over the whole line."""
    word = r"[\p{L}\p{N}_]+(?:\s+(?:\d+|\{[^}]+\}))?"
    return F.regexp_like(strip_parentheticals(c), F.lit(rf"^{word}(?:\s*,\s*{word})*$"))


def is_named_trigger(c: Column) -> Column:
    at = F.instr(c, " - ")
    return (at > 1) & (at + 3 <= F.length(c))


def is_trigger(c: Column) -> Column:
    return c.startswith("When ") | c.startswith("Whenever ") | c.startswith("At ")


def is_activated(c: Column) -> Column:
    """A colon before any parenthesis."""
    colon, paren = F.instr(c, ":"), F.instr(c, "(")
    return (colon > 0) & ((paren == 0) | (colon < paren))


def line_kind(c: Column) -> Column:
    """The first rule that matches a line of rules text."""
    return (
        F.when(is_keyword_line(c), "keyword").when(is_named_trigger(c), "named").when(is_trigger(c), "triggered")
        .when(is_activated(c), "activated").otherwise("passive")
    )


def split_two(c: Column, pattern: str) -> Column:
    """struct(head, tail) around the first match, both trimmed; an empty tail if there is none."""
    parts = F.split(c, pattern, 2)
    return F.struct(F.trim(parts[0]).alias("head"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("tail"))


def lines(c: Column, keep_empty: bool = False) -> Column:
    every = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    return every if keep_empty else F.filter(every, lambda x: x != "")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def section(c: Column, delimiter: str, offset: int = 1) -> Column:
    """struct(left, right) at the first delimiter from a place on; it stays on the right; none: (all, '')."""
    at = F.locate(delimiter, c, offset)
    return F.when(at > 0, F.struct(F.trim(F.substring(c, F.lit(1), at - 1)).alias("left"), F.substring(c, at, F.length(c)).alias("right"))).otherwise(
        F.struct(c.alias("left"), F.lit("").alias("right")))


def rule_suffix(c: Column) -> Column:
    return F.regexp_extract(c, r"\.\d+([a-z]*)", 1)


def identity_string(colors: Column) -> Column:
    """Colours in canonical order, Colorless if there are none."""
    ordered = F.filter(F.array(*[F.lit(x) for x in "WUBRG"]), lambda x: F.array_contains(colors, x))
    return F.when(colors.isNull() | (F.size(ordered) == 0), "Colorless").otherwise(F.array_join(ordered, ""))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_html(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def search_tokens(c: Column) -> Column:
    """Lower-case tokens by white space; each CJK character is one of its own."""
    cjk = r"\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{20000}-\x{2A6DF}"
    return F.regexp_extract_all(F.lower(c), F.lit(rf"[{cjk}]|[^\s{cjk}]+"), F.lit(0))


def prefixes(parts: Column, separator: str) -> Column:
    """All leading runs of an array, joined: [a, b] gives a and a<separator>b."""
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))).otherwise(
        F.array().cast("array<string>"))


def description(c: Column, length: int = 150, most: int = 300) -> Column:
    """Leading sentences, one at least, until the length is reached; never more than `most` characters."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"(https?://)?([\da-z.-]+)\.([a-z.]{2,6})(:\d+)?(/[/\w.-]*)(\?[/\w.=&;-]*)?", "$2.$3$5"), r"\s+", " "))
    sentences = F.split(plain, r"(?<=\.) ")
    taken = F.aggregate(sentences, F.lit(""), lambda a, s: F.when(F.length(a) == 0, s).when(F.length(a) + F.length(s) < length, F.concat_ws(" ", a, s)).otherwise(a))
    return F.when(F.length(taken) > most, F.concat(F.substring(taken, 1, most), F.lit("..."))).otherwise(taken)


def reading_minutes(c: Column, words_per_minute: int = 200) -> Column:
    return F.ceil(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) / words_per_minute)


def without_code(c: Column, fill: str = " ") -> Column:
    """The text with `fill` in place of each fenced block, code span and comment."""
    return F.regexp_replace(c, CODE, fill)


def without_blocks(c: Column) -> Column:
    """The text without fenced blocks and comments; code spans stay, as in headings."""
    return F.regexp_replace(c, f"{FENCE}|{COMMENT}", "")


def outside_code(c: Column, change) -> Column:
    """change(text) of what is neither code nor a comment; those stay as they are, in their places."""
    pieces, held = F.split(c, CODE, -1), F.concat(F.regexp_extract_all(c, F.lit(CODE), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.transform(pieces, change), held, lambda a, b: F.concat(a, b)), "")


def wikilinks(c: Column) -> Column:
    """Targets of [[target#heading|label]] links outside of code."""
    return F.transform(F.regexp_extract_all(without_code(c), F.lit(r"!?\[\[([^\[\]|#\\]*)(?:#[^\[\]|]*)?(?:\\?\|[^\[\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))


def hashtags(c: Column) -> Column:
    """Distinct #tags outside of code, which aren't numbers alone."""
    return F.array_distinct(F.filter(F.regexp_extract_all(without_code(c), F.lit(r"(?:^|\s)#([\p{L}\p{N}_/-]+)"), F.lit(1)), lambda t: ~t.rlike(r"^[\d/]+$")))


def markup(c: Column) -> Column:
    """Comments go, highlights and arrows become HTML, block references are cut off; code stays as it is."""

    def changed(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?s)%%.*?%%", "")
        t = F.regexp_replace(t, r"==([^=]+)==", "<mark>$1</mark>")
        for a, b in (("<-->", "&harr;"), ("-->", "&rarr;"), ("<--", "&larr;"), ("==>", "&rArr;"), ("<==", "&lArr;")):
            t = F.replace(t, F.lit(a), F.lit(b))
        return F.regexp_replace(t, r"(?m) \^([-_A-Za-z0-9]+)$", "")

    return outside_code(c, changed)


def roam(c: Column) -> Column:
    """Dialect with {{TODO}}, __italics__, ^^highlights^^."""
    c = F.regexp_replace(c, r"\{\{\[\[TODO\]\]\}\}|\{\{TODO\}\}", "[ ]")
    c = F.regexp_replace(c, r"\{\{\[\[DONE\]\]\}\}|\{\{DONE\}\}", "[x]")
    return F.regexp_replace(F.regexp_replace(c, r"__(.+?)__", "_$1_"), r"\^\^(.+?)\^\^", "==$1==")


def hugo(c: Column) -> Column:
    """Dialect with {{< relref "x" >}}, figures and shortcodes."""
    c = F.regexp_replace(c, r"""\[([^\]]*)\]\(\{\{< (?:rel)?ref "([^"]*)" >\}\}\)""", "[$1]($2)")
    c = F.regexp_replace(c, r"""\{\{< ?figure src="([^"]*)"[^>]*>\}\}""", "![]($1)")
    return F.regexp_replace(c, r"\{\{.*?\}\}", "")


def coerce_list(c: Column) -> Column:
    """A comma-separated string as a list of trimmed, non-empty values."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    """Words of a query and their runs from the first on, the longest first."""
    words = query.split()
    return sorted([*words, *(" ".join(words[: k + 1]) for k in range(1, len(words)))], key=len, reverse=True)


def highlight(c: Column, query: str, trim: bool = False, width: int = 30) -> Column:
    """Words that hold a term are marked. Trimmed: from `width` words before the window with most words that start with a term,
    the last of equal ones, twice that width; three dots show what was cut off. A window that ends the text is never chosen."""
    terms = query_terms(query)
    split = F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def starts(low: Column) -> Column:
        found = F.lit(False)
        for t in terms:
            found = found | low.startswith(t.lower())
        return found.cast("long")

    def mark(w: Column) -> Column:
        out = w
        for t in reversed(terms):
            literal = "\\Q" + t.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"
            out = F.when(F.contains(F.lower(w), F.lit(t.lower())), F.regexp_replace(w, f"(?iu){literal}", '<span class="highlight">$0</span>')).otherwise(out)
        return out

    if not trim:
        return F.array_join(F.transform(split, mark), " ")
    # words, their hits and the best place are bound, so that each is worked out once; one pass keeps a mask of the hits among the last `width` words
    if not 0 < width < 63:
        raise ValueError("width must be from 1 to 62")
    zero = F.struct(F.lit(0).cast("long").alias("mask"), F.lit(0).alias("i"), F.lit(0).alias("most"), F.lit(0).alias("at"))

    def step(acc: Column, hit: Column) -> Column:
        mask = F.shiftleft(acc["mask"], 1).bitwiseOR(hit).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        better = (acc["i"] >= width - 1) & (F.bit_count(mask) >= acc["most"])
        return F.struct(mask.alias("mask"), (acc["i"] + 1).alias("i"), F.when(better, F.bit_count(mask)).otherwise(acc["most"]).alias("most"), F.when(better, acc["i"] - (width - 1)).otherwise(acc["at"]).alias("at"))

    def cut(words: Column) -> Column:
        n = F.size(words)
        hits = F.transform(F.transform(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lower), starts)
        # without a hit the last window is the best one
        best = let(hits, lambda h: F.when(F.array_contains(h, F.lit(1).cast("long")), F.aggregate(h, zero, step, lambda acc: acc["at"])).otherwise(F.greatest(F.size(h) - width, F.lit(0))))

        def shown(start: Column) -> Column:
            end = F.greatest(F.least(start + 2 * width, n - 1), F.lit(0))
            held = F.array_join(F.transform(F.slice(words, start + 1, F.greatest(end - start, F.lit(0))), mark), " ")
            return F.concat(F.when(start > 0, "...").otherwise(""), held, F.when(n > 0, "...").otherwise(""))

        return let(F.greatest(best - width, F.lit(0)), shown)

    return let(split, cut)


def under_heading(c: Column, anchor: Column) -> Column:
    """Lines from the heading with the anchor to the next of the same level or a higher one; null if there is none.

    A heading's anchor gets a number if headings before it have the same. One fold over the headings, which only remembers those
    that the anchor starts with.
    """
    rows = F.split(c, "\n")
    heads = F.filter(F.transform(rows, lambda x, i: F.struct(
        i.alias("line"), F.length(F.regexp_extract(x, r"^(#{1,6})\s+\S", 1)).alias("level"),
        P.slug_anchor(F.trim(F.regexp_replace(x, r"^#+\s+", ""))).alias("slug"))), lambda h: h["level"] > 0)
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("level"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, h: Column) -> Column:
        before = F.size(F.filter(acc["seen"], lambda s: s == h["slug"]))
        name = F.when(before > 0, F.concat_ws("-", h["slug"], before.cast("string"))).otherwise(h["slug"])
        opens = (acc["first"] < 0) & (name == anchor)
        closes = (acc["first"] >= 0) & (acc["last"] < 0) & (h["level"] <= acc["level"])
        return F.struct(
            F.when(F.startswith(anchor, h["slug"]), F.concat(acc["seen"], F.array(h["slug"]))).otherwise(acc["seen"]).alias("seen"), F.when(opens, h["level"]).otherwise(acc["level"]).alias("level"),
            F.when(opens, h["line"]).otherwise(acc["first"]).alias("first"), F.when(closes, h["line"]).otherwise(acc["last"]).alias("last"))

    span = F.aggregate(heads, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))
    end = F.when(span["last"] < 0, F.size(rows)).otherwise(span["last"])
    return F.when(span["first"] >= 0, F.array_join(F.slice(rows, span["first"] + 1, end - span["first"]), "\n"))


def block(c: Column, name: Column) -> Column:
    """The list item or paragraph that ends with ^name, without that mark; null if there is none."""
    end = F.concat(F.lit("^"), name)
    marked = lambda x: x.endswith(F.concat(F.lit(" "), end)) | (x == end)
    item = F.get(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*([-*+]|\d+\.)\s") & marked(x)), F.lit(0))
    paragraph = F.get(F.filter(F.split(c, r"\n\s*\n"), marked), F.lit(0))
    found = F.coalesce(item, paragraph)
    return F.rtrim(F.substring(found, F.lit(1), F.length(found) - F.length(end)))


def embedded(c: Column, reference: Column) -> Column:
    """What a reference embeds of a text: #^name a block, #anchor a heading and what is below it, else all of it."""
    rest = lambda k: F.substring(reference, F.lit(k), F.length(reference))
    return F.when(reference.startswith("#^"), block(c, rest(3))).when(reference.startswith("#"), under_heading(c, rest(2))).otherwise(c)


def date_or_now(now: Column, *chain: Column) -> Column:
    """The first date given (not null or empty) as a time stamp; now if none is given or the one given is bad or the epoch."""
    first = F.coalesce(*[F.when(c != "", c) for c in chain])
    at = F.try_to_timestamp(first)
    return F.when(at.isNotNull() & (at != F.lit("1970-01-01 00:00:00").cast("timestamp")), at).otherwise(now.cast("timestamp"))


def clamped(c: Column, low: Column | int, high: Column | int) -> Column:
    """Rounded half up and held between two bounds."""
    bound = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(F.floor(c + 0.5), bound(low)), bound(high))


def natural_key(c: Column) -> Column:
    """Sorts as people do: case aside, numbers by value."""
    padded = F.regexp_replace(F.lower(c), r"(\d+)", "0" * 20 + "$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")
