"""Main text of web pages.

Site templates go: element subtrees are hashed, the hashes are counted per host over its different main texts, and subtrees that
recur are deleted. A subtree has two hashes: one of all that is in it, and one of its shape, which is the elements, their marks (class, id and
role, without digits) and no text, as a menu or an advert says something else on each page. A shape stands for a template only outside the
article, where it is marked or an element made for the purpose, and holds little of its pages' words.

What doesn't recur is left to names, on every host: elements, roles, classes and ids that set a part of the page apart, and the article where
a page has one. Plain text blocks within an article are never taken for a template.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fresh, partitions, prepare, shared_dir

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
NO_TEXT = frozenset(
    "script style noscript iframe template head title svg math canvas object embed audio video button select textarea input option datalist map noembed noframes xmp".split()
)
SECTIONS = frozenset("nav header footer aside form fieldset legend label dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr b i em strong a span code q cite sub sup u br".split())
INLINE = frozenset("b i em strong span code cite sub sup u br q small mark abbr time".split())
DIGITS = re.compile(r"[0-9]+")
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs header footer masthead topbar sidebar sidebars aside rail widget widgets "
    "notice notices cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter signup login share sharing social "
    "related recommended comment comments commentlist disqus discussion replies respond form search pagination pager toolbar".split()
)
SPLIT_NAMES = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


#: How far a node is set apart: by names, or as an element that never holds text of the page.
NAMED, SILENT = 1, 2


class Node:
    __slots__ = ("name", "mark", "items", "digest", "shape", "words", "holds", "apart", "article")

    def __init__(self, name: str, mark: str = "", apart: int = 0, article: bool = False):
        self.name, self.mark, self.items, self.digest, self.shape, self.words = name, mark, [], 0, 0, 0
        self.apart, self.article, self.holds = apart, article, name in ("article", "main")


def _marks(attributes: str) -> tuple[str, bool]:
    """Attributes that tell an element's part, and whether they set it apart."""
    mark, apart = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            mark.append(value)
            apart = apart or any(w.lower() in MARKS for part in value.split() for w in SPLIT_NAMES.split(part.lower()))
        elif name == "role":
            mark.append(value)
            apart = apart or value.strip().lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            apart = True
    return " ".join(mark), apart


def parse(page: str) -> Node:
    """A tree of elements; end tags that HTML implies are added, stray ones ignored."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            stack[-1].items.append(page[at:start])
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].items.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in ("article", "main", "body", "td", "table") and name not in BLOCK:
                    break  # an inline end tag doesn't reach out of a section
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in BLOCK:
                    break
        if name in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in CLOSED_BY[name]:
                    del stack[k:]
                    break
                if stack[k].name in SCOPE[name]:
                    break
        mark, apart = _marks(m[3]) if m[3] and m[3].strip(" /") else ("", False)
        top = stack[-1]
        named = name in SECTIONS or apart and name not in ("html", "body", "article", "main")
        node = Node(name, mark, max(top.apart, SILENT if name in NO_TEXT else NAMED if named else 0), top.article or name in ("article", "main"))
        top.items.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """(element, whether it ends), without recursion, as pages may nest deeply."""
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, ends = todo.pop()
        yield node, ends
        if not ends:
            todo.append((node, True))
            todo += [(x, False) for x in reversed(node.items) if isinstance(x, Node)]


def _hash(parts: list[str]) -> int:
    raw = "\x00".join(p for p in parts if p).encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 | zlib.adler32(raw[::-1]) >> 1


def digest(root: Node) -> None:
    """Both hashes of every element, its words, and whether it holds an article."""
    for node, ends in walk(root):
        if ends:
            inner = [x for x in node.items if isinstance(x, Node)]
            texts = [" ".join(x.split()) for x in node.items if isinstance(x, str)]
            own = iter(texts)
            node.digest = _hash([node.name, node.mark, *(str(x.digest) if isinstance(x, Node) else next(own) for x in node.items)])
            shapes = [x.shape for x in inner if x.name not in INLINE]
            runs = [str(x) for k, x in enumerate(shapes) if not k or shapes[k - 1] != x]  # as many alike in a row as there are
            node.shape = _hash(["shape", node.name, DIGITS.sub("#", node.mark), *runs])
            node.words = 0 if node.apart == SILENT else sum(x.words for x in inner) + sum(len(x.split()) for x in texts)
            node.holds = node.holds or any(x.holds for x in inner)


def templatable(node: Node) -> bool:
    """Whether the subtree may be deleted for recurring: not what holds the page, nor a plain block of the article."""
    if node.name in ("#root", "html", "body", "article", "main"):
        return False
    return not (node.article and node.name in TEXT_BLOCKS)


def shapely(node: Node, has_article: bool) -> bool:
    """Whether the subtree's shape may be a template: outside the article, marked or made for it; without an article only the latter."""
    return not node.article and not node.holds and node.words > 0 and (node.name in SECTIONS or bool(node.mark) and has_article)


def subtrees(root: Node) -> dict[int, int]:
    """The hashes of the subtrees that a template may have, with the words of those that are shapes and -1 for the others."""
    digest(root)
    out: dict[int, int] = {}
    for n, ends in walk(root):
        if ends and n.items and templatable(n):
            out.setdefault(n.digest, -1)
            if shapely(n, root.holds):
                out[n.shape] = out.get(n.shape, 0) + n.words
    return out


def main_text(page: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    root = parse(page)
    if templates:
        digest(root)
    return text_of(root, templates)


def text_of(root: Node, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The text outside of templates and of what names set apart: that of the articles, if the page has any."""
    has_article = any(n.name in ("article", "main") and not n.apart for n, _ in walk(root))
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        now.clear()
        if text:
            blocks.append(text)

    def gone(x: Node) -> bool:
        if templates and (x.digest in templates and templatable(x) or x.shape in templates and shapely(x, root.holds)):
            return True
        return bool(x.apart)

    todo: list = [root]
    inside = [not has_article]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, bool):
            inside.pop()
        elif isinstance(x, tuple):
            if inside[-1]:
                now.append(x[0])
        elif gone(x):
            if x.name in BLOCK:
                close()
        elif x.name == "br":  # a line break is white space of its block
            if inside[-1]:
                now.append(" ")
        else:
            block = x.name in BLOCK
            if block:
                close()
                todo.append(None)
            if x.name in ("article", "main"):
                inside.append(True)
                todo.append(False)
            todo += [y if isinstance(y, Node) else (y,) for y in reversed(x.items)]
    close()
    return "\n".join(blocks)


def host(url: Column) -> Column:
    """Lower-case host of a URL, empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, min_pages: int = 5) -> DataFrame:
    """host, hash: the subtrees that the host has beside at least min_pages different main texts.

    Main texts are told by names here. Copies of a page, whatever their URLs, are one; the number does not rise with the size of the host.
    A shape must also hold a quarter of its pages' words at most, over all of them. Each (host, hash, main text) is counted once, dealt by all
    three, so a hot host does not matter.
    """
    prepare(pages.sparkSession)
    shared_dir(pages.sparkSession)

    def emit(batches):
        for pdf in batches:
            rows = []
            for h, page in zip(pdf["host"], pdf["html"]):
                root = parse(page or "")
                found = subtrees(root)
                content = xxhash.xxh3_64_intdigest(text_of(root).encode("utf-8", "surrogatepass")) - (1 << 63)
                rows += [(h, x, content, words, root.words) for x, words in found.items()]
            yield pd.DataFrame(rows, columns=["host", "hash", "content", "words", "page_words"])

    found = pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(emit, "host string, hash long, content long, words long, page_words long")
    each = found.groupBy("host", "hash", "content").agg(F.max("words").alias("words"), F.max("page_words").alias("page_words"))
    counted = each.groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("words").alias("most"), F.sum("words").alias("words"), F.sum("page_words").alias("page_words"))
    return counted.where((F.col("n") >= min_pages) & ((F.col("most") < 0) | (4 * F.col("words") <= F.col("page_words")))).select("host", "hash").checkpoint()


def templates_of_pages(pages: DataFrame, known: DataFrame) -> DataFrame:
    """a, b, hashes: of each distinct text of host and html (named by a, b), the templates of its host that it has."""
    salts = partitions(pages.sparkSession)

    def emit(batches):
        for pdf in batches:
            rows = [(h, a, b, x) for h, a, b, page in zip(pdf["host"], pdf["a"], pdf["b"], pdf["html"]) for x in subtrees(parse(page or ""))]
            yield pd.DataFrame(rows, columns=["host", "a", "b", "hash"])

    found = pages.mapInPandas(emit, "host string, a long, b long, hash long").withColumn("salt", F.pmod("a", F.lit(salts)).cast("int"))
    # each template goes to every salt, and pages are dealt over the salts
    salted = known.select("host", "hash", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return found.join(salted, ["host", "hash", "salt"]).groupBy("a", "b").agg(F.collect_set("hash").alias("hashes"))


def extract(pages: DataFrame, min_pages: int = 5, broadcast_hashes: int = 200_000) -> DataFrame:
    """pages with text and n_chars (code points) in place of html.

    A null html is empty, a null url has the empty host; repeated rows stay, but count once for templates. Other columns are kept,
    those named text or n_chars are replaced. An empty table gives no rows. What recurs beside min_pages different main texts of a host
    goes as a template; what names set apart goes on every host, however many pages it has. Templates are broadcast if all hosts' lists hold broadcast_hashes hashes at most (8 bytes each); beyond
    that each page gets those that it has.
    """
    prepare(pages.sparkSession)
    held = pages.drop("text", "n_chars")
    at, hashes, a, b = fresh(held, "host", "hashes", "a", "b")
    placed = held.withColumn(at, host(F.col("url")))
    known = templates(pages, min_pages)

    @F.pandas_udf("string")
    def text(page: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([main_text(p or "", frozenset(h) if h is not None else frozenset()) for p, h in zip(page, hashes)], dtype=object)

    if known.count() <= broadcast_hashes:
        lists = known.groupBy(F.col("host").alias(at)).agg(F.collect_list("hash").alias(hashes))
        joined = placed.join(F.broadcast(lists), at, "left")
    else:
        named = placed.withColumns({a: F.xxhash64(at, "html"), b: F.xxhash64(F.lit(1), at, "html")})
        mine = templates_of_pages(named.select(F.col(at).alias("host"), F.col(a).alias("a"), F.col(b).alias("b"), "html"), known)
        joined = named.join(mine.withColumnsRenamed({"a": a, "b": b, "hashes": hashes}), [a, b], "left")
    out = joined.withColumn("text", text("html", hashes))
    others = [c for c in held.columns if c.lower() != "html"]
    return out.select(*others, "text", F.length("text").cast("long").alias("n_chars"))
