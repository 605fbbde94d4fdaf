"""Document collections: links, tags, folders, search, and graphs of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import paths as P
from quillstone.functions import text as X
from quillstone.sources.io import shared_folder


def backlinks(pages: DataFrame, slug: str = "slug", links: str = "links") -> DataFrame:
    """slug, backlinks: pages that link to a page, itself left out, sorted."""
    edges = pages.select(F.col(slug).alias("source"), F.explode(F.array_distinct(links)).alias("target")).where("source <> target")
    known = edges.join(pages.select(F.col(slug).alias("target")), "target", "left_semi")
    return known.groupBy(F.col("target").alias(slug)).agg(F.array_sort(F.collect_set("source")).alias("backlinks"))


def edges(pages: DataFrame, remove_tags: tuple[str, ...] = ()) -> DataFrame:
    """source, target: links to pages that exist, and tags as nodes tags/<tag>."""
    links = pages.select(F.col("slug").alias("source"), F.explode(F.array_distinct("links")).alias("target")).join(pages.select(F.col("slug").alias("target")), "target", "left_semi").select("source", "target")
    kept = F.array_except("tags", F.array(*[F.lit(t) for t in remove_tags]).cast("array<string>"))
    return links.unionByName(pages.select(F.col("slug").alias("source"), F.explode(kept).alias("t")).select("source", F.concat(F.lit("tags/"), "t").alias("target")))


def neighbourhood(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth: nodes within so many undirected steps of the start nodes; a negative depth goes on to the end.

    Each round joins the frontier alone and leaves out what was visited; it is written to the shared folder, so that no plan grows with the rounds.
    """
    shared_folder(links.sparkSession)
    both = links.select("source", "target").unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct().checkpoint()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier, d = seen, 0
    while d != depth:
        d += 1
        new = frontier.join(both, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among the nodes."""
    n = nodes.select("node").distinct()
    return links.join(n, F.col("source") == n["node"], "left_semi").join(n, F.col("target") == n["node"], "left_semi")


def tag_pages(pages: DataFrame) -> DataFrame:
    """tag, slugs: pages of every tag and of the tags above it (a/b counts for a)."""
    every = pages.select("slug", F.explode("tags").alias("t")).select("slug", F.explode(X.prefixes(F.split("t", "/"), "/")).alias("tag")).distinct()
    return every.groupBy("tag").agg(F.array_sort(F.collect_list("slug")).alias("slugs"))


def folders(pages: DataFrame) -> DataFrame:
    """folder, n, modified: direct children of every folder that a slug lies in, and their latest date."""
    own = pages.select(F.element_at(F.concat(F.array(F.lit("")), P.parents(F.col("slug"))), -1).alias("folder"), "modified")
    every = pages.select(F.explode(P.parents(F.col("slug"))).alias("folder")).distinct()
    stats = own.groupBy("folder").agg(F.count("*").alias("n"), F.max("modified").alias("modified"))
    return every.join(stats, "folder", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def described(kind: DataFrame, authored: DataFrame, key: str, default: str) -> DataFrame:
    """Titles of generated pages, overridden by authored ones."""
    return kind.join(authored.select(key, F.col("title").alias("_t")), key, "left").withColumn("title", F.coalesce("_t", F.concat(F.lit(default), F.col(key)))).drop("_t")


def shortest_links(links: DataFrame, slugs: DataFrame) -> DataFrame:
    """link, slug: a link's page if its last part names one page only, else the link from the root."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    one = slugs.groupBy(last(F.col("slug")).alias("base")).agg(F.count("*").alias("n"), F.min("slug").alias("slug")).where("n = 1").drop("n")
    return links.withColumn("base", last(F.col("link"))).join(one, "base", "left").select("link", F.coalesce("slug", P.strip_slashes(F.col("link"))).alias("slug"))


def listed(pages: DataFrame, folders_first: bool = False) -> DataFrame:
    """Newest first, undated last, then by title without regard to case."""
    keys = [F.desc_nulls_last("modified"), F.lower("title"), F.col("slug")]
    return pages.orderBy(*([~P.is_folder(F.col("slug"))] if folders_first else []), *keys)


def transclude(pages: DataFrame, depth: int | None = None) -> DataFrame:
    """slug, included: the pages that each page embeds, in turn, itself left out; up to a depth, or all.

    Pairs are kept, not paths, and the rounds end when no pair is new. Without a depth each round doubles the steps that pairs stand for: what is
    exactly so many steps away leads on to all that is up to as many steps from there, so that a chain meets each pair once. Rounds are
    written to the shared folder.
    """
    shared_folder(pages.sparkSession)
    if depth is None:
        seen = pages.select("slug", F.explode("embeds").alias("included")).where("slug <> included").distinct().checkpoint()
        jump = seen  # pairs that are exactly 2^r steps apart, a page and itself among them
        while True:
            by = lambda rows: rows.select(F.col("slug").alias("included"), F.col("included").alias("next"))
            step = lambda rows: jump.join(by(rows), "included").select("slug", F.col("next").alias("included")).distinct()
            new = step(seen).where("slug <> included").join(seen, ["slug", "included"], "left_anti").checkpoint()
            if new.isEmpty():
                return seen
            jump = step(jump).checkpoint()
            seen = seen.unionByName(new).checkpoint()
    links = pages.select("slug", F.explode("embeds").alias("included")).where("slug <> included").distinct().checkpoint()
    seen, new, d = links, links, 1
    while d < depth:
        d += 1
        by = links.select(F.col("slug").alias("included"), F.col("included").alias("next"))
        further = new.join(by, "included").select("slug", F.col("next").alias("included")).where("slug <> included").distinct()
        new = further.join(seen, ["slug", "included"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        seen = seen.unionByName(new).checkpoint()
    return seen


def index(pages: DataFrame, fields: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """field, token, slug, hits: an inverted index; tokens are whole, prefixes are matched when asked."""
    out = None
    for f in fields:
        one = pages.select(F.lit(f).alias("field"), F.explode(X.search_tokens(F.col(f))).alias("token"), "slug")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("field", "token", "slug").agg(F.count("*").alias("hits"))


def store_index(pages: DataFrame, folder: str, parts: int | None = None, fields: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """The inverted index as a table in a folder, in ranges of tokens, sorted within: a prefix is in few files, and in few row groups of them."""
    whole = index(pages, fields)
    spread = whole.repartitionByRange(parts, "token", "field", "slug") if parts else whole.repartitionByRange("token", "field", "slug")
    spread.sortWithinPartitions("token", "field", "slug").write.mode("errorifexists").parquet(folder)
    return pages.sparkSession.read.schema(whole.schema).parquet(folder)


def after(prefix: str) -> str | None:
    """The least string that is greater than all strings with the prefix; None if there is none."""
    for k in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[k])
        if code < 0x10FFFF:
            return prefix[:k] + chr(0xE000 if code + 1 == 0xD800 else code + 1)
    return None


def starting(column: str, prefix: str) -> F.Column:
    """Whether the column starts with the prefix, as a range that a scan can prune by."""
    end = after(prefix)
    least = F.col(column) >= prefix
    return least & (F.col(column) < end) if end else least


def search(inverted: DataFrame, query: str, per_field: int = 8, among: DataFrame | None = None, before: int = 10_000) -> DataFrame:
    """slug, place: pages whose tokens start with every term; titles come before contents, more hits before fewer.

    The terms are ranges of tokens, which reach the scan of a stored index. With among (slug), the first `before` pages of a field are looked
    for in it, and the first per_field of those stay.
    """
    terms = query.lower().split()
    match = F.lit(False)
    for t in terms:
        match = match | starting("token", t)
    hit = inverted.where(match)
    which = F.array(*[F.when(F.col("token").startswith(t), F.lit(i)) for i, t in enumerate(terms)])
    found = hit.withColumn("_w", F.explode(F.filter(which, lambda x: x.isNotNull()))).groupBy("field", "slug").agg(F.countDistinct("_w").alias("terms"), F.sum("hits").alias("hits"))
    best = found.where(F.col("terms") == len(set(terms)))

    def first(rows: DataFrame, n: int) -> DataFrame:
        """The first n of each field: ranked in parts before, so that no task ranks all hits."""
        order = [F.desc("hits"), F.col("slug")]
        part = F.row_number().over(Window.partitionBy("field", F.pmod(F.xxhash64("slug"), F.lit(32))).orderBy(*order))
        few = rows.withColumn("place", part).where(F.col("place") <= n)
        return few.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(*order))).where(F.col("place") <= n)

    if among is not None:
        best = first(best, max(before, per_field)).drop("place").join(among.select("slug").distinct(), "slug", "left_semi")
    ranked = first(best, per_field)
    return ranked.withColumn("priority", F.when(F.col("field") == "title", 0).otherwise(1)).groupBy("slug").agg(F.min(F.struct("priority", "place")).alias("f")).select("slug", "f.priority", "f.place")


def best_window(docs: DataFrame, key: str, text: str, terms: list[str], width: int = 30) -> DataFrame:
    """key, start, hits: the window of words with most hits, the last of equal ones."""
    words = docs.select(key, F.posexplode(F.split(text, r"\s+")).alias("at", "w")).where("w <> ''")
    hit = F.lit(0)
    for t in terms:
        hit = F.when(F.lower("w").contains(t), 1).otherwise(hit)
    ahead = Window.partitionBy(key).orderBy("at").rowsBetween(0, width - 1)
    return words.withColumn("h", F.sum(hit).over(ahead)).groupBy(key).agg(F.max(F.struct("h", "at")).alias("m")).select(key, F.col("m.at").alias("start"), F.col("m.h").alias("hits"))


def headings(docs: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """key, ordinal, depth, title, anchor: headings of a text with more than one, depths from 0, anchors made unique by number; code and comments have none."""
    found = docs.select(key, F.posexplode(F.split(X.without_blocks(F.col(text)), "\n")).alias("line", "raw")).where(F.col("raw").rlike(rf"^#{{1,{most}}} \S"))
    rows = found.select(key, "line", F.length(F.regexp_extract("raw", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("raw", r"^#+\s+", "")).alias("title"))
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")
    of = Window.partitionBy(key)
    numbered = rows.withColumns({"n": F.count("*").over(of), "depth": F.col("level") - F.min("level").over(of), "ordinal": F.row_number().over(of.orderBy("line")), "_s": slug})
    numbered = numbered.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_s").orderBy("line")) - 1)
    return numbered.where("n > 1").select(key, "ordinal", "depth", "title", F.when(F.col("_k") > 0, F.concat_ws("-", "_s", F.col("_k").cast("string"))).otherwise(F.col("_s")).alias("anchor"))


def ordered(rows: DataFrame, key: str, coarse: list[F.Column], fine: list[F.Column], name: str = "place") -> DataFrame:
    """rows with their place (from 1) within the key, in order of coarse and then fine.

    The rows of a key are numbered apart for each value of coarse, and the counts of those before are added, so that a key with most rows is no
    single task. coarse should hold the leading part of the order.
    """
    marks = [f"_c{i}" for i in range(len(coarse))]
    held = rows.select("*", *[c.alias(m) for c, m in zip(coarse, marks)])
    inside = held.withColumn("_in", F.row_number().over(Window.partitionBy(key, *marks).orderBy(*fine)))
    counts = held.groupBy(key, *marks).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy(*marks).rowsBetween(Window.unboundedPreceding, -1)  # a row for each value of coarse
    offsets = counts.select(F.col(key).alias("_key"), *[F.col(m).alias(f"{m}_") for m in marks], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = inside[key].eqNullSafe(offsets["_key"])
    for m in marks:
        same = same & inside[m].eqNullSafe(offsets[f"{m}_"])
    return inside.join(offsets, same).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_key", *marks, *[f"{m}_" for m in marks])


def feed(pages: DataFrame, base: str, n: int = 10) -> DataFrame:
    """The newest pages as feed items."""
    e = X.escape_html
    return listed(pages).limit(n).select(F.concat(F.lit(f"<item><title>"), e(F.col("title")), F.lit(f"</title><link>https://{base}/"), P.simplify(F.col("slug")), F.lit("</link></item>")).alias("item"))


def sitemap(pages: DataFrame, base: str) -> DataFrame:
    return pages.select(F.concat(F.lit(f"<url><loc>https://{base}/"), P.simplify(F.col("slug")), F.lit("</loc></url>")).alias("entry"))


def aliases(pages: DataFrame) -> DataFrame:
    """alias, slug: where each alias of a page redirects to."""
    return pages.select(F.explode("aliases").alias("a"), "slug").select(P.slugify(F.col("a")).alias("alias"), "slug").distinct()
