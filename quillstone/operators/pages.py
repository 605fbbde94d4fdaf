"""Pages of a site: the index of contents, trees, breadcrumbs, link crawling, embeds and rebuilds."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import paths as P
from quillstone.functions import text as X

#: ![[page#reference|label]], as both engines read it.
EMBED = r"!\[\[([^\[\]|#\\]+)(#[^\[\]|]*)?(?:\\?\|[^\[\]]*)?\]\]"
ANY_EMBED = re.compile(EMBED)


def content_index(pages: DataFrame, include_empty: bool = True) -> DataFrame:
    """slug, entry: title, distinct links, tags and content as JSON; a page without text is left out unless it is to be kept."""
    kept = pages if include_empty else pages.where(~X.is_blank(F.col("content")))
    return kept.select("slug", F.to_json(F.struct("slug", "title", F.array_distinct("links").alias("links"), "tags", "content")).alias("entry"))


def labels(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """node, label: #tag for a tag, else the page's title, else its slug."""
    titled = nodes.join(pages.select(F.col("slug").alias("node"), "title"), "node", "left")
    tag = F.when(F.col("node").startswith("tags/"), F.concat(F.lit("#"), F.substring("node", 6, 1 << 30)))
    return titled.select("node", F.coalesce(tag, "title", "node").alias("label"))


def tree(pages: DataFrame, hidden: tuple[str, ...] = ("tags",)) -> DataFrame:
    """path, parent, folder, name: pages and the folders above them; what lies below a hidden segment goes.

    A folder is named by its index page, or by its last segment.
    """
    bare = F.regexp_replace("slug", r"(^|/)index$", "")
    shown = pages.where(~F.arrays_overlap(F.split("slug", "/"), F.array(*[F.lit(h) for h in hidden]).cast("array<string>")))
    own = shown.select(bare.alias("path"), (bare != F.col("slug")).alias("folder"), F.when(F.col("title") != "index", F.col("title")).alias("title"))
    above = own.select(F.explode(P.parents(F.col("path"))).alias("path")).distinct().select("path", F.lit(True).alias("folder"), F.lit(None).cast("string").alias("title"))
    nodes = own.unionByName(above).where("path <> ''").groupBy("path").agg(F.bool_or("folder").alias("folder"), F.max("title").alias("title"))
    last = F.element_at(F.split("path", "/"), -1)
    return nodes.select("path", F.regexp_replace("path", r"/?[^/]*$", "").alias("parent"), "folder", F.coalesce("title", last).alias("name"))


def explorer(pages: DataFrame, hidden: tuple[str, ...] = ("tags",)) -> DataFrame:
    """The tree in the order shown: by parent, folders first, then by name without case or accents and by number.

    A sort over all rows, dealt by range, so that a folder with most pages is no single task.
    """
    return tree(pages, hidden).orderBy("parent", F.desc("folder"), F.collate(X.natural_key(F.col("name")), "UNICODE_CI_AI"), "path")


def breadcrumbs(pages: DataFrame, root: str = "Home") -> DataFrame:
    """slug, ordinal, name, path: from the root down to the page, whose own path is empty."""
    bare = F.regexp_replace("slug", r"(^|/)index$", "")
    steps = F.concat(F.array(F.lit("")), F.filter(X.prefixes(F.split(bare, "/"), "/"), lambda p: p != ""))
    chain = pages.select("slug", F.size(steps).alias("_n"), F.posexplode(steps).alias("ordinal", "path"))
    named = chain.join(tree(pages, ()).select("path", "folder", F.col("name").alias("_name")), "path", "left")
    target = F.when(F.col("ordinal") == 0, "").otherwise(F.concat("path", F.when(F.col("folder"), "/").otherwise("")))
    return named.select(
        "slug", "ordinal", F.when(F.col("ordinal") == 0, root).otherwise(F.replace("_name", F.lit("-"), F.lit(" "))).alias("name"),
        F.when(F.col("ordinal") == F.col("_n") - 1, "").otherwise(P.join_segments(P.path_to_root(F.col("slug")), target)).alias("path"))


def recent(pages: DataFrame, most: int = 3) -> DataFrame:
    """place, slug, title, remaining: the newest pages, and how many more there are."""
    from quillstone.operators.site import listed

    total = pages.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("remaining"))
    newest = listed(pages.select("slug", "title", "modified")).limit(most).agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce(F.unix_date("modified"), F.lit(-(1 << 31))).alias("d"), F.lower("title").alias("t"), "slug", "title"))).alias("rows"))  # `most` rows at most
    order = F.array_sort("rows", lambda a, b: F.when(a["d"] > b["d"], -1).when(a["d"] < b["d"], 1).when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).when(a["slug"] < b["slug"], -1).when(a["slug"] > b["slug"], 1).otherwise(0))
    return newest.join(F.broadcast(total)).select(F.posexplode(order).alias("place", "r"), "remaining").select("place", "r.slug", "r.title", "remaining")


def external(link: Column) -> Column:
    return link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def crawl(pages: DataFrame, strategy: str = "shortest") -> DataFrame:
    """slug, link, href, target: links within the site as relative URLs and the simple slugs they lead to.

    Links elsewhere and to anchors of the page itself are left out. Strategies: relative, absolute (from the root), shortest (by
    name where it is the name of one page only, else from the root).
    """
    links = pages.select("slug", F.explode("links").alias("link")).where(~external(F.col("link")) & ~F.col("link").startswith("#")).distinct()
    made = links.withColumn("_l", P.internal_link(F.col("link")))
    if strategy == "relative":
        found = made.withColumn("href", F.col("_l"))
    elif strategy == "absolute":
        found = made.withColumn("href", P.from_root(F.col("slug"), F.col("_l")))
    elif strategy == "shortest":
        parts = P.split_anchor(P.strip_slashes(F.substring("_l", 2, 1 << 30)))
        name = F.element_at(F.split("slug", "/"), -1)
        only = pages.select("slug").distinct().groupBy(name.alias("_base")).agg(F.count("*").alias("_n"), F.min("slug").alias("_only")).where("_n = 1")
        joined = made.withColumn("_base", parts["path"]).join(only, "_base", "left")
        found = joined.withColumn("href", F.when(F.col("_only").isNotNull(), F.concat(P.resolve_relative(F.col("slug"), F.col("_only")), parts["anchor"])).otherwise(P.from_root(F.col("slug"), F.col("_l"))))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return found.select("slug", "link", "href", P.simplify(P.resolve_url(P.simplify(F.col("slug")), F.col("href"))).alias("target"))


def embeds(references: DataFrame, pages: DataFrame) -> DataFrame:
    """slug, target, reference, body: what each reference (slug, target, reference) embeds of its target; null where there is no such page or part."""
    texts = pages.select(F.col("slug").alias("target"), F.col("content").alias("_c"))
    return references.join(texts, "target", "left").select("slug", "target", "reference", X.embedded(F.col("_c"), F.col("reference")).alias("body"))


def expand(pages: DataFrame) -> DataFrame:
    """slug, content: texts with what they embed, ![[page]], ![[page#heading]] and ![[page#^block]], in its place, and what that embeds in turn.

    A page is shown once in a text, where it comes first; where it comes again, and where a text embeds itself, a note says so. Embeds of pages that aren't
    there stay as they are, and so do those in code. What meets in a task is a text and the pages that end up in it, each once.
    """
    from quillstone.operators import site

    embeds = F.regexp_extract_all(X.without_code(F.col("content")), F.lit(EMBED), F.lit(1))
    held = pages.select("slug", "content").withColumn("embeds", F.array_distinct(F.transform(embeds, lambda x: P.slugify(F.trim(x)))))
    pairs = site.transclude(held)
    # each page's embeds are looked up once, whatever the number of texts that it ends up in; a slug is made by the same function as the pages' own
    each = held.select("slug", F.explode(F.array_distinct(F.regexp_extract_all(X.without_code(F.col("content")), F.lit(EMBED), F.lit(0)))).alias("embed"))
    each = each.withColumns({"to": P.slugify(F.trim(F.regexp_extract("embed", EMBED, 1))), "reference": F.regexp_extract("embed", EMBED, 2)})
    bodies = held.select(F.col("slug").alias("to"), F.col("content").alias("target"))
    part = X.embedded(F.col("target"), F.when(F.startswith("reference", F.lit("#^")), F.col("reference")).when(
        F.col("reference") != "", F.concat(F.lit("#"), P.slug_anchor(F.substring("reference", 2, 1 << 30)))).otherwise(""))
    filled = each.join(bodies, "to", "left").select(F.col("slug").alias("included"), F.struct("embed", "to", part.alias("part")).alias("e"))
    known = filled.groupBy("included").agg(F.collect_list("e").alias("embeds"))  # those of a page
    own = held.where(F.size("embeds") > 0).select("slug", F.col("slug").alias("included"))
    met = pairs.select("slug", "included").unionByName(own).join(known, "included").groupBy("slug").agg(F.collect_list(F.struct("included", "embeds")).alias("met"))

    def assemble(slug: str, body: str, met: list) -> str:
        known = {(m["included"], e["embed"]): (e["to"], e["part"]) for m in met for e in m["embeds"]}
        seen, out = {slug}, []
        todo: list[tuple[str, str, int]] = [(slug, body, 0)]
        while todo:
            page, text, at = todo.pop()
            for m in ANY_EMBED.finditer(text, at):
                to, part = known.get((page, m[0]), (None, None))
                if to is None:
                    continue
                out.append(text[at : m.start()])
                todo.append((page, text, m.end()))
                if to in seen:
                    out.append(f"Circular transclusion detected: {to}")
                elif part is None:
                    out.append(m[0])
                    seen.add(to)
                else:
                    seen.add(to)
                    todo.append((to, part, 0))
                break
            else:
                out.append(text[at:])
        return "".join(out)

    @F.pandas_udf("string")
    def assembled(slug: pd.Series, body: pd.Series, met: pd.Series) -> pd.Series:
        return pd.Series([assemble(*row) for row in zip(slug, body, met)], dtype=object)

    made = met.join(held.select("slug", "content"), "slug").select("slug", assembled("slug", "content", "met").alias("content"))
    return made.unionByName(held.where(F.size("embeds") == 0).select("slug", "content"))


def find(pages: DataFrame, query: str, per_field: int = 8, per_tag: int = 5, stored: DataFrame | None = None) -> DataFrame:
    """slug, priority, place for what a user types: words search titles, then contents; #tag searches tags; #tag words search the pages with that tag.

    stored: an index that store_index has written; without one it is made of the pages.
    """
    from quillstone.operators import site

    if not query.startswith("#"):
        return site.search(stored if stored is not None else site.index(pages), query, per_field)
    tag, _, words = query[1:].strip().partition(" ")
    if words.strip():
        return site.search(stored if stored is not None else site.index(pages), words, per_field, among=pages.where(F.array_contains("tags", tag)))
    start = F.lower(F.lit(tag))
    hits = pages.select("slug", F.size(F.filter("tags", lambda t: F.startswith(F.lower(t), start))).alias("hits")).where("hits > 0")
    best = hits.orderBy(F.desc("hits"), "slug").limit(per_tag)
    ranked = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("hits")).alias("h"), "slug"))).alias("rows"))  # per_tag rows at most
    return ranked.select(F.posexplode("rows").alias("place", "r")).select("r.slug", F.lit(2).alias("priority"), (F.col("place") + 1).alias("place"))


def affected_folders(changed: DataFrame) -> DataFrame:
    """folder: all folders above changed pages, whose lists are to be made anew."""
    return changed.select(F.explode(P.parents(F.col("slug"))).alias("folder")).distinct()


def affected_tags(changed: DataFrame) -> DataFrame:
    """tag: tags of changed pages and the tags above them."""
    return changed.select(F.explode("tags").alias("t")).select(F.explode(X.prefixes(F.split("t", "/"), "/")).alias("tag")).distinct()


def hotspots(failures: DataFrame, pattern: str, name: str, order: str, examples: int = 3) -> DataFrame:
    """pattern, n, examples, more: failures by pattern, most first, with the first names of each."""
    from quillstone.operators.relational import top_per_group

    counts = failures.groupBy(pattern).agg(F.count("*").alias("n"))
    first = top_per_group(failures.select(pattern, name, order), [pattern], [F.col(order)], examples)
    lists = first.groupBy(pattern).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", name))), lambda x: x[name]).alias("examples"))
    return counts.join(lists, pattern).withColumn("more", F.greatest(F.col("n") - examples, F.lit(0))).orderBy(F.desc("n"), pattern)
