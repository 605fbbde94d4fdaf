"""Slugs and paths of a document site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.once import let


def slug_segment(c: Column) -> Column:
    c = F.regexp_replace(c, r"\s", "-")
    for a, b in (("&", "-and-"), ("%", "-percent"), ("?", ""), ("#", "")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.array_join(F.transform(F.split(c, "/"), slug_segment), "/"), r"/$", "")


def extension(c: Column) -> Column:
    """The file extension with its dot, null if there is none."""
    found = F.regexp_extract(c, r"\.[A-Za-z0-9]+$", 0)
    return F.when(found != "", found)


def file_slug(c: Column) -> Column:
    """A path as a slug: .md and .html are cut off, other extensions stay, _index is index."""
    def made(path: Column) -> Column:
        bare = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
        kept = let(F.regexp_extract(path, r"\.[A-Za-z0-9]+$", 0), lambda ext: F.when(ext.isin(".md", ".html"), "").otherwise(ext))
        return F.concat(F.regexp_replace(slugify(bare), r"(^|/)_index$", "$1index"), kept)

    return let(F.regexp_replace(c, r"^/+|/+$", ""), made)


def simplify(c: Column) -> Column:
    """A slug without a trailing index, / if nothing is left."""
    return let(F.regexp_replace(F.regexp_replace(c, r"(^|/)index$", "$1"), r"^/+", ""), lambda bare: F.when(bare == "", "/").otherwise(bare))


def strip_slashes(c: Column, only_lead: bool = False) -> Column:
    return F.regexp_replace(c, r"^/" if only_lead else r"^/|/$", "")


def join_segments(*parts: Column) -> Column:
    """Parts joined by single slashes; a slash before the first and one after the last stay."""
    def joined(each: Column) -> Column:
        kept = F.filter(each, lambda p: ~p.isin("", "/"))
        body = F.array_join(F.transform(kept, lambda p: strip_slashes(p)), "/")
        return F.concat(F.when(each[0].startswith("/"), "/").otherwise(""), body, F.when(each[len(parts) - 1].endswith("/"), "/").otherwise(""))

    return let(F.array(*parts), joined)


def is_folder(c: Column) -> Column:
    return c.endswith("/") | c.rlike(r"(^|/)index(\.md|\.html)?$")


def path_to_root(slug: Column) -> Column:
    """From a page up to the root: as many .. as the slug has slashes, . if none."""
    up = F.size(F.filter(F.split(slug, "/"), lambda x: x != "")) - 1
    return let(up, lambda depth: F.when(depth > 0, F.array_join(F.array_repeat(F.lit(".."), depth.cast("int")), "/")).otherwise("."))


def resolve_relative(current: Column, target: Column) -> Column:
    return F.concat(path_to_root(current), F.lit("/"), let(simplify(target), lambda to: F.when(to == "/", "").otherwise(to)))


def slug_anchor(title: Column) -> Column:
    """A heading's anchor: lower case, without punctuation, hyphens for white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def split_anchor(link: Column) -> Column:
    """struct(path, anchor): the anchor is a slug with its #, as it stands behind a .pdf."""
    def made(parts: Column) -> Column:
        anchor = F.get(parts, F.lit(1))
        slug = F.when(parts[0].endswith(".pdf"), anchor).otherwise(slug_anchor(anchor))
        return F.struct(parts[0].alias("path"), F.when(anchor.isNull(), "").otherwise(F.concat(F.lit("#"), slug)).alias("anchor"))

    return let(F.split(link, "#"), made)


def internal_link(link: Column) -> Column:
    """A link as a relative URL of slugs: leading dots stay, folders keep a trailing slash, anchors are slugs."""
    decoded = F.coalesce(F.try_url_decode(F.replace(link, F.lit("+"), F.lit("%2B"))), link)

    def made(parts: Column) -> Column:
        def relative(segments: Column) -> Column:
            dots = F.array_join(F.filter(segments, lambda s: s.isin(".", "..")), "/")
            named = F.array_join(F.filter(segments, lambda s: ~s.isin(".", "..")), "/")
            joined = join_segments(dots, strip_slashes(simplify(file_slug(named))))
            return let(joined, lambda j: F.when(j == "", ".").when(j.startswith("."), j).otherwise(F.concat(F.lit("./"), j)))

        to = let(F.filter(F.split(parts["path"], "/"), lambda s: s != ""), relative)
        return F.concat(to, F.when(is_folder(parts["path"]), "/").otherwise(""), parts["anchor"])

    return let(split_anchor(decoded), made)


def from_root(src: Column, link: Column) -> Column:
    """What internal_link has made of a link, read from the root of the site and as seen from the page src."""
    def made(to: Column) -> Column:
        canonical = strip_slashes(F.substring(to, F.lit(2), F.length(to)))
        return F.concat(join_segments(path_to_root(src), canonical), F.when(is_folder(to), "/").otherwise(""))

    return let(link, made)


def resolve_url(page: Column, link: Column) -> Column:
    """The path that a relative URL on a page leads to, without a leading slash; .. never climbs above the root."""
    path = F.split(link, "[#?]")[0]
    rooted = path.startswith("/")
    base = F.split(F.regexp_replace(page, r"[^/]*$", ""), "/")
    segments = F.filter(F.concat(F.when(rooted, F.array().cast("array<string>")).otherwise(base), F.split(path, "/")), lambda s: ~s.isin("", "."))
    walked = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))))
    def made(joined: Column) -> Column:
        folder = path.rlike(r"(^|/)\.{0,2}$") & (path != "") & (joined != "")
        return F.when(path == "", page).otherwise(F.concat(joined, F.when(folder, "/").otherwise("")))

    return let(F.array_join(walked, "/"), made)


def slug_tag(c: Column) -> Column:
    return slugify(c)


def is_full_slug(c: Column) -> Column:
    return ~(c.startswith(".") | c.startswith("/")) & ~c.endswith("/") & ~c.rlike(r"[ #?&]")


def is_relative(c: Column) -> Column:
    return c.rlike(r"^\.{1,2}") & ~c.rlike(r"\.(md|html)$") & ~c.rlike(r"/index$")


def is_simple_slug(c: Column) -> Column:
    return ~c.startswith(".") & ((F.length(c) <= 1) | ~c.startswith("/")) & ~c.rlike(r"(^|/)index$") & ~c.rlike(r"[ #?&]")


def parents(slug: Column) -> Column:
    """Folders above a slug, the nearest last."""
    parts = F.split(slug, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
