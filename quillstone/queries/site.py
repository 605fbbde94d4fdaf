"""Document collections: links, tags, search and graphs, on pages made of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import site as S
from quillstone.plans import site_build as site_build_plan
from quillstone.queries.registry import query, table
from quillstone.sources import io


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: slug, title, links, tags, content, modified."""
    p = table(spark, sf_dir, "part")
    n = F.lit(table(spark, sf_dir, "part").count())
    slug = lambda k: F.concat(F.lit("p/"), k.cast("string"))
    links = F.array(slug(F.col("p_partkey") * 7 % n), slug(F.col("p_partkey") * 3 % n + F.col("p_size")), slug(F.col("p_partkey") * 7 % n))
    tags = F.array(F.concat(F.lit("type/"), F.col("p_type")), F.col("p_brand"))
    return p.select(slug(F.col("p_partkey")).alias("slug"), F.col("p_name").alias("title"), links.alias("links"), tags.alias("tags"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("content"),
                    F.when(F.col("p_partkey") % 9 != 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))).alias("modified"))


PAGES = """pages_ AS (SELECT 'p/' || p_partkey AS slug, p_name AS title, ['p/' || (p_partkey * 7 % n), 'p/' || (p_partkey * 3 % n + p_size)] AS links, ['type/' || p_type, p_brand] AS tags, p_name || ' ' || p_type || ' ' || p_brand AS content,
CASE WHEN p_partkey % 9 <> 0 THEN DATE '2024-01-01' + CAST(p_size AS INTEGER) END AS modified FROM part, (SELECT count(*) AS n FROM part)),
links_ AS (SELECT DISTINCT slug AS source, unnest(links) AS target FROM pages_)"""


@query(f"WITH {PAGES} SELECT target AS slug, string_agg(source, ',' ORDER BY source) AS backlinks FROM links_ WHERE source <> target AND target IN (SELECT slug FROM pages_) GROUP BY target")
def backlinks(spark, d):
    return S.backlinks(pages(spark, d)).select("slug", F.array_join("backlinks", ",").alias("backlinks"))


@query(f"""WITH {PAGES} SELECT source, target FROM links_ WHERE target IN (SELECT slug FROM pages_) UNION ALL SELECT slug, 'tags/' || t FROM (SELECT slug, unnest(tags) AS t FROM pages_) WHERE t <> 'Brand#2'""")
def link_edges(spark, d):
    return S.edges(pages(spark, d), ("Brand#2",))


@query(f"""WITH RECURSIVE {PAGES}, e AS (SELECT source, target FROM links_ WHERE target IN (SELECT slug FROM pages_)), u AS (SELECT source, target FROM e UNION SELECT target, source FROM e),
b AS (SELECT 'p/1' AS node, 0 AS depth UNION SELECT target, depth + 1 FROM b JOIN u ON node = source WHERE depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def neighbourhood_bfs(spark, d):
    p = pages(spark, d)
    links = S.edges(p).where(~F.col("target").startswith("tags/"))
    return S.neighbourhood(links, spark.createDataFrame([("p/1",)], "node string"), 3)


@query(f"""WITH {PAGES} SELECT source, target FROM links_ WHERE source IN (SELECT slug FROM pages_ WHERE title LIKE 'red%') AND target IN (SELECT slug FROM pages_ WHERE title LIKE 'red%')""")
def induced_subgraph(spark, d):
    p = pages(spark, d)
    return S.induced(S.edges(p), p.where(F.col("title").like("red%")).select(F.col("slug").alias("node")))


@query(f"""WITH {PAGES}, t AS (SELECT DISTINCT slug, tag FROM (SELECT slug, unnest(CASE WHEN strpos(t, '/') > 0 THEN [split_part(t, '/', 1), t] ELSE [t] END) AS tag FROM (SELECT slug, unnest(tags) AS t FROM pages_))) SELECT tag, count(*) AS n, min(slug) AS first FROM t GROUP BY tag""")
def tag_rollup(spark, d):
    return S.tag_pages(pages(spark, d)).select("tag", F.size("slugs").cast("long").alias("n"), F.col("slugs")[0].alias("first"))


@query(f"WITH {PAGES} SELECT 'p' AS folder, count(*) AS n, max(modified) AS modified FROM pages_")
def folder_rollup(spark, d):
    return S.folders(pages(spark, d)).select("folder", "n", "modified")


@query(f"WITH {PAGES}, b AS (SELECT split_part(slug, '/', 2) AS base, count(*) AS n, min(slug) AS slug FROM pages_ GROUP BY 1 HAVING count(*) = 1), l AS (SELECT CAST(l_partkey + l_linenumber * 300 AS VARCHAR) AS link FROM lineitem) SELECT link, coalesce(slug, link) AS slug FROM l LEFT JOIN b ON base = link")
def shortest_link_resolution(spark, d):
    links = table(spark, d, "lineitem").select((F.col("l_partkey") + F.col("l_linenumber") * 300).cast("string").alias("link"))
    return S.shortest_links(links, pages(spark, d))


@query(f"WITH {PAGES}, b AS (SELECT split_part(slug, '/', 2) AS base, count(*) AS n, min(slug) AS slug FROM pages_ GROUP BY 1 HAVING count(*) = 1), l AS (SELECT CAST(l_partkey + l_linenumber * 300 AS VARCHAR) AS link FROM lineitem) SELECT link, coalesce(slug, link) AS slug FROM l LEFT JOIN b ON base = link")
def shortest_link_resolution_all(spark, d):
    """The older name of the same query."""
    return shortest_link_resolution(spark, d)


@query(f"WITH {PAGES} SELECT slug, title FROM pages_ ORDER BY modified DESC NULLS LAST, lower(title), slug LIMIT 10")
def recent_pages(spark, d):
    return S.listed(pages(spark, d)).limit(10).select("slug", "title")


_HITS = """t AS (SELECT 'title' AS field, slug, unnest(string_split(lower(title), ' ')) AS token FROM pages_ UNION ALL SELECT 'content', slug, unnest(string_split(lower(content), ' ')) FROM pages_)"""


@query(f"""WITH {PAGES}, {_HITS}, f AS (SELECT field, slug, count(*) AS hits, count(DISTINCT w) AS terms FROM t JOIN (SELECT unnest(['red', 'wid']) AS w) ON starts_with(token, w) GROUP BY ALL),
r AS (SELECT field, slug, row_number() OVER (PARTITION BY field ORDER BY hits DESC, slug) AS place FROM f WHERE terms = 2)
SELECT slug, priority, CAST(place AS INTEGER) AS place FROM (SELECT slug, CASE WHEN field = 'title' THEN 0 ELSE 1 END AS priority, place, row_number() OVER (PARTITION BY slug ORDER BY CASE WHEN field = 'title' THEN 0 ELSE 1 END, place) AS k FROM r WHERE place <= 8) WHERE k = 1""")
def search_basic(spark, d):
    """A search in the index as it is stored."""
    return S.search(S.store_index(pages(spark, d), f"{io.shared_folder(spark)}/{uuid.uuid4().hex}"), "red wid")


@query(f"""WITH {PAGES}, {_HITS} SELECT field, token, slug, count(*) AS hits FROM t GROUP BY ALL""")
def inverted_index(spark, d):
    return S.index(pages(spark, d))


@query(f"""WITH {PAGES}, {_HITS.replace('FROM pages_', "FROM pages_ WHERE list_contains(tags, 'Brand#2')")}, f AS (SELECT field, slug, count(*) AS hits FROM t WHERE starts_with(token, 're') GROUP BY ALL),
r AS (SELECT field, slug, row_number() OVER (PARTITION BY field ORDER BY hits DESC, slug) AS place FROM f)
SELECT slug, priority, CAST(place AS INTEGER) AS place FROM (SELECT slug, CASE WHEN field = 'title' THEN 0 ELSE 1 END AS priority, place, row_number() OVER (PARTITION BY slug ORDER BY CASE WHEN field = 'title' THEN 0 ELSE 1 END, place) AS k FROM r WHERE place <= 8) WHERE k = 1""")
def search_tag(spark, d):
    return S.search(S.index(pages(spark, d).where(F.array_contains("tags", "Brand#2"))), "re")


@query(r"""WITH w AS (SELECT doc_id, pos, w FROM (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS w FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS ws FROM documents)) WHERE w <> ''),
s AS (SELECT doc_id, pos, sum(CASE WHEN contains(lower(w), 'the') OR contains(lower(w), 'que') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS h FROM w)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(hits AS BIGINT) AS hits FROM (SELECT doc_id, pos AS start, h AS hits, row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, pos DESC) AS k FROM s) WHERE k = 1""")
def highlight_window(spark, d):
    return S.best_window(table(spark, d, "documents"), "doc_id", "text", ["the", "que"])


@query(f"WITH {PAGES} SELECT '<url><loc>https://site.example/' || slug || '</loc></url>' AS entry FROM pages_")
def sitemap(spark, d):
    return S.sitemap(pages(spark, d), "site.example")


@query(f"WITH {PAGES} SELECT '<item><title>' || title || '</title><link>https://site.example/' || slug || '</link></item>' AS item FROM pages_ ORDER BY modified DESC NULLS LAST, lower(title), slug LIMIT 10")
def feed(spark, d):
    return S.feed(pages(spark, d), "site.example")


@query(f"""WITH RECURSIVE {PAGES}, e AS (SELECT slug AS s, links[1] AS t FROM pages_ WHERE slug <> links[1]), r AS (SELECT s AS slug, t AS included, [s, t] AS path FROM e UNION ALL SELECT slug, t, list_append(path, t) FROM r JOIN e ON included = s WHERE NOT list_contains(path, t) AND len(path) < 4) SELECT DISTINCT slug, included FROM r""")
def transclusion(spark, d):
    return S.transclude(pages(spark, d).select("slug", F.slice("links", 1, 1).alias("embeds")), 3)


@query("""SELECT tag, coalesce(title, 'Tag: ' || tag) AS title FROM (SELECT DISTINCT p_brand AS tag FROM part) LEFT JOIN (SELECT n_name AS title, 'Brand#' || n_nationkey AS tag FROM nation WHERE n_nationkey % 2 = 0) USING (tag)""")
def described_tags(spark, d):
    tags = table(spark, d, "part").select(F.col("p_brand").alias("tag")).distinct()
    authored = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("tag"), F.col("n_name").alias("title"))
    return S.described(tags, authored, "tag", "Tag: ")


@query("""SELECT 'notes/s-' || s_suppkey AS slug, s_name AS title, 'type/' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ',even' ELSE '' END || ',in-text' AS tags, 'notes/s-' || (s_suppkey + 1) AS links FROM supplier WHERE s_suppkey % 7 <> 0""")
def site_build(spark, d):
    """Suppliers as pages with headers, built into a site; the index of contents as it was written."""
    top = f"{io.shared_folder(spark)}/{uuid.uuid4().hex}"
    write_suppliers(spark, d, f"{top}/source")
    site_build_plan.build(spark, f"{top}/source", f"{top}/site", f"{top}/work", ignore=("^private/",))
    entry = F.from_json(F.decode("content", "utf-8"), "slug string, title string, tags array<string>, links array<string>")
    index = io.read_binary(spark, f"{top}/site/static/index", "*.json").select(entry.alias("e"))
    return index.select("e.slug", "e.title", F.array_join("e.tags", ",").alias("tags"), F.array_join("e.links", ",").alias("links"))


def write_suppliers(spark, d, folder):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    head = F.concat(F.lit('---\ntitle: "'), "s_name", F.lit('"\ntags:\n  - type/'), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "\n  - even").otherwise(""), F.lit("\naliases: [old/"), key, F.lit("]\ndraft: "),
                    F.when(F.col("s_suppkey") % 7 == 0, "true").otherwise("false"), F.lit("\ndate: 2024-02-03\n---\nSee [[notes/s "), (F.col("s_suppkey") + 1).cast("string"), F.lit("]] and #in-text here.\n"))
    own = s.select(F.concat(F.lit("notes/s "), key, F.lit(".md")).alias("path"), head.alias("content"))
    private = s.select(F.concat(F.lit("private/s"), key, F.lit(".md")).alias("path"), F.lit("not: [to be read").alias("content"))
    io.write_files(own.unionByName(private), folder).count()


@query("""SELECT * FROM (SELECT 'aliases' AS emitter, count(*) AS n FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'feed', 1 UNION ALL SELECT 'index', count(*) FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT 'pages', count(*) FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'sitemap', 1)""")
def site_files(spark, d):
    """Files that each emitter has made."""
    top = f"{io.shared_folder(spark)}/{uuid.uuid4().hex}"
    write_suppliers(spark, d, f"{top}/source")
    return site_build_plan.build(spark, f"{top}/source", f"{top}/site", f"{top}/work", ignore=("^private/",)).groupBy("emitter").agg(F.count("*").alias("n"))
