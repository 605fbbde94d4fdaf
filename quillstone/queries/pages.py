"""Site operators over the pages made of parts, and their functions over small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import paths as P
from quillstone.functions import text as X
from quillstone.operators import pages as G
from quillstone.queries.registry import query, table
from quillstone.queries.scalars import of, over
from quillstone.queries.site import PAGES, pages

over("fn_internal_link", P.internal_link, of("'./index#' || a", "a || ' ' || b || '/note' || k || '.md'", "'../x/' || k || '.pdf'", "t || '/'", "a || '%20' || b || '#An ' || t || '!'"),
     of("'./#' || a", "'./' || a || '-' || b || '/note' || k", "'../x/' || k || '.pdf'", "'./' || t || '/'", "'./' || a || '-' || b || '#an-' || lower(t)"))
over("fn_from_root", lambda c: P.from_root(F.lit("a/b/c"), P.internal_link(c)), of("a || '/e' || k", "a || '/'", "a || '#' || b || ' H'"), of("'../../' || a || '/e' || k", "'../../' || a || '/'", "'../../' || a || '#' || b || '-h'"))
over("fn_resolve_url", lambda c: P.resolve_url(F.lit("a/b/c"), c), of("'./' || k", "'../' || a || '/'", "'../../../' || a || '#x'", "''", "'/' || a || '/' || b"), of("'a/b/' || k", "'a/' || a || '/'", "a", "'a/b/c'", "a || '/' || b"))
over("fn_join_segments", lambda c: P.join_segments(c, F.lit("b/")), of("a || '/'", "'/' || a", "''"), of("a || '/b/'", "'/' || a || '/b/'", "'b/'"))
over("fn_pdf_anchor", lambda c: F.concat_ws("|", P.split_anchor(c)["path"], P.split_anchor(c)["anchor"]), of("a || '.pdf#page=' || n", "a || '#page=' || n"), of("a || '.pdf|#page=' || n", "a || '|#page' || n"))
over("fn_block", lambda c: F.coalesce(X.block(c, F.lit("id")), F.lit("none")), of("a || chr(10) || chr(10) || b || chr(10) || 'lines ^id' || chr(10) || chr(10) || t", "'- ' || a || chr(10) || '- ' || b || ' ^id'", "a"), of("b || chr(10) || 'lines'", "'- ' || b", "'none'"))
over("fn_under_heading", lambda c: F.coalesce(X.under_heading(c, F.lit("b-1")), F.lit("none")),
     of("'# B' || chr(10) || a || chr(10) || '## B' || chr(10) || b || chr(10) || '### C' || chr(10) || k || chr(10) || '## D' || chr(10) || t", "'# B' || chr(10) || a"), of("'## B' || chr(10) || b || chr(10) || '### C' || chr(10) || k", "'none'"))
over("fn_natural_key", X.natural_key, of("upper(a) || ' ' || k", "b"), of("a || ' ' || lpad(CAST(k AS VARCHAR(20)), 20, '0')", "b"))
over("fn_clamped", lambda c: X.clamped(c.cast("double"), 1, 4), "CAST(n % 6 AS VARCHAR(2)) || '.' || CAST(k % 10 AS VARCHAR(2))", "CAST(CAST(least(greatest(floor(n % 6 + (k % 10) / 10.0 + 0.5), 1), 4) AS INTEGER) AS VARCHAR(9))")
over("fn_date_or_now", lambda c: X.date_or_now(F.lit("2030-01-01"), c, F.lit("2024-05-06")), of("'2020-02-' || lpad(CAST(1 + n % 28 AS VARCHAR(2)), 2, '0')", "''", "a", "'1970-01-01'"),
     of("'2020-02-' || lpad(CAST(1 + n % 28 AS VARCHAR(2)), 2, '0') || ' 00:00:00'", "'2024-05-06 00:00:00'", "'2030-01-01 00:00:00'", "'2030-01-01 00:00:00'"))
over("fn_key_union", lambda c: F.array_join(F.array_sort(F.array_union(F.json_object_keys(c), F.array(F.lit("b"), F.lit("z")))), ","), of("""'{"a' || k || '":1,"b":' || n || '}'""", "'{}'"), of("'a' || k || ',b,z'", "'b,z'"))


def _foldered(spark, d):
    """The pages in a folder for each type, some of them index pages, and some below tags."""
    p = pages(spark, d)
    n = F.split_part("slug", F.lit("/"), F.lit(2)).cast("long")
    top = F.when(n % 11 == 0, "tags/").otherwise("docs/")
    slug = F.concat(top, F.element_at("tags", 2), F.lit("/"), F.when(n < 10, "n").otherwise("note-"), n.cast("string"))
    index = F.concat(F.lit("docs/"), F.element_at("tags", 2), F.lit("/index"))
    return p.withColumn("slug", slug).unionByName(p.where("slug IN ('p/1', 'p/2')").withColumn("slug", index))


_FOLDERED = PAGES + """, foldered AS (SELECT CASE WHEN k % 11 = 0 THEN 'tags/' ELSE 'docs/' END || tags[2] || '/' || CASE WHEN k < 10 THEN 'n' ELSE 'note-' END || k AS slug, title FROM (SELECT *, CAST(split_part(slug, '/', 2) AS BIGINT) AS k FROM pages_)
 UNION ALL SELECT 'docs/' || tags[2] || '/index', title FROM pages_ WHERE slug IN ('p/1', 'p/2')),
own AS (SELECT regexp_replace(slug, '/index$', '') AS path, slug LIKE '%/index' AS folder, title FROM foldered),
nodes AS (SELECT path, bool_or(folder) AS folder, max(title) AS title FROM (SELECT * FROM own UNION ALL SELECT split_part(path, '/', 1), true, NULL FROM own UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), true, NULL FROM own WHERE len(string_split(path, '/')) > 2) GROUP BY path),
tree AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS parent, folder, coalesce(title, string_split(path, '/')[-1]) AS name FROM nodes)"""


@query(f"WITH {_FOLDERED} SELECT path, parent, folder, name FROM tree WHERE path <> 'tags' AND path NOT LIKE 'tags/%'")
def explorer_tree(spark, d):
    return G.explorer(_foldered(spark, d))


@query(f"""WITH {_FOLDERED}, step AS (SELECT slug, len(p) AS n, unnest(range(0, len(p) + 1)) AS o, p FROM (SELECT slug, string_split(regexp_replace(slug, '/index$', ''), '/') AS p FROM foldered))
SELECT slug, CAST(o AS INTEGER) AS ordinal, CASE WHEN o = 0 THEN 'Home' ELSE replace(t.name, '-', ' ') END AS name,
CASE WHEN o = n THEN '' ELSE rtrim(repeat('../', len(string_split(slug, '/')) - 1), '/') || CASE WHEN o = 0 THEN '' ELSE '/' || t.path || '/' END END AS path
FROM step LEFT JOIN tree t ON t.path = array_to_string(p[1:o], '/')""")
def breadcrumbs(spark, d):
    return G.breadcrumbs(_foldered(spark, d))


@query(f"WITH {PAGES} SELECT CAST(row_number() OVER (ORDER BY modified DESC NULLS LAST, lower(title), slug) - 1 AS INTEGER) AS place, slug, title, (SELECT greatest(count(*) - 3, 0) FROM pages_) AS remaining FROM pages_ ORDER BY modified DESC NULLS LAST, lower(title), slug LIMIT 3")
def recent_notes(spark, d):
    return G.recent(pages(spark, d))


@query(f"WITH {PAGES} SELECT slug, len(list_distinct(links)) AS links, len(tags) AS tags, title, content FROM pages_ WHERE content NOT LIKE 'red%'")
def content_index(spark, d):
    """The index read back from its JSON."""
    p = pages(spark, d).withColumn("content", F.when(~F.col("content").startswith("red"), F.col("content")).otherwise(" "))
    entry = F.from_json("entry", "slug string, title string, links array<string>, tags array<string>, content string")
    size = lambda c: F.size(c).cast("long")
    return G.content_index(p, include_empty=False).select("slug", entry.alias("e")).select("slug", size("e.links").alias("links"), size("e.tags").alias("tags"), "e.title", "e.content")


@query(f"WITH {PAGES}, e AS (SELECT DISTINCT target AS node FROM (SELECT target FROM links_ UNION ALL SELECT 'tags/' || unnest(tags) FROM pages_)) SELECT node, CASE WHEN node LIKE 'tags/%' THEN '#' || substr(node, 6) ELSE coalesce(title, node) END AS label FROM e LEFT JOIN pages_ ON slug = node")
def graph_labels(spark, d):
    p = pages(spark, d)
    every = p.select(F.explode(F.concat("links", F.transform("tags", lambda t: F.concat(F.lit("tags/"), t)))).alias("node")).distinct()
    return G.labels(every, p)


@query(f"""WITH {PAGES}, l AS (SELECT DISTINCT slug, link, split_part(link, '#', 1) AS base, CASE WHEN strpos(link, '#') > 0 THEN '#top' ELSE '' END AS anchor FROM (SELECT slug, unnest([split_part(links[1], '/', 2), 'p/' || split_part(links[2], '/', 2) || '#Top']) AS link FROM pages_)),
one AS (SELECT split_part(slug, '/', 2) AS base, min(slug) AS known FROM pages_ GROUP BY 1 HAVING count(*) = 1)
SELECT slug, link, '../' || coalesce(known, base) || anchor AS href, coalesce(known, base) AS target FROM l LEFT JOIN one USING (base)""")
def link_crawl(spark, d):
    """Links by name and from the root; those elsewhere and within a page are left out."""
    name = lambda k: F.split_part(F.col("links")[k], F.lit("/"), F.lit(2))
    links = F.array(name(0), F.concat(F.lit("p/"), name(1), F.lit("#Top")), F.lit("https://site.example/x"), F.lit("#here"))
    return G.crawl(pages(spark, d).withColumn("links", links))


@query(f"WITH {PAGES} SELECT slug, links[1] AS target, ref AS reference, CASE WHEN t.title IS NULL THEN NULL WHEN ref = '#b' THEN '## B' || chr(10) || t.title WHEN ref = '#^x' THEN 'para ' || t.title ELSE '# A' || chr(10) || 'para ' || t.title || ' ^x' || chr(10) || chr(10) || '## B' || chr(10) || t.title END AS body FROM (SELECT *, CASE CAST(split_part(slug, '/', 2) AS BIGINT) % 3 WHEN 0 THEN '' WHEN 1 THEN '#b' ELSE '#^x' END AS ref FROM pages_) s LEFT JOIN (SELECT slug AS target, title FROM pages_) t ON links[1] = t.target".replace("'# A' || chr(10) || 'para '", "'# A' || chr(10) || chr(10) || 'para '"))
def transclusion_parts(spark, d):
    p = pages(spark, d)
    text = F.concat(F.lit("# A\n\npara "), "title", F.lit(" ^x\n\n## B\n"), "title")
    k = F.split_part("slug", F.lit("/"), F.lit(2)).cast("long") % 3
    wanted = p.select("slug", F.col("links")[0].alias("target"), F.when(k == 0, "").when(k == 1, "#b").otherwise("#^x").alias("reference"))
    return G.embeds(wanted, p.withColumn("content", text))


@query(r"""WITH t AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents)),
u AS (SELECT doc_id, n, unnest(range(0, n)) AS pos, lower(unnest(ws)) AS w FROM t),
s AS (SELECT doc_id, n, pos, sum(CASE WHEN starts_with(w, 'th') OR starts_with(w, 'que') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS h FROM u),
k AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, pos DESC) AS r FROM s WHERE pos < n - 30) WHERE r = 1),
b AS (SELECT doc_id, ws, n, greatest(coalesce(pos, 0) - 30, 0) AS a FROM t LEFT JOIN k USING (doc_id))
SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || array_to_string(list_transform(ws[a + 1:greatest(least(a + 60, n - 1), 0)], lambda w: CASE WHEN contains(lower(w), 'que') THEN regexp_replace(w, 'que', '<span class="highlight">\0</span>', 'gi') ELSE regexp_replace(w, 'th', '<span class="highlight">\0</span>', 'gi') END), ' ') || CASE WHEN n > 0 THEN '...' ELSE '' END AS snippet FROM b""")
def search_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", X.highlight(F.col("text"), "th que", trim=True).alias("snippet"))


_FACET = "SELECT slug, 2 AS priority, CAST(row_number() OVER (ORDER BY hits DESC, slug) AS INTEGER) AS place FROM (SELECT slug, len(list_filter(tags, lambda t: starts_with(lower(t), 'brand#1'))) AS hits FROM pages_) WHERE hits > 0 ORDER BY hits DESC, slug LIMIT 8"


@query(f"WITH {PAGES} {_FACET}")
def search_tag_facet(spark, d):
    return G.find(pages(spark, d), "#Brand#1", per_tag=8)


@query(f"WITH {PAGES}, c AS (SELECT * FROM pages_ WHERE title LIKE 'red%') SELECT DISTINCT 'folder' AS kind, split_part(slug, '/', 1) AS name FROM c UNION SELECT DISTINCT 'tag', unnest(['type', tags[1], tags[2]]) FROM c")
def rebuild_scope(spark, d):
    changed = pages(spark, d).where(F.col("title").like("red%"))
    return G.affected_folders(changed).select(F.lit("folder").alias("kind"), F.col("folder").alias("name")).unionByName(G.affected_tags(changed).select(F.lit("tag").alias("kind"), F.col("tag").alias("name")))


@query("""SELECT p_type AS pattern, count(*) AS n, array_to_string(list_slice(list(p_name ORDER BY p_partkey), 1, 3), '|') AS examples, greatest(count(*) - 3, 0) AS more FROM part GROUP BY p_type""")
def failure_hotspots(spark, d):
    failed = table(spark, d, "part").select(F.col("p_type").alias("pattern"), "p_name", "p_partkey")
    return G.hotspots(failed, "pattern", "p_name", "p_partkey").withColumn("examples", F.array_join("examples", "|"))
