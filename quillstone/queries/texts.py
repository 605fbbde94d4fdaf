"""Text and path functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import paths as P
from quillstone.functions import text as X
from quillstone.operators import rules as RU
from quillstone.queries.registry import query, table

_LINES = "(SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents)"


@query("SELECT doc_id, translate(text, '‘’“”–—•', '''''\"\"--*') AS t FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("t"))


@query(r"SELECT item_id, trim(regexp_replace(text || ' (x) tail (y z)', '\s*\([^)]*\)', '', 'g')) AS t FROM benchmark")
def strip_parentheticals(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.strip_parentheticals(F.concat("text", F.lit(" (x) tail (y z)"))).alias("t"))


@query(r"SELECT p_partkey, regexp_full_match(p_type, '[\p{L}\p{N}_]+(\s+(\d+|\{[^}]+\}))?(\s*,\s*[\p{L}\p{N}_]+(\s+(\d+|\{[^}]+\}))?)*') AS whole, regexp_full_match(p_name, '[\p{L}\p{N}_]+(\s+(\d+|\{[^}]+\}))?(\s*,\s*[\p{L}\p{N}_]+(\s+(\d+|\{[^}]+\}))?)*') AS pair FROM part")
def keyword_line(spark, d):
    return table(spark, d, "part").select("p_partkey", X.is_keyword_line(F.col("p_type")).alias("whole"), X.is_keyword_line(F.col("p_name")).alias("pair"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS t FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 100).alias("t"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS t FROM pages")
def escape_html(spark, d):
    return table(spark, d, "pages").select("page_id", X.escape_html(F.col("html")).alias("t"))


@query("SELECT page_id, html AS t FROM pages")
def unescape_html(spark, d):
    return table(spark, d, "pages").select("page_id", X.unescape_html(X.escape_html(F.col("html"))).alias("t"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(u, '\s', '-', 'g'), '&', '-and-'), '%', '-percent'), '?', ''), '#', ''), '/$', ''), '^$', '') AS slug
FROM (SELECT page_id, replace(replace(url, 'https://', ''), 'http://', '') || ' a&b' AS u FROM pages)""")
def slugify(spark, d):
    u = F.concat(F.replace(F.replace("url", F.lit("https://")), F.lit("http://")), F.lit(" a&b"))
    return table(spark, d, "pages").select("page_id", P.slugify(u).alias("slug"))


@query("""WITH s AS (SELECT page_id, list_filter(string_split(split_part(url, '//', 2), '/'), lambda x: x <> '') AS p FROM pages)
SELECT page_id, CAST(n AS INTEGER) AS n, array_to_string(p[1:n], '/') AS prefix FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS n FROM s)""")
def segment_prefixes(spark, d):
    parts = F.filter(F.split(F.split_part("url", F.lit("//"), F.lit(2)), "/"), lambda x: x != "")
    rows = table(spark, d, "pages").select("page_id", F.posexplode(X.prefixes(parts, "/")).alias("n", "prefix"))
    return rows.withColumn("n", F.col("n") + 1)


@query(r"SELECT conv_id, turn, len(t) AS n, array_to_string(t, '|') AS tokens FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[^\s]+') AS t FROM conversations)")
def search_tokens(spark, d):
    t = X.search_tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("tokens"))


@query("""SELECT doc_id, CASE WHEN pos > 0 THEN trim(substr(text, 1, pos - 1)) ELSE text END AS lhs, CASE WHEN pos > 0 THEN substr(text, pos) ELSE '' END AS rhs FROM (SELECT doc_id, text, strpos(text, chr(10)) AS pos FROM documents)""")
def section_split(spark, d):
    s = X.section(F.col("text"), "\n")
    return table(spark, d, "documents").select("doc_id", s["left"].alias("lhs"), s["right"].alias("rhs"))


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS ordinal, CASE
 WHEN regexp_full_match(x, '[\\p{L}\\p{N}_]+(\\s+(\\d+|\\{[^}]+\\}))?(\\s*,\\s*[\\p{L}\\p{N}_]+(\\s+(\\d+|\\{[^}]+\\}))?)*') THEN 'keyword'
 WHEN strpos(x, ' - ') > 1 AND strpos(x, ' - ') + 3 <= length(x) THEN 'named' WHEN starts_with(x, 'When ') OR starts_with(x, 'Whenever ') OR starts_with(x, 'At ') THEN 'triggered'
 WHEN strpos(x, ':') > 0 AND (strpos(x, '(') = 0 OR strpos(x, ':') < strpos(x, '(')) THEN 'activated' ELSE 'passive' END AS kind, x AS line
FROM (SELECT doc_id, line, trim(regexp_replace(translate(t, '‘’“”–—•', '''''""--*'), '\\s*\\([^)]*\\)', '', 'g')) AS x FROM """.replace("\\\\", "\\") + _LINES + ") WHERE x <> ''")
def refine_lines(spark, d):
    return RU.refine(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH x AS (SELECT doc_id, line, trim(regexp_replace(translate(t, '‘’“”–—•', '''''""--*'), '\\s*\\([^)]*\\)', '', 'g')) AS x FROM """.replace("\\\\", "\\") + _LINES + """),
k AS (SELECT doc_id, line, x, CASE WHEN regexp_full_match(x, '[\\p{L}\\p{N}_]+(\\s+(\\d+|\\{[^}]+\\}))?(\\s*,\\s*[\\p{L}\\p{N}_]+(\\s+(\\d+|\\{[^}]+\\}))?)*') THEN 'keyword'
 WHEN strpos(x, ' - ') > 1 AND strpos(x, ' - ') + 3 <= length(x) THEN 'named' WHEN starts_with(x, 'When ') OR starts_with(x, 'Whenever ') OR starts_with(x, 'At ') THEN 'triggered'
 WHEN strpos(x, ':') > 0 AND (strpos(x, '(') = 0 OR strpos(x, ':') < strpos(x, '(')) THEN 'activated' ELSE 'passive' END AS kind FROM x WHERE x <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['keyword', 'named', 'triggered', 'activated', 'passive'], kind), line) - 1 AS o FROM k)
SELECT doc_id, CAST(o AS INTEGER) AS ordinal, kind AS text_type, x AS text, md5(CAST(doc_id AS VARCHAR) || '|' || kind || '|' || CAST(o AS VARCHAR)) AS text_entry_id FROM o""".replace("\\\\", "\\"))
def flatten_entries(spark, d):
    return RU.flatten(RU.refined_arrays(RU.refine(table(spark, d, "documents"), "doc_id", "text"), "doc_id"), "doc_id")


@query("""WITH l AS (SELECT doc_id, line, trim(t) AS t FROM """ + _LINES + """ WHERE trim(t) <> '')
SELECT doc_id, "at", count(*) AS n, string_agg(t, ' ' ORDER BY line) AS body FROM (SELECT doc_id, line, t, max(CASE WHEN length(t) % 3 = 0 THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS "at" FROM l) WHERE "at" IS NOT NULL GROUP BY doc_id, "at" """)
def line_continuation(spark, d):
    """The state scan behind rule hierarchies: lines hang on the last line that opens a rule."""
    from pyspark.sql import Window

    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("t", F.trim("t")).where("t <> ''")
    at = F.max(F.when(F.length("t") % 3 == 0, F.col("line"))).over(Window.partitionBy("doc_id").orderBy("line"))
    return lines.withColumn("at", at.cast("long")).where("at IS NOT NULL").groupBy("doc_id", "at").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), " ").alias("body"))


RULES = """Intro text
Contents
1. Game Concepts
100. General
Credits
1. Game Concepts
100. General
100.1. These rules apply to any game.
100.1a A two-player game has two players.
Example: one and two.
100.2 To play, each player needs a deck.
101. Golden Rules
101.1 Whenever a text contradicts the rules, it wins.
2. Parts
200. Names
200.1 A name is a name.

Glossary

Abandon
To turn a scheme face down.

Ability
1. Text on an object.
2. An activated ability.

Ability
The last one counts.

Credits
Some people"""


@query("""WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS n, s_name AS name FROM supplier)
SELECT k, '1. Concepts of ' || name AS section, '100. General' AS subsection, '100.1' AS rule, '' AS suffix, 'These rules apply to ' || name || '. Example: one.' AS body FROM s
UNION ALL SELECT k, '1. Concepts of ' || name, '100. General', '100.1a', 'a', 'Rule ' || n || ' has two.' FROM s
UNION ALL SELECT k, '1. Concepts of ' || name, '101. Golden Rules', '101.' || n || 'bc', 'bc', 'It wins.' FROM s UNION ALL SELECT k, '2. Parts', '200. Names', '200.1', '', 'A name is ' || name || '.' FROM s""")
def rules_hierarchy(spark, d):
    """A rules document a supplier."""
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("before any rule\n1. Concepts of "), "s_name", F.lit("\n\n100. General\n100.1. These rules apply to "), "s_name", F.lit(".\n  Example: one.\n100.1a Rule "), key,
                    F.lit(" has two.\n101. Golden Rules\nno rule yet\n101."), key, F.lit("bc It wins.\n2. Parts\n200. Names\n200.1. A name is "), "s_name", F.lit("."))
    return RU.hierarchy(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("text")), "k")


@query("""SELECT s_suppkey AS k, s_name AS term, 'Is number ' || s_suppkey || '. And goes on.' AS definition FROM supplier UNION ALL SELECT s_suppkey, 'Ability', 'The last, of ' || s_nationkey || '.' FROM supplier""")
def rules_glossary(spark, d):
    """A glossary a supplier, with a term given twice and one without a definition."""
    text = F.concat(F.lit("\nGlossary\n\n"), "s_name", F.lit("\nIs number "), F.col("s_suppkey").cast("string"), F.lit(".\nAnd goes on.\n\nAlone\n\nAbility\nThe first.\n\nAbility\nThe last, of "), F.col("s_nationkey").cast("string"), F.lit(".\n"))
    return RU.glossary(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("text")), "k")


@query(r"SELECT doc_id, CAST(ceil(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 200.0) AS BIGINT) AS minutes FROM documents")
def reading_time(spark, d):
    return table(spark, d, "documents").select("doc_id", X.reading_minutes(F.col("text")).cast("long").alias("minutes"))


@query(r"SELECT p_partkey, slug, up, array_to_string(folders, ',') AS folders FROM (SELECT p_partkey, slug, CASE WHEN n > 0 THEN rtrim(repeat('../', n), '/') ELSE '.' END AS up, list_transform(range(1, n + 1), lambda k: array_to_string(p[1:k], '/')) AS folders FROM (SELECT p_partkey, slug, string_split(slug, '/') AS p, len(string_split(slug, '/')) - 1 AS n FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_type || '/' || replace(p_name, ' ', '-') ELSE 'a/' || p_type || '/' || replace(p_name, ' ', '-') END AS slug FROM part)))")
def path_functions(spark, d):
    p = table(spark, d, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    slug = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, P.join_segments(F.col("p_type"), name)).otherwise(P.join_segments(F.lit("a"), F.col("p_type"), name))
    return p.select("p_partkey", slug.alias("slug")).withColumns({"up": P.path_to_root(F.col("slug")), "folders": F.array_join(P.parents(F.col("slug")), ",")})


@query(r"SELECT conv_id, turn, md5(string_agg(w, ' ' ORDER BY i)) AS h FROM (SELECT conv_id, turn, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM conversations)) GROUP BY conv_id, turn")
def group_to_list(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("i", "w"))
    return rows.groupBy("conv_id", "turn").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ")).alias("h"))
