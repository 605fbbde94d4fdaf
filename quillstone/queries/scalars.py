"""Scalar functions over texts made of the parts, and the remaining site and source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import paths as P
from quillstone.functions import text as X
from quillstone.operators import charts, site, tokens
from quillstone.queries.registry import query, table
from quillstone.sources import io


def over(name: str, function, made: str, result: str) -> None:
    """A query of function over texts made of every part; its SQL states the results. made and result are SQL that both engines read.

    In them k is the part's number, a and b are the words of its name, t its type and n its size.
    """
    parts = "SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_type AS t, p_size AS n, p_retailprice AS price FROM part"

    @query(f"SELECT k, input, {result} AS result FROM (SELECT *, {made} AS input FROM ({parts}))", name=name)
    def run(spark, d):
        p = table(spark, d, "part")
        held = p.select(F.col("p_partkey").alias("k"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("n"), F.col("p_retailprice").alias("price"))
        return held.withColumn("input", F.expr(made.replace("chr(10)", "char(10)"))).select("k", "input", function(F.col("input")).cast("string").alias("result"))


def of(*values: str) -> str:
    """The value of a part's turn."""
    return "CASE " + " ".join(f"WHEN k % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


over("fn_line_kind", X.line_kind, of("a || ', ' || b", "'Ward ' || n", "a || ' ' || b || ' - ' || t", "'When ' || a || ' dies, draw.'", "a || ' ' || b || ': Add {G}.'", "a || ' (the one: here) stays.'"),
     of("'keyword'", "'keyword'", "'named'", "'triggered'", "'activated'", "'passive'"))
over("fn_rule_suffix", X.rule_suffix, of("'100.' || n || 'a'", "'100.' || n", "'702.' || n || 'bc ' || a"), of("'a'", "''", "'bc'"))
over("fn_file_slug", P.file_slug, of("t || '/_index.md'", "a || ' ' || b || '/c&' || k || '.md'", "'img/' || a || '.png'", "'/' || a || '/' || k || '.html'"),
     of("t || '/index'", "a || '-' || b || '/c-and-' || k", "'img/' || a || '.png'", "a || '/' || k"))
over("fn_simplify_slug", P.simplify, of("t || '/index'", "'index'", "t || '/' || k"), of("t || '/'", "'/'", "t || '/' || k"))
over("fn_path_to_root", P.path_to_root, "repeat(a || '/', CAST(n % 4 AS INTEGER)) || k", "CASE WHEN n % 4 = 0 THEN '.' ELSE substr(repeat('/..', CAST(n % 4 AS INTEGER)), 2) END")
over("fn_extension", lambda c: F.coalesce(P.extension(c), F.lit("none")), of("k || '.md'", "a || '/' || k"), of("'.md'", "'none'"))
over("fn_is_folder", P.is_folder, of("t || '/'", "t || '/index'", "t || '/' || k"), of("'true'", "'true'", "'false'"))
over("fn_full_slug", P.is_full_slug, of("t || '/' || k", "'./' || k", "a || ' ' || b"), of("'true'", "'false'", "'false'"))
over("fn_split_anchor", lambda c: F.concat(P.split_anchor(c)["path"], F.lit("|"), P.split_anchor(c)["anchor"]), of("k || '#' || upper(a) || ' ' || b || '!'", "t"), of("k || '|#' || a || '-' || b", "t || '|'"))
over("fn_wikilinks", lambda c: F.array_join(X.wikilinks(c), ","), "'see [[' || a || '/' || k || '#c|' || b || ']] and ![[' || t || ']], not `[[' || b || ']]`'", "a || '/' || k || ',' || t")
over("fn_hashtags", lambda c: F.array_join(X.hashtags(c), ","), "'#' || a || ' x #two/' || b || ' #' || n || ' #' || a", "a || ',two/' || b")
over("fn_markup", X.markup, "a || ' ==' || b || '== %%' || k || '%% --> `==' || t || '==`'", "a || ' <mark>' || b || '</mark>  &rarr; `==' || t || '==`'")
over("fn_roam", X.roam, "'{{TODO}} __' || a || '__ ^^' || b || '^^'", "'[ ] _' || a || '_ ==' || b || '=='")
over("fn_hugo", X.hugo, """'[' || a || ']({{< relref "' || k || '" >}})'""", "'[' || a || '](' || k || ')'")
over("fn_description", X.description, "a || repeat('. Then ' || t, CAST(n AS INTEGER)) || '.'",
     "a || '.' || repeat(' Then ' || t || '.', CAST(least(n, ceil((150.0 - (6 + length(t)) - (length(a) + 1)) / (7 + length(t)))) AS INTEGER))")
over("fn_coerce_list", lambda c: F.array_join(X.coerce_list(c), "|"), "a || ', ' || b || ',,' || t || ' '", "a || '|' || b || '|' || t")
over("fn_query_prefixes", lambda c: F.array_join(X.prefixes(F.split(c, " "), " "), "|"), "a || ' ' || b || ' ' || k", "a || '|' || a || ' ' || b || '|' || a || ' ' || b || ' ' || k")
over("fn_identity", lambda c: X.identity_string(F.split(c, "")), "upper(a || b)",
     "CASE WHEN length(translate(input, 'ACDEFHIJKLMNOPQSTVXYZ', '')) = 0 THEN 'Colorless' ELSE " + " || ".join(f"CASE WHEN instr(input, '{x}') > 0 THEN '{x}' ELSE '' END" for x in "WUBRG") + " END")
over("fn_tokens_cjk", lambda c: F.array_join(X.search_tokens(c), "|"), "upper(a) || ' 漢字 ' || b || '漢' || k", "a || '|漢|字|' || b || '|漢|' || k")
over("fn_hover_price", lambda c: F.format_string("%s - $%.2f", c, F.col("price")), "a || ' ' || b", "input || ' - $' || printf('%.2f', price)")
over("fn_date_short", lambda c: F.date_format(F.coalesce(F.try_to_timestamp(c), F.lit("1970-01-01").cast("timestamp")), "MMM dd, yyyy"), of("'2024-02-' || lpad(CAST(1 + n % 28 AS VARCHAR(2)), 2, '0')", "a"), of("'Feb ' || lpad(CAST(1 + n % 28 AS VARCHAR(2)), 2, '0') || ', 2024'", "'Jan 01, 1970'"))
over("fn_split_two", lambda c: F.concat_ws("|", X.split_two(c, ": ")["head"], X.split_two(c, ": ")["tail"]), of("a || ': Add ' || b || ': ' || t", "a"), of("a || '|Add ' || b || ': ' || t", "a || '|'"))


@query("SELECT DISTINCT unnest(['Old-' || s_suppkey, 'other', 'same' || s_nationkey]) AS alias, 's/' || s_suppkey AS slug FROM supplier")
def alias_redirects(spark, d):
    key = F.col("s_suppkey").cast("string")
    nation = F.concat(F.lit("same"), F.col("s_nationkey").cast("string"))
    return site.aliases(table(spark, d, "supplier").select(F.concat(F.lit("s/"), key).alias("slug"), F.array(F.concat(F.lit("Old "), key), F.lit("other"), nation, nation).alias("aliases")))


@query("SELECT p_partkey, p_name AS title, 'x, ' || p_type AS tags, p_brand || chr(10) || 'more' AS body FROM part")
def front_matter(spark, d):
    f = io.front_matter(F.col("text"))
    p = table(spark, d, "part").withColumn("text", F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\ntags: x, "), "p_type", F.lit("\n---\n"), "p_brand", F.lit("\nmore")))
    return p.select("p_partkey", f["fields"]["title"].alias("title"), f["fields"]["tags"].alias("tags"), f["body"].alias("body"))


@query("""WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey, 1 AS ordinal, 0 AS depth, a AS title, a AS anchor FROM p UNION ALL SELECT p_partkey, 2, 1, b || '!', b FROM p UNION ALL SELECT p_partkey, 3, 0, a, a || '-1' FROM p""")
def table_of_contents(spark, d):
    """Contents of a page a part, with a heading in a fence and one too deep."""
    a, b = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    text = F.concat(F.lit("## "), a, F.lit("\ntext\n### "), b, F.lit("!\n~~~\n# "), b, F.lit("\n~~~\n## "), a, F.lit("\n#no\n#### deep"))
    return site.headings(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")


@query("SELECT item_id, true AS fits FROM benchmark")
def token_limit(spark, d):
    """Texts within the token limit, with masks of ones."""
    import public_tokenizers

    found = tokens.tokenize(table(spark, d, "benchmark"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("item_id", ((F.size("input_ids") == F.size("attention_mask")) & F.forall("attention_mask", lambda x: x == 1)).alias("fits"))


@query("SELECT p_partkey, p_name, p_retailprice AS price, CAST(greatest(trunc(p_retailprice * 0.1), 5) AS INTEGER) AS size, n_name IS NOT NULL AS known FROM part JOIN nation ON p_partkey % 40 = n_nationkey")
def enhanced_points(spark, d):
    """Points joined with their card, those without one left out, and sized by price."""
    p, n = table(spark, d, "part").withColumn("k", F.col("p_partkey") % 40), table(spark, d, "nation").withColumnRenamed("n_nationkey", "k")
    joined = p.join(n, "k")
    return joined.select("p_partkey", "p_name", F.col("p_retailprice").alias("price"), charts.marker_size(F.col("p_retailprice"), 0.1, 5).alias("size"), F.col("n_name").isNotNull().alias("known"))
