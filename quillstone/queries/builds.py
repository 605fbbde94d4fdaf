"""Builds that go on: changed files, streams of changes, stored indexes, embeds and files of any size, on pages made of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstone.operators import filters as FI
from quillstone.operators import pages as G
from quillstone.operators import rules as RU
from quillstone.operators import site as S
from quillstone.plans import site_build
from quillstone.queries.registry import query, table
from quillstone.queries.site import _HITS, PAGES, pages, write_suppliers
from quillstone.sources import front, ignore, io, json_array
from quillstone.streaming import folder_changes, keyed_state


def fresh_folder(spark) -> str:
    return f"{io.shared_folder(spark)}/{uuid.uuid4().hex}"


_SITE = """s AS (SELECT s_suppkey AS k, s_nationkey AS nation, s_suppkey % 2 = 0 AS even, s_suppkey % 10 = 0 AS gone, s_suppkey % 3 = 1 AS edited FROM supplier WHERE s_suppkey % 7 <> 0),
before AS (SELECT * FROM s), after AS (SELECT * FROM s WHERE NOT gone)"""


@query(f"""WITH {_SITE},
tags_before AS (SELECT DISTINCT unnest(['type/' || nation, 'type', 'in-text'] || CASE WHEN even THEN ['even'] ELSE [] END) AS t FROM before),
tags_after AS (SELECT DISTINCT unnest(['type/' || nation, 'type', 'in-text'] || CASE WHEN even THEN ['even'] ELSE [] END || CASE WHEN edited THEN ['new'] ELSE [] END) AS t FROM after)
SELECT * FROM (
SELECT 'pages' AS emitter, count(*) FILTER (edited AND NOT gone) AS written, count(*) FILTER (gone) AS removed, count(*) AS files_before, count(*) FILTER (NOT gone) AS files, TRUE AS same FROM before
UNION ALL SELECT 'aliases', 0, count(*) FILTER (gone), count(*), count(*) FILTER (NOT gone), TRUE FROM before
UNION ALL SELECT 'index', count(*) FILTER (edited AND NOT gone), count(*) FILTER (gone), count(*), count(*) FILTER (NOT gone), TRUE FROM before
UNION ALL SELECT 'assets', 1, 1, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0), (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0), TRUE)""")
def site_update(spark, d):
    """A build, then one after edits and deletions that writes and removes only what differs, against a whole build of the same source; the emitters whose files are as many as pages."""
    top = fresh_folder(spark)
    source = f"{top}/source"
    write_suppliers(spark, d, source)
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("assets/a-"), key, F.lit(".bin"))
    io.write_files(s.where("s_suppkey % 5 = 0").select(name.alias("path"), F.encode(F.repeat(key, 9), "utf-8").alias("content")), source).count()
    first = site_build.update(spark, source, f"{top}/site", f"{top}/work", ignore=("^private/",))
    counts = first.where("action = 'write'").groupBy("emitter").agg(F.count("*").alias("files_before"))
    # edits of a third of the notes, a tenth of them deleted, and an asset exchanged for another
    note = F.concat(F.lit("notes/s "), key, F.lit(".md"))
    held = io.read_files(spark, source, "*.md").select("path", F.decode("content", "utf-8").alias("text"))
    edited = s.where("s_suppkey % 3 = 1 AND s_suppkey % 10 <> 0").select(note.alias("path")).join(held, "path").select("path", F.concat("text", F.lit("More, with #new.\n")).alias("content"))
    edited.write.parquet(f"{top}/edited")
    io.write_files(spark.read.parquet(f"{top}/edited"), source).count()
    io.remove_files(s.where("s_suppkey % 10 = 0").select(note.alias("path")), source).count()
    io.remove_files(s.where("s_suppkey = 5").select(name.alias("path")), source).count()
    io.write_files(s.where("s_suppkey = 5").select(F.lit("assets/b.bin").alias("path"), F.lit("b").alias("content")), source).count()
    actions = site_build.update(spark, source, f"{top}/site", f"{top}/work", ignore=("^private/",))
    site_build.update(spark, source, f"{top}/whole", f"{top}/work2", ignore=("^private/",))
    files = lambda at: io.read_files(spark, at).select("path", F.sha2("content", 256).alias("digest"))
    site, whole = files(f"{top}/site"), files(f"{top}/whole")
    differ = site.exceptAll(whole).count() + whole.exceptAll(site).count()
    done = actions.groupBy("emitter").agg(F.count_if(F.col("action") == "write").alias("written"), F.count_if(F.col("action") == "remove").alias("removed"), F.count_if(F.col("action") != "remove").alias("files"))
    found = done.join(counts, "emitter").where(F.col("emitter").isin("pages", "aliases", "index", "assets"))
    return found.select("emitter", "written", "removed", "files_before", "files").withColumn("same", F.lit(differ == 0))


@query("""WITH t AS (SELECT p_partkey AS k, p_brand AS tag FROM part), c AS (SELECT tag, count(*) AS n FROM t GROUP BY tag), u AS (SELECT DISTINCT p_brand AS tag FROM part)
SELECT 'tags/' || tag || CASE WHEN part > 1 THEN '/' || part ELSE '' END || '.html' AS path, CAST(least(20, n - 20 * (part - 1)) AS BIGINT) AS items FROM (SELECT tag, n, unnest(range(1, CAST(ceil(n / 20.0) AS BIGINT) + 1)) AS part FROM c)
UNION ALL SELECT 'tags/index' || CASE WHEN part > 1 THEN '/' || part ELSE '' END || '.html', CAST(least(20, n - 20 * (part - 1)) AS BIGINT) FROM (SELECT n, unnest(range(1, CAST(ceil(n / 20.0) AS BIGINT) + 1)) AS part FROM (SELECT count(*) AS n FROM u))""")
def tag_list_files(spark, d):
    """Lists of the pages of each brand, in parts of twenty."""
    p = pages(spark, d).withColumn("tags", F.array(F.col("tags")[1])).withColumn("dates", F.struct(F.col("modified").cast("string").alias("modified")))
    made = site_build.tag_files(p, most=20)
    return made.select("path", F.regexp_count("content", F.lit("<li>")).cast("long").alias("items"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS title, CASE WHEN p_partkey % 9 <> 0 THEN DATE '2024-01-01' + CAST(p_size AS INTEGER) END AS modified, 'docs/' || p_brand || '/n-' || p_partkey AS slug, p_brand AS brand FROM part),
e AS (SELECT 'docs' AS folder, * FROM p UNION ALL SELECT 'docs/' || brand, * FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY modified DESC NULLS LAST, lower(title), slug) AS place FROM e)
SELECT folder || '/index' || CASE WHEN (place - 1) // 30 > 0 THEN '/' || ((place - 1) // 30 + 1) ELSE '' END || '.html' AS path, string_agg(slug, '|' ORDER BY place) AS links FROM r GROUP BY folder, (place - 1) // 30""")
def folder_list_files(spark, d):
    """Lists of the pages below each folder, newest first, in parts of thirty."""
    p = pages(spark, d)
    slug = F.concat(F.lit("docs/"), F.col("tags")[1], F.lit("/n-"), F.split_part("slug", F.lit("/"), F.lit(2)))
    made = site_build.folder_files(p.withColumn("slug", slug).withColumn("dates", F.struct(F.col("modified").cast("string").alias("modified"))), most=30)
    return made.select("path", F.array_join(F.regexp_extract_all("content", F.lit('<li><a href="/([^"]*)"'), F.lit(1)), "|").alias("links"))


@query("""WITH s AS (SELECT s_suppkey AS k, 'd' || s_nationkey || '/s' || s_suppkey || '.md' AS path FROM supplier)
SELECT path, 'add' AS kind, 1 AS version FROM s UNION ALL SELECT path, 'change', 2 FROM s WHERE k % 3 = 0 AND k % 5 <> 0 UNION ALL SELECT path, 'delete', 2 FROM s WHERE k % 5 = 0
UNION ALL SELECT path, 'add', 3 FROM s WHERE k % 10 = 0 UNION ALL SELECT 'new/' || k || '.md', 'add', 3 FROM s WHERE k % 4 = 0""")
def folder_replay(spark, d):
    """Three states of a folder, each met by a run of the same stream."""
    top = fresh_folder(spark)
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    path = F.concat(F.lit("d"), F.col("s_nationkey").cast("string"), F.lit("/s"), key, F.lit(".md")).alias("path")
    put = lambda rows, *columns: io.write_files(rows.select(*columns), f"{top}/in").count()

    def run() -> None:
        stream = folder_changes.changes(spark, f"{top}/in", f"{top}/listings", ".md")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start(f"{top}/events").awaitTermination()

    put(s, path, F.lit("one").alias("content"))
    put(s, F.concat(F.lit("other/"), key).alias("path"), F.lit("not listed").alias("content"))
    run()
    put(s.where("s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0"), path, F.lit("two, longer").alias("content"))
    io.remove_files(s.where("s_suppkey % 5 = 0").select(path), f"{top}/in").count()
    run()
    run()  # nothing has changed
    put(s.where("s_suppkey % 10 = 0"), path, F.lit("again").alias("content"))
    put(s.where("s_suppkey % 4 = 0"), F.concat(F.lit("new/"), key, F.lit(".md")).alias("path"), F.lit("n").alias("content"))
    run()
    return spark.read.schema(folder_changes.SCHEMA).parquet(f"{top}/events").select("path", "kind", F.col("version").cast("int").alias("version"))


@query("""SELECT CAST(user_id AS VARCHAR) AS key, tie, kind FROM (SELECT user_id, event_id AS tie, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def keyed_latest(spark, d):
    """The last event of every user, kept as state of a stream that is stopped and goes on."""
    top = fresh_folder(spark)
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    changes = e.select(F.col("user_id").cast("string").alias("key"), at.alias("at"), F.col("event_id").cast("long").alias("tie"), F.col("event_type").alias("kind"), F.lit("").alias("body"), F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("lot"))
    stream = lambda: spark.readStream.schema("key string, at long, tie long, kind string, body string").option("maxFilesPerTrigger", 2).parquet(f"{top}/in")
    for lot in (2, 0, 3, 1):  # events come in any order; the stream ends after each lot
        changes.where(F.col("lot") == lot).drop("lot").coalesce(1).write.mode("append").parquet(f"{top}/in")
        if lot in (0, 1):
            found = keyed_state.run_latest(stream(), f"{top}/progress")
    return found.select("key", "tie", "kind")


@query(f"""WITH {PAGES}, {_HITS}, f AS (SELECT field, slug, count(*) AS hits, count(DISTINCT w) AS terms FROM t JOIN (SELECT unnest(['blu', 'bol']) AS w) ON starts_with(token, w) GROUP BY ALL),
r AS (SELECT field, slug, row_number() OVER (PARTITION BY field ORDER BY hits DESC, slug) AS place FROM f WHERE terms = 2)
SELECT slug, priority, CAST(place AS INTEGER) AS place, TRUE AS pruned FROM (SELECT slug, CASE WHEN field = 'title' THEN 0 ELSE 1 END AS priority, place, row_number() OVER (PARTITION BY slug ORDER BY CASE WHEN field = 'title' THEN 0 ELSE 1 END, place) AS k FROM r WHERE place <= 8) WHERE k = 1""")
def search_stored(spark, d):
    """A search in a stored index; pruned says whether the scan is given the ranges of tokens."""
    stored = S.store_index(pages(spark, d), f"{fresh_folder(spark)}/index")
    found = S.search(stored, "blu bol")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = "GreaterThanOrEqual(token,blu)" in plan and "LessThan(token,blv)" in plan
    return found.withColumn("pruned", F.lit(pushed))


@query("""WITH RECURSIVE p AS (SELECT 'p/' || p_partkey AS slug, p_name || ' {' AS head, CASE WHEN p_partkey = 1 THEN 'p/5' WHEN p_partkey % 11 = 0 THEN 'p/none' ELSE 'p/' || (p_partkey // 2) END AS target FROM part),
r AS (SELECT slug AS root, target AS next, head AS text, [slug] AS seen, 1 AS depth FROM p
 UNION ALL SELECT root, p.target, r.text || p.head, list_append(seen, p.slug), depth + 1 FROM r JOIN p ON r.next = p.slug WHERE NOT list_contains(seen, r.next)),
l AS (SELECT root, next, text, seen, depth, row_number() OVER (PARTITION BY root ORDER BY depth DESC) AS k FROM r)
SELECT root AS slug, text || CASE WHEN list_contains(seen, next) THEN 'Circular transclusion detected: ' || next ELSE '![[' || next || ']]' END || repeat('}', depth) AS content FROM l WHERE k = 1""")
def embeds_expanded(spark, d):
    """Every part embeds that of half its number, down to a cycle or to a page that isn't there."""
    k = F.col("p_partkey")
    target = F.when(k == 1, "p/5").when(k % 11 == 0, "p/none").otherwise(F.concat(F.lit("p/"), F.expr("CAST(p_partkey div 2 AS string)")))
    p = table(spark, d, "part").select(F.concat(F.lit("p/"), k.cast("string")).alias("slug"), F.concat("p_name", F.lit(" {![["), target, F.lit("]]}")).alias("content"))
    return G.expand(p)


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name FROM part ORDER BY p_partkey) SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS number, k AS "key", name || ' "[{,' || chr(92) AS name FROM p""")
def json_array_elements(spark, d):
    """All parts as one array in one file, read in chunks of a few kilobytes."""
    top = fresh_folder(spark)
    p = table(spark, d, "part")
    row = F.to_json(F.struct(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(' "[{,\\')).alias("name"), F.array(F.struct(F.col("p_size").alias("s"))).alias("more")))
    ends = p.agg(F.min("p_partkey").alias("least"), F.max("p_partkey").alias("most"))  # one row
    at = p.select("p_partkey", row.alias("row")).join(F.broadcast(ends))
    line = F.concat(F.when(F.col("p_partkey") == F.col("least"), "[ ").otherwise(""), "row", F.when(F.col("p_partkey") == F.col("most"), " ]").otherwise(","), F.lit("\n"))
    few = F.floor(F.col("p_partkey") / 1000).alias("part")
    lines = at.select(few, F.struct("p_partkey", line.alias("line")).alias("x")).groupBy("part").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # a thousand keys
    made = lines.select(F.lit("array.json").alias("path"), "part", F.array_join(F.transform("xs", lambda x: x["line"]), "").alias("content"))
    io.write_files(made, f"{top}/array").collect()  # one file
    path = io.read_binary(spark, f"{top}/array", "*.json").select("path").first()[0]
    return json_array.read(spark, path, "key long, name string", chunk=1 << 13)


_RULES = """
# of a site
*.tmp
/private/
drafts/**
!keep.tmp
node_modules
docs/*.pdf
"""


@query("""WITH f AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, CASE p_partkey % 5 WHEN 0 THEN '.tmp' WHEN 1 THEN '.pdf' ELSE '.md' END AS ext,
 CASE p_partkey % 7 WHEN 0 THEN 'private/' WHEN 1 THEN 'x/private/' WHEN 2 THEN 'drafts/deep/' WHEN 3 THEN 'x/drafts/' WHEN 4 THEN 'a/node_modules/b/' WHEN 5 THEN 'docs/' ELSE '' END AS dir, p_partkey % 13 = 0 AS kept FROM part),
p AS (SELECT dir || CASE WHEN kept THEN 'keep.tmp' ELSE a || k || ext END AS path, dir, ext, kept FROM f)
SELECT path, count(*) AS n FROM p WHERE NOT (dir IN ('private/', 'drafts/deep/', 'a/node_modules/b/')) AND (kept OR (ext <> '.tmp' AND NOT (dir = 'docs/' AND ext = '.pdf'))) GROUP BY path""")
def ignored_paths(spark, d):
    """Paths made of parts that an ignore file leaves in."""
    k = F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    folder = pick(7, "private/", "x/private/", "drafts/deep/", "x/drafts/", "a/node_modules/b/", "docs/", "")
    name = F.when(k % 13 == 0, "keep.tmp").otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), k.cast("string"), pick(5, ".tmp", ".pdf", ".md", ".md", ".md")))
    paths = table(spark, d, "part").select(F.concat(folder, name).alias("path"))
    return paths.where(~ignore.ignored(F.col("path"), _RULES)).groupBy("path").agg(F.count("*").alias("n"))


_FENCED = """f AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents WHERE text IS NOT NULL AND strpos(text, '`') = 0 AND strpos(text, '~~~') = 0 AND strpos(text, '<!--') = 0),
g AS (SELECT doc_id, 'h' || (i + 1) AS title, i, CASE WHEN i % 3 = 1 THEN 2 ELSE 1 END AS level FROM (SELECT doc_id, unnest(range(0, len(ls))) AS i FROM f))"""


@query(f"""WITH {_FENCED}, k AS (SELECT * FROM g WHERE i % 4 <> 2), n AS (SELECT doc_id, title, level, count(*) OVER (PARTITION BY doc_id) AS n, level - min(level) OVER (PARTITION BY doc_id) AS depth, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal FROM k)
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(depth AS INTEGER) AS depth, title, title AS anchor FROM n WHERE n > 1""")
def headings_outside_code(spark, d):
    """A heading before each line of a document; every fourth is in a fence."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND instr(text, '`') = 0 AND instr(text, '~~~') = 0 AND instr(text, '<!--') = 0")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def headed(line, i):
        head = F.concat(F.when(i % 3 == 1, "## ").otherwise("# "), F.lit("h"), (i + 1).cast("string"))
        fence = F.element_at(F.array(F.lit("```"), F.lit("~~~~"), F.lit("`````")), (F.expr("1") + F.floor(i / 4) % 3).cast("int"))
        plain = F.translate(line, "#", "")
        return F.when(i % 4 == 2, F.concat(fence, F.lit("md\n"), head, F.lit("\n``\n"), plain, F.lit("\n"), fence)).otherwise(F.concat(head, F.lit("\n"), plain))

    text = F.array_join(F.transform(lines, headed), "\n")
    return S.headings(docs.select("doc_id", text.alias("text")), "doc_id", "text")


@query("""SELECT p_partkey, t, array_to_string(costs, '|') AS costs, effect FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'When ' || p_name || ' dies' END AS t,
 CASE WHEN p_partkey % 3 = 1 THEN ['{T}', 'Pay ' || p_size] ELSE [] END AS costs, CASE p_partkey % 3 WHEN 0 THEN 'draw.' WHEN 1 THEN 'Add ' || p_type || '.' ELSE p_name END AS effect FROM part)""")
def ability_costs(spark, d):
    """Triggers, lists of costs and effects of lines made of parts."""
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("When "), "p_name", F.lit(" dies, draw."))).when(k == 1, F.concat(F.lit("{T}, , Pay "), F.col("p_size").cast("string"), F.lit(" : Add "), "p_type", F.lit("."))).otherwise(F.col("p_name"))
    a = RU.ability(line)
    return table(spark, d, "part").select("p_partkey", a["trigger"].alias("t"), F.coalesce(F.array_join(a["costs"], "|"), F.lit("")).alias("costs"), a["effect"].alias("effect"))


@query(f"""WITH {PAGES}, f AS (SELECT CASE WHEN CAST(split_part(slug, '/', 2) AS BIGINT) % 4 = 0 THEN slug || '/' ELSE slug END AS slug, title, modified FROM pages_)
SELECT slug, CAST(row_number() OVER (ORDER BY slug NOT LIKE '%/', modified DESC NULLS LAST, lower(title), slug) AS INTEGER) AS place FROM f QUALIFY place <= 25""")
def folders_first(spark, d):
    """The first pages of a list that has folders before others."""
    p = pages(spark, d).withColumn("slug", F.when(F.split_part("slug", F.lit("/"), F.lit(2)).cast("long") % 4 == 0, F.concat("slug", F.lit("/"))).otherwise(F.col("slug")))
    first = S.listed(p, folders_first=True).limit(25).agg(F.collect_list("slug").alias("s"))  # twenty-five rows, in order
    return first.select(F.posexplode("s").alias("place", "slug")).select("slug", (F.col("place") + 1).alias("place"))


@query("SELECT p_partkey, p_name AS text FROM part")
def data_urls(spark, d):
    """What data: URLs hold."""
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("p_name", "utf-8")))
    return table(spark, d, "part").select("p_partkey", F.decode(io.strip_data_prefix(url), "utf-8").alias("text"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '2020-01-' || lpad(CAST(1 + s_nationkey AS VARCHAR), 2, '0') ELSE '2022-01-01' END AS created,
CASE WHEN s_suppkey % 3 = 0 THEN '2021-05-05' WHEN s_suppkey % 2 = 0 THEN '2020-01-' || lpad(CAST(1 + s_nationkey AS VARCHAR), 2, '0') WHEN s_suppkey % 5 = 0 THEN '2023-03-03' ELSE '2022-02-02' END AS modified FROM supplier""")
def dates_by_precedence(spark, d):
    """Dates of a page by its header, then history, then files."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    date = F.when(k % 2 == 0, F.array(F.concat(F.lit("2020-01-"), F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0"))))
    fields = F.map_filter(F.create_map(F.lit("date"), date, F.lit("modified"), F.when(k % 3 == 0, F.array(F.lit("2021-05-05")))), lambda name, v: v.isNotNull())
    found = front.dates(fields, F.when(k % 5 == 0, "2023-03-03"), F.lit("2022-01-01"), F.lit("2022-02-02"))
    return s.select("s_suppkey", found["created"].alias("created"), found["modified"].alias("modified"))


@query("SELECT path FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN '.git/' || p_name WHEN 1 THEN 'a/.git/' || p_partkey WHEN 2 THEN 'a.git/' || p_partkey ELSE p_type || '/' || p_partkey END AS path FROM part) WHERE path NOT LIKE '.git/%' AND path NOT LIKE '%/.git/%'")
def watched_paths(spark, d):
    """Paths of change events that aren't of the history's own folder."""
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit(".git/"), "p_name")).when(k % 4 == 1, F.concat(F.lit("a/.git/"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("a.git/"), k.cast("string"))).otherwise(F.concat("p_type", F.lit("/"), k.cast("string")))
    return table(spark, d, "part").select(path.alias("path")).where(FI.not_ignored(F.col("path")))


@query("SELECT s_suppkey AS k, s_name AS name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def source_json_array(spark, d):
    """Arrays of JSON over several lines, a file a nation."""
    top = fresh_folder(spark)
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.groupBy("n_nationkey").agg(F.collect_list(F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.struct(F.col("n_name").alias("name")).alias("nation"))).alias("rows"))
    io.write_files(rows.select(F.concat("n_nationkey", F.lit(".json")).alias("path"), F.to_json("rows", {"pretty": "true"}).alias("content")), f"{top}/json").count()
    return io.read_json(spark, f"{top}/json", "k long, name string, nation struct<name: string>").select("k", "name", F.col("nation.name").alias("nation"))


@query("SELECT n_regionkey AS region, len(list(n_name)) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def source_json_document(spark, d):
    """One JSON document a region, read by its schema."""
    top = fresh_folder(spark)
    doc = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    io.write_files(doc.select(F.concat("n_regionkey", F.lit(".json")).alias("path"), F.to_json(F.struct(F.col("n_regionkey").alias("region"), "names"), {"pretty": "true"}).alias("content")), f"{top}/json").count()
    return io.read_json(spark, f"{top}/json", "region long, names array<string>").select("region", F.size("names").cast("long").alias("n"), F.col("names")[0].alias("first"))
