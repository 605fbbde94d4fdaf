"""Relational dataflow: filters, splits, joins, groupings, rankings, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import cards as C
from quillstone.operators import filters as FI
from quillstone.operators import relational as R
from quillstone.queries.registry import query, table


def cards(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Card-like rows made of parts, with the given columns or all; a third of them is banned, and a third is restricted, not legal, without status or legal."""
    p = table(spark, sf_dir, "part")
    bit = lambda i: F.expr(f"(p_size div {1 << i}) % 2 = 1")
    dash = F.element_at(F.array(F.lit("—"), F.lit("–"), F.lit("-")), (F.col("p_partkey") % 3 + 1).cast("int"))
    raw = p.select(
        F.lit("{1}{W}").alias("mana_cost"), F.concat_ws("\n", "p_name", F.lit("Flying")).alias("oracle_text"), F.when(F.col("p_partkey") % 2 == 0, F.lit("2")).alias("power"),
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", F.split("p_name", " ")[1], F.col("p_type"), F.when(F.col("p_partkey") % 5 != 0, F.concat(dash, F.lit(" "), F.split("p_name", " ")[0], F.lit("  Top-Class")))).alias("type_line"),
        F.array_compact(F.array(*[F.when(bit(i), c) for i, c in enumerate(C.COLORS)])).alias("colors"),
        F.array_compact(F.array(*[F.when(bit(i), c) for i, c in enumerate(C.COLORS)])).alias("color_identity"),
        (F.col("p_size") % 10).cast("double").alias("cmc"), F.element_at(F.array(*[F.lit(r) for r in [*C.RARITIES[:5], "odd"]]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("rarity"),
        F.col("p_brand").alias("set"), F.concat(F.lit("20"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"), F.lit("-01-15")).alias("released_at"),
        (F.col("p_partkey") % 7 == 0).alias("digital"), (F.col("p_partkey") % 11 == 0).alias("promo"),
        F.when(F.expr("p_partkey % 3 < 2 OR p_partkey div 3 % 4 < 3"), F.create_map(F.lit("commander"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'banned' WHEN 1 THEN 'legal' ELSE element_at(array('restricted', 'not_legal', null), cast(p_partkey div 3 % 4 + 1 AS int)) END"))).alias("legalities"),
        F.create_map(F.lit("usd"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice").cast("string")), F.lit("usd_foil"), F.when(F.col("p_partkey") % 8 != 0, F.lit("12.50")), F.lit("usd_etched"), F.lit("bad")).alias("prices"),
    )
    return C.parse(raw, list(columns) or None)


FLAGS = ("digital", "promo", "legal", "released_at")

CARDS = """cards AS (
  SELECT CAST(p_partkey AS VARCHAR) AS card_id, p_name AS name,
    split_part(p_name, ' ', 2) || ' ' || p_type || CASE WHEN p_partkey % 5 <> 0 THEN ' ' || ['—', '–', '-'][p_partkey % 3 + 1] || ' ' || split_part(p_name, ' ', 1) || '  Top-Class' ELSE '' END AS type_line,
    [split_part(p_name, ' ', 2), p_type] AS types, CASE WHEN p_partkey % 5 <> 0 THEN [split_part(p_name, ' ', 1), 'Top-Class'] ELSE [] END AS subtypes,
    p_name || chr(10) || 'Flying' AS oracle_text, CASE WHEN p_partkey % 2 = 0 THEN '2' END AS power,
    CASE WHEN p_size % 32 > 0 THEN list_filter([CASE WHEN p_size % 2 = 1 THEN 'W' END, CASE WHEN (p_size // 2) % 2 = 1 THEN 'U' END, CASE WHEN (p_size // 4) % 2 = 1 THEN 'B' END,
      CASE WHEN (p_size // 8) % 2 = 1 THEN 'R' END, CASE WHEN (p_size // 16) % 2 = 1 THEN 'G' END], lambda x: x IS NOT NULL) END AS colors,
    CAST(p_size % 10 AS DOUBLE) AS cmc, ['common', 'uncommon', 'rare', 'mythic', 'special', 'common'][p_partkey % 6 + 1] AS rarity, p_brand AS "set",
    CAST('20' || lpad(CAST(p_size % 30 AS VARCHAR), 2, '0') || '-01-15' AS DATE) AS released_at, p_partkey % 7 = 0 AS digital, p_partkey % 11 = 0 AS promo,
    p_partkey % 3 = 1 OR p_partkey % 3 = 2 AND p_partkey // 3 % 4 = 0 AS legal,
    CAST(CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice WHEN p_partkey % 8 <> 0 THEN 12.5 ELSE 0 END AS DECIMAL(18,4)) AS price
  FROM part)"""


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, so that any engine compares them alike."""
    return df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


@query(f"WITH {CARDS} SELECT card_id, name, type_line, array_to_string(types, ',') AS types, array_to_string(subtypes, ',') AS subtypes, array_to_string(colors, ',') AS colors, array_to_string(colors, ',') AS color_identity, cmc, rarity, \"set\" FROM cards")
def parse_cards_core(spark, d):
    return _flat(cards(spark, d, *C.CORE).drop("mana_cost", "oracle_text", "power", "toughness", "loyalty"))


@query(f"""WITH {CARDS} SELECT name, '{{1}}{{W}}' AS mana_cost, array_to_string(types, ' ') || CASE WHEN len(subtypes) > 0 THEN ' — ' || array_to_string(subtypes, ' ') ELSE '' END AS type_line,
oracle_text, power, CAST(NULL AS VARCHAR) AS toughness, CAST(NULL AS VARCHAR) AS loyalty FROM cards""")
def card_inputs(spark, d):
    """What the parser is given, made of parsed cards."""
    return C.parser_input(cards(spark, d, *C.CORE))


def _parts_of_suppliers(spark, d):
    """Raw cards with related cards and faces as lists of maps."""
    s = table(spark, d, "supplier")
    text = lambda c: F.col(c).cast("string")
    part = lambda k: F.create_map(F.lit("id"), F.concat(F.lit(f"A{k}-"), text("s_suppkey")), F.lit("component"), F.element_at(F.array(*[F.lit(x) for x in ("token", "meld_part", "odd")]), (F.col("s_suppkey") % 3 + 1).cast("int")),
                                  F.lit("name"), F.col("s_name"), F.lit("type_line"), F.lit("Token"), F.lit("uri"), F.lit("u"))
    face = F.map_filter(F.create_map(F.lit("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")), F.lit("type_line"), F.lit("Creature – Elf elf Scout"), F.lit("cmc"), text("s_nationkey"),
                                     F.lit("colors"), F.lit('["W","X","G"]'), F.lit("layout"), F.when(F.col("s_suppkey") % 3 == 0, "odd"), F.lit("artist_id"), F.lit("AB")), lambda k, v: v.isNotNull())
    return C.parse(s.select(text("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 != 0, F.array(part(1), part(2))).alias("all_parts"),
                            F.when(F.col("s_suppkey") % 5 == 0, F.array().cast("array<map<string,string>>")).otherwise(F.array(face)).alias("card_faces")))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS card_id, 'a' || k || '-' || s_suppkey AS id, ['token', 'meld_part', 'combo_piece'][s_suppkey % 3 + 1] AS component, s_name AS name, 'Token' AS type_line, 'u' AS uri
FROM supplier, (SELECT unnest([1, 2]) AS k) WHERE s_suppkey % 4 <> 0""")
def related_cards(spark, d):
    return _parts_of_suppliers(spark, d).select("card_id", F.explode("all_parts").alias("p")).select("card_id", "p.*")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS card_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name, '' AS mana_cost, 'Creature' AS types, 'Elf,Scout' AS subtypes, CAST(s_nationkey AS DOUBLE) AS cmc,
'W,G' AS colors, CASE WHEN s_suppkey % 3 = 0 THEN 'normal' END AS layout, 'ab' AS artist_id, TRUE AS no_images FROM supplier WHERE s_suppkey % 5 <> 0""")
def card_faces(spark, d):
    f = _parts_of_suppliers(spark, d).select("card_id", F.explode("card_faces").alias("f"))
    return _flat(f.select("card_id", *[F.col(f"f.{k}").alias(k) for k in ("name", "mana_cost", "types", "subtypes", "cmc", "colors", "layout", "artist_id")], F.col("f.image_uris").isNull().alias("no_images")))


@query(f"WITH {CARDS} SELECT card_id, CAST(released_at AS VARCHAR) AS released_at, digital, promo, CAST(price AS DOUBLE) AS price FROM cards")
def parse_cards_meta(spark, d):
    return _flat(cards(spark, d, *C.META).drop("legalities").withColumn("released_at", F.col("released_at").cast("string")))


@query(f"WITH {CARDS} SELECT card_id, cmc FROM cards WHERE (legal OR released_at > DATE '2020-01-01') AND NOT digital AND NOT promo")
def filter_legality_override(spark, d):
    return cards(spark, d, "card_id", "cmc", *FLAGS).where(FI.predicate(FI.FilterOptions(), now="2020-01-01")).select("card_id", "cmc")


@query(f"WITH {CARDS} SELECT card_id FROM cards WHERE legal AND NOT digital AND NOT promo")
def filter_exclude_unreleased(spark, d):
    return cards(spark, d, "card_id", *FLAGS).where(FI.predicate(FI.FilterOptions(exclude_unreleased=True), now="2020-01-01")).select("card_id")


@query(f"WITH {CARDS} SELECT card_id FROM cards WHERE list_has_any(colors, ['W', 'R'])")
def filter_any_color(spark, d):
    return cards(spark, d, "card_id", "colors").where(FI.any_of("colors", ["W", "R"])).select("card_id")


@query(f"WITH {CARDS} SELECT card_id FROM cards WHERE colors IS NOT NULL AND list_has_all(['W', 'U', 'B'], colors)")
def filter_identity_subset(spark, d):
    return cards(spark, d, "card_id", "color_identity").where(FI.subset_of("color_identity", ["W", "U", "B"])).select("card_id")


@query(f"""WITH {CARDS} SELECT card_id, name FROM cards WHERE len(list_intersect(list_transform(types, lambda x: lower(x)), ['widget', 'economy'])) > 0 AND rarity IN ('rare', 'mythic')
AND lower("set") IN ('brand#2', 'brand#17', 'brand#5') AND cmc >= 2 AND cmc <= 8 AND NOT digital AND NOT promo""")
def filter_chain_all(spark, d):
    o = FI.FilterOptions(format=None, types=("WIDGET", "Economy"), rarities=("rare", "mythic"), sets=("BRAND#2", "brand#17", "Brand#5"), min_cmc=2, max_cmc=8)
    return cards(spark, d, "card_id", "name", "types", "rarity", "set", "cmc", *FLAGS).where(FI.predicate(o)).select("card_id", "name")


@query(f"""WITH {CARDS}, v AS (SELECT CASE WHEN digital THEN 'digital' WHEN promo THEN 'promo' WHEN colors IS NULL THEN 'colorless' END AS step FROM cards)
SELECT step, count(*) AS removed FROM v WHERE step IS NOT NULL GROUP BY step""")
def filter_chain_report(spark, d):
    return FI.chain(cards(spark, d, "card_id", "colors", *FLAGS), [("digital", ~F.col("digital")), ("promo", ~F.col("promo")), ("colorless", F.size("colors") > 0)])[1]


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND event_type IN ('click', 'view', 'error')")
def filter_text_types(spark, d):
    return table(spark, d, "events").where(FI.text_types("event_type", ["click", "view", "error"], ["error"])).select("event_id", "event_type")


@query("SELECT p_partkey FROM part WHERE lower(p_name) IN ('red widget', 'small ring')")
def filter_names(spark, d):
    return table(spark, d, "part").where(F.lower("p_name").isin("red widget", "small ring")).select("p_partkey")


@query("SELECT doc_id, lang FROM documents WHERE NOT (quality = 0) AND (toxic = 0)".replace("FROM documents", "FROM documents JOIN labels USING (doc_id)"))
def filter_published(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return joined.where(FI.published(F.col("quality") == 0, F.when(F.col("toxic") == 0, "true").otherwise("no"), explicit=True)).select("doc_id", "lang")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text ORDER BY n DESC, text LIMIT 100")
def text_frequency_topk(spark, d):
    return R.frequency(table(spark, d, "documents"), "text", 100)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def frequency_all(spark, d):
    return R.frequency(table(spark, d, "events"), "event_type", None)


@query("SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").join(table(spark, d, "customer"), "c_custkey").select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query("SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def join_left_default(spark, d):
    return R.enrich(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id", {"quality": F.lit(-1), "toxic": F.lit(0)})


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_excluded(spark, d):
    return R.excluded(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def join_must_match(spark, d):
    return R.must_match(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query("SELECT doc_id FROM labels SEMI JOIN documents USING (doc_id)")
def join_semi(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id", "left_semi").select("doc_id")


@query("SELECT n, m FROM (SELECT DISTINCT s_nationkey AS n FROM supplier), (SELECT DISTINCT p_size % 3 * 25 + 25 AS m FROM part)")
def parameter_grid(spark, d):
    """Every value of one list with every value of another; both are short."""
    n = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n")).distinct()
    return n.crossJoin(table(spark, d, "part").select((F.col("p_size") % 3 * 25 + 25).alias("m")).distinct())


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 3""")
def topn_per_group(spark, d):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return R.top_per_group(table(spark, d, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


_HASH = "((({0}) * 48271 + 42 * 16807 + 12345) % 2147483647 * 48271 % 2147483647)"


@query(f"SELECT vec_id, label FROM embeddings ORDER BY {_HASH.format('vec_id')}, vec_id LIMIT 200")
def sample_count(spark, d):
    return R.sample_n(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 200)


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format('doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= ceil(n * 0.3)")
def sample_percent(spark, d):
    return R.sample_share(table(spark, d, "documents").select("doc_id"), "doc_id", 0.3)


@query("SELECT event_id AS id, 'event' AS kind FROM events UNION ALL SELECT conv_id, 'turn' FROM conversations UNION ALL SELECT item_id, 'item' FROM benchmark")
def union_all(spark, d):
    parts = [("events", "event_id", "event"), ("conversations", "conv_id", "turn"), ("benchmark", "item_id", "item")]
    frames = [table(spark, d, t).select(F.col(c).alias("id"), F.lit(k).alias("kind")) for t, c, k in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("""WITH t AS (SELECT doc_id, 0 AS priority, doc_id AS place FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1, quality FROM labels UNION ALL SELECT doc_id, 2, n_chars FROM documents)
SELECT doc_id, priority, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, place) AS r FROM t) WHERE r = 1""")
def union_ranked(spark, d):
    docs = table(spark, d, "documents")
    parts = [docs.where("lang = 'en'").select("doc_id", F.col("doc_id").alias("place")), table(spark, d, "labels").select("doc_id", F.col("quality").alias("place")), docs.select("doc_id", F.col("n_chars").alias("place"))]
    return R.merge_ranked(parts, "doc_id", "place").select("doc_id", "priority", F.col("place").cast("long").alias("place"))


@query("""WITH b AS (SELECT doc_id, quality = 1 AS p FROM labels WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, toxic = 0 AS p FROM labels WHERE doc_id % 7 <> 0)
SELECT doc_id, CASE WHEN b.p IS NULL THEN 'new' WHEN n.p IS NULL THEN 'gone' WHEN b.p AND n.p THEN 'pass' WHEN b.p THEN 'regression' WHEN n.p THEN 'progression' ELSE 'fail' END AS change FROM b FULL JOIN n USING (doc_id)""")
def baseline_diff(spark, d):
    lab = table(spark, d, "labels")
    before = lab.where("doc_id % 5 <> 0").select("doc_id", (F.col("quality") == 1).alias("passed"))
    return R.baseline_diff(before, lab.where("doc_id % 7 <> 0").select("doc_id", (F.col("toxic") == 0).alias("passed")), "doc_id")


@query("SELECT DISTINCT source FROM documents")
def distinct_values(spark, d):
    return table(spark, d, "documents").select("source").distinct()


@query("SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


@query("""SELECT label, vec_id, round(CASE WHEN hx > lx THEN (x - lx) / (hx - lx) ELSE 0.5 END, 6) AS x, round(CASE WHEN hy > ly THEN (y - ly) / (hy - ly) ELSE 0.5 END, 6) AS y FROM
(SELECT label, vec_id, x, y, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy FROM (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) WINDOW w AS (PARTITION BY label))""")
def minmax_normalise(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return R.minmax(e, ["x", "y"], ["label"]).select("label", "vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH e AS (SELECT unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), b AS (SELECT dim, min(x) AS lo, max(x) AS hi, count(*) AS total FROM e GROUP BY dim)
SELECT CAST(dim AS INTEGER) AS dim, CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 8)), 7) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM e JOIN b USING (dim) GROUP BY ALL""")
def embedding_histogram(spark, d):
    return R.histogram(table(spark, d, "embeddings"), "embedding", 8).select("dim", "bin", "n")


@query("""WITH c AS (SELECT event_type AS category, CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS pattern, user_id % 3 AS message, CAST(event_id AS VARCHAR) AS example, event_id FROM events),
g AS (SELECT category, pattern, message, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, pattern, message) AS rank FROM g),
x AS (SELECT category, pattern, message, string_agg(example, ',' ORDER BY event_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY category, pattern, message ORDER BY event_id) AS k FROM c) WHERE k <= 3 GROUP BY ALL)
SELECT category, pattern, message, CAST(rank AS INTEGER) AS rank, n, round(100.0 * n / (SELECT count(*) FROM c), 6) AS percent, examples FROM r JOIN x USING (category, pattern, message) WHERE rank <= 3""")
def diagnostics_topk(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("category"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("pattern"), (F.col("user_id") % 3).alias("message"), F.col("event_id").cast("string").alias("example"), "event_id")
    return R.diagnostics(rows, "category", "pattern", "message", "example", "event_id").withColumns({"percent": F.round("percent", 6), "examples": F.array_join("examples", ",")})


@query("SELECT p_partkey, CAST(coalesce(TRY_CAST(CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_retailprice AS VARCHAR) END AS DECIMAL(18,4)), CASE WHEN p_partkey % 8 <> 0 THEN 12.5 END, 0) AS DOUBLE) AS price, CAST(greatest(trunc(p_size * 0.5), 5) AS INTEGER) AS size FROM part")
def price_and_marker(spark, d):
    from quillstone.operators.charts import marker_size

    p = table(spark, d, "part")
    usd, foil = F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice").cast("string")), F.when(F.col("p_partkey") % 8 != 0, "12.50")
    return p.select("p_partkey", C.price(usd, foil, F.lit("none")).cast("double").alias("price"), marker_size(F.col("p_size"), 0.5, 5).alias("size"))


@query("SELECT '{' || s_suppkey || '}' AS symbol, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE s_nationkey END AS DOUBLE) AS cmc FROM supplier")
def card_symbols(spark, d):
    """Symbol lists, a document a nation; values that are missing are 0."""
    s = table(spark, d, "supplier")
    one = F.struct(F.concat(F.lit("{"), F.col("s_suppkey").cast("string"), F.lit("}")).alias("symbol"), F.when(F.col("s_suppkey") % 2 != 0, F.col("s_nationkey").cast("double")).alias("cmc"))
    doc = s.groupBy("s_nationkey").agg(F.collect_list(one).alias("data")).select("data")
    return C.symbols(doc)
