"""The rules-text parser, sources and sinks, and change streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstone.parser import frames as PF
from quillstone.queries.registry import query, table
from quillstone.sources import io
from quillstone.streaming import incremental

# Own cards in the shape of the parser's input.
CARDS = [
    (1, "Dawn Drake", "{3}{W}{U}", "Legendary Creature — Drake Spirit", "Flying, vigilance\nWhen this creature dies, create two 1/1 blue Bird creature tokens with flying.", "3", "4", None),
    (2, "Moss Tender", "{G}", "Creature — Elf", "{T}: Add {G}.", "1", "1", None),
    (3, "Ash Seer", "{X}{2/R}{B/P}", "Creature — Human", "{1}, Sacrifice another creature: Scry 2.\nProtection from red and from Dragons", "*", "1+*", None),
    (4, "Bell of Ends", "{2}", "Artifact", "If a creature would die, exile it instead.\nChoose one — • Draw a card. • Discard a card.", None, None, None),
    (5, "Vale Warden", "{1}{W}{W}", "Planeswalker — Vale", "+1: Draw two cards.\n−2: Put a +1/+1 counter on target creature you control.", None, None, "4"),
    (6, "Blank Page", None, "Basic Snow Land -- Page", None, None, None, None),
]
CARD = "card_id long, name string, mana_cost string, type_line string, oracle_text string, power string, toughness string, loyalty string"


def cards(spark):
    return spark.createDataFrame(CARDS, CARD)


@query("SELECT * FROM (VALUES (1, 5), (2, 1), (3, 3), (4, 2), (5, 3)) t(card_id, mana_value)".replace("SELECT *", "SELECT CAST(card_id AS BIGINT) AS card_id, mana_value"))
def parse_mana(spark, d):
    return cards(spark).where("mana_cost IS NOT NULL").select("card_id", PF.mana_value(F.col("mana_cost")).alias("mana_value"))


@query("SELECT CAST(card_id AS BIGINT) AS card_id, a AS supertypes, b AS types, c AS subtypes FROM (VALUES (1, 'Legendary', 'Creature', 'Drake Spirit'), (2, '', 'Creature', 'Elf'), (3, '', 'Creature', 'Human'), (4, '', 'Artifact', ''), (5, '', 'Planeswalker', 'Vale'), (6, 'Basic Snow', 'Land', 'Page')) t(card_id, a, b, c)")
def parse_typeline(spark, d):
    p = PF.type_parts(F.col("type_line"))
    return cards(spark).select("card_id", *[F.array_join(p[n], " ").alias(n) for n in ("supertypes", "types", "subtypes")])


@query("SELECT CAST(card_id AS BIGINT) AS card_id, status, kinds FROM (VALUES (1, 'FullyParsed', 'static,static,triggered'), (2, 'FullyParsed', 'activated'), (3, 'FullyParsed', 'activated,static'), (4, 'Failed', 'unparsed,unparsed,unparsed,unparsed'), (5, 'FullyParsed', 'activated,activated'), (6, 'FullyParsed', '')) t(card_id, status, kinds)")
def parse_cards(spark, d):
    return PF.parse_cards(cards(spark)).select("card_id", "parsed.status", F.array_join(F.col("parsed.abilities.kind"), ",").alias("kinds"))


@query()
def parse_sampled(spark, d):
    """Lines of documents as rules text: sampled, parsed, with their diagnostics."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("name"), F.lit(None).cast("string").alias("mana_cost"), F.lit("Sorcery").alias("type_line"), F.col("text").alias("oracle_text"), *[F.lit(None).cast("string").alias(c) for c in ("power", "toughness", "loyalty")])
    return PF.sample_and_analyze(docs, "doc_id", 50).select("doc_id", "succeeded", "parsed.status", "parsed.clauses")


@query()
def parse_report(spark, d):
    return PF.report(PF.parse_cards(cards(spark)), "card_id")


@query("SELECT " + ", ".join(f'{n}::BIGINT AS "{c}"' for c, n in (("cards", 6), ("full", 5), ("partial", 0), ("failed", 1), ("static", 3), ("triggered", 1), ("activated", 4), ("unparsed", 4))) + ", round(500.0 / 6, 6)::DOUBLE AS percent")
def parse_summary(spark, d):
    return PF.summary(PF.parse_cards(cards(spark))).withColumn("percent", F.round("percent", 6))


def _folder(spark) -> str:
    return f"{io.shared_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_csv(spark, d):
    path = _folder(spark)
    io.write_csv(table(spark, d, "nation"), path)
    return io.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT event_id, event_type, value, props FROM events")
def source_json(spark, d):
    path = _folder(spark)
    table(spark, d, "events").select("event_id", "event_type", "value", "props").write.json(path)
    return io.read_json_lines(spark, path, "event_id long, event_type string, value double, props string")


@query("SELECT count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars FROM benchmark")
def source_text(spark, d):
    path = _folder(spark)
    table(spark, d, "benchmark").select("text").write.text(path)
    rows = table(spark, d, "benchmark").agg(F.count("*").alias("files"))
    found = io.read_text(spark, path).agg(F.sum(F.length("text")).alias("chars"))  # each row ends with a line feed
    return found.crossJoin(rows).select("files", (F.col("chars") - F.col("files")).alias("chars"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY event_type")
def incremental_counts(spark, d):
    """events as a file stream through foreachBatch; the final state."""
    path, events = _folder(spark), table(spark, d, "events")
    events.repartition(3, "event_id").write.parquet(path)
    return incremental.run_counts(spark, path, events.schema, _folder(spark)).withColumn("total", F.col("total").cast("double"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def last_write_wins(spark, d):
    return incremental.last_write_wins(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH s AS (SELECT doc_id, lang, 'add' AS kind FROM documents WHERE doc_id % 4 <> 0), c AS (SELECT doc_id, 'xx' AS lang, CASE WHEN doc_id % 3 = 0 THEN 'delete' ELSE 'change' END AS kind FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, lang FROM s WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL SELECT doc_id, lang FROM c WHERE kind <> 'delete'""")
def upsert_state(spark, d):
    docs = table(spark, d, "documents")
    changes = docs.where("doc_id % 5 = 0").select("doc_id", F.lit("xx").alias("lang"), F.when(F.col("doc_id") % 3 == 0, "delete").otherwise("change").alias("kind"))
    return incremental.upsert(docs.where("doc_id % 4 <> 0").select("doc_id", "lang"), changes, "doc_id")


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed(e).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT region, count(*) AS n FROM (SELECT r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY region")
def pipeline_run(spark, d):
    """The pipeline runner over catalog datasets, with a join node before a count node, declared in the wrong order."""
    from quillstone.plans.catalog import Catalog, Dataset
    from quillstone.plans.pipeline import Pipeline, Registry

    catalog = Catalog(spark, _folder(spark))
    for t in ("supplier", "nation", "region"):
        catalog.add(Dataset(t, path=f"{d}/{t}.parquet"))
    catalog.add(Dataset("placed", "primary"))
    catalog.add(Dataset("counts", "reporting", "json", "region string, n long"))
    p = Pipeline("suppliers")
    p.add_node("count", lambda placed: placed.groupBy("region").agg(F.count("*").alias("n")), ("placed",), ("counts",))
    p.add_node("place", lambda s, n, r: s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("region")), ("supplier", "nation", "region"), ("placed",))
    registry = Registry(catalog)
    registry.register(p)
    registry.run("suppliers")
    return spark.read.schema("region string, n long").json(catalog.path("counts"))


# Pairs of JSON texts, and whether they say the same.
JSON_PAIRS = [
    ('{"a": 1, "b": [1, 2]}', '{"b": [1, 2], "a": 1}', True), ('{"a": 1}', '{"a": 1, "n": null, "f": false, "z": 0, "l": []}', True),
    ('{"note": {"text": "x"}}', "{}", True), ('{"note": {"text": "x", "more": 1}}', "{}", False), ('{"a": null}', '{"a": false}', False),
    ("[1, 2]", "[2, 1]", False), ("[]", "[0]", False), ('{"a": "0"}', "{}", False), ('{"a": 1}', '{"a": 1.0}', False), ('{"z": 0.0}', "{}", False), ("{", "{}", None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if same is None else same})" for i, (_, _, same) in enumerate(JSON_PAIRS)) + ") t(pair, same)")
def json_same(spark, d):
    """Golden comparison of JSON texts."""
    rows = [(i, a, b) for i, (a, b, _) in enumerate(JSON_PAIRS)]
    return spark.createDataFrame(rows, "pair int, a string, b string").select("pair", PF.same_json(F.col("a"), F.col("b")).alias("same"))


@query("SELECT * FROM (VALUES (1, 1, 'Flying, vigilance', 'a|b'), (1, 2, 'Flying', 'c'), (3, 1, 'Flying, vigilance', 'a')) t(card_id, line, line_text, abilities)")
def line_cases(spark, d):
    """Test cases of single lines, with the abilities that each is expected to give."""
    rows = [(1, "Flying, vigilance\n\n  Flying ", ["a", "b", "c"]), (2, None, ["a"]), (3, "Flying, vigilance\nFlying", ["a"]), (4, "Flying", []), (5, "Flying", None), (6, "", ["a"])]
    found = PF.line_cases(spark.createDataFrame(rows, "card_id int, oracle_text string, expected array<string>"))
    return found.select("card_id", "line", "line_text", F.array_join("line_expected", "|").alias("abilities"))
