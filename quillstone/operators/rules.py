"""Rules documents: sections, the four-level hierarchy of numbered rules, the glossary, and lines of rules text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X

KINDS = ["keyword", "named", "triggered", "activated", "passive"]


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """intro, contents, rules, glossary, credits: cut at the first of each delimiter, those that follow only."""
    cut = docs.withColumn("_a", X.section(F.col(text), "Contents")).withColumn("_b", X.section(F.col("_a.right"), "1. Game Concepts", 100))
    cut = cut.withColumn("_c", X.section(F.col("_b.right"), "\nGlossary\n")).withColumn("_d", X.section(F.col("_c.right"), "\nCredits\n"))
    return cut.select(key, F.col("_a.left").alias("intro"), F.col("_b.left").alias("contents"), F.col("_c.left").alias("rules"), F.col("_d.left").alias("glossary"), F.col("_d.right").alias("credits"))


def hierarchy(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row per rule: key, section, subsection, rule, suffix, body.

    `1. Title` opens a section, `100. Title` a subsection, `100.1a Text` a rule; other lines continue the rule before
    them, in the same subsection; lines before any rule go.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("t", F.trim("raw")).where("t <> ''")
    at = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({
        "_s": F.when(F.col("t").rlike(r"^\d\. "), F.col("t")), "_u": F.when(F.col("t").rlike(r"^\d{3}\. "), F.col("t")),
        "_r": F.when(F.col("t").rlike(r"^\d{3}\.\d+[a-z]*\.? "), F.regexp_extract("t", r"^(\d{3}\.\d+[a-z]*)", 1))})
    held = marked.withColumns({
        "section": F.last("_s", True).over(at), "subsection": F.last("_u", True).over(at), "rule": F.last("_r", True).over(at),
        "_at_rule": F.max(F.when(F.col("_r").isNotNull(), F.col("line"))).over(at), "_at_head": F.max(F.when(F.col("_s").isNotNull() | F.col("_u").isNotNull(), F.col("line"))).over(at)})
    body = held.where("rule IS NOT NULL AND _at_rule > coalesce(_at_head, -1)")
    words = F.when(F.col("_r").isNotNull(), F.regexp_replace("t", r"^\d{3}\.\d+[a-z]*\.? ", "")).otherwise(F.col("t"))
    grouped = body.withColumn("w", words).groupBy(key, "section", "subsection", "rule", "_at_rule").agg(F.array_sort(F.collect_list(F.struct("line", "w"))).alias("ls"))
    return grouped.select(key, "section", "subsection", "rule", X.rule_suffix(F.col("rule")).alias("suffix"), F.array_join(F.col("ls.w"), " ").alias("body"))


def glossary(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """term, definition: blocks between blank lines, the first line the term; of a term given twice, the last counts; terms alone go."""
    blocks = docs.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("at", "block")).select(key, "at", X.lines(F.col("block")).alias("ls")).where("size(ls) > 1")
    split = blocks.select(key, "at", F.col("ls")[0].alias("term"), F.array_join(F.slice("ls", F.lit(2), F.size("ls")), " ").alias("definition")).where("term <> 'Glossary'")
    return split.groupBy(key, "term").agg(F.max_by("definition", "at").alias("definition"))


def refine(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per line: key, ordinal, kind, line: normalised, without parentheses, classified by the first rule that matches."""
    lines = F.filter(F.transform(F.split(X.normalize(F.col(text)), "\n"), lambda x: F.trim(F.regexp_replace(x, X.PARENTHESES, ""))), lambda x: x != "")
    return docs.select(key, F.posexplode(lines).alias("ordinal", "line")).select(key, "ordinal", X.line_kind(F.col("line")).alias("kind"), "line")


def refined_arrays(refined: DataFrame, key: str) -> DataFrame:
    """An array of lines per kind for each key."""
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ordinal", "line")))), lambda x: x["line"]).alias(k)
    return refined.groupBy(key).agg(*[of(k) for k in KINDS])


def flatten(arrays: DataFrame, key: str) -> DataFrame:
    """Embedding input: keyword, named, triggered, activated and passive lines, in that order, with an id made of the place."""
    of = lambda k: F.transform(F.coalesce(k, F.array().cast("array<string>")), lambda t: F.struct(F.lit(k).alias("text_type"), t.alias("text")))
    every = F.concat(*[of(k) for k in KINDS])
    rows = arrays.select(key, F.posexplode(every).alias("ordinal", "e")).select(key, "ordinal", "e.*")
    return rows.withColumn("text_entry_id", F.md5(F.concat_ws("|", F.col(key).cast("string"), "text_type", F.col("ordinal").cast("string")))).where(~X.is_blank(F.col("text")))


def ability(line: Column) -> Column:
    """A line as struct(trigger or cost list, effect): triggers at the first comma, activated ones at the first colon."""
    trigger, cost = X.split_two(line, ","), X.split_two(line, ":")
    costs = F.filter(F.transform(F.split(cost["head"], ", "), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        F.when(X.is_trigger(line), trigger["head"]).alias("trigger"), F.when(X.is_activated(line) & ~X.is_trigger(line), costs).alias("costs"),
        F.when(X.is_trigger(line), trigger["tail"]).when(X.is_activated(line), cost["tail"]).otherwise(line).alias("effect"))
