"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import GAP, fresh, let, words


@dataclass(frozen=True)
class Rule:
    """A document passes if passes(c) holds, c giving the column of a name: base counts, n_lines and text.

    scans and numbers say what it costs: the characters of the texts it scans, besides the numbers it compares.
    """

    name: str
    passes: Callable[[Callable[[str], Column]], Column]
    scans: int = 0  # times that it goes through the text
    numbers: int = 2


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", "")).cast("long")


#: Gentle thresholds: junk of symbols, shouting, tables and repeated lines fails, prose passes.
RULES: tuple[Rule, ...] = (
    Rule("word_length", lambda c: c("word_chars").between(2 * c("n_words"), 30 * c("n_words")), numbers=3),
    Rule("symbols", lambda c: 10 * c("n_symbols") <= 3 * c("n_words")),
    Rule("duplicate_lines", lambda c: 10 * c("n_dup_lines") <= 3 * c("n_lines")),
    Rule("upper_case", lambda c: 2 * _count(c("text"), r"\p{Lu}") <= c("word_chars"), 1),
    Rule("letters", lambda c: 2 * _count(c("text"), r"\p{L}\p{M}") >= c("word_chars"), 1),
    Rule("exclamation", lambda c: 5 * _count(c("text"), "!") <= 2 * c("n_words"), 1),
)


def _repeat_words(ws: Column) -> Column:
    """Words covered by a 5-word window that occurs twice or more; sorting keeps this n log n in the words."""

    def covered(hs: Column) -> Column:
        n = F.size(hs)
        windows = F.transform(
            F.sequence(F.lit(0), n - 5),
            lambda i: F.struct(F.xxhash64(*[F.get(hs, i + k) for k in range(5)]).alias("h"), i.alias("p")),
        )

        def repeated(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"].eqNullSafe(F.get(s, b)["h"])
            at = F.filter(
                F.transform(s, lambda x, k: F.when(((k > 0) & same(k, k - 1)) | same(k, k + 1), x["p"])),
                lambda p: p.isNotNull(),
            )
            # each place adds the words up to the next place, five at most
            return let(F.sort_array(at), lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))),
                F.lit(0), lambda a, x: a + x))

        return F.when(n >= 6, let(F.sort_array(windows), repeated)).otherwise(0)

    return let(F.transform(ws, lambda w: F.xxhash64(w)), covered).cast("long")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measure(docs: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """docs with the base counts and two columns of new names (text, n_lines), and what gives the column of a rule's name."""
    text, lines, w, l_ = fresh(docs, "text", "n_lines", "w", "l")
    named = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = lambda ws: F.struct(F.size(ws).cast("long").alias("n"), _repeat_words(ws).alias("again"))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = lambda x: F.struct(F.size(x).cast("long").alias("all"), F.size(F.array_distinct(x)).cast("long").alias("own"))
    held = named.withColumn(w, let(words(F.col(text)), own)).withColumn(l_, let(worded, both))
    out = held.withColumns({
        "n_words": F.col(w)["n"],
        "n_repeat_words": F.col(w)["again"],
        "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
        "n_symbols": _count(F.col(text), "#*$%&|<>"),
        "n_dup_lines": F.col(l_)["all"] - F.col(l_)["own"],
        lines: F.col(l_)["all"],
    }).drop(w, l_)
    return out, lambda name: F.col({"text": text, "n_lines": lines}.get(name, name))


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost, the best first, as (rule, share rejected, cost), from about sample_rows rows spread over all.

    The cost of a rule is the mean number of characters and numbers that it reads of a row that passed the base, so that it is the
    same in each run. One job counts for all rules, where the rows are. The order alone depends on the sample; which documents pass does not.
    """
    every = max(1, docs.count() // sample_rows)
    sample = docs.select("text").where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0)
    held, c = measure(sample)
    rejected = [F.sum((~F.coalesce(r.passes(c), F.lit(False))).cast("int")).alias(f"r{i}") for i, r in enumerate(rules)]
    row = held.where(~base_failed()).agg(F.count("*").alias("n"), F.sum(F.length(c("text"))).alias("chars"), *rejected).first()
    n, chars = max(row["n"], 1), (row["chars"] or 0)
    found = [(r, (row[f"r{i}"] or 0) / n, r.scans * chars / n + r.numbers) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: -(x[1] + 1e-6) / x[2])


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """docs with the base counts, base_failed, kept and failed_rule (null if kept).

    A null text has no words and fails the base. Rows, repeated ones too, are judged one by one; other columns
    are kept, but those that share a name with a result are replaced. An empty table gives no rows. The rules
    run in the order found by order(); a CASE stops at the first that fails.
    """
    ranked = [rule for rule, _, _ in order(docs, rules, sample_rows)]
    held = docs.drop(*BASE, "base_failed", "kept", "failed_rule")
    measured, c = measure(held)
    chain = F.when(base_failed(), "base")
    for rule in ranked:
        chain = chain.when(~rule.passes(c), rule.name)
    judged = measured.withColumn("base_failed", base_failed()).withColumn("failed_rule", chain).withColumn("kept", F.col("failed_rule").isNull())
    return judged.select(*held.columns, *BASE, "base_failed", "failed_rule", "kept")
