"""Joins, groupings, rankings, samples and set operations shared by the pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(df: DataFrame, column: str, keep: int | None = 100) -> DataFrame:
    """Counts of exact values, most frequent first, ties by value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts if keep is None else counts.limit(keep)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with rank from 1; only those cross the shuffle, thanks to the group limit below the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def enrich(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Left lookup with defaults for what is missing."""
    out = left.join(right, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in (defaults or {}).items()})


def must_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner lookup in which a missing key is an error."""
    found = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    return found.where(F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean"))).drop("_found")


def excluded(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def order_key(column: str, seed: int) -> Column:
    """A pseudo-random order that any SQL engine can repeat."""
    return (F.col(column).cast("long") * 48271 + seed * 16807 + 12345) % 2147483647 * 48271 % 2147483647


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the same on every run."""
    return df.orderBy(order_key(key, seed), key).limit(n)


def sample_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """ceil(rows * share) rows; the share is above 0 and 1 at most."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and 1 at most")
    return sample_n(df, key, -int(-(df.count() * share) // 1), seed)


def merge_ranked(parts: list[DataFrame], key: str, rank: str) -> DataFrame:
    """Distinct keys of several ranked lists, those of earlier lists first."""
    tagged = None
    for k, p in enumerate(parts):
        own = p.select(key, F.lit(k).alias("priority"), F.col(rank).cast("long").alias("place"))
        tagged = own if tagged is None else tagged.unionByName(own)
    return tagged.groupBy(key).agg(F.min(F.struct("priority", "place")).alias("f")).select(key, "f.priority", "f.place")


def baseline_diff(before: DataFrame, now: DataFrame, key: str, passed: str = "passed") -> DataFrame:
    """key, change: pass, fail, progression, regression, new or gone."""
    a, b = before.select(key, F.col(passed).alias("_b")), now.select(key, F.col(passed).alias("_n"))
    change = (
        F.when(F.col("_b").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("_b") & F.col("_n"), "pass")
        .when(F.col("_b"), "regression").when(F.col("_n"), "progression").otherwise("fail"))
    return a.join(b, key, "full").select(key, change.alias("change"))


def minmax(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """columns scaled to [0, 1] within the group; 0.5 where all are equal."""
    bounds = df.groupBy(*group).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = df.join(bounds, group)  # a row per group is joined back, so no group meets in one task
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        joined = joined.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5))
    return joined.select(*df.columns)


def histogram(df: DataFrame, vector: str, bins: int) -> DataFrame:
    """dim, bin, n, center, percent: equal-width bins per dimension, the last closed; a constant dimension fills bin 0."""
    values = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    bounds = values.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = values.join(bounds, "dim")
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0)
    return placed.groupBy("dim", "lo", "hi", "total", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n")).select(
        "dim", "bin", "n", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("center"), (100.0 * F.col("n") / F.col("total")).alias("percent"))


def cluster_stats(assigned: DataFrame, cluster: str = "cluster_id", distance: str = "distance") -> DataFrame:
    """Count, mean and population deviation of squared distances."""
    return assigned.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(distance).alias("mean"), F.stddev_pop(distance).alias("deviation"))


def diagnostics(df: DataFrame, category: str, pattern: str, message: str, example: str, order: str, top: int = 3, examples: int = 3) -> DataFrame:
    """Groups of messages per category: count, percent of all diagnostics, first examples; the largest groups of each category."""
    groups = df.groupBy(category, pattern, message).agg(F.count("*").alias("n"))
    ranked = top_per_group(groups, [category], [F.desc("n"), F.col(pattern), F.col(message)], top)
    total = df.agg(F.count("*").alias("total"))
    first = top_per_group(df.select(category, pattern, message, example, order), [category, pattern, message], [F.col(order)], examples)
    lists = first.groupBy(category, pattern, message).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", example))), lambda x: x[example]).alias("examples"))
    out = ranked.join(lists, [category, pattern, message]).join(F.broadcast(total))  # total is one row
    return out.select(category, pattern, message, "rank", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"), "examples")
