"""Rows for charts: series, coordinates, sizes, colours and hover texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X

# Display names and colours of text types.
TYPE_NAMES = {"keyword": "Keyword Abilities", "named": "Named Abilities", "triggered": "Triggered Abilities", "activated": "Activated Abilities", "passive": "Passive Abilities"}
TYPE_COLORS = {"keyword": "#1f77b4", "named": "#ff7f0e", "triggered": "#2ca02c", "activated": "#d62728", "passive": "#9467bd"}


def _of(table: dict[str, str], c: Column, default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def marker_size(metric: Column, multiplier: float, least: int) -> Column:
    return F.greatest(metric * multiplier, F.lit(float(least))).cast("int")


def scatter(points: DataFrame, kind: str, text: str, components: str = "components", excluded: tuple[str, ...] = ("Full",)) -> DataFrame:
    """series, color, x, y, hover; points of fewer than two components are an error."""
    ok = points.where(~F.col(kind).isin(*excluded))
    x = F.when(F.size(components) >= 2, F.col(components)[0]).otherwise(F.raise_error(F.lit("two components are needed")))
    return ok.select(_of(TYPE_NAMES, F.col(kind), "Other").alias("series"), _of(TYPE_COLORS, F.col(kind), "#7f7f7f").alias("color"), x.alias("x"), F.get(components, F.lit(1)).alias("y"), X.truncate(F.col(text), 100).alias("hover"))


def colored(identity: Column, key: Column, seed: int = 42) -> Column:
    """One colour of an identity, picked by hash; Colorless if it has none."""
    return F.when(identity.isNull() | (F.size(identity) == 0), "Colorless").otherwise(F.element_at(identity, (F.pmod(F.xxhash64(key, F.lit(seed)), F.size(identity)) + 1).cast("int")))


def grid(layouts: DataFrame) -> DataFrame:
    """Layouts with the row and column of their combination, from 1."""
    from pyspark.sql import Window

    n = layouts.select("n_neighbors").distinct().withColumn("row", F.row_number().over(Window.orderBy("n_neighbors")))
    d = layouts.select("min_dist").distinct().withColumn("col", F.row_number().over(Window.orderBy("min_dist")))
    return layouts.join(n, "n_neighbors").join(d, "min_dist").withColumn("title", F.format_string("n=%d, d=%.2f", "n_neighbors", "min_dist"))
