"""Composable predicates over card-like rows; each is a boolean Column that Catalyst can push down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.cards import FORMATS


@dataclass(frozen=True)
class FilterOptions:
    format: str | None = "commander"
    colors: tuple[str, ...] | None = None
    color_identity: tuple[str, ...] | None = None
    types: tuple[str, ...] | None = None
    rarities: tuple[str, ...] | None = None
    sets: tuple[str, ...] | None = None
    min_cmc: float | None = None
    max_cmc: float | None = None
    exclude_digital: bool = True
    exclude_promo: bool = True
    exclude_unreleased: bool = False


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def legal(format: str | None, now: str, exclude_unreleased: bool) -> Column:
    """Legal or restricted in the format, or not yet released unless those are excluded; blank or unknown formats keep all."""
    name = (format or "").strip().lower()
    if name not in FORMATS:
        return F.lit(True)
    ok = F.coalesce(F.col(f"legal.{name}"), F.lit(False))
    return ok if exclude_unreleased else ok | F.coalesce(F.col("released_at") > F.lit(now).cast("date"), F.lit(False))


def any_of(column: str, values) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), _array(values)), F.lit(False))


def any_of_ignore_case(column: str, values) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(column, F.lower), _array(v.lower() for v in values)), F.lit(False))


def subset_of(column: str, values) -> Column:
    """Null fails: a colourless card has a null identity."""
    return F.col(column).isNotNull() & (F.size(F.array_except(F.coalesce(F.col(column), F.array().cast("array<string>")), _array(values))) == 0)


def predicate(o: FilterOptions, now: str = "2000-01-01") -> Column:
    p = legal(o.format, now, o.exclude_unreleased)
    for on, value in (
        (o.colors, lambda: any_of("colors", o.colors)), (o.color_identity, lambda: subset_of("color_identity", o.color_identity)),
        (o.types, lambda: any_of_ignore_case("types", o.types)), (o.rarities, lambda: F.col("rarity").isin(*o.rarities)),
        (o.sets, lambda: F.lower("set").isin(*[s.lower() for s in o.sets])), (o.min_cmc is not None, lambda: F.col("cmc") >= o.min_cmc),
        (o.max_cmc is not None, lambda: F.col("cmc") <= o.max_cmc), (o.exclude_digital, lambda: ~F.col("digital")), (o.exclude_promo, lambda: ~F.col("promo")),
    ):
        if on:
            p = p & value()
    return p


def text_types(column: str, included=None, excluded=()) -> Column:
    """Included types but those excluded; Full goes always."""
    p = ~F.col(column).isin("Full", *excluded)
    return p & F.col(column).isin(*included) if included else p


def chain(df: DataFrame, steps: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every step, step and number of rows that each removed); a null verdict removes."""
    verdict = None
    for name, p in steps:
        bad = ~F.coalesce(p, F.lit(False))
        verdict = F.when(bad, name) if verdict is None else verdict.when(bad, name)
    marked = df.withColumn("_step", verdict)
    removed = marked.where(F.col("_step").isNotNull()).groupBy(F.col("_step").alias("step")).agg(F.count("*").alias("removed"))
    return marked.where(F.col("_step").isNull()).drop("_step"), removed


def published(draft: Column, publish: Column, explicit: bool = False) -> Column:
    """Not a draft and, if publishing is explicit, published; true and "true" count."""
    yes = lambda c: F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))
    return ~yes(draft) & (yes(publish) if explicit else F.lit(True))


def not_ignored(path: Column, patterns=(r"(^|/)\.git(/|$)",)) -> Column:
    p = F.lit(True)
    for x in patterns:
        p = p & ~path.rlike(x)
    return p
