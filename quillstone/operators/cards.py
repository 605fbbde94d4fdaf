"""Typed cards from raw ones: enumerations, type lines, dates, prices, faces and related cards, and the vertical split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import normalize

# Wire names of the enumerations; the first of each is the default.
RARITIES = ["common", "uncommon", "rare", "mythic", "special", "bonus"]
FINISHES = ["nonfoil", "foil", "etched"]
BORDERS = ["black", "white", "borderless", "silver", "gold"]
FRAMES = ["2015", "1993", "1997", "2003", "future"]
COLORS = ["W", "U", "B", "R", "G"]
LAYOUTS = [
    "normal", "split", "flip", "transform", "modal_dfc", "meld", "leveler", "class", "case", "saga", "adventure", "mutate", "prototype", "battle",
    "planar", "scheme", "vanguard", "token", "double_faced_token", "emblem", "augment", "host", "art_series", "reversible_card",
]
SET_TYPES = [
    "core", "expansion", "masters", "alchemy", "masterpiece", "arsenal", "from_the_vault", "spellbook", "premium_deck", "duel_deck", "draft_innovation",
    "treasure_chest", "commander", "planechase", "archenemy", "vanguard", "funny", "starter", "box", "promo", "token", "memorabilia", "minigame",
]
IMAGE_STATUSES = ["missing", "placeholder", "lowres", "highres_scan"]
STAMPS = ["oval", "triangle", "acorn", "circle", "arena", "heart"]
PLATFORMS = ["paper", "arena", "mtgo"]
COMPONENTS = ["combo_piece", "token", "meld_part", "meld_result"]
FORMATS = [
    "standard", "future", "historic", "timeless", "gladiator", "pioneer", "explorer", "modern", "legacy", "pauper", "vintage", "penny", "commander",
    "oathbreaker", "standardbrawl", "brawl", "alchemy", "paupercommander", "duel", "oldschool", "premodern", "predh",
]
PRICES = ["usd", "usd_foil", "usd_etched", "eur", "eur_foil", "eur_etched", "tix"]
IMAGES = ["small", "normal", "large", "png", "art_crop", "border_crop"]

#: Columns of a raw card; those that a table lacks are null.
RAW = """id string, oracle_id string, multiverse_ids array<int>, mtgo_id int, mtgo_foil_id int, arena_id int, tcgplayer_id int, cardmarket_id int, name string,
lang string, released_at string, uri string, scryfall_uri string, layout string, highres_image boolean, image_status string, image_uris map<string,string>, mana_cost string,
cmc double, type_line string, oracle_text string, power string, toughness string, loyalty string, life_modifier string, hand_modifier string, colors array<string>,
color_identity array<string>, color_indicator array<string>, keywords array<string>, produced_mana array<string>, all_parts array<map<string,string>>,
card_faces array<map<string,string>>, legalities map<string,string>, games array<string>, reserved boolean, game_changer boolean, foil boolean, nonfoil boolean,
finishes array<string>, oversized boolean, promo boolean, promo_types array<string>, reprint boolean, variation boolean, set_id string, set string, set_name string,
set_type string, set_uri string, set_search_uri string, scryfall_set_uri string, rulings_uri string, prints_search_uri string, collector_number string, digital boolean,
rarity string, flavor_text string, flavor_name string, card_back_id string, artist string, artist_ids array<string>, illustration_id string, border_color string, frame string,
frame_effects array<string>, security_stamp string, full_art boolean, textless boolean, booster boolean, story_spotlight boolean, watermark string, edhrec_rank int,
penny_rank int, prices map<string,string>, related_uris map<string,string>, purchase_uris map<string,string>, preview map<string,string>, attraction_lights array<int>"""

CORE = ["card_id", "name", "type_line", "types", "subtypes", "colors", "color_identity", "cmc", "rarity", "set", "mana_cost", "oracle_text", "power", "toughness", "loyalty"]
META = ["card_id", "released_at", "digital", "promo", "legalities", "price"]


def enum(c: Column, values: list[str], default: str | None = None) -> Column:
    """The value if it is known, else the default (the first, unless one is given)."""
    return F.when(c.isin(*values), c).otherwise(F.lit(values[0] if default is None else default))


def colors(c: Column) -> Column:
    """Known colours; null if none is left."""
    known = F.filter(c, lambda x: x.isin(*COLORS))
    return F.when(F.size(known) > 0, known)


def price(*chain: Column) -> Column:
    """The first price that is a number, else 0."""
    return F.coalesce(*[F.expr(f"try_cast({c} AS decimal(18,4))") if isinstance(c, str) else c.try_cast("decimal(18,4)") for c in chain], F.lit(0).cast("decimal(18,4)"))


def _words(part: Column) -> Column:
    """Words between blanks, once each, case aside; the first spelling stays."""
    words = F.filter(F.split(F.coalesce(part, F.lit("")), " "), lambda w: w != "")
    return F.filter(words, lambda w, i: ~F.exists(F.slice(words, F.lit(1), i), lambda v: F.lower(v) == F.lower(w)))


def types(line: Column) -> Column:
    """Words of a type line up to its first dash (em, en or hyphen)."""
    return _words(F.regexp_extract(line, r"^([^\u2014\u2013-]*)", 1))


def subtypes(line: Column) -> Column:
    """Words of a type line after its first dash."""
    return _words(F.regexp_extract(line, r"(?s)^[^\u2014\u2013-]*[\u2014\u2013-](.*)$", 1))


def _key(c: Column, name: str) -> Column:
    return F.try_element_at(c, F.lit(name))


def related(parts: Column) -> Column:
    """Related cards of a list of maps; id, component, name, type_line and uri must be there. Null of an empty list."""
    must = lambda x, k: F.coalesce(_key(x, k), F.raise_error(F.lit(f"a related card without {k}")).cast("string"))
    one = lambda x: F.struct(
        F.lower(must(x, "id")).alias("id"), enum(must(x, "component"), COMPONENTS).alias("component"),
        *[must(x, k).alias(k) for k in ("name", "type_line", "uri")])
    return F.when(F.size(parts) > 0, F.transform(parts, one))


def faces(maps: Column) -> Column:
    """Faces of a list of maps: every key may be missing; lists are JSON text, images are always null. Null of an empty list."""
    def one(x: Column) -> Column:
        listed = lambda k: colors(F.from_json(_key(x, k), "array<string>"))
        plain = ("artist", "defense", "loyalty", "power", "toughness", "printed_name", "printed_text", "printed_type_line", "watermark")
        layout = _key(x, "layout")
        line = _key(x, "type_line")
        return F.struct(
            *[_key(x, k).alias(k) for k in plain], *[F.lower(_key(x, k)).alias(k) for k in ("artist_id", "illustration_id", "oracle_id")],
            _key(x, "cmc").cast("decimal(18,4)").alias("cmc"), listed("colors").alias("colors"), listed("color_indicator").alias("color_indicator"),
            *[normalize(_key(x, k)).alias(k) for k in ("flavor_text", "oracle_text")], F.when(layout.isNotNull(), enum(layout, LAYOUTS)).alias("layout"),
            *[F.coalesce(_key(x, k), F.lit("")).alias(k) for k in ("mana_cost", "name")], types(line).alias("types"), subtypes(line).alias("subtypes"),
            F.lit(None).cast("map<string,string>").alias("image_uris"))

    return F.when(F.size(maps) > 0, F.transform(maps, one))


def parse(raw: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Raw rows to typed cards: unknown rarities are common, unknown colours go, a bad release date is an error.

    Columns of RAW that the table lacks are null. Legalities stay a map of status, and legal tells for each format if it may be played.
    Of the record of some ninety columns only the given ones are built.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RAW)
    held = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    c = F.col
    lists = lambda name, values: F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda x: enum(x, values))
    plain = [f.name for f in schema]
    changed = {
        "oracle_id": lambda: F.lower("oracle_id"), "layout": lambda: enum(c("layout"), LAYOUTS),
        "image_status": lambda: F.when(c("image_status").isNotNull(), enum(F.lower("image_status"), IMAGE_STATUSES)),
        "image_uris": lambda: F.when(c("image_uris").isNotNull(), F.struct(*[_key(c("image_uris"), k).alias(k) for k in IMAGES])),
        "oracle_text": lambda: normalize(c("oracle_text")), "flavor_text": lambda: normalize(c("flavor_text")),
        **{k: lambda k=k: colors(c(k)) for k in ("colors", "color_identity", "color_indicator", "produced_mana")},
        "cmc": lambda: F.coalesce("cmc", F.lit(0.0)), "all_parts": lambda: related(c("all_parts")), "card_faces": lambda: faces(c("card_faces")),
        "games": lambda: lists(c("games"), PLATFORMS), "finishes": lambda: lists(c("finishes"), FINISHES), "set_id": lambda: F.lower("set_id"),
        "set_type": lambda: enum(c("set_type"), SET_TYPES), "rarity": lambda: enum(c("rarity"), RARITIES), "card_back_id": lambda: F.lower("card_back_id"),
        "artist_ids": lambda: F.transform("artist_ids", F.lower), "illustration_id": lambda: F.lower("illustration_id"), "border_color": lambda: enum(c("border_color"), BORDERS),
        "frame": lambda: enum(c("frame"), FRAMES), "security_stamp": lambda: F.when(c("security_stamp").isin(*STAMPS), c("security_stamp")),
        "released_at": lambda: F.to_date("released_at"), **{k: lambda k=k: F.coalesce(k, F.lit(False)) for k in ("digital", "promo")},
        "prices": lambda: F.struct(*[_key(c("prices"), k).try_cast("decimal(18,4)").alias(k) for k in PRICES]),
        "preview": lambda: F.when(F.size("preview") > 0, F.struct(F.to_date(F.when(_key(c("preview"), "previewed_at") != "", _key(c("preview"), "previewed_at"))).alias("previewed_at"),
                                                                  *[_key(c("preview"), k).alias(k) for k in ("source_uri", "source")])),
        "card_id": lambda: F.lower("id"), "types": lambda: types(c("type_line")), "subtypes": lambda: subtypes(c("type_line")),
        "legal": lambda: F.struct(*[F.coalesce(_key(c("legalities"), k).isin("legal", "restricted"), F.lit(False)).alias(k) for k in FORMATS]),
        "price": lambda: price(_key(c("prices"), "usd"), _key(c("prices"), "usd_foil"), _key(c("prices"), "usd_etched")),
    }
    every = ["card_id", *[k for k in plain if k != "id"], "types", "subtypes", "legal", "price"]
    return held.select(*[(changed[k]() if k in changed else c(k)).alias(k) for k in every if columns is None or k in columns])


def split(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Core and metadata columns; both read the same parent."""
    return cards.select(*CORE), cards.select(*META)


def symbols(document: DataFrame) -> DataFrame:
    """Rows of a symbol list document, keyed by symbol; cmc defaults to 0, a symbol given twice is an error."""
    rows = document.select(F.explode("data").alias("s")).select("s.*").withColumn("cmc", F.coalesce("cmc", F.lit(0.0)))
    counted = rows.groupBy("symbol").agg(F.count("*").alias("_n"), F.first("cmc").alias("cmc"))
    return counted.select(F.when(F.col("_n") == 1, F.col("symbol")).otherwise(F.raise_error(F.concat(F.lit("symbol given twice: "), "symbol"))).alias("symbol"), "cmc")


def parser_input(core: DataFrame) -> DataFrame:
    """name, type line with its types before an em dash, rules text, and empty optional columns."""
    line = F.concat_ws(" — ", F.array_join("types", " "), F.when(F.size("subtypes") > 0, F.array_join("subtypes", " ")))
    return core.select("name", "mana_cost", line.alias("type_line"), "oracle_text", "power", "toughness", "loyalty")
