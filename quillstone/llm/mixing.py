"""Mixing sources to target weights, in DataFrame functions only.

Sources get target sizes by filling up: targets in proportion to weight, none above its cap.
A low-discrepancy schedule then deals equal-token slots to sources: the n-th point of a
golden-ratio sequence falls into one source's interval of the cumulative targets. The k-th slot of a source
takes the k-th block of that source's shuffled stream of documents, which runs twice at most. Slots are places in the mix: sorted by place,
every stretch of it has the sources in proportion to their targets.

A hot source never meets in one task: its documents are dealt into hash buckets of bounded size and its
slots into chunks of the sequence, and both are numbered by adding the offsets of the buckets before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import WORD, fresh, shared_dir

#: Golden-ratio step of a sequence over 2**31 points: odd, nearest to 2**31 / phi, so products stay within 63 bits.
STEP, POINTS = 1327217885, 1 << 31
#: Cells of the unit interval, to find a point's source by an equi-join.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source, n_docs, source_size, weight, target, cum_lo, cum_hi (of targets), total.

    Sources by code point, null last, take the weights in turn. A source is full where its cap over
    its weight is below the common level; the level is the first at which no further source fills up.
    Rows here are sources, not documents, so the running sums go over a short table.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = by_source.withColumn("_i", F.row_number().over(named) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    )
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    before = weighted.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        F.coalesce(F.sum("source_size").over(by_fill), F.lit(0)).alias("_full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0))).alias("_open"),
    )
    # the level if all sources before this one are full; the right level is at the first source it doesn't fill
    level = (F.lit(share) * F.col("_all") - F.lit(cap) * F.col("_full")) / F.col("_open")
    fills = F.lit(cap) * F.col("source_size") / F.col("weight")
    levels = before.withColumn("_level", level).withColumn("_fits", F.col("_level") <= fills)
    chosen = levels.withColumn("_at", F.min(F.when(F.col("_fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("_i"), F.col("_level").alias("level")))).over(everything))
    targets = chosen.withColumn(
        "target",
        F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("_at.level") * F.col("weight"), F.lit(cap) * F.col("source_size"))).cast("double"),
    )
    running = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return targets.select(
        "source", "n_docs", "source_size", "weight", "target",
        F.sum("target").over(running).alias("cum_hi"),
        F.sum("target").over(everything).alias("total"),
    ).withColumn("cum_lo", F.col("cum_hi") - F.col("target"))


def schedule(targets: DataFrame, slots: int, chunk: int = 1 << 16) -> DataFrame:
    """slot, source, rank: the low-discrepancy sequence of sources, each slot ranked from 1 within its source."""
    spark = targets.sparkSession
    edges = targets.where("target > 0").select(
        "source",
        F.floor(F.col("cum_lo") / F.col("total") * POINTS).cast("long").alias("_lo"),
        F.when(F.col("cum_hi") >= F.col("total"), F.lit(POINTS)).otherwise(F.floor(F.col("cum_hi") / F.col("total") * POINTS)).cast("long").alias("_hi"),
    ).where("_hi > _lo")
    cells = edges.withColumn("_cell", F.explode(F.sequence(F.expr(f"_lo div {POINTS // CELLS}"), F.expr(f"(_hi - 1) div {POINTS // CELLS}"))))
    points = spark.range(1, slots + 1).select(F.col("id").alias("slot"), ((F.col("id") % POINTS) * STEP % POINTS).alias("_u"))
    points = points.withColumn("_cell", F.expr(f"_u div {POINTS // CELLS}"))
    dealt = points.join(cells, "_cell").where("_u >= _lo AND _u < _hi").select("slot", "source", F.expr(f"slot div {chunk}").alias("_chunk"))
    inside = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("source", "_chunk").orderBy("slot")))
    counts = dealt.groupBy("source", "_chunk").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        F.col("source").alias("_s"), F.col("_chunk").alias("_c"),
        F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    return inside.join(offsets, inside["source"].eqNullSafe(offsets["_s"]) & (inside["_chunk"] == offsets["_c"])).select(
        "slot", "source", (F.col("_r") + F.col("_before")).cast("long").alias("rank")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0,
        seed: int = 7, docs_per_bucket: int = 4096, slots: int = 1 << 17) -> DataFrame:
    """One row per document: doc_id, source, key_a, key_b, size, source_size, target, taken, place.

    size is the number of words (0 of a null text); taken is how many of them the mix takes, counting
    repeats. place is where the document first comes in the mix: the slot of the schedule that deals its first block, null if none is taken. A null source is a source of its own. Repeated rows count as documents of their own and share
    taken words in any order among themselves; documents without words take none. key_a and key_b are hashes of the row,
    to join whole texts again. Other columns are left out. An empty table gives no rows.
    The sequence deals the blocks, with a little to spare. A source of a few blocks that the sequence serves late gets the ranks it still lacks
    in the slots after it, and each source stops at its target, so a source's words differ from its target by rounding, however large
    a block is.
    """
    keyed = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("key_a"), F.xxhash64(F.lit(~seed), "text", "source", "doc_id").alias("key_b"),
    )
    shared_dir(docs.sparkSession)
    keyed = keyed.checkpoint()  # a few numbers a document: the texts are read once
    targets = source_targets(keyed, weights, share, cap)
    placed = targets.select(F.col("source").alias("_s"), "n_docs", "source_size", "target")
    same = lambda a, b: a["source"].eqNullSafe(b["_s"])
    shuffled = keyed.join(placed, same(keyed, placed)).drop("_s").withColumn(
        "_bucket", F.pmod(F.col("key_a"), F.expr(f"n_docs div {docs_per_bucket} + 1"))
    )
    in_bucket = Window.partitionBy("source", "_bucket").orderBy("key_a", "key_b", "doc_id")
    numbered = shuffled.withColumns({
        "_r": F.row_number().over(in_bucket),
        "_own": F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    })
    per_bucket = shuffled.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    offsets = per_bucket.select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    stream = numbered.join(offsets, same(numbered, offsets) & (numbered["_bucket"] == offsets["_b"])).withColumn("_at", F.col("_own") + F.col("_before")).drop("_s", "_b", "_own", "_before")

    total = targets.agg(F.sum("target")).first()[0] or 0.0  # one number
    block = max(1, math.ceil(total / slots))
    # both runs of the stream: a document covers words _at.. and source_size + _at..
    runs = stream.withColumn("_run", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_lo", F.col("_at") + F.col("_run") * F.col("source_size"))
    pieces = runs.withColumn(
        "_block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"_lo div {block}"), F.expr(f"(_lo + size - 1) div {block}"))))
    )
    length = math.ceil(1.02 * slots) + 64
    dealt = schedule(targets, length).select(F.col("source").alias("_s"), (F.col("rank") - 1).alias("_k"), F.col("slot").alias("_slot"))
    limit = F.floor(F.col("target") + 0.5)
    # the blocks that the sequence has not come to: from the one after its last to the target's last block
    got = dealt.groupBy(F.col("_s").alias("_g")).agg(F.max("_k").alias("_most"))
    first = F.coalesce(F.col("_most") + 1, F.lit(0))
    behind = targets.join(got, F.col("source").eqNullSafe(F.col("_g")), "left").withColumn("_need", F.expr(f"(floor(target + 0.5) - 1) div {block}")).where((first <= F.col("_need")) & (limit > 0))
    rest = behind.select(F.col("source").alias("_s"), F.explode(F.sequence(first, F.col("_need"))).alias("_k"), (F.lit(length + 1) - first).alias("_from"))
    rest = rest.select("_s", "_k", (F.col("_k") + F.col("_from")).alias("_slot"))
    taken = pieces.join(dealt.unionByName(rest), pieces["source"].eqNullSafe(F.col("_s")) & (pieces["_block"] == F.col("_k")), "left")
    part = F.least(F.col("_lo") + F.col("size"), (F.col("_block") + 1) * block, limit) - F.greatest(F.col("_lo"), F.col("_block") * block)
    words = F.when(F.col("_k").isNotNull(), F.greatest(part, F.lit(0)))
    place = F.min(F.when(words > 0, F.col("_slot"))).alias("place")
    by = ["source", "_bucket", "_r", "doc_id", "key_a", "key_b", "size", "source_size", "target"]
    return taken.groupBy(*by).agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"), place).drop("_bucket", "_r")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix holds, each as many times as its taken words make it whole, to the nearest whole document.

    All columns stay as they are, whatever their names. An empty table gives no rows.
    """
    found = mix(docs, **options)
    seed = options.get("seed", 7)
    ka, kb, copies, n = fresh(docs, "key_a", "key_b", "copies", "n")
    whole = (
        found.groupBy(F.col("key_a").alias(ka), F.col("key_b").alias(kb)).agg(F.sum(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")))).alias("_c"), F.count("*").alias("_m"))
        .select(ka, kb, F.round(F.col("_c") / F.col("_m")).cast("int").alias(copies)).where(F.col(copies) > 0)
    )
    keyed = docs.withColumns({ka: F.xxhash64(F.lit(seed), "doc_id", "source", "text"), kb: F.xxhash64(F.lit(~seed), "text", "source", "doc_id")})
    return keyed.join(whole, [ka, kb]).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
