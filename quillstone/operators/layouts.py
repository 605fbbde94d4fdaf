"""Layouts of neighbour graphs in the plane, several of them at once, by blocks of points that move together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.neighbours import neighbour_graph
from quillstone.sources.io import shared_folder


def bandwidths(d: pd.Series, rounds: int = 64) -> pd.DataFrame:
    """rho and sigma of each list of neighbour distances: rho is the least distance above 0; sigma, by bisection, makes the memberships
    exp(-(d - rho) / sigma) add up to log2 of their number. sigma isn't below a thousandth of the mean distance."""
    out = np.zeros((len(d), 2))
    for size in {len(x) for x in d}:
        rows = [i for i, x in enumerate(d) if len(x) == size]
        if not size:
            continue
        x = np.stack([np.asarray(d.iloc[i], dtype=np.float64) for i in rows])
        rho = np.where((x > 0).any(1), np.where(x > 0, x, np.inf).min(1), 0.0)
        over, want = np.maximum(x - rho[:, None], 0), np.log2(max(size, 2))
        lo, hi, sigma = np.zeros(len(x)), np.full(len(x), np.inf), np.ones(len(x))
        for _ in range(rounds):
            total = np.exp(-over / sigma[:, None]).sum(1)
            high = total > want
            hi, lo = np.where(high, sigma, hi), np.where(high, lo, sigma)
            sigma = np.where(np.isinf(hi), 2 * sigma, (lo + np.minimum(hi, 1e300)) / 2)
        out[rows, 0], out[rows, 1] = rho, np.maximum(np.maximum(sigma, 1e-3 * x.mean(1)), 1e-9)
    return pd.DataFrame(out, columns=["rho", "sigma"])


def fuzzy_graph(neighbours: DataFrame) -> DataFrame:
    """a, b, weight: memberships from neighbour distances (source, target, d) with a solved bandwidth a point, joined for both directions."""

    @F.pandas_udf("rho double, sigma double")
    def solved(d: pd.Series) -> pd.DataFrame:
        return bandwidths(d)

    lists = neighbours.groupBy("source").agg(F.collect_list(F.struct("target", "d")).alias("near"))  # k rows each
    widths = lists.withColumn("w", solved(F.transform("near", lambda p: p["d"])))
    each = widths.select("source", "w", F.explode("near").alias("p"))
    w = each.select(F.least("source", F.col("p.target")).alias("a"), F.greatest("source", F.col("p.target")).alias("b"), F.exp(-F.greatest(F.col("p.d") - F.col("w.rho"), F.lit(0.0)) / F.col("w.sigma")).alias("w"))
    return w.groupBy("a", "b").agg((1 - F.product(1 - F.col("w"))).alias("weight"))


def curve(min_dist: float) -> tuple[float, float]:
    """a and b of 1 / (1 + a r^2b), nearest to 1 up to min_dist and an exponential fall beyond."""
    r = np.linspace(1e-3, 3, 300)
    want = np.where(r < min_dist, 1.0, np.exp(-(r - min_dist)))
    a, b = np.exp(np.linspace(-3, 2, 80))[:, None, None], np.linspace(0.4, 2.5, 80)[None, :, None]
    i, j = np.unravel_index(((1 / (1 + a * r ** (2 * b)) - want) ** 2).sum(2).argmin(), (80, 80))
    return float(a[i, 0, 0]), float(b[0, j, 0])


def move(at: np.ndarray, head: np.ndarray, tail: np.ndarray, beside: np.ndarray, every: np.ndarray, far: np.ndarray, first: int, last: int, epochs: int,
         a: float, b: float, negative: int, rng: np.random.Generator, parts: int = 4) -> None:
    """Move the points `at` through epochs first..last: an edge (head, tail) is taken once in `every` epochs, and with it `negative` others of far.

    Tails from len(at) on are points of other blocks (`beside`), which stay where they are. Edges of an epoch are taken in `parts` lots. A point takes
    the mean of its edges' steps rather than their sum: with a sum, points of many edges leap over each other and what they start from is lost.
    """
    n = len(at)
    pace = 1.0 / max(1.0, (1.0 / every).sum() / n)
    everyone = np.concatenate([at, beside])
    lot = rng.integers(0, parts, len(head))
    for e in range(first, last):
        due = np.floor((e + 1) / every) > np.floor(e / every)
        rate = pace * (1.0 - e / epochs)
        for part in range(parts):
            rows = np.flatnonzero(due & (lot == part))
            if not len(rows):
                continue
            h = head[rows]
            delta = everyone[h] - everyone[tail[rows]]
            r = (delta * delta).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(r > 0, -2 * a * b * r ** (b - 1) / (1 + a * r**b), 0.0)
            step = 2 * np.clip(pull[:, None] * delta, -4, 4)  # for both ends: the other direction of the edge moves the other one
            delta = everyone[h][:, None] - far[rng.integers(0, len(far), (len(rows), negative))]
            r = (delta * delta).sum(2)
            push = 2 * b / ((0.001 + r) * (1 + a * r**b))
            step += np.where(r[:, :, None] > 0, np.clip(push[:, :, None] * delta, -4, 4), 0.0).sum(1)
            for axis in (0, 1):
                everyone[:n, axis] += rate * np.bincount(h, weights=step[:, axis], minlength=n)[:n]
    at[:] = everyone[:n]


def packed(table: pa.Table) -> pa.Table:
    """A block's points (combo, block, place, x, y) as one row of places: in double precision, and in single precision for other blocks."""
    xy = np.c_[table.column("x").to_numpy(), table.column("y").to_numpy()].astype(np.float64)[np.argsort(table.column("place").to_numpy(), kind="stable")]
    return _row(table.column("combo")[0].as_py(), table.column("block")[0].as_py(), xy)


def _row(combo: int, block: int, xy: np.ndarray) -> pa.Table:
    return pa.table({"combo": pa.array([combo], pa.int32()), "block": pa.array([block], pa.int32()), "xy": pa.array([xy.tobytes()], pa.binary()), "seen": pa.array([xy.astype(np.float32).tobytes()], pa.binary())})


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for combo, block, raw in zip(*(batch.column(c).to_pylist() for c in ("combo", "block", "xy"))):
            xy = np.frombuffer(raw).reshape(-1, 2)
            fixed = [pa.array(np.full(len(xy), v, np.int32)) for v in (combo, block)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(len(xy), dtype=np.int32)), pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], names=["combo", "block", "place", "x", "y"])


def mover(curves: dict[int, tuple[float, float]], seed: int, first: int, last: int, epochs: int, negative: int, others: int):
    """A function that moves a block through some epochs, from its edges (place, tail, every) and the places of all blocks of its layout (from, xy or seen)."""

    def run(edges: pa.Table, places: pa.Table) -> pa.Table:
        combo, own = places.column("combo")[0].as_py(), places.column("to")[0].as_py()
        held = {f: (xy, seen) for f, xy, seen in zip(*(places.column(c).to_pylist() for c in ("from", "xy", "seen")))}
        if own not in held:  # a block without points
            return _row(combo, own, np.zeros((0, 2)))
        at = np.frombuffer(held.pop(own)[0]).reshape(-1, 2).copy()
        beside, base, total = [np.zeros((0, 2))], np.zeros(max([own, *held]) + 1, np.int64), len(at)
        for f in sorted(held):
            base[f], total = total, total + len(held[f][1]) // 8
            beside.append(np.frombuffer(held[f][1], np.float32).reshape(-1, 2))
        if edges.num_rows:
            tails, every = (edges.column(c).combine_chunks() for c in ("tail", "every"))
            tails, every = (x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (tails, every))
            head = np.repeat(edges.column("place").to_numpy().astype(np.int64), np.asarray(tails.value_lengths()))
            code = tails.flatten().to_numpy()
            tail = base[code >> 32] + (code & 0xFFFFFFFF)
            rng = np.random.default_rng([seed, combo, own, first])
            others_at = np.concatenate(beside).astype(np.float64)
            far = np.concatenate([at, others_at])[rng.integers(0, total, others)]
            move(at, head, tail, others_at, every.flatten().to_numpy(), far, first, last, epochs, *curves[combo], negative, rng)
        return _row(combo, own, at)

    return run


def layouts(nodes: DataFrame, edges: DataFrame, min_dists: dict[int, float], epochs: int, seed: int, negative: int = 5, together: int | None = None,
            block: int = 65_536, others: int = 4096, spread: int = 16, small: int = 4096) -> DataFrame:
    """combo, id, x, y: a layout for each combo. nodes: combo, id (and x, y to start from, else random ones); edges: combo, a, b, weight.

    Edges are taken as often as their weight is to the greatest; those too light to be taken once are left out. All layouts move at once, `together`
    epochs a job (a twentieth of all, ten at least). Points are dealt by hash into blocks of `block` at most; layouts of more than `small` points have
    `spread` blocks in all at least. A point's edges are one row, and stay where its block is: they are dealt once. In a job a
    block sees where all points of its layout were before it, `others` of them as those that its points keep away from; so what a job sends is places, one
    row from each block to each other. Places are written to the shared folder after each job. The first places and all draws come from hashes and seeds.
    """
    shared_folder(nodes.sparkSession)
    together = together or max(10, epochs // 20)
    curves = {c: curve(d) for c, d in min_dists.items()}
    unit = lambda salt: F.pmod(F.xxhash64("id", "combo", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    start = nodes if "x" in nodes.columns else nodes.select("combo", "id", (20 * unit(1) - 10).alias("x"), (20 * unit(2) - 10).alias("y"))
    start = start.select(F.col("combo").cast("int").alias("combo"), "id", "x", "y").checkpoint()
    sizes = {r["combo"]: r["n"] for r in start.groupBy("combo").agg(F.count("*").alias("n")).collect()}  # a row a combo
    if not sizes or not epochs:
        return start
    cuts = {c: max(-(-n // block), -(-spread // len(sizes)) if n > small else 1) for c, n in sizes.items()}
    count = F.create_map(*[F.lit(x) for c in cuts.items() for x in c])[F.col("combo")]
    dealt = start.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(3)), count).cast("int"))
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy("combo", "block").orderBy("id")) - 1).checkpoint()
    code = F.shiftleft(F.col("block").cast("long"), 32) + F.col("place")
    ends = lambda end: numbered.select("combo", F.col("id").alias(end), code.alias(f"{end}_at"), F.col("combo").alias(f"{end}_combo"))
    known = edges.withColumn("combo", F.col("combo").cast("int")).join(ends("a"), ["combo", "a"]).join(ends("b"), ["combo", "b"])
    most = edges.groupBy("combo").agg(F.max("weight").alias("most"))  # a row a combo
    taken = known.join(F.broadcast(most), "combo").where(F.col("weight") * epochs >= F.col("most")).select(F.col("a_combo").alias("combo"), "a_at", "b_at", (F.col("most") / F.col("weight")).alias("every"))
    both = taken.select("combo", F.explode(F.array(F.struct(F.col("a_at").alias("at"), F.col("b_at").alias("tail")), F.struct(F.col("b_at").alias("at"), F.col("a_at").alias("tail")))).alias("e"), "every")
    keyed = both.select("combo", F.shiftright("e.at", 32).cast("int").alias("block"), F.col("e.at").bitwiseAND(0xFFFFFFFF).cast("int").alias("place"), "e.tail", "every")
    dealings = 4 * sum(cuts.values())  # few blocks meet in a task
    listed = keyed.repartition(dealings, "combo", "block").groupBy("combo", "block", "place").agg(F.array_sort(F.collect_list(F.struct("tail", "every"))).alias("e"))  # a point's edges
    near = listed.select("combo", "block", "place", *[F.col(f"e.{c}").alias(c) for c in ("tail", "every")]).sortWithinPartitions("combo", "block", "place").persist(StorageLevel.DISK_ONLY)
    near.count()  # once it is there, Spark knows how it is dealt, and leaves it in place
    schema = "combo int, block int, xy binary, seen binary"
    at = numbered.drop("id").groupBy("combo", "block").applyInArrow(packed, schema).checkpoint()
    for first in range(0, epochs, together):
        to = F.explode(F.sequence(F.lit(0), count - 1)).alias("to")
        sent = at.select("combo", to, F.col("block").alias("from"), "xy", "seen")
        sent = sent.select("combo", "to", "from", *[F.when((F.col("to") == F.col("from")) == own, F.col(c)).alias(c) for c, own in (("xy", True), ("seen", False))])
        run = mover(curves, seed, first, min(first + together, epochs), epochs, negative, others)
        at = near.groupBy("combo", "block").cogroup(sent.groupBy("combo", "to")).applyInArrow(run, schema).checkpoint()
    near.unpersist()
    moved = at.select("combo", "block", "xy").mapInArrow(unpacked, "combo int, block int, place int, x double, y double")
    return numbered.select("combo", "block", "place", "id").join(moved, ["combo", "block", "place"]).select("combo", "id", "x", "y").checkpoint()


def layout(nodes: DataFrame, edges: DataFrame, min_dist: float, epochs: int, seed: int, negative: int = 5, **options) -> DataFrame:
    """id, x, y: one layout of nodes (id, and x and y to start from, else random ones) by edges (a, b, weight). See layouts()."""
    one = F.lit(0).alias("combo")
    return layouts(nodes.select(one, "*"), edges.select(one, "*"), {0: min_dist}, epochs, seed, negative, **options).drop("combo")


def umap(points: DataFrame, key: str, neighbors: int = 50, min_dist: float = 0.75, epochs: int = 500, seed: int = 43, vector: str = "embedding", **options) -> DataFrame:
    """key, components (two): a layout of the fuzzy neighbour graph of all points, whatever their number, from their principal components."""
    from quillstone.operators.vectors import pca

    shared_folder(points.sparkSession)
    held = points.where(F.col(vector).isNotNull())
    graph = fuzzy_graph(neighbour_graph(held, key, neighbors, vector, seed=seed)).checkpoint()
    start = held.select(F.col(key).alias("id")).distinct()
    if held.limit(3).count() == 3:
        c = pca(held, key, 2, vector)
        first = c.groupBy(F.col(key).alias("id")).agg(*[F.min(F.col("components")[i]).alias(n) for i, n in enumerate(("x", "y"))]).checkpoint()
        most = first.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")).first()["m"] or 1.0
        start = first.select("id", *[(F.col(n) * (10.0 / most)).alias(n) for n in ("x", "y")])  # spread over the width that random places have
    return layout(start, graph, min_dist, epochs, seed, **options).select(F.col("id").alias(key), F.array("x", "y").alias("components"))


def umap_grid(points: DataFrame, key: str, neighbors: tuple[int, ...] = (2, 4, 6, 8), min_dists: tuple[float, ...] = (0.25, 0.5, 0.75), epochs: int = 100, seed: int = 42,
              vector: str = "embedding", **options) -> DataFrame:
    """Layouts of every combination from random places, with coordinates scaled to [0, 1] within each; all combinations are laid out in the same jobs.

    Neighbours are found once, for the greatest number; a smaller one takes the nearest of them.
    """
    from quillstone.operators.relational import minmax

    shared_folder(points.sparkSession)
    found = neighbour_graph(points, key, max(neighbors), vector, seed=seed)
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("d", F.xxhash64("source", "target"), "target"))).checkpoint()
    combos = [(n, d) for n in neighbors for d in min_dists]
    graph = None
    for n in neighbors:
        one = fuzzy_graph(ranked.where(F.col("k") <= n)).withColumn("combos", F.array(*[F.lit(i) for i, c in enumerate(combos) if c[0] == n]))
        graph = one if graph is None else graph.unionByName(one)
    graph = graph.checkpoint().select("a", "b", "weight", F.explode("combos").alias("combo"))
    nodes = points.where(F.col(vector).isNotNull()).select(F.col(key).alias("id")).distinct().withColumn("combo", F.explode(F.sequence(F.lit(0), F.lit(len(combos) - 1))))
    placed = layouts(nodes, graph, {i: d for i, (_, d) in enumerate(combos)}, epochs, seed, **options)
    of = lambda k, t: F.element_at(F.array(*[F.lit(c[k]) for c in combos]), F.col("combo") + 1).cast(t)
    out = placed.select(of(0, "int").alias("n_neighbors"), of(1, "double").alias("min_dist"), F.lit(seed).alias("seed"), F.col("id").alias(key), "x", "y")
    return minmax(out, ["x", "y"], ["n_neighbors", "min_dist"])
