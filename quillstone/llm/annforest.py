"""Approximate nearest neighbours with a forest of hash prefixes.

Rows are dealt into cells by the first bits of a hash string (signs of random projections), and full cells into blocks. A
query goes to the cells whose bits cost it the least to flip, as many as the recall needs, which is found on a bounded sample.
Each block keeps, for every tree, a sorted array of long hash strings. A query descends every tree to its longest matching
prefix, then all trees ascend together, one bit at a time, until the matched runs hold enough rows; those are measured
exactly. How many are enough is found on the sample too: vectors in clusters need few, vectors without any structure nearly all.
"""

from __future__ import annotations

from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import groups_for, prepare

BITS = 32


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part: no null, null component, NaN, infinity or zero vector."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        embeddings.select("vec_id", v.cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull())
        .where(~bad & F.exists(v, lambda x: x != 0.0))
    )


class Forest:
    """Sorted hash strings of one block of vectors."""

    def __init__(self, x: np.ndarray, trees: int, seed: int):
        self.x = x
        self.norms = np.einsum("ij,ij->i", x, x)
        rng = np.random.default_rng(seed)
        self.center = x.mean(0)
        self.planes = rng.standard_normal((trees, x.shape[1], BITS))
        codes = self.codes(x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        place = (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))
        out = np.empty((len(self.planes), len(x)), dtype=np.uint64)
        for t, plane in enumerate(self.planes):
            out[t] = ((x - self.center) @ plane > 0).astype(np.uint64) @ place
        return out

    def matched(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every tree and query, the run of rows that share a prefix of depth bits."""
        low = np.uint64((1 << (BITS - depth)) - 1)
        start, stop = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(len(codes)):
            start[t] = np.searchsorted(self.sorted[t], codes[t] & ~low, "left")
            stop[t] = np.searchsorted(self.sorted[t], codes[t] | low, "right")
        return start, stop

    def candidates(self, q: np.ndarray, enough: int):
        """Of each query, the distinct rows in the runs of the deepest level, equal in all trees, that holds enough."""
        codes = self.codes(q)
        lo, hi = np.zeros(codes.shape, np.int64), np.full(codes.shape, len(self.x), np.int64)
        open_ = np.ones(len(q), bool)
        for depth in range(BITS, -1, -1):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            a, b = self.matched(codes[:, at], depth)
            done = (b - a).sum(0) >= enough
            lo[:, at[done]], hi[:, at[done]] = a[:, done], b[:, done]
            open_[at[done]] = False
        for j in range(len(q)):
            hit = np.zeros(len(self.x), bool)
            for t in range(len(codes)):
                hit[self.order[t, lo[t, j] : hi[t, j]]] = True
            yield np.flatnonzero(hit)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class Block:
    """Equal vectors collapse into a class, which keeps the smallest ids: later ones can't be among the nearest k."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, trees: int, seed: int, fraction: float):
        raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
        _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
        order = np.lexsort((ids, inverse))
        starts = np.searchsorted(inverse[order], np.arange(len(first) + 1))
        self.members = [ids[order[a : min(b, a + k + 1)]] for a, b in zip(starts[:-1], starts[1:])]
        self.forest = Forest(x[first], trees, seed)
        self.measured = 0  # rows that queries were compared with
        self.k, self.enough = k, enough_for(fraction, len(first), k, trees)

    def nearest(self, ids: np.ndarray, q: np.ndarray) -> list[tuple[int, int, float]]:
        out, k = [], self.k
        for own, v, found in zip(ids.tolist(), q, self.forest.candidates(q, self.enough)):
            rough = self.forest.norms[found] - 2 * (self.forest.x[found] @ v)
            self.measured += len(found)
            if len(found) > 3 * k + 8:  # measured exactly below, in double precision; what rounding can't tell apart stays
                bar = np.partition(rough, 3 * k + 4)[3 * k + 4]
                found = found[rough <= bar + 1e-9 * (1 + abs(bar) + float(v @ v))]
            d = exact(v, self.forest.x[found])
            best: list[tuple[float, int]] = []
            for c, s in zip(found.tolist(), d.tolist()):
                best += [(s, m) for m in self.members[c].tolist() if m != own]
            out += [(own, m, s) for s, m in sorted(best)[:k]]
        return out


def enough_for(fraction: float, rows: int, k: int, trees: int) -> int:
    """Rows in the runs of all trees at which a query stops ascending: k and itself for each tree at least."""
    return max(trees * (k + 1), int(fraction * rows * trees / 8))


def fit_fraction(sample: np.ndarray, k: int, trees: int, seed: int, recall: float) -> float:
    """The smallest share of candidates (runs of all trees, over an eighth of trees x rows) that reaches the recall on the sample."""
    if len(sample) <= 20 * k:
        return 8.0
    forest = Forest(sample, trees, seed)
    picked = np.arange(0, len(sample), max(1, len(sample) // 200))
    true = [set(np.argsort(exact(sample[i], sample), kind="stable")[1 : k + 1].tolist()) for i in picked]

    def reached(fraction: float) -> bool:
        got = forest.candidates(sample[picked], enough_for(fraction, len(sample), k, trees))
        return np.mean([len(t & set(c.tolist())) / len(t) for t, c in zip(true, got)]) >= recall

    low, high = 0.005, 0.01
    while not reached(high):
        low, high = high, 2 * high
        if high > 8:
            return 8.0
    for _ in range(3):
        middle = (low * high) ** 0.5
        low, high = (low, middle) if reached(middle) else (middle, high)
    return high


class Router:
    """Cells of the first bits, the blocks of each, and how many cells a query is sent to."""

    def __init__(self, sample: np.ndarray, rows: float, per_block: int, k: int, seed: int, recall: float):
        self.bits = min(12, max(0, int(np.ceil(np.log2(max(1.0, rows / per_block)))))) if len(sample) > 20 * k else 0
        self.center = sample.mean(0) if len(sample) else 0.0
        self.planes = np.random.default_rng(seed + 1).standard_normal((sample.shape[1], self.bits))
        share = np.bincount(self.cells(sample), minlength=1 << self.bits) / len(sample) if len(sample) else np.ones(1)
        self.salts = np.maximum(1, np.ceil(share * rows / per_block)).astype(np.int64)
        self.probes = 1 << self.bits
        if self.bits:
            picked = np.arange(0, len(sample), max(1, len(sample) // 200))
            place = np.argsort(self.order(sample[picked]), axis=1)  # of each cell, in the query's order
            own = self.cells(sample)
            at = [place[j, own[np.argsort(exact(sample[i], sample), kind="stable")[1 : k + 1]]] for j, i in enumerate(picked)]
            self.probes = int(np.quantile(np.concatenate(at), recall, method="higher")) + 1

    def signs(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) @ self.planes

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (self.signs(x) > 0).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells by what it costs to flip the query's bits into theirs."""
        s = self.signs(q)
        every = np.arange(1 << self.bits)[:, None] >> np.arange(self.bits) & 1
        flipped = (s > 0)[:, None, :] != every.astype(bool)
        return np.argsort((flipped * np.abs(s)[:, None, :]).sum(2), axis=1, kind="stable")

    def asked(self, q: np.ndarray):
        """(query, cell, salt) of the blocks that each query is sent to; cells are put in order for a few queries at a time."""
        for start in range(0, len(q), 32):
            for i, cells in enumerate(self.order(q[start : start + 32])[:, : self.probes].tolist(), start):
                yield from ((i, c, s) for c in cells for s in range(self.salts[c]))


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, trees: int = 24, recall: float = 0.95, seed: int = 11,
            rows_per_block: int = 1 << 14, sample_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of queries, the nearest k other rows found, ties to the smaller id.

    Both tables hold vec_id and embedding. Rows that are not usable() take no part; vectors are compared with
    those of their own length only. Rows that share a vec_id with the query are its own and no candidates; of rows that share one
    among themselves the nearest counts, and of query rows the least vector. Fewer than k candidates: all. An empty table gives no
    rows. Other columns are left out. The index is fitted on sample_rows rows, chosen by hash, and holds every row. A
    block is bounded by rows_per_block as far as the sample tells, whatever vectors are frequent, as full cells are dealt by hash of vec_id;
    vectors of a length that the sample lacks are dealt by their count, and all of them are measured. So are those of a table no larger than the sample.
    """
    spark = embeddings.sparkSession
    prepare(spark, 2048)
    rows, asked = usable(embeddings), usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    counts = {r["n"]: r["count"] for r in rows.groupBy(F.size("embedding").alias("n")).count().collect()}  # a row a length of vectors
    blocks = groups_for(sum(counts.values()), rows_per_block)
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "embedding").limit(sample_rows).collect()  # bounded by sample_rows
    by_length: dict[int, list] = {}
    for r in picked:
        by_length.setdefault(len(r["embedding"]), []).append(r["embedding"])
    each = recall**0.5  # routing and forest miss alike, unless every cell is asked
    routers = {n: Router(np.array(by_length.get(n, np.zeros((0, n)))), c, rows_per_block, k, seed, each) for n, c in counts.items()}
    all_in = sum(counts.values()) <= sample_rows  # then all are measured
    fractions = {n: 8.0 if all_in else fit_fraction(np.array(v), k, trees, seed, each if routers[n].probes < len(routers[n].salts) else recall) for n, v in by_length.items()}
    tools = spark.sparkContext.broadcast((fractions, routers))  # bounded by the sample

    def place(batches):
        for pdf in batches:
            for (kind, dim), part in pdf.assign(dim=pdf["embedding"].map(len)).groupby(["kind", "dim"], sort=False):
                router = tools.value[1][int(dim)]
                ids = part["vec_id"].to_numpy(np.int64)
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                if kind == 0:
                    cells = router.cells(x)
                    places = ((i, c, (v * 0x9E3779B97F4A7C15 >> 40 & 0xFFFFFF) % router.salts[c]) for i, (c, v) in enumerate(zip(cells.tolist(), ids.tolist())))
                else:
                    places = router.asked(x)
                for at in batched(places, 4096):  # a query's copies can be many
                    i = [a[0] for a in at]
                    yield pd.DataFrame({"dim": dim, "cell": [a[1] for a in at], "salt": [a[2] for a in at], "kind": kind, "vec_id": ids[i], "embedding": list(x[i])})

    both = rows.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))
    placed = both.mapInPandas(place, "dim int, cell int, salt int, kind int, vec_id long, embedding array<double>")
    dealt = placed.repartition(2 * blocks, "dim", "cell", "salt").sortWithinPartitions("dim", "cell", "salt", "kind")

    def search(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key, block = None, None
        for pdf in batches:
            for now, part in pdf.groupby(["dim", "cell", "salt"], sort=False):
                if now != key:
                    key, held, block = now, [], None
                for kind, p in part.groupby("kind", sort=True):
                    x = np.stack(p["embedding"].to_numpy()).astype(np.float64) if len(p) else None
                    ids = p["vec_id"].to_numpy(np.int64)
                    if kind == 0:
                        held.append((ids, x))
                        continue
                    if block is None and held:
                        fraction = tools.value[0].get(int(now[0]), 8.0)
                        block = Block(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), k, trees, seed, fraction)
                        held = []
                    if block is not None:
                        yield pd.DataFrame(block.nearest(ids, x), columns=["query_id", "vec_id", "score"])

    found = dealt.mapInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    own = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
