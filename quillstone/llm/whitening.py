"""Whitening of embeddings by their leading principal components.

A randomised range finder with oversampling takes power passes over all centred rows; Rayleigh-Ritz gives components and residuals. Where the
residuals don't fall far enough, the range is expanded to the full dimension, for which one pass is exact. What leaves a task, and what the
driver holds, is a matrix of dimension x range, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import partitions, prepare

#: An entry beyond this times 1024 has no long with room for its own differences, so its row takes no part.
LARGEST = float(1 << 50)
MOST_EXACT = 1 << 62
DECIMAL = pa.decimal128(38, 0)


@dataclass
class Model:
    n: int
    sums: list[int]
    vectors: np.ndarray  # a column a component
    values: np.ndarray  # falling
    trace: float
    full: bool  # whether the range was expanded to the full dimension
    passes: int


def quantised(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and x, long entries floor(1024 * c) + 100000, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))  # false for NaN, as it is greater than all
    return rows.where(F.col(vector).isNotNull() & sound).select(F.col(key).alias("key"), F.transform(v, lambda c: F.floor(c * 1024) + F.lit(100000)).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims)


def split(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S / n as a whole part and a fraction, so that centring loses no digit to the offset of x."""
    return np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])


def gathered(parts: DataFrame) -> DataFrame:
    """part: some sums of the tasks' matrices, as many as the root of the partitions, so that no number is shuffled by itself for every task."""

    def add(batches):
        total = None
        for b in batches:
            if len(b):
                rows = matrix(b.column(0), len(b.column(0).flatten()) // len(b))
                total = rows.sum(0) if total is None else total + rows.sum(0)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total], pa.list_(pa.float64()))})

    return parts.repartition(max(1, math.isqrt(partitions(parts.sparkSession)))).mapInArrow(add, "part array<double>")


def range_pass(x: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q and the trace of V, of all rows: each task sums its rows' products, and the tasks' matrices are summed by entry."""
    dims, width = q.shape

    def products(batches):
        whole, rest = split(n, sums)
        total, trace = np.zeros((dims, width)), 0.0
        for b in batches:
            if len(b):
                y = (matrix(b.column(0), dims) - whole).astype(np.float64) - rest
                total += y.T @ (y @ q)
                trace += float((y * y).sum())
        yield pa.RecordBatch.from_pydict({"part": pa.array([[trace, *total.ravel()]], pa.list_(pa.float64()))})

    got = gathered(x.select("x").mapInArrow(products, "part array<double>")).select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # dims * width + 1 numbers
    flat = np.zeros(dims * width + 1)
    for r in got:
        flat[r["i"]] = r["v"] / n
    return flat[1:].reshape(dims, width), float(flat[0])


def settled(values: np.ndarray, residual: np.ndarray, k: int, trust: float) -> bool:
    """Whether each of the first k vectors is as near to its eigenvector as double precision tells: its residual over the gap to the next value."""
    gaps = np.abs(np.diff(values))
    near = np.minimum(np.r_[np.inf, gaps[: k - 1]], gaps[:k])
    return bool((residual[:k] <= np.maximum(trust * near, 8 * np.finfo(float).eps * values[0])).all())


def fit(x: DataFrame, components: int = 8, oversample: int = 8, passes: int = 12, trust: float = 1e-12, seed: int = 0) -> Model | None:
    """Components of quantised rows (key, x) of one length; None without rows.

    The range has components + oversample columns. After each pass the rate at which residuals fall tells whether `passes` can suffice; if
    not, or when they are used up, the range becomes the full dimension. Ties between values have gaps of zero, so they go there as well.
    """

    def sums(batches):
        n, high, low = 0, 0, 0
        for b in batches:
            if len(b):
                m = matrix(b.column(0), len(b.column(0).flatten()) // len(b))
                n, high, low = n + len(b), high + (m >> 20).sum(0), low + (m & 0xFFFFF).sum(0)
        if n:
            exact = [n, *[(int(h) << 20) + int(lo) for h, lo in zip(high, low)]]
            yield pa.RecordBatch.from_pydict({"part": pa.array([[Decimal(v) for v in exact]], pa.list_(DECIMAL))})

    parts = x.select("x").mapInArrow(sums, "part array<decimal(38,0)>")
    got = {r["i"]: int(r["v"]) for r in parts.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()}  # dims + 1
    if len(got) < 2:
        return None
    n, dims = got[0], len(got) - 1
    total = [got[i + 1] for i in range(dims)]
    k, width = min(components, dims), min(components + oversample, dims)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    last, done = None, 0
    while True:
        full = width == dims
        if full:
            q = np.eye(dims)
        z, trace = range_pass(x, n, total, q)
        done += 1
        small = q.T @ z
        values, w = np.linalg.eigh((small + small.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        vectors = q @ w
        if full or not values[0] > 0:
            break
        residual = np.linalg.norm(z @ w - vectors * values, axis=0)
        if settled(values, residual, k, trust):
            break
        worst = residual[:k].max() / values[0]
        rate = worst / last if last else 0.5
        left = np.log(trust / worst) / np.log(rate) if 0 < rate < 1 else np.inf
        last = worst
        if done >= passes or (done > 2 and done + left > passes):
            width = dims
        else:
            q = np.linalg.qr(z)[0]
    keep = [i for i in range(k) if values[i] > dims * np.finfo(float).eps * max(values[0], 0.0)]
    vectors = vectors[:, keep]
    if keep:  # either sign is right; the greatest entry is positive, so that reruns agree
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(keep))])
    return Model(n, total, vectors, values[keep], trace, full, done)


def deviations(x: np.ndarray, n: int, whole: np.ndarray, rests: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond 38 digits."""
    d = x - whole
    if x.shape[1] * (n * (float(np.abs(d).max(initial=0)) + 1)) ** 2 < MOST_EXACT:
        y = n * d - np.array(rests, dtype=np.int64)
        exact = (y * y).sum(1).tolist()
    else:
        y = d.astype(object) * n - np.array(rests, dtype=object)
        exact = (y * y).sum(1).tolist()
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], DECIMAL)


def whiten(rows: DataFrame, components: int = 8, oversample: int = 8, passes: int = 12, vector: str = "embedding", key: str = "vec_id", seed: int = 0) -> DataFrame:
    """Per row and component: key, component (from 1), n, deviation (decimal), whitened, explained, identity_error, full.

    Rows whose vector is null or holds null or non-finite entries take no part, nor do those with entries beyond 2^50 in size. Vectors should
    be of one length: the length that most rows have counts (of equally frequent ones the greater) and rows of others take no part. Repeated
    rows and equal or null keys count each by itself; other columns are left out, whatever their names. Directions without variance are no
    components, so a single row, rows that are all equal, empty vectors and empty tables give no rows. full says whether the range was expanded.
    """
    spark = rows.sparkSession
    prepare(spark)
    kind = rows.schema[key].dataType
    schema = f"key {kind.simpleString()}, deviation decimal(38,0), w array<double>"
    x = quantised(rows, vector, key)
    lengths = x.groupBy(F.size("x").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    model = fit(x.where(F.size("x") == lengths["s"]), components, oversample, passes, seed=seed) if lengths else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"{key} {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, full boolean")
    x = x.where(F.size("x") == lengths["s"])
    n, sums, scaled, k = model.n, model.sums, model.vectors / np.sqrt(model.values), len(model.values)

    def project(batches):
        whole, rest = split(n, sums)
        rests = [s % n for s in sums]
        for b in batches:
            if len(b):
                m = matrix(b.column(1), len(sums))
                w = ((m - whole).astype(np.float64) - rest) @ scaled
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), deviations(m, n, whole, rests), lists], names=["key", "deviation", "w"])

    projected = x.mapInArrow(project, schema)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = F.col("w")
    cov = projected.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    out = projected.select("key", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select(
        F.col("key").alias(key), (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("i")].alias("explained"), F.lit(float(error)).alias("identity_error"), F.lit(model.full).alias("full"),
    )
