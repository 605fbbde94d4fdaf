"""Vector functions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NaN for a zero vector; vectors of unequal length raise an error."""
    size = norm(a) * norm(b)
    similarity = F.when(size == 0, F.lit(float("nan"))).otherwise(dot(a, b) / size)
    return F.when(F.size(a) == F.size(b), similarity).otherwise(F.raise_error(F.lit("vectors differ in length")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def component(v: Column, k: int) -> Column:
    """Component k from 0, 0.0 if absent."""
    return F.coalesce(F.get(v, F.lit(k)).cast("double"), F.lit(0.0))


def noise(v: Column, key: Column, scale: float, seed: int) -> Column:
    """Gaussian noise by Box-Muller from hashes of key and place: the same on every run."""
    unit = lambda i, salt: (F.pmod(F.xxhash64(key, i, F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    return F.transform(_doubles(v), lambda x, i: x + scale * F.sqrt(-2 * F.ln(unit(i, 1))) * F.cos(2 * 3.141592653589793 * unit(i, 2)))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean per dimension of the vectors whose mask is 1; zeros if none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda p: p["m"] == 1), lambda p: _doubles(p["v"]))
    total = F.aggregate(kept, F.transform(_doubles(vectors[0]), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
