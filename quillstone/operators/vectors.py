"""Nearest neighbours of named cards, clusters, projections and encodings of embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.operators.neighbours import against, matrix
from quillstone.operators.relational import top_per_group


class Alike:
    """For each pair of a target card and another card the greatest cosine of their entries."""

    def __init__(self, q: pa.Table, names: list[str]):
        self.names, self.kind = names, q.schema.field("c").type
        self.x = self.unit(matrix(q.column("v")))
        card, self.at = np.unique(q.column("c").to_numpy(), return_inverse=True)
        self.cards, self.found = card, []

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / np.linalg.norm(x, axis=1)[:, None]

    def take(self, points: pa.RecordBatch) -> None:
        x = self.unit(matrix(points.column("v")))
        if x.shape[1] != self.x.shape[1]:
            raise ValueError("vectors differ in length")
        cards, at = np.unique(points.column("c").to_numpy(zero_copy_only=False), return_inverse=True)
        for t, name in enumerate(self.cards):
            own, best = self.x[self.at == t], np.full(len(x), -np.inf)
            for lo in range(0, len(own), 1024):
                s = x @ own[lo : lo + 1024].T
                best = np.fmax(best, np.where(np.isnan(s), -np.inf, s).max(1))
            most = np.full(len(cards), -np.inf)
            np.maximum.at(most, at, best)
            ok = np.isfinite(most) & (cards != name)
            self.found.append(pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), name, dtype=self.cards.dtype), self.kind), pa.array(cards[ok], self.kind), pa.array(most[ok])], names=self.names))

    def result(self):
        yield from self.found


def knn(entries: DataFrame, targets: DataFrame, k: int = 5, card: str = "card_id", vector: str = "embedding", most_targets: int | None = None) -> DataFrame:
    """target, card, similarity, rank: the k cards whose entries are most similar to any entry of the target card.

    Entries of targets are dealt into groups, each of which meets all entries; with most_targets, more of them are an error. A maximum per pair
    of cards is taken before the shuffle, then a top k.
    """
    asked = targets.select(F.col(card).alias("c"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("c").isNotNull())
    n = asked.count()
    if most_targets is not None and n > most_targets:
        raise ValueError(f"more than {most_targets} target entries")
    kind, names = entries.schema[card].dataType.simpleString(), ["target", card, "s"]
    held = entries.select(F.col(card).alias("c"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("c").isNotNull())
    numbered = lambda rows: rows.withColumn("c", F.col("c").cast(kind)).withColumn("id", F.xxhash64("c", "v"))
    scored = against(numbered(asked), numbered(held), lambda q: Alike(q, names), f"target {kind}, {card} {kind}, s double", (n, held.count()))
    best = scored.groupBy("target", card).agg(F.max("s").alias("similarity"))
    return top_per_group(best, ["target"], [F.desc("similarity"), F.col(card)], k)


def masked_means(rows: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """key, mean: of each key the mean per dimension of the vectors whose mask is 1, zeros if none; sums are made before the shuffle."""
    parts = rows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("k", "x"), mask)
    means = parts.groupBy(key, "k").agg(F.coalesce(F.avg(F.when(F.col(mask) == 1, F.col("x"))), F.lit(0.0)).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("mean"))  # a row a dimension


def nearest_centroid(points: DataFrame, centroids: DataFrame, key: str, vector: str = "embedding", most: int = 10_000) -> DataFrame:
    """key, cluster_id, distance (squared) of the nearest of at most `most` centroids (cluster_id, centroid), ties to the smaller id."""
    held = centroids.select("cluster_id", "centroid").limit(most + 1).collect()  # bounded by most
    if len(held) > most:
        raise ValueError(f"more than {most} centroids")
    held.sort(key=lambda r: r["cluster_id"])
    shared = points.sparkSession.sparkContext.broadcast(([r["cluster_id"] for r in held], np.array([r["centroid"] for r in held], dtype=np.float64)))
    kind, name = points.schema[key].dataType.simpleString(), centroids.schema["cluster_id"].dataType.simpleString()

    def place(batches):
        ids, c = shared.value
        for pdf in batches:
            x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            at = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
            d = x - c[at]
            yield pd.DataFrame({key: pdf[key], "cluster_id": [ids[i] for i in at], "distance": (d * d).sum(1)})

    return points.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(place, f"{key} {kind}, cluster_id {name}, distance double")


def assign(points: DataFrame, centroids: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """cluster_id (from 1) and squared distance of every point's own cluster; centroids: cluster_id, centroid."""
    return points.join(centroids, "cluster_id").select(key, "cluster_id", V.squared_distance(F.col(vector), F.col("centroid")).alias("distance"))


def kmeans(points: DataFrame, key: str, k: int = 32, seed: int = 42, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(key, cluster_id, distance), (cluster_id, n, mean, deviation)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from quillstone.operators.relational import cluster_stats

    prepared = points.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed).fit(prepared)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])  # k x dims numbers
    found = model.transform(prepared).select(key, (F.col("prediction") + 1).alias("cluster_id"), V.squared_distance(vector_to_array("features"), centers[F.col("prediction")]).alias("distance"))
    return found, cluster_stats(found)


def pca(points: DataFrame, key: str, rank: int = 50, vector: str = "embedding", center: bool = True) -> DataFrame:
    """key, components: projection on the leading components of the centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    prepared = points.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    scaled = StandardScaler(withMean=center, withStd=False, inputCol="raw", outputCol="features").fit(prepared).transform(prepared)
    return PCA(k=rank, inputCol="features", outputCol="out").fit(scaled).transform(scaled).select(key, vector_to_array("out").alias("components"))


def encode(texts: DataFrame, key: str, text: str = "text", dims: int = 384) -> DataFrame:
    """key, embedding: a hashing encoder that needs no weights; token counts hashed to signed dimensions, unit length."""
    from quillstone.functions.text import search_tokens

    tokens = texts.select(key, F.explode(search_tokens(F.col(text))).alias("token"))
    signed = tokens.groupBy(key, F.pmod(F.xxhash64("token"), F.lit(dims)).cast("int").alias("d")).agg(F.sum(F.when(F.pmod(F.xxhash64(F.lit(1), "token"), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("v"))
    maps = signed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0))
    return maps.select(key, dense.alias("embedding"))
