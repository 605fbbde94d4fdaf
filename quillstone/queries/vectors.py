"""Vector analytics over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.operators import charts
from quillstone.operators import layouts as L
from quillstone.operators import neighbours as N
from quillstone.operators import relational as R
from quillstone.operators import vectors as VO
from quillstone.queries.registry import query, table

#: Vectors without clusters, as those of the tables are, can't keep much of their neighbourhoods in a plane.
TRUST = 0.53


@query("""WITH e AS (SELECT vec_id, vec_id % 97 AS card_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT t.card_id AS target, c.card_id, max(list_cosine_similarity(t.v, c.v)) AS similarity FROM e t, e c WHERE t.card_id IN (3, 50, 96) AND t.card_id <> c.card_id GROUP BY ALL)
SELECT target, card_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, card_id) AS rank FROM s) WHERE rank <= 5""")
def knn_cosine(spark, d):
    e = table(spark, d, "embeddings").withColumn("card_id", F.col("vec_id") % 97)
    return VO.knn(e, e.where(F.col("card_id").isin(3, 50, 96))).withColumn("similarity", F.round("similarity", 6))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT label, unnest(range(0, len(v))) AS d, unnest(v) AS x FROM e), c AS (SELECT label, list(m ORDER BY d) AS m FROM (SELECT label, d, avg(x) AS m FROM u GROUP BY ALL) GROUP BY label),
s AS (SELECT label + 1 AS cluster_id, pow(list_distance(v, m), 2) AS distance FROM e JOIN c USING (label)) SELECT cluster_id, count(*) AS n, round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS deviation FROM s GROUP BY cluster_id""")
def cluster_stats(spark, d):
    e = table(spark, d, "embeddings").withColumn("cluster_id", F.col("label") + 1)
    means = e.select("cluster_id", F.posexplode("embedding").alias("d", "x")).groupBy("cluster_id", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("centroid"))
    stats = R.cluster_stats(VO.assign(e, centroids, "vec_id"))
    return stats.select("cluster_id", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS component_0, round(CAST(embedding[2] AS DOUBLE), 6) AS component_1, CAST(0 AS DOUBLE) AS component_99 FROM embeddings")
def flattened_components(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.component(F.col("embedding"), 0), 6).alias("component_0"), F.round(V.component(F.col("embedding"), 1), 6).alias("component_1"), V.component(F.col("embedding"), 99).alias("component_99"))


@query("SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mean FROM embeddings WHERE vec_id % 2 = 1 GROUP BY label")
def masked_mean_pooling(spark, d):
    means = VO.masked_means(table(spark, d, "embeddings").withColumn("mask", F.col("vec_id") % 2), "label", "embedding", "mask")
    return means.select("label", F.round(F.col("mean")[0], 6).alias("mean"))


@query()
def kmeans_assign(spark, d):
    return VO.kmeans(table(spark, d, "embeddings"), "vec_id", k=8)[0]


@query()
def pca_project(spark, d):
    return VO.pca(table(spark, d, "embeddings"), "vec_id", rank=10)


@query()
def umap_layout(spark, d):
    """All vectors, with the defaults of the operator: 50 neighbours, 500 epochs."""
    return L.umap(table(spark, d, "embeddings"), "vec_id")


@query()
def umap_grid_chart(spark, d):
    """Half of the vectors, as the operator samples them; all twelve combinations of 100 epochs."""
    points = R.sample_share(table(spark, d, "embeddings"), "vec_id", 0.5)
    return charts.grid(L.umap_grid(points, "vec_id"))


@query("SELECT count(*) AS points, count(*) FILTER (vec_id % 20 = 0) AS queries, TRUE AS over_95 FROM embeddings")
def neighbour_recall(spark, d):
    """The graph by descent from small buckets, against the exact neighbours of every twentieth vector."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0")
    exact = N.exact_neighbours(e, asked, "vec_id", 15)
    share = N.recall(N.neighbour_graph(e, "vec_id", 15, bucket=64), exact)
    return e.agg(F.count("*").alias("points"), F.count_if(F.col("vec_id") % 20 == 0).alias("queries")).withColumn("over_95", F.lit(share > 0.95))


@query("SELECT count(*) AS points, TRUE AS kept FROM embeddings")
def layout_trust(spark, d):
    """How far the layout keeps neighbourhoods, over every twentieth vector: more than TRUST, where places at random have 0.5."""
    e = table(spark, d, "embeddings")
    trust = N.trustworthiness(e, L.umap(e, "vec_id"), e.where("vec_id % 20 = 0"), "vec_id")
    return e.agg(F.count("*").alias("points")).withColumn("kept", F.lit(trust > TRUST))


@query()
def encode_texts(spark, d):
    return VO.encode(table(spark, d, "benchmark").withColumnRenamed("item_id", "text_entry_id"), "text_entry_id")


@query()
def embedding_noise(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.noise(F.col("embedding"), F.col("vec_id"), 1e-3, 42).alias("embedding"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, TRUE AS moved, TRUE AS near, TRUE AS again FROM embeddings")
def embedding_noise_bounds(spark, d):
    """Noise moves every vector a little, and the same on every run."""
    e = table(spark, d, "embeddings")
    noisy = V.noise(F.col("embedding"), F.col("vec_id"), 1e-3, 42)
    far = F.array_max(F.zip_with(noisy, F.col("embedding").cast("array<double>"), lambda a, b: F.abs(a - b)))
    return e.select("vec_id", F.size(noisy).alias("n"), (far > 0).alias("moved"), (far < 1e-3 * 7).alias("near"), (noisy == V.noise(F.col("embedding"), F.col("vec_id"), 1e-3, 42)).alias("again"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id AS cluster_id, v AS m FROM e WHERE vec_id < 5),
d AS (SELECT e.vec_id, cluster_id, pow(list_distance(v, m), 2) AS distance, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(v, m), cluster_id) AS k FROM e, c)
SELECT vec_id, cluster_id, round(distance, 6) AS distance FROM d WHERE k = 1""")
def kmeans_nearest_centroid(spark, d):
    """Every vector with the nearest of given centroids."""
    e = table(spark, d, "embeddings")
    centroids = e.where("vec_id < 5").select(F.col("vec_id").alias("cluster_id"), F.col("embedding").alias("centroid"))
    return VO.nearest_centroid(e, centroids, "vec_id").withColumn("distance", F.round("distance", 6))


@query("""SELECT 'Passive Abilities' AS series, '#9467bd' AS color, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y, 'vector ' || vec_id AS hover FROM embeddings WHERE label <> 0""")
def scatter_chart(spark, d):
    e = table(spark, d, "embeddings").select(F.when(F.col("label") == 0, "Full").otherwise("passive").alias("text_type"), F.concat(F.lit("vector "), "vec_id").alias("text"), F.col("embedding").cast("array<double>").alias("components"))
    return charts.scatter(e, "text_type", "text").withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})
