"""Findings of the third review: layouts in blocks, and sites listed in tasks."""

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import layouts as L
from quillstone.operators import neighbours as N
from quillstone.plans import site_build
from quillstone.sources import io


def shuffled(spark, run) -> int:
    """Bytes that the stages of run() write into shuffles."""
    sc = spark.sparkContext
    none, store = sc._jvm.java.util.ArrayList(), sc._jsc.sc().statusStore()

    def total():
        held = store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(held.apply(i).shuffleWriteBytes() for i in range(held.size()))

    before = total()
    run()
    return total() - before


def test_layout_in_blocks_keeps_what_it_starts_from(spark):
    """Vectors without clusters: blocks that see each other's places late don't lose the principal components."""
    x = np.random.default_rng(8).standard_normal((1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "id long, embedding array<float>").checkpoint()
    made = L.umap(df, "id", neighbors=15, epochs=200, block=200)
    assert N.trustworthiness(df, made, df.where("id % 3 = 0"), "id") > 0.65


def test_layout_deals_edges_once(spark):
    """Ten times the jobs send places only: shuffles don't grow with jobs times edges."""
    n, k = 4000, 40
    points = spark.range(n).select("id").checkpoint()
    edges = points.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(k)))).select(F.col("id").alias("a"), ((F.col("id") + F.col("j") * 37) % n).alias("b"), F.lit(1.0).alias("weight")).where("a <> b").checkpoint()
    few, many = (shuffled(spark, lambda t=t: L.layout(points, edges, 0.5, 20, 1, block=1000, together=t).count()) for t in (20, 2))
    assert many < 2 * few


def test_files_are_listed_in_tasks(spark, tmp_path):
    """The same files as Spark's reader finds, without a status of each on the driver: no plan has an index of files."""
    for k, name in enumerate(["a.md", "b/c.md", "b/d e/f.md", "b/g.bin", "_h/i.md", ".j.md", "b/k#l.md"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * k)
    own = io.read_files(spark, str(tmp_path), "*.md")
    theirs = io.read_binary(spark, str(tmp_path), "*.md").select("path", "length", "content").collect()
    assert {r["length"]: bytes(r["content"]) for r in own.collect()} == {0: b""} | {r["length"]: bytes(r["content"]) for r in theirs}  # theirs has no empty files
    assert {r["path"] for r in own.collect()} == {"a.md", "b/c.md", "b/d e/f.md", "b/k#l.md"} and not own.inputFiles()
    pages = site_build.read_pages(spark, str(tmp_path), ignore=("^b/d",))
    assert {r["path"] for r in pages.collect()} == {"a.md", "b/c.md", "b/k#l.md"} and not pages.inputFiles()
