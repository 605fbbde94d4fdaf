"""Change events as a stream: keyed tables kept up to date by micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_write_wins(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of every key."""
    return changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("_r = 1").drop("_r")


def upsert(state: DataFrame, changes: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """State after changes of one row a key: deletes go, adds and changes replace."""
    kept = state.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where(F.col(kind) != "delete").select(*state.columns))


def affected(pages: DataFrame, changed: DataFrame, key: str = "slug") -> DataFrame:
    """Pages to emit anew: those changed, and those that share a tag with one."""
    tags = pages.join(changed.select(key), key, "left_semi").select(F.explode("tags").alias("tag")).distinct()
    by_tag = pages.select(key, F.explode("tags").alias("tag")).join(tags, "tag", "left_semi").select(key)
    return by_tag.unionByName(changed.select(key).join(pages.select(key), key, "left_semi")).distinct()


def tables(spark: SparkSession, top: str, prefix: str = "state-") -> list[int]:
    """Numbers of the whole tables <prefix><number> in a folder, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(top)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [(str(f.getPath().getName()), f.getPath()) for f in system.listStatus(path)]
    return sorted(int(n[len(prefix) :]) for n, at in names if n.startswith(prefix) and system.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")))


def run_counts(spark: SparkSession, path: str, schema, folder: str, files_per_batch: int = 1, name: str | None = None, keep: int = 2) -> DataFrame:
    """event_type, n, total: counts kept by a file stream through foreachBatch, each batch merged into the table once.

    Every state is a table of its own, named by the batch. A batch starts from the last whole state before its own, found in the folder, so
    that a batch that is run again writes the same state again, and a run of the same name goes on where the last one stopped.
    The last `keep` states stay; older ones are deleted.
    """
    top = f"{folder}/counts-{name or uuid.uuid4().hex}"

    def merge(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        now = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        before = [e for e in tables(session, top) if e < epoch]
        if before:
            now = now.unionByName(session.read.parquet(f"{top}/state-{before[-1]}"))
        now.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,2)").alias("total")).write.mode("overwrite").parquet(f"{top}/state-{epoch}")
        jvm = session.sparkContext._jvm
        for old in before[: -max(1, keep - 1)]:
            at = jvm.org.apache.hadoop.fs.Path(f"{top}/state-{old}")
            at.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    held = tables(spark, top)
    if not held:  # no file has come yet
        return spark.createDataFrame([], "event_type string, n long, total decimal(28,2)")
    return spark.read.parquet(f"{top}/state-{held[-1]}")


def windowed(events: DataFrame, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """event_type counts per window of event time; with a delay, late rows are dropped by a watermark."""
    held = events.withWatermark("ts", delay) if delay else events
    return held.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
