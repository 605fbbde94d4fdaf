"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import math
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.io import shared_folder

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession, rows_per_batch: int = 512) -> None:
    """Let Python workers import this package and bound the rows of an Arrow batch.

    Texts may be very long, so batches are kept to a few hundred rows.
    """
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows_per_batch or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows_per_batch)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() write to the shared folder the cluster names; without a name, to a local one in local mode, else this is an error."""
    shared_folder(spark)


def words(text: Column) -> Column:
    """The words of a text, in order; none of a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row (a lambda variable is never inlined)."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of df has, whatever its case, so that no column of the user's is lost."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def groups_for(rows: int, per_group: int) -> int:
    return max(1, math.ceil(rows / per_group))


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: read again it costs no work, and no executor's loss harms it."""
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits in one of bitmap_construct_agg's bitmaps.
BITMAP = 1 << 15


def parted(frame: DataFrame, key: str, keys: DataFrame, most: int = 1 << 12) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in keys, rows whose key is surely not); frame is not shuffled. key is a column of 64-bit hashes of both.

    keys are marked in bitmaps, which are broadcast: 32 bits a key, up to `most` bitmaps of 4 KB each. With more keys than these bear,
    more rows pass that have none, so an exact join comes after it. keys are read twice; rows of a null key have none.
    """
    bucket, bits, may = fresh(frame, "bucket", "bits", "may")
    room = min(max(1, math.ceil(keys.count() * 32 / BITMAP)), most) * BITMAP
    place = F.pmod(F.col(key), F.lit(room))
    own, at = F.floor(place / BITMAP).alias(bucket), F.pmod(F.col(key), F.lit(BITMAP))
    bitmaps = keys.where(F.col(key).isNotNull()).select(own, at.alias(bits)).repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg(bits).alias(bits))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = frame.select("*", own).join(F.broadcast(bitmaps), bucket, "left").withColumn(may, F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False)))
    return found.where(F.col(may)).drop(bucket, bits, may), found.where(~F.col(may)).drop(bucket, bits, may)


def release() -> None:
    """Give memory that a worker no longer uses back to the system, where the C library can; workers outlive their tasks."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
