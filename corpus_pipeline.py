"""A corpus pipeline: language ID, near duplicates, repeated passages, mixing and packing.

Each stage reads what the one before has written. The operators that SQL can't express are in it, so there is no ORACLE_SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import jaccardforest, langid, mixing, packing, suffixdedup
from quillstone.llm.common import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose language is surely (score of 0.9 or more) another than the lang they state.

    A null text has no letters. A null lang states nothing, so such a document stays. Rows are judged one by one, repeated ones too; extra
    columns stay, whatever their names. An empty table, or one without any lang to learn from, gives no rows.
    """
    model = langid.train(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    pred, score = "lang_pred", "score"
    named = docs.select(F.struct(*docs.columns).alias("row"), "text")  # the columns of the documents can have any name
    found = langid.identify(named, model)
    stated = F.col("row")["lang"]
    kept = found.where((F.col(pred) != "und") & (stated.isNull() | (stated == F.col(pred)) | (F.col(score) < 0.9)))
    return kept.select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least doc_id; repeated rows and rows of null doc_id are copies.

    Ties of the doc_id go to the least hash of the row. Documents without words are classes of their own and stay. Extra columns stay. An
    empty table gives no rows.
    """
    return jaccardforest.join(docs, one_each=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur again; those of which no word stays go.

    Every occurrence goes, the first included. A document that loses nothing stays as it is, null and empty texts too; n_chars of the others
    is that of what is left. Repeated rows are occurrences of each other, and go as a whole if they have over 50 words. Extra columns stay. An
    empty table gives no rows.
    """
    named = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")
    found = suffixdedup.remove(named, length=51, by_word=True, keep_text=True)
    lost = F.col("n_removed") > 0
    kept = found.where(~lost | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("text"), "n_chars": F.when(lost, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"])}
    return kept.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, to the nearest whole document.

    A null source is a source of its own. Documents without words are in no mix and go. Repeated rows share what is taken of them. Extra columns
    stay. An empty table gives no rows.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null text is its separator alone. Every row is packed, repeated ones too; other columns are left out, as these are rows of pieces. An empty
    table gives no rows.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packed", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to a folder of this run in the shared one and read again."""
    shared_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/stage_{k}_{name}")
        docs = spark.read.parquet(f"{top}/stage_{k}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
