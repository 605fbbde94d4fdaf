"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import annforest, cascade, divergence, ebquality, geneticpack, htmlmain, jaccardforest, langid, mixing, packing, suffixdedup, tokencount, whitening
from quillstone.llm.common import read
from quillstone.llm.oracles import ORACLES


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "place")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cascade.apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return annforest.nearest(rows, rows.where("vec_id % 100 = 0"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_edited(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardforest.join(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "class_id", "n_links")


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = ebquality.score(docs, ebquality.fit(docs, read(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))
    return found.select("doc_id", "p_doc", "site_mean", "path_mean", "quality_score", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    exact = F.expr("try_cast(deviation AS long)")  # null where no long holds it
    return found.select("vec_id", "component", "n", exact.alias("deviation"), "whitened", "explained", "identity_error")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geneticpack.pack(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_mix_sources, op2_html_main_text, op3_language_id, op4_quality_cascade, op5_pack_sequences,
        op6_nearest_vectors, op7_suffix_dedup, op8_edited_token_counts, op9_ngram_jaccard_join, op10_site_quality,
        op11_whitening, op12_source_divergence, op13_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
