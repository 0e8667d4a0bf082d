"""Queries over the whole tables, one for each operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupeplan.llm import decontaminate, language, license, oracle, packing, quality, simhash, substrings, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model and base scores of every document."""
    return language.scores(_table(spark, sf_dir, "documents"), language.held_by_key())


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in packed sequences."""
    import public_tokenizers

    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places and license labels of every document."""
    starts = F.transform("places", lambda x: x["start"])
    return license.labels(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        "score",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn_rules(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier 100-byte string covers."""
    found = substrings.repeated_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, held = _table(spark, sf_dir, "documents").select("doc_id", "text"), language.held_by_key(folds=5)
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), held)
    return toxicity.scores(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_simhash": op1_simhash, "op2_lm_scoring": op2_lm_scoring, "op3_packing": op3_packing, "op4_decontaminate": op4_decontaminate, "op5_url_filter": op5_url_filter, "op6_warc": op6_warc, "op7_license_scan": op7_license_scan, "op8_quality_rules": op8_quality_rules, "op9_suffix_dedup": op9_suffix_dedup, "op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = oracle.SQL
