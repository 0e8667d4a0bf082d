"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before it kept and returns those
that it keeps itself, with the columns that they have; the last returns the
packed pieces. Stages judge rows, not ids: two rows of one doc_id with different
texts (or other columns) are two documents, rows alike in every column are
copies of each other. Added columns never replace a document's own.

Null, empty and blank texts fail the quality rules. Null ids take part in all
stages and come last. Texts may be of any length. An empty table gives empty
stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dupeplan.llm import decontaminate, packing, quality, simhash, substrings
from dupeplan.llm.common import materialize


def row_key(docs: DataFrame) -> Column:
    """128 bits over all columns of a row, in hex."""
    parts = [F.coalesce(F.md5(F.col(f"`{c}`").cast("string")), F.lit("-")) for c in docs.columns]
    return F.md5(F.concat(*parts))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the learned list rejects."""
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), rules).where("kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest id (null ids last), of equal ids the one with the least row key."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), row_key(docs).alias("row"))
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row_key(docs).alias("row")).alias("who"), "text")
    found = simhash.near_duplicates(named, "who").where("who = component_id")
    first = materialize(found.groupBy("who.row").agg(F.count("*").alias("n")), "firsts")
    once = whole.join(first.where("n = 1"), "row", "left_semi")
    alike = whole.join(first.where("n > 1"), "row", "left_semi").dropDuplicates(["row"])  # rows alike in every column
    return once.unionByName(alike).select("_doc.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte that an earlier copy of a 100-byte string holds.

    All documents stay, with what is left of them (null and wholly removed texts
    are empty then); n_chars follows.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    carried = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    left = substrings.repeated_spans(carried, keep=True, carry=("_rest",))
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[own.get(c, F.col("_rest")[c]).alias(c) for c in docs.columns])


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that benchmark windows contaminate."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), row_key(docs).alias("row"))
    found = decontaminate.contamination(docs.select(row_key(docs).alias("row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row")
    dirty = found.where(decontaminate.contaminated()).select("row").distinct()
    return whole.join(dirty, "row", "left_anti").select("_doc.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes and packs what is left."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", clean_of_benchmark),
    ("packing", packed_sequences),
]
#: SQL can express neither the learned list nor tokenizing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"stage{number}")
    return docs
