"""A file inventory made from the documents and labels tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUT = "/dupes"


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file: ordinal, file_role, label, nas_root, path, relative_path, primary_path, pos, size_bytes, digest, content."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    j = d.join(labels, "doc_id", "left")
    root = F.concat(F.element_at(F.array(F.lit("/nas/takeout/"), F.lit("/nas/mobilebackup/"), F.lit("/nas/archive/")), F.substring("source", 4, 10).cast("int") % 3 + 1), "source")
    folder = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('Photos from ', 2015 + doc_id % 9) WHEN 1 THEN concat('2021-05-1', doc_id % 10) ELSE concat('Album ', lang) END")
    base = j.select("doc_id", "text", "source", "quality", "toxic", root.alias("nas_root"), F.concat(folder, F.lit("/IMG_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("stem"), (F.col("doc_id") % 7 != 6).alias("primary"))
    files = F.expr(
        """filter(array(
             named_struct('role', if(primary, 'primary', 'uncategorized'), 'ext', if(primary, '.jpg', '.bin'), 'content', text),
             if(primary AND quality IS NOT NULL, named_struct('role', 'sidecar', 'ext', '.jpg.json', 'content', concat('{"quality":', quality, ',"toxic":', toxic, '}')), NULL),
             if(primary AND doc_id % 4 < 2, named_struct('role', 'sidecar', 'ext', '.mov', 'content', if(doc_id % 4 = 0, source, concat(text, '#mov'))), NULL),
             if(primary AND doc_id % 23 = 0, named_struct('role', 'sidecar', 'ext', '.xmp', 'content', concat(text, '#xmp')), NULL)
           ), x -> x IS NOT NULL)"""
    )
    each = base.select("doc_id", "source", "nas_root", "stem", F.posexplode(files).alias("i", "f"))
    relative = F.concat("stem", "f.ext")
    return each.select(
        F.col("doc_id").alias("ordinal"),
        F.col("f.role").alias("file_role"),
        F.col("source").alias("label"),
        "nas_root",
        F.concat("nas_root", F.lit("/"), relative).alias("path"),
        relative.alias("relative_path"),
        F.when(F.col("f.role") == "sidecar", F.concat("nas_root", F.lit("/"), "stem", F.lit(".jpg"))).alias("primary_path"),
        F.col("i").cast("long").alias("pos"),
        F.octet_length("f.content").cast("long").alias("size_bytes"),
        F.sha2(F.col("f.content"), 256).alias("digest"),
        F.col("f.content").alias("content"),
    )


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primaries of the inventory, each with a sidecar of its own kind (so that no bucket has a keeper) and a JSON sidecar.

    JSON contents differ by key, lack keys, nest or cannot be read, by ordinal.
    """
    primaries = inventory(spark, sf_dir).where("file_role = 'primary'")
    files = F.expr(
        """array(
             named_struct('role', 'primary', 'ext', '.jpg', 'i', 0L, 'content', content),
             named_struct('role', 'sidecar', 'ext', '.jpg.json', 'i', 1L, 'content', CASE ordinal % 7 WHEN 5 THEN 'no json' WHEN 6 THEN '[1]'
               ELSE concat('{"id": ', ordinal, ', "same": "x", "some": ', if(ordinal % 2 = 0, 'null', '1'), if(ordinal % 3 = 0, '', ', "deep": {"b": [1, 2], "a": "é"}'), '}') END),
             named_struct('role', 'sidecar', 'ext', '.xmp', 'i', 2L, 'content', concat('own ', ordinal)))"""
    )
    each = primaries.select("ordinal", "label", "nas_root", F.regexp_replace("relative_path", "\\.jpg$", "").alias("stem"), F.explode(files).alias("f"))
    relative = F.concat("stem", "f.ext")
    return each.select(
        "ordinal", F.col("f.role").alias("file_role"), "label", "nas_root", F.concat("nas_root", F.lit("/"), relative).alias("path"), relative.alias("relative_path"), F.when(F.col("f.role") == "sidecar", F.concat("nas_root", F.lit("/"), "stem", F.lit(".jpg"))).alias("primary_path"), F.col("f.i").alias("pos"),
        F.octet_length("f.content").cast("long").alias("size_bytes"), F.sha2(F.col("f.content"), 256).alias("digest"), F.col("f.content").alias("content"),
    )


def split(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, sidecars, others) without contents."""
    plain = files.drop("content")
    return plain.where("file_role = 'primary'"), plain.where("file_role = 'sidecar'"), plain.where("file_role = 'uncategorized'")


#: The same inventory in DuckDB SQL, as the common table ``inv``.
INVENTORY_SQL = """
base AS (
  SELECT doc_id, text, source, quality, toxic, doc_id % 7 <> 6 AS prim,
    CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN '/nas/takeout/' WHEN 1 THEN '/nas/mobilebackup/' ELSE '/nas/archive/' END || source AS nas_root,
    CASE doc_id % 3 WHEN 0 THEN 'Photos from ' || (2015 + doc_id % 9) WHEN 1 THEN '2021-05-1' || (doc_id % 10) ELSE 'Album ' || lang END || '/IMG_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS stem
  FROM documents LEFT JOIN labels USING (doc_id)),
raw AS (
  SELECT doc_id, source, nas_root, stem, CASE WHEN prim THEN 'primary' ELSE 'uncategorized' END AS file_role, CASE WHEN prim THEN '.jpg' ELSE '.bin' END AS ext, text AS content FROM base
  UNION ALL SELECT doc_id, source, nas_root, stem, 'sidecar', '.jpg.json', '{"quality":' || quality || ',"toxic":' || toxic || '}' FROM base WHERE prim AND quality IS NOT NULL
  UNION ALL SELECT doc_id, source, nas_root, stem, 'sidecar', '.mov', CASE WHEN doc_id % 4 = 0 THEN source ELSE text || '#mov' END FROM base WHERE prim AND doc_id % 4 < 2
  UNION ALL SELECT doc_id, source, nas_root, stem, 'sidecar', '.xmp', text || '#xmp' FROM base WHERE prim AND doc_id % 23 = 0),
inv AS (
  SELECT doc_id AS ordinal, file_role, source AS label, nas_root, nas_root || '/' || stem || ext AS path, stem || ext AS relative_path,
    CASE WHEN file_role = 'sidecar' THEN nas_root || '/' || stem || '.jpg' END AS primary_path,
    CAST(CASE WHEN file_role <> 'sidecar' THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, file_role ORDER BY ext) END AS BIGINT) AS pos,
    CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS digest, content
  FROM raw)
"""
