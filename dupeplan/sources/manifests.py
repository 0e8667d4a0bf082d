"""Manifest, plan and log CSV files."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dupeplan.operators import inventory
from dupeplan.schema import MANIFEST_FIELDS, MANIFEST_VERSION, ROLES, STATUSES
from dupeplan.sources.scratch import stored

#: Reading options under which what the writer below writes comes back unchanged.
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, required: list[str], what: str) -> DataFrame:
    """All columns as strings, bound by name; blanks are empty strings. ``_line`` numbers the rows in order."""
    df = spark.read.options(**CSV).csv(str(path))
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{what} missing required fields {missing}: {path}")
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns], F.monotonically_increasing_id().alias("_line"))


def write_csv(df: DataFrame, path: str, what: str, order: list[str] | None = None) -> str:
    """Writes one CSV file with a header, CRLF lines and minimal quotes; an existing one is never replaced.

    Rows stream to the driver partition by partition, already sorted.
    """
    import csv

    refuse_existing(path, what)
    columns = [c for c in df.columns if c not in (order or [])]
    rows = df.orderBy(*order).select(*columns) if order else df
    with open(path, "x", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(columns)
        for row in rows.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
    return str(path)


def refuse_existing(path: str, what: str) -> None:
    if os.path.exists(path):
        raise ValueError(f"{what} already exists: {path}")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)


def _integer(column: str) -> Column:
    return F.expr(f"try_cast({column} AS bigint)")


def _error_rows(df: DataFrame, phase: int, error: Column) -> DataFrame:
    return df.select("_manifest", F.lit(phase).alias("_phase"), "_line", error.alias("error")).where("error IS NOT NULL")


def load(spark: SparkSession, manifests: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, sidecars, others) of manifests in their order, checked; see ``dupeplan.operators.planning``.

    The error is that of the first manifest with one: that of its first line
    whose fields are bad (version, role, status, size, pointers, group) or whose
    group has a primary already, else of its first sidecar without a primary,
    else of its first sidecar that points at another one. Paths that occur twice
    are collapsed if their rows agree.
    """
    parts = None
    for number, path in enumerate(manifests):
        part = read_csv(spark, path, MANIFEST_FIELDS, "manifest").select(*MANIFEST_FIELDS, "_line").withColumns({"_manifest": F.lit(number), "_file": F.lit(str(path))})
        parts = part if parts is None else parts.unionByName(part)
    rows = stored(parts.withColumn("ordinal", F.col("_manifest") * F.lit(1 << 40).cast("long") + F.col("_line")), "manifest")
    say = lambda text, *more: F.concat(F.lit(text), *more, F.lit(": "), F.col("_file"))
    has = lambda c: F.col(c) != ""
    sidecar = F.col("file_role") == "sidecar"
    error = (
        F.when(F.col("manifest_version") != MANIFEST_VERSION, say("unsupported manifest version ", F.col("manifest_version")))
        .when(~F.col("file_role").isin(ROLES), say("unsupported manifest file_role ", F.col("file_role")))
        .when(~F.col("status").isin(STATUSES), say("unsupported manifest status ", F.col("status")))
        .when(_integer("size_bytes").isNull(), say("invalid manifest size_bytes ", F.col("size_bytes")))
        .when(sidecar & ~(has("primary_relative_path") & has("primary_nas_path")), say("sidecar manifest row missing primary path fields"))
        .when(~sidecar & (has("primary_relative_path") | has("primary_nas_path")), say("non-sidecar manifest row has primary path fields"))
        .when(F.col("file_role").isin("primary", "sidecar") & ~has("group_id"), say("manifest row missing group_id"))
    )
    typed = rows.select("ordinal", "_manifest", "_file", "_line", "file_role", "status", "reason", "group_id", F.col("nas_root_label").alias("label"), "nas_root", "batch_root", F.col("nas_path").alias("path"), "relative_path", F.col("primary_nas_path").alias("primary_path"), "primary_relative_path", _integer("size_bytes").alias("size_bytes"), F.col("xxh128").alias("digest"))
    primaries, sidecars = typed.where("file_role = 'primary'"), typed.where("file_role = 'sidecar'")
    key = ["_manifest", "group_id"]
    first = primaries.groupBy(*key).agg(F.count("*").alias("n"), F.min("_line").alias("_first")).where("n > 1").drop("n")
    again = primaries.join(first, key).where("_line > _first")
    owner = primaries.select(*key, F.col("ordinal").alias("o"), F.col("path").alias("p"), F.col("relative_path").alias("r"))
    owned = sidecars.join(owner, key, "left")
    lost = F.when(F.col("o").isNull(), say("sidecar manifest row has no primary for group_id ", F.col("group_id")))
    astray = F.when((F.col("p") != F.col("primary_path")) | (F.col("r") != F.col("primary_relative_path")), say("sidecar manifest row points at a different primary for group_id ", F.col("group_id")))
    errors = _error_rows(rows, 0, error).unionByName(_error_rows(again, 1, say("multiple primary rows for group_id ", F.col("group_id"))))
    errors = errors.withColumn("_late", F.lit(0)).unionByName(_error_rows(owned, 2, lost).unionByName(_error_rows(owned, 3, astray)).withColumn("_late", F.col("_phase")))
    if bad := errors.orderBy("_manifest", "_late", "_line", "_phase").first():
        raise ValueError(bad["error"])
    attached = owned.select(F.col("o").alias("ordinal"), "label", "nas_root", "path", "relative_path", "primary_path", "size_bytes", "digest")
    own = F.expr("transform(array_sort(collect_list(struct(relative_path, path, size_bytes, digest))), x -> x)")
    held = attached.groupBy("ordinal").agg(own.alias("_own"))
    compared = primaries.join(held, "ordinal", "left").withColumn("_own", F.to_json(F.coalesce("_own", F.array().cast("array<struct<relative_path:string,path:string,size_bytes:bigint,digest:string>>"))))
    entries = inventory.collapsed(compared, ["label", "nas_root", "relative_path", "size_bytes", "digest", "_own"])
    others = inventory.collapsed(typed.where("file_role = 'uncategorized'"), ["label", "nas_root", "batch_root", "relative_path", "size_bytes", "digest", "status", "reason"])
    kept = held.join(entries.select("ordinal"), "ordinal", "left_semi").select("ordinal", F.posexplode("_own").alias("i", "s"))
    label = entries.select("ordinal", "label")
    sidecar_rows = kept.join(label, "ordinal").select("ordinal", "label", (F.col("i") + 1).cast("long").alias("pos"), "s.path", "s.relative_path", "s.size_bytes", "s.digest")
    columns = ["ordinal", "label", "path", "relative_path", "size_bytes", "digest"]
    return stored(entries.select(*columns), "entries"), stored(sidecar_rows, "sidecars"), stored(others.select(*columns), "others")


def manifest_beside(root: str) -> str:
    return f"{Path(root).name}.manifest.csv"


def dated_log(action: str) -> str:
    from datetime import datetime

    return str(Path.cwd() / f"{action}_{datetime.now():%Y%m%d_%H%M%S}.csv")
