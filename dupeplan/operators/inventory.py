"""Roles of files, group numbers and the manifest of a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupeplan.functions import paths
from dupeplan.operators.ordering import positioned


def classified(files: DataFrame) -> DataFrame:
    """Adds file_role, status, reason and primary_name to (dir, name, ...).

    A file that is no primary image belongs to a primary of its directory with
    the same stem, or whose whole name (in any case) is one of its own dotted
    prefixes. Both are equi-joins on one key column. One match makes a sidecar.
    """
    marked = files.withColumn("_primary", paths.is_primary("name"))
    lowered = F.transform(paths.dotted_prefixes("name"), lambda p: F.struct(F.lit("f").alias("t"), F.lower(p).alias("key")))
    by_stem = lambda: F.array(F.struct(F.lit("s").alias("t"), paths.stem("name").alias("key")))
    primary_keys = marked.where("_primary").select("dir", F.col("name").alias("primary_name"), F.inline(F.concat(by_stem(), F.array(F.struct(F.lit("f").alias("t"), F.lower("name").alias("key"))))))
    other_keys = marked.where("NOT _primary").select("dir", "name", F.inline(F.concat(by_stem(), lowered)))
    matches = other_keys.join(primary_keys, ["dir", "t", "key"]).groupBy("dir", "name").agg(F.countDistinct("primary_name").alias("_n"), F.min("primary_name").alias("primary_name"))
    found = marked.join(matches, ["dir", "name"], "left")
    role = F.when(F.col("_primary"), "primary").when(F.col("_n") == 1, "sidecar").otherwise("uncategorized")
    reason = F.when(F.col("_primary") | F.coalesce(F.col("_n") == 1, F.lit(False)), "").when(F.col("_n") > 1, "ambiguous_sidecar_multiple_primaries").otherwise("unrecognized_non_primary")
    status = F.when(reason == "", "included").otherwise("skipped")
    return found.withColumns({"file_role": role, "status": status, "reason": reason, "primary_name": F.when(role == "sidecar", F.col("primary_name"))}).drop("_primary", "_n")


def with_group_ids(files: DataFrame) -> DataFrame:
    """Adds group_id (f and a number) to classified files, by directory and lower-cased name of the primary."""
    primaries = files.where("file_role = 'primary'").select("dir", F.col("name").alias("_anchor"), F.lower("name").alias("_lower"))
    ids = positioned(primaries, "dir", "_lower", "_anchor").select("dir", "_anchor", F.format_string("f%06d", F.col("position") + 1).alias("group_id"))
    anchored = files.withColumn("_anchor", F.when(F.col("file_role") == "primary", F.col("name")).otherwise(F.col("primary_name")))
    return anchored.join(ids, ["dir", "_anchor"], "left").withColumn("group_id", F.coalesce("group_id", F.lit(""))).drop("_anchor")


def manifest_rows(files: DataFrame, nas_root: str, batch_root: str, created_at: str) -> DataFrame:
    """Manifest columns (and o_* columns that give the order) of files (dir, name, size_bytes, digest) below a root; dir is ``.`` at the root."""
    from dupeplan.schema import MANIFEST_FIELDS, MANIFEST_VERSION

    rows = with_group_ids(classified(files))
    below = lambda n: F.when(F.col("dir") == ".", F.col(n)).otherwise(F.concat("dir", F.lit("/"), n))
    relative, primary = below("name"), F.when(F.col("file_role") == "sidecar", below("primary_name"))
    anchor = F.coalesce("primary_name", "name")
    root = nas_root.rstrip("/")
    values = {
        "relative_path": relative, "primary_relative_path": F.coalesce(primary, F.lit("")), "xxh128": F.col("digest"), "nas_path": paths.joined(F.lit(root), relative), "primary_nas_path": F.coalesce(paths.joined(F.lit(root), primary), F.lit("")),
        "manifest_version": F.lit(MANIFEST_VERSION), "created_at": F.lit(created_at), "nas_root_label": F.lit(root.rsplit("/", 1)[-1]), "batch_root": F.lit(batch_root), "nas_root": F.lit(root),
    }
    order = {"o_dir": F.col("dir"), "o_anchor": F.lower(anchor), "o_exact": anchor, "o_side": (F.col("file_role") == "sidecar").cast("int"), "o_name": F.lower("name")}
    made = [F.col(c).alias(c) if c not in values else values[c].alias(c) for c in MANIFEST_FIELDS]
    return rows.select(*made, *[v.alias(k) for k, v in order.items()])


MANIFEST_ORDER = ["o_dir", "o_anchor", "o_exact", "o_side", "o_name"]


def collapsed(files: DataFrame, compared: list[str]) -> DataFrame:
    """One row for each path, the first by ordinal; rows of a path that differ in a compared column raise an error."""
    agreed = files.groupBy("path").agg(F.min("ordinal").alias("ordinal"), F.count_distinct(F.struct(*compared)).alias("_n"))
    checked = agreed.withColumn("ordinal", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("conflicting duplicate nas_path: "), "path"))).otherwise(F.col("ordinal"))).drop("_n")
    return files.join(checked, ["path", "ordinal"])


def structure_difference(local: DataFrame, nas: DataFrame) -> DataFrame:
    """(dir, side): directories that only one of two trees has."""
    a, b = local.distinct(), nas.distinct()
    return a.join(b, "dir", "left_anti").select("dir", F.lit("missing").alias("side")).unionByName(b.join(a, "dir", "left_anti").select("dir", F.lit("extra").alias("side")))
