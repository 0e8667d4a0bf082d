"""Byte verification of equal digests, and verification of the state after moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupeplan.operators import planning
from dupeplan.schema import MERGE_DISPOSITION


def byte_groups(entries: DataFrame, sidecars: DataFrame, others: DataFrame) -> DataFrame:
    """Files of all buckets with several, of the three roles: file_role, group_id, first (whether it is its group's), g, ordinal, pos, path, label, size_bytes, digest."""
    parts = []
    one = lambda members: members.withColumns({"pos": F.lit(0).cast("long"), "g_pos": F.lit(0).cast("long")})
    for role, members in (("primary", one(planning.duplicate_members(entries, "m"))), ("sidecar", planning.sidecar_members(sidecars)), ("uncategorized", one(planning.duplicate_members(others, "u")))):
        first = (F.col("ordinal") == F.col("g")) & (F.col("pos") == F.col("g_pos"))
        parts.append(members.select(F.lit(role).alias("file_role"), "group_id", first.alias("first"), "g", "ordinal", "pos", "path", "label", "size_bytes", "digest"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def byte_log(groups: DataFrame, contents: DataFrame) -> DataFrame:
    """One row for each file whose bytes differ from the first of its group, or for each group without such a file.

    ``contents`` has path and content; any two contents are equal if and only if
    the files are (a strong digest of the bytes will do).
    """
    held = groups.join(contents.select("path", "content"), "path", "left")
    first = held.where("first").select("file_role", "group_id", F.col("content").alias("_first"))
    compared = held.join(first, ["file_role", "group_id"]).withColumn("differs", ~F.coalesce(F.col("content") == F.col("_first"), F.lit(False)))
    failed = compared.where("differs").select(
        F.lit("verify_failed").alias("disposition"), F.concat(F.lit("verify_manifest_"), "file_role").alias("event"), F.lit("error").alias("status"), "group_id", "file_role", F.col("label").alias("input_root"),
        F.col("path").alias("source_path"), "size_bytes", F.col("digest").alias("xxh128"), F.lit("same_manifest_hash_but_bytes_differ").alias("reason"),
    )
    whole = compared.groupBy("file_role", "group_id", "size_bytes", "digest").agg(F.bool_or("differs").alias("bad")).where("NOT bad")
    matched = whole.select(
        F.lit("verify_matched").alias("disposition"), F.concat(F.lit("verify_manifest_"), "file_role", F.lit("_group")).alias("event"), F.lit("kept").alias("status"), "group_id", "file_role", F.lit("").alias("input_root"),
        F.lit("").alias("source_path"), "size_bytes", F.col("digest").alias("xxh128"), F.lit("all_manifest_hash_matches_are_byte_equal").alias("reason"),
    )
    return failed.unionByName(matched)


def expected_checks(plan_rows: DataFrame) -> DataFrame:
    """What must hold after the moves: (path, expect, at, ...) for every file of the plan; at is source or destination."""
    kept = {
        "kept_unique_primary": ("verify_move_unique_intact", "verify_move_unique", "unique_source_intact"),
        "kept_unique_sidecar": ("verify_move_unique_intact", "verify_move_unique", "unique_source_intact"),
        "kept_unique_uncategorized": ("verify_move_unique_uncategorized_intact", "verify_move_unique_uncategorized", "unique_source_intact"),
        "kept_sidecar_conflict": ("verify_move_skipped_conflict_intact", "verify_move_sidecar_conflict", "sidecar_conflict_source_intact"),
        "kept_sidecar_conflict_sidecar": ("verify_move_skipped_conflict_intact", "verify_move_sidecar_conflict", "sidecar_conflict_source_intact"),
        "kept_duplicate_keeper": ("verify_move_matched", "verify_move_keeper", "keeper_source_intact"),
        "kept_duplicate_keeper_sidecar": ("verify_move_matched", "verify_move_keeper", "keeper_source_intact"),
        "kept_duplicate_uncategorized": ("verify_move_matched", "verify_move_uncategorized_keeper", "keeper_source_intact"),
    }
    source = lambda d, e, r, expect: F.struct(F.lit("source").alias("at"), F.col("source_path").alias("path"), F.lit(expect).alias("expect"), F.lit(d).alias("good"), F.lit(e).alias("event"), F.lit(r).alias("good_reason"))
    there = lambda e, r: F.struct(F.lit("destination").alias("at"), F.col("destination_path").alias("path"), F.lit("present").alias("expect"), F.lit("verify_move_matched").alias("good"), F.lit(e).alias("event"), F.lit(r).alias("good_reason"))
    moved = source("verify_move_matched", "verify_move_duplicate_source", "duplicate_source_missing", "absent")
    checks = F.when(F.col("disposition") == MERGE_DISPOSITION, F.array(moved, there("verify_move_sidecar_merge", "merged_sidecar_present"))).when(F.startswith("disposition", F.lit("planned_duplicate")), F.array(moved, there("verify_move_duplicate_destination", "duplicate_destination_present")))
    for disposition, (good, event, reason) in kept.items():
        checks = checks.when(F.col("disposition") == disposition, F.array(source(good, event, reason, "present")))
    blank = F.startswith("disposition", F.lit("kept_unique")) | F.startswith("disposition", F.lit("kept_sidecar_conflict"))
    order = [c for c in planning.VERIFY_ORDER if c in plan_rows.columns]
    return plan_rows.select("group_id", "file_role", "input_root", "size_bytes", "xxh128", F.when(blank, "").otherwise(F.col("keeper_path")).alias("keeper_path"), *order, F.inline(checks))


def move_log(plan_rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The expected checks with their outcome."""
    there = snapshot.select("path", F.lit(True).alias("_there"), "is_file", F.col("size_bytes").alias("_size"))
    rows = expected_checks(plan_rows).join(there, "path", "left")
    exists = F.col("_there").isNotNull()
    trouble = F.when(F.col("expect") == "absent", F.when(exists, "duplicate_source_still_exists")).otherwise(F.when(~exists, "expected_file_missing").when(~F.col("is_file"), "expected_path_not_file").when(F.col("_size") != F.col("size_bytes"), "expected_file_size_mismatch"))
    done = F.when((F.col("expect") == "absent") | (F.col("at") == "destination"), "moved").otherwise("kept")
    return rows.withColumn("_trouble", trouble).select(
        F.when(F.col("_trouble").isNull(), F.col("good")).otherwise("verify_move_failed").alias("disposition"), "event", F.when(F.col("_trouble").isNull(), done).otherwise("error").alias("status"), "group_id", "file_role", "input_root",
        F.when(F.col("at") == "source", F.col("path")).otherwise("").alias("source_path"), F.when(F.col("at") == "destination", F.col("path")).otherwise("").alias("destination_path"), "keeper_path", "size_bytes", "xxh128",
        F.coalesce("_trouble", "good_reason").alias("reason"), *[c for c in planning.VERIFY_ORDER if c in rows.columns], (F.col("at") == "destination").alias("o_at"),
    )


def unexpected_outputs(plan_rows: DataFrame, output_files: DataFrame) -> DataFrame:
    """Files below the output that no moved duplicate explains; where a merge would have put a sidecar otherwise is not expected either."""
    expected = plan_rows.where(F.startswith("disposition", F.lit("planned_duplicate"))).select(F.col("destination_path").alias("path")).distinct()
    extra = output_files.where("is_file").join(expected, "path", "left_anti")
    return extra.select(
        F.lit("verify_move_unexpected_output").alias("disposition"), F.lit("verify_move_output_scan").alias("event"), F.lit("error").alias("status"), F.col("path").alias("source_path"), "size_bytes",
        F.lit("unexpected_output_file").alias("reason"), F.lit("output file is not an expected moved duplicate or sidecar").alias("message"),
    )
