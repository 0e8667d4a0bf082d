"""The execution state machine over a plan and a snapshot of the file system.

``plan`` has the plan's columns and ``_line``, the distinct numbers of its rows in
their order. ``snapshot`` has path, is_file, size_bytes and digest of everything
that exists. All states are joins and conditional expressions; a bundle's verdict is a
grouped aggregate joined back to its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dupeplan.schema import KEEPER_DISPOSITIONS, MERGE_DISPOSITION
from dupeplan.sources.scratch import stored

PRIMARY = ["planned_duplicate_primary", "planned_duplicate_uncategorized"]
ROW = ["disposition", "group_id", "file_role", "source_path", "destination_path", "duplicate_output_path", "keeper_path", "primary_source_path", "size_bytes", "xxh128", "input_root"]


def planned(plan: DataFrame) -> DataFrame:
    """The rows that execution reads, whose role fits their disposition."""
    rows = plan.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c not in ("size_bytes",) else F.col(c).cast("long") for c in ROW if c in plan.columns], F.col("_line").alias("line"))
    role = F.create_map(*[F.lit(x) for kv in {"planned_duplicate_primary": "primary", "planned_duplicate_uncategorized": "uncategorized", "planned_duplicate_sidecar": "sidecar", MERGE_DISPOSITION: "sidecar"}.items() for x in kv])
    keeper = F.col("disposition").isin(KEEPER_DISPOSITIONS) & F.col("file_role").isin("primary", "uncategorized")
    return rows.where(keeper | (role[F.col("disposition")] == F.col("file_role")))


def bundles(plan: DataFrame) -> DataFrame:
    """Rows of bundles: a primary, then its sidecars, then its merges, with the bundle's key (at, the line of its primary) and the group's keeper.

    Two primaries of one group and path are two bundles, each with all sidecars.
    """
    rows = planned(plan)
    primary = rows.where(F.col("disposition").isin(PRIMARY))
    keepers = rows.where(F.col("disposition").isin(KEEPER_DISPOSITIONS)).select("group_id", *[F.col(c).alias(f"k_{c}") for c in ("source_path", "size_bytes", "xxh128", "file_role", "input_root")])
    own = primary.withColumns({"bundle": F.col("source_path"), "at": F.col("line"), "kind": F.lit(0)})
    key = primary.select("group_id", F.col("source_path").alias("bundle"), F.col("line").alias("at"))
    rest = rows.where(F.col("disposition").isin("planned_duplicate_sidecar", MERGE_DISPOSITION)).withColumns({"bundle": F.col("primary_source_path"), "kind": F.when(F.col("disposition") == MERGE_DISPOSITION, 2).otherwise(1)})
    return own.unionByName(rest.join(key, ["group_id", "bundle"]).select(*own.columns)).join(keepers, "group_id", "left")


def orphans(plan: DataFrame) -> DataFrame:
    """Sidecar and merge rows without a primary row; sidecars come first."""
    rows = planned(plan)
    key = rows.where(F.col("disposition").isin(PRIMARY)).select("group_id", F.col("source_path").alias("primary_source_path"))
    rest = rows.where(F.col("disposition").isin("planned_duplicate_sidecar", MERGE_DISPOSITION))
    return rest.join(key, ["group_id", "primary_source_path"], "left_anti").select(*rows.columns)


def shared_destinations(rows: DataFrame) -> DataFrame:
    """(path) of destinations and duplicate outputs that occur more than once."""
    each = rows.select(F.explode(F.array("destination_path", F.when(F.col("duplicate_output_path") != "", F.col("duplicate_output_path")))).alias("path")).where("path IS NOT NULL")
    return each.groupBy("path").count().where("count > 1").select("path")


def _looked_up(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Adds what exists at the source (s_), destination (d_), duplicate output (o_) and keeper (k_)."""
    for prefix, column in (("s", "source_path"), ("d", "destination_path"), ("o", "duplicate_output_path"), ("kf", "k_source_path")):
        there = snapshot.select(F.col("path").alias(column), F.lit(True).alias(f"{prefix}_there"), F.col("is_file").alias(f"{prefix}_file"), F.col("size_bytes").alias(f"{prefix}_size"), F.col("digest").alias(f"{prefix}_digest"))
        rows = rows.join(there, column, "left")
    return rows


def row_states(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Adds state, action_destination, and the hash_check and observed_hash that finding it takes."""
    on = _looked_up(rows, snapshot)
    s, d, o = (F.col(f"{p}_there").isNotNull() for p in "sdo")
    size = F.col("size_bytes")
    check = lambda p: F.when(~F.col(f"{p}_file") | (F.col(f"{p}_size") != size) | (F.col("xxh128") == ""), "not_applicable").when(F.col(f"{p}_digest") == F.col("xxh128"), "matched").otherwise("mismatched")
    wrong_source = F.col("s_size") != size
    plain = (
        F.when(s & d, "destination_exists").when(s & wrong_source, "source_size_mismatch").when(s, "ready")
        .when(d & (F.col("d_size") != size), "destination_exists").when(d, "already_moved").otherwise("source_missing")
    )
    bad_target, bad_output = d & (check("d") != "matched"), ~s & o & (check("o") != "matched")
    merge = (
        F.when(F.col("duplicate_output_path") == "", "destination_exists").when(bad_target, "merge_destination_hash_mismatch")
        .when(d & s & o, "destination_exists").when(d & s & wrong_source, "source_size_mismatch").when(d & s, "ready")
        .when(d & bad_output, "destination_exists").when(d, "already_moved")
        .when(s & wrong_source, "source_size_mismatch").when(s, "ready").otherwise("source_missing")
    )
    is_merge = F.col("disposition") == MERGE_DISPOSITION
    has_output = is_merge & (F.col("duplicate_output_path") != "")
    looked = F.when(has_output & bad_target, check("d")).when(has_output & d & bad_output, check("o")).otherwise("not_checked")
    seen = F.when(has_output & bad_target & (check("d") == "mismatched"), F.col("d_digest")).when(has_output & d & ~bad_target & bad_output & (check("o") == "mismatched"), F.col("o_digest")).otherwise("")
    out = on.withColumn("state", F.when(is_merge, merge).otherwise(plain)).withColumns({"hash_check": looked, "observed_hash": seen})
    action = F.when(F.col("state").isin("ready", "already_moved"), F.when(is_merge & (F.col("state") == "ready") & d, F.col("duplicate_output_path")).otherwise(F.col("destination_path")))
    return out.withColumn("action_destination", action)


def verdicts(plan: DataFrame, snapshot: DataFrame, verify_hashes: bool = False) -> DataFrame:
    """Bundle rows with their states and the verdict of the bundle (null: it may run)."""
    rows = stored(bundles(plan), "bundles")
    shared = shared_destinations(rows).withColumn("_shared", F.lit(True))
    stated = row_states(rows, snapshot)
    hit = stated.join(shared.withColumnsRenamed({"path": "destination_path"}), "destination_path", "left").withColumnRenamed("_shared", "_hit_d")
    hit = hit.join(shared.withColumnsRenamed({"path": "duplicate_output_path"}), "duplicate_output_path", "left").withColumnRenamed("_shared", "_hit_o")
    hit = stored(hit.withColumn("shared", F.coalesce("_hit_d", "_hit_o", F.lit(False))).drop("_hit_d", "_hit_o"), "states")
    failed = lambda p: F.coalesce((F.col("xxh128") == "") | (F.col(f"{p}_digest") != F.col("xxh128")), F.lit(True))
    state = F.col("state")
    keeper = (
        F.when(F.col("k_source_path").isNull(), "keeper_missing_from_plan").when(F.col("kf_there").isNull(), "keeper_missing").when(F.col("kf_size") != F.col("k_size_bytes"), "keeper_size_mismatch")
        .when(F.lit(verify_hashes) & ((F.col("k_xxh128") == "") | (F.coalesce(F.col("kf_digest"), F.lit("")) != F.col("k_xxh128"))), "keeper_hash_mismatch")
    )
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    ask = hit.groupBy("at").agg(
        F.max(keeper).alias("keeper_result"),
        some(F.col("source_path") == F.col("k_source_path")).alias("is_keeper"),
        some(F.col("shared")).alias("any_shared"),
        F.bool_and(state == "already_moved").alias("all_moved"),
        some(failed("d")).alias("wrong_moved"),
        some(failed("s")).alias("wrong_source"),
        *[some(state == x).alias(f"any_{x}") for x in ("merge_destination_hash_mismatch", "destination_exists", "source_size_mismatch", "source_missing", "ready", "already_moved")],
    )
    verify = F.lit(verify_hashes)
    result = (
        F.when(F.col("keeper_result").isNotNull(), F.col("keeper_result")).when(F.col("is_keeper"), "duplicate_source_is_keeper").when(F.col("any_shared"), "duplicate_destination_in_plan")
        .when(F.col("all_moved"), F.when(verify & F.col("wrong_moved"), "destination_hash_mismatch").otherwise("already_moved"))
        .when(F.col("any_merge_destination_hash_mismatch"), "merge_destination_hash_mismatch").when(F.col("any_destination_exists"), "destination_exists").when(F.col("any_source_size_mismatch"), "source_size_mismatch")
        .when(F.col("any_source_missing"), F.when(F.col("any_ready") | F.col("any_already_moved"), "partial_bundle_state").otherwise("source_missing"))
        .when(F.col("any_already_moved"), "partial_bundle_state").when(verify & F.col("wrong_source"), "source_hash_mismatch")
    )
    flags = ["is_keeper", "any_shared", "all_moved", "any_source_missing"]
    return hit.join(ask.select("at", result.alias("verdict"), *flags), "at")


#: Order of the log: orphans, then bundle by bundle.
LOG_ORDER = ["at", "part", "o_line", "source_path"]


def log_rows(plan: DataFrame, snapshot: DataFrame, verify_hashes: bool = False) -> DataFrame:
    """Rows of the dry-run log: orphans, keepers (once for each bundle) and bundle rows, with what validation found; ``LOG_ORDER`` sorts them."""
    rows = stored(verdicts(plan, snapshot, verify_hashes), "verdicts")
    state, verdict = F.col("state"), F.coalesce("verdict", F.lit(""))
    wrong = lambda p: F.when(F.col("xxh128") == "", "not_applicable").when(F.col(f"{p}_digest") == F.col("xxh128"), "matched").otherwise("mismatched")
    # Hashes are checked row by row until the first that fails.
    order = W.partitionBy("at").orderBy("kind", "source_path", "line").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"_d": wrong("d"), "_s": wrong("s")}).withColumns({f"_until_{p}": F.coalesce(F.max(F.col(f"_{p}") != "matched").over(order), F.lit(False)) for p in "ds"})
    hashed_d = F.lit(verify_hashes) & verdict.isin("already_moved", "destination_hash_mismatch") & ~F.col("_until_d")
    hashed_s = F.lit(verify_hashes) & verdict.isin("", "source_hash_mismatch") & ~F.col("_until_s")
    early = verdict.startswith("keeper_") | (verdict == "duplicate_source_is_keeper")
    shared = (verdict == "duplicate_destination_in_plan") & F.col("shared")
    exists = verdict.isin("merge_destination_hash_mismatch", "destination_exists") & state.isin("destination_exists", "merge_destination_hash_mismatch")
    small = (verdict == "source_size_mismatch") & (state == "source_size_mismatch")
    gone = verdict.isin("partial_bundle_state", "source_missing") & state.isin("source_missing", "already_moved")
    initial = F.when(state == "ready", "validated").when((F.col("disposition") == MERGE_DISPOSITION) & (state == "destination_exists") & (F.col("hash_check") != "not_checked"), "destination_hash_mismatch").otherwise(state)
    validation = (
        F.when(early | ((verdict == "duplicate_destination_in_plan") & ~F.col("shared")), verdict).when(shared, "duplicate_destination_in_plan").when(hashed_d & (F.col("_d") != "matched"), "destination_hash_mismatch")
        .when(hashed_d, "already_moved").when(hashed_s & (F.col("_s") != "matched"), "source_hash_mismatch").when(hashed_s, "validated").when(exists, state).when(small | gone, verdict).otherwise(initial)
    )
    none = early | (verdict == "duplicate_destination_in_plan")
    check = F.when(shared | small | gone, "not_applicable").when(none, "not_checked").when(hashed_d, F.col("_d")).when(hashed_s, F.col("_s")).otherwise(F.col("hash_check"))
    seen = F.when(none | small | gone, "").when(hashed_d, F.when(F.col("_d") != "not_applicable", F.col("d_digest")).otherwise("")).when(hashed_s, F.when(F.col("_s") != "not_applicable", F.col("s_digest")).otherwise("")).otherwise(F.col("observed_hash"))
    action = F.when(none | small | gone | (F.lit(verify_hashes) & hashed_d), F.col("destination_path")).otherwise(F.coalesce("action_destination", "destination_path"))
    merge = F.col("disposition") == MERGE_DISPOSITION
    role = F.col("file_role")
    moved = F.when(role == "uncategorized", "already_moved_duplicate_uncategorized").when(role == "primary", "already_moved_duplicate_primary").when(merge, "already_merged_sidecar").otherwise("already_moved_sidecar")
    event = F.when(role == "uncategorized", "execute_plan_uncategorized_move").when(role == "primary", "execute_plan_move").when(merge, "execute_plan_sidecar_merge").otherwise("execute_plan_sidecar_move")
    pick = lambda done, run, error: F.when(verdict == "already_moved", done).when(verdict == "", run).otherwise(error)
    body = rows.select(
        "group_id", "at", (F.col("kind") + 1).alias("part"), F.lit(0).cast("long").alias("o_line"), pick(moved, F.col("disposition"), F.concat(F.lit("skipped_error_"), role)).alias("disposition"), event.alias("event"),
        pick(F.lit("kept"), F.lit("planned"), F.lit("error")).alias("status"), "file_role", "source_path", action.alias("destination_path"), "duplicate_output_path", "keeper_path", "primary_source_path",
        pick(F.lit("already_moved"), F.lit("validated"), verdict).alias("reason"), "size_bytes", "xxh128", validation.alias("validation_result"),
        pick(F.lit("already_moved"), F.lit("planned"), F.lit("skipped")).alias("action_taken"), check.alias("hash_check"), F.coalesce(seen, F.lit("")).alias("observed_hash"), "input_root", F.lit("").alias("message"),
    )
    error = verdict.isin("keeper_missing", "keeper_size_mismatch", "keeper_hash_mismatch")
    other = F.col("k_file_role") == "uncategorized"
    bad_hash = F.when(F.col("k_xxh128") == "", "not_applicable").otherwise("mismatched")
    k_check = F.when(verdict.isin("keeper_missing", "keeper_size_mismatch"), "not_applicable").when(F.lit(not verify_hashes), "not_checked").when(verdict == "keeper_hash_mismatch", bad_hash).otherwise("matched")
    keeper = rows.where("kind = 0 AND k_source_path IS NOT NULL").select(
        "group_id", "at", F.lit(0).alias("part"), F.lit(0).cast("long").alias("o_line"),
        F.when(other, F.when(error, "uncategorized_keeper_error").otherwise("verified_uncategorized_keeper")).otherwise(F.when(error, "keeper_error").otherwise("verified_keeper")).alias("disposition"),
        F.lit("execute_plan_keeper").alias("event"), F.when(error, "error").otherwise("kept").alias("status"), F.when(other, "uncategorized").otherwise("keeper").alias("file_role"),
        F.col("k_source_path").alias("source_path"), F.lit("").alias("destination_path"), F.lit("").alias("duplicate_output_path"), F.col("k_source_path").alias("keeper_path"), F.lit("").alias("primary_source_path"),
        F.when(error, verdict).otherwise("keeper_verified").alias("reason"), F.col("k_size_bytes").alias("size_bytes"), F.col("k_xxh128").alias("xxh128"), F.when(error, verdict).otherwise("validated").alias("validation_result"),
        F.when(error, "skipped").otherwise("keeper_verified").alias("action_taken"), k_check.alias("hash_check"), F.when(k_check.isin("matched", "mismatched"), F.col("kf_digest")).otherwise("").alias("observed_hash"),
        F.col("k_input_root").alias("input_root"), F.lit("").alias("message"),
    )
    lost = orphans(plan).select(
        "group_id", F.lit(-1).cast("long").alias("at"), F.when(F.col("disposition") == MERGE_DISPOSITION, 1).otherwise(0).alias("part"), F.col("line").alias("o_line"), F.lit("orphan_plan_sidecar").alias("disposition"), F.lit("execute_plan_orphan_sidecar").alias("event"), F.lit("error").alias("status"),
        F.lit("sidecar").alias("file_role"), "source_path", "destination_path", F.lit("").alias("duplicate_output_path"), "keeper_path", "primary_source_path", F.lit("orphan_plan_sidecar").alias("reason"), "size_bytes",
        F.lit("").alias("xxh128"), F.lit("orphan_plan_sidecar").alias("validation_result"), F.lit("skipped").alias("action_taken"), F.lit("not_applicable").alias("hash_check"), F.lit("").alias("observed_hash"), "input_root",
        F.lit("planned sidecar row has no matching planned primary row").alias("message"),
    )
    return lost.unionByName(keeper).unionByName(body)
