"""The seven commands as functions over paths."""

from __future__ import annotations

import csv
import os
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupeplan.operators import analysis, execution, inventory, moving, planning, verification
from dupeplan.progress import SILENT, Progress
from dupeplan.schema import EXECUTION_REQUIRED, JSON_FIELDS, LOG_FIELDS
from dupeplan.sources import files, manifests
from dupeplan.sources.scratch import stored


def _now() -> str:
    return datetime.now().isoformat(timespec="seconds")


def validate_roots(spark: SparkSession, local_root: str, nas_root: str, depth: int = 2) -> None:
    """Errors unless both are directories of one name with the same directories down to the depth."""
    if not os.path.exists(nas_root):
        raise ValueError(f"NAS root does not exist: {nas_root}")
    if not os.path.isdir(nas_root):
        raise ValueError(f"NAS root is not a directory: {nas_root}")
    a, b = Path(local_root).name, Path(nas_root).name
    if a != b:
        raise ValueError(f"local batch root basename must match NAS root basename: {a!r} != {b!r}")
    if depth < 0:
        raise ValueError(f"structure check depth must be non-negative: {depth}")
    if not depth:
        return
    differ = inventory.structure_difference(files.directories(spark, local_root, depth), files.directories(spark, nas_root, depth))
    for side, words in (("missing", "is missing local"), ("extra", "has extra")):
        sample = [r[0] for r in differ.where(F.col("side") == side).orderBy(F.split("dir", "/")).limit(5).select("dir").collect()]
        if sample:
            raise ValueError(f"NAS root {words} directories within depth {depth}: {', '.join(sample)}")


def generate_manifest(spark: SparkSession, local_root: str, nas_root: str, manifest: str, structure_depth: int = 2, progress: Progress = SILENT) -> str:
    local = str(Path(local_root).resolve())
    if not os.path.isdir(local):
        raise ValueError(f"local batch root is not a directory: {local_root}")
    if os.path.exists(manifest):
        raise ValueError(f"manifest already exists: {manifest}")
    validate_roots(spark, local, str(nas_root), structure_depth)
    with progress.phase("list files"):
        found = files.regular_files(spark, local)
        progress.advance(found.count())
    with progress.phase("hash files", progress.done):
        hashed = stored(files.with_digests(found), "hashed")
    if bad := hashed.where("digest IS NULL").orderBy("path").first():
        raise OSError(bad["digest_error"])
    rows = inventory.manifest_rows(hashed, str(nas_root), local, _now())
    with progress.phase("write manifest"):
        return manifests.write_csv(rows, manifest, "manifest", inventory.MANIFEST_ORDER)


def _write_log(rows: DataFrame, path: str, what: str, mode: str, order: list[str]) -> str:
    values = {"mode": F.lit(mode), "timestamp": F.lit(_now())}
    full = rows.withColumns({c: F.lit("") for c in LOG_FIELDS if c not in rows.columns} | values)
    return manifests.write_csv(full.select(*LOG_FIELDS, *order), path, what, order)


def plan_from_manifests(spark: SparkSession, paths: list[str], output_root: str, log: str | None = None, ignore_json: bool = False, progress: Progress = SILENT) -> dict:
    with progress.phase("load manifests", len(paths)):
        tables = manifests.load(spark, paths)
    with progress.phase("plan"):
        rows = stored(planning.plan(*tables, str(output_root), ignore_json), "plan")
    # Within an entry the log sorts by place; a conflict group keeps the order of reading.
    with progress.phase("write plan"):
        path = _write_log(rows, log or manifests.dated_log("plan"), "plan log", "manifest_plan", planning.ORDER)
    return {"log_path": path, **planning.totals(rows).first().asDict()}


def analyze_plan(spark: SparkSession, plan: str) -> dict:
    from dupeplan.schema import ANALYSIS_REQUIRED

    rows = stored(manifests.read_csv(spark, plan, ANALYSIS_REQUIRED, "plan"), "plan")
    found = analysis.plan_totals(rows).first().asDict()
    counts = {r["kind"]: r["conflicts"] for r in analysis.destination_conflicts(rows).collect()}
    found |= {"duplicate_output_destination_conflicts": counts["move"], "sidecar_merge_target_conflicts": counts["merge"]}
    for kind in ("file_role", "disposition", "input_root"):
        found[f"by_{kind}"], found[f"bytes_by_{kind}"] = {}, {}
    for r in analysis.plan_breakdown(rows).collect():  # one row for each distinct role, disposition and root
        found[f"by_{r['kind']}"][r["key"]], found[f"bytes_by_{r['kind']}"][r["key"]] = r["files"], r["bytes"]
    found["skipped_by_disposition"] = {r["disposition"]: r["rows"] for r in analysis.plan_skipped(rows).collect()}
    return found


def analyze_json_sidecars(spark: SparkSession, paths: list[str], log: str | None = None, progress: Progress = SILENT) -> dict:
    with progress.phase("load manifests", len(paths)):
        entries, sidecars, _ = manifests.load(spark, paths)
    with progress.phase("find conflicts"):
        found = analysis.json_conflict_groups(entries, sidecars)
    order = ["o_group", "o_part", "o_key", "o_label", "o_path", "o_pos"]
    with progress.phase("compare sidecars", found.count() if progress.enabled else 0):
        rows = stored(analysis.json_differences(found, analysis.json_items(file_texts(found))), "differences")
    path = manifests.write_csv(rows.select(*JSON_FIELDS, *order), log or manifests.dated_log("analyze_json_sidecars"), "JSON analysis log", order)
    counts = rows.agg(F.count_if(F.col("status") == "error").alias("e"), F.count_distinct(F.when(F.col("status") == "differing", F.struct("group_id", "json_key"))).alias("d")).first()
    return {"log_path": path, "analyzed_groups": found.select("g").distinct().count(), "differing_keys": counts["d"], "parse_errors": counts["e"]}


def file_texts(paths: DataFrame) -> DataFrame:
    """(path, content, error) of small files, read where the task runs."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            content, errors = [], []
            for p in batch.column(0).to_pylist():
                try:
                    with open(p, "rb") as f:
                        content.append(f.read())
                    errors.append(None)
                except OSError as error:
                    content.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    return paths.select("path").distinct().mapInArrow(run, "path string, content binary, error string")


def verify_bytes(spark: SparkSession, paths: list[str], log: str | None = None, progress: Progress = SILENT) -> dict:
    """Compares every file of a bucket with the first, piece by piece."""
    with progress.phase("load manifests", len(paths)):
        groups = stored(verification.byte_groups(*manifests.load(spark, paths)), "groups")
    first = groups.where("first").select("file_role", "group_id", F.col("path").alias("left"))
    with progress.phase("compare bytes", groups.count() if progress.enabled else 0):
        compared = stored(files.equal_files(groups.join(first, ["file_role", "group_id"]).withColumn("right", F.col("path"))), "compared")
    contents = compared.select("path", F.when(F.col("equal"), F.col("left")).otherwise(F.col("path")).alias("content")).distinct()
    rows = stored(verification.byte_log(groups, contents), "bytes")
    role = F.when(F.col("file_role") == "primary", 0).when(F.col("file_role") == "sidecar", 1).otherwise(2)
    path = _write_log(rows.withColumn("o_role", role), log or manifests.dated_log("verify_bytes"), "verify log", "manifest_verify", ["o_role"])
    failed = rows.where("disposition = 'verify_failed'").select("file_role", "group_id").distinct().count()
    return {"log_path": path, "checked_groups": groups.select("file_role", "group_id").distinct().count(), "failed_groups": failed}


def verify_move(spark: SparkSession, paths: list[str], output_root: str, log: str | None = None, ignore_json: bool = False, progress: Progress = SILENT) -> dict:
    with progress.phase("plan", len(paths)):
        rows = stored(planning.plan(*manifests.load(spark, paths), str(output_root), ignore_json), "plan")
    where = rows.select(F.explode(F.array("source_path", "destination_path")).alias("path")).where("path <> ''")
    with progress.phase("check paths"):
        checks = stored(verification.move_log(rows, files.snapshot(spark, where, with_digest=False)), "checks")
    target = log or manifests.dated_log("verify_move")
    inside = files.tree(spark, str(output_root)).where("is_file").select("path", F.lit(True).alias("is_file"), "size_bytes")
    extra = stored(verification.unexpected_outputs(rows, inside).where(F.col("source_path") != os.path.abspath(target)), "extra")
    whole = checks.withColumn("o_extra", F.lit(0)).unionByName(extra.withColumn("o_extra", F.lit(1)), allowMissingColumns=True).fillna("")
    path = _write_log(whole, target, "verify-move log", "verify_move", ["o_extra", *planning.VERIFY_ORDER, "o_at", "source_path"])
    counts = checks.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("bad")).first()
    return {"log_path": path, "checked_paths": counts["n"], "matched_paths": counts["n"] - counts["bad"], "failed_paths": counts["bad"], "unexpected_outputs": extra.count()}


def execute_plan(spark: SparkSession, plan: str, log: str | None = None, move: bool = False, verify_hashes: bool | None = None, progress: Progress = SILENT) -> dict:
    """Dry run, or moves; hashes are verified by default when files move."""
    verify = move if verify_hashes is None else verify_hashes
    read = manifests.read_csv(spark, plan, EXECUTION_REQUIRED, "plan")
    digest = "xxh128" if "xxh128" in read.columns else "xxh64"
    wanted = {c: F.lit("") for c in ("keeper_path", "input_root", "xxh128") if c not in read.columns}
    rows = read.withColumns(wanted)
    if digest == "xxh64" and digest in read.columns:
        rows = rows.withColumn("xxh128", F.col("xxh64"))
    rows = stored(rows, "plan")
    _check_plan(rows, plan)
    target = log or manifests.dated_log("execute_plan")
    manifests.refuse_existing(target, "execution log")
    every = execution.planned(rows).selectExpr("explode(array(source_path, destination_path, duplicate_output_path)) AS path").where("path <> ''")
    if move:
        made = moving.move_bundles(spark, rows, verify)
    else:
        found = execution.log_rows(rows, files.snapshot(spark, every), verify)
        made = (r.asDict() for r in found.orderBy(*execution.LOG_ORDER).toLocalIterator())
    result = {"log_path": target, "bundles": 0, "moved_bundles": 0, "planned_bundles": 0, "already_moved_bundles": 0, "skipped_bundles": 0, "orphan_sidecars": 0}
    fields = [digest if c == "xxh128" else c for c in LOG_FIELDS]
    total = rows.where(F.col("disposition").isin(*execution.PRIMARY)).count() if progress.enabled else 0
    with progress.phase("move bundles" if move else "check bundles", total), open(target, "x", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(fields)
        for r in made:
            r |= {"mode": f"execute_plan_{'move' if move else 'dry_run'}", "timestamp": _now()}
            writer.writerow([r.get(c, "") if r.get(c) is not None else "" for c in LOG_FIELDS])
            if r["disposition"] == "orphan_plan_sidecar":
                result["orphan_sidecars"] += 1
            elif r["part"] == 1:
                result["bundles"] += 1
                name = {"kept": "already_moved", "planned": "planned", "moved": "moved"}.get(r["status"], "skipped")
                result[f"{name}_bundles"] += 1
                progress.advance(errors=int(name == "skipped"))
            if r["status"] == "moved":
                progress.advance(0, moved_files=1, moved_bytes=r["size_bytes"])
    return result


def _check_plan(rows: DataFrame, path: str) -> None:
    """Errors of malformed rows that execution would read."""
    keepers = [*execution.KEEPER_DISPOSITIONS]
    read = rows.where(F.col("disposition").isin(*keepers, "planned_sidecar_merge", "planned_duplicate_sidecar", *execution.PRIMARY))
    keeper, sidecar, merge = F.col("disposition").isin(keepers), F.col("file_role") == "sidecar", F.col("disposition") == "planned_sidecar_merge"
    error = (
        F.when(F.expr("try_cast(size_bytes AS bigint)").isNull(), F.concat(F.lit("invalid plan size_bytes "), "size_bytes"))
        .when((F.col("source_path") == "") | (~keeper & (F.col("destination_path") == "")), "plan row missing source or destination path")
        .when(sidecar & (F.col("primary_source_path") == ""), "sidecar plan row missing primary_source_path")
        .when(~sidecar & (F.col("primary_source_path") != ""), "non-sidecar plan row has primary_source_path")
        .when(merge & (F.col("duplicate_output_path") == ""), "sidecar merge plan row missing duplicate_output_path")
        .when(~merge & (F.col("duplicate_output_path") != ""), "plan row has unexpected duplicate_output_path")
    )
    bad = read.select("_line", error.alias("error")).where("error IS NOT NULL").orderBy("_line").first()
    if bad is not None:
        raise ValueError(f"{bad['error']}: {path}")
    twice = execution.planned(rows).where(keeper).groupBy("group_id").count().where("count > 1").orderBy("group_id").first()
    if twice is not None:
        raise ValueError(f"multiple keeper rows for group_id {twice['group_id']}: {path}")
