"""Aggregates of a plan, and key differences of JSON sidecars."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupeplan.functions import paths
from dupeplan.operators import planning
from dupeplan.schema import ANALYSIS_REQUIRED, MERGE_DISPOSITION, OUTPUT_DISPOSITIONS
from dupeplan.sources.scratch import stored


def _checked(plan: DataFrame) -> DataFrame:
    if missing := sorted(set(ANALYSIS_REQUIRED) - set(plan.columns)):
        raise ValueError(f"plan missing required fields {missing}")
    size = F.try_cast("size_bytes", "bigint") if hasattr(F, "try_cast") else F.expr("try_cast(size_bytes AS bigint)")
    ok = size >= 0
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ANALYSIS_REQUIRED if c != "size_bytes"}
    flags = {
        "invalid": F.coalesce(~ok, F.lit(True)),
        "size": F.when(ok, size).otherwise(0).cast("long"),
        "output": F.col("disposition").isin(OUTPUT_DISPOSITIONS),
        "merge": F.col("disposition") == MERGE_DISPOSITION,
        "skipped": F.col("status").isin("skipped", "error") | F.startswith("disposition", F.lit("kept_sidecar_conflict")),
    }
    return plan.withColumns(text).withColumns(flags)


def plan_totals(plan: DataFrame) -> DataFrame:
    """One row: files, bytes and groups of moves and of merges, skipped rows, and rows with an invalid size."""
    named = lambda flag: F.countDistinct(F.when(F.col(flag) & (F.col("group_id") != ""), F.col("group_id")))
    of = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("size"))), F.lit(0)).cast("long")
    return _checked(plan).agg(
        F.count_if("output").alias("duplicate_output_files"),
        of("output").alias("duplicate_output_bytes"),
        named("output").alias("duplicate_output_groups"),
        F.count_if("merge").alias("sidecar_merge_files"),
        of("merge").alias("sidecar_merge_bytes"),
        named("merge").alias("sidecar_merge_groups"),
        F.count_if("skipped").alias("skipped_rows"),
        F.count_if("invalid").alias("invalid_size_rows"),
    )


def plan_breakdown(plan: DataFrame) -> DataFrame:
    """(kind, key, files, bytes) of moved files by file_role, disposition and input_root; one pass over the plan."""
    rows = _checked(plan).where("output")
    blank = lambda c: F.when(F.col(c) == "", "(blank)").otherwise(F.col(c))
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), (F.col(c) if c == "disposition" else blank(c)).alias("key")) for c in ("file_role", "disposition", "input_root")])
    return rows.select(F.inline(pairs), "size").groupBy("kind", "key").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def plan_skipped(plan: DataFrame) -> DataFrame:
    return _checked(plan).where("skipped").groupBy("disposition").agg(F.count("*").alias("rows"))


def destination_conflicts(plan: DataFrame) -> DataFrame:
    """(kind, conflicts): destinations that several rows share, for moves and for merges."""
    kind = F.when(F.col("output"), "move").when(F.col("merge"), "merge")
    uses = _checked(plan).where("(output OR merge) AND destination_path <> ''").groupBy(kind.alias("kind"), "destination_path").agg(F.count("*").alias("n"))
    kinds = plan.sparkSession.createDataFrame([("move",), ("merge",)], "kind string")
    return kinds.join(uses.where("n > 1").groupBy("kind").agg(F.count("*").alias("conflicts")), "kind", "left").fillna(0, ["conflicts"])


def json_items(contents: DataFrame) -> DataFrame:
    """(path, error, items): the canonical text of every top-level value, or why there is none.

    ``contents`` has path and content (the file's text or bytes; null with its error in column error if there is one).
    """
    schema = "path string, error string, items array<struct<key:string,value:string>>"
    has_error = "error" in contents.columns

    def canonical(raw: bytes | str) -> list[dict[str, str]]:
        data = json.loads(raw.decode("utf-8") if isinstance(raw, bytes) else raw)
        if not isinstance(data, dict):
            raise ValueError("JSON sidecar root is not an object")
        return [{"key": k, "value": json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)} for k, v in data.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
        for batch in batches:
            paths, errors, items = batch.column(0).to_pylist(), [], []
            given = batch.column(2).to_pylist() if has_error else [None] * len(paths)
            for raw, error in zip(batch.column(1).to_pylist(), given, strict=True):
                found = None
                if error is None:
                    try:
                        found = canonical("" if raw is None else raw)
                    except ValueError as problem:
                        error = str(problem)
                errors.append(error)
                items.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(errors, pa.string()), pa.array(items, item)], names=["path", "error", "items"])

    return contents.select("path", "content", *["error"] * has_error).mapInArrow(run, schema)


def json_conflict_groups(entries: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars that are JSON files in groups without a keeper: g, group_id, their primary's path and order."""
    members, grouped = planning.duplicate_groups(entries, sidecars)
    conflict = members.join(planning.primary_keepers(members, grouped).select("g"), "g", "left_anti")
    own = conflict.select("ordinal", "g", "group_id", F.col("path").alias("primary_source_path"), F.lower("label").alias("o_label"), F.lower("relative_path").alias("o_path"))
    return stored(sidecars.where(F.lower(paths.suffix("path")) == ".json").select("ordinal", "pos", "path").join(own, "ordinal"), "json")


def json_differences(files: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of the JSON analysis: unreadable files, and values of keys that differ within a group; a missing key counts as null."""
    total = files.groupBy("g").agg(F.count("*").alias("json_sidecar_count"))
    read = stored(files.join(items, "path").join(total, "g"), "read")
    errors = read.where("error IS NOT NULL")
    good = read.where("error IS NULL")
    parsed = good.groupBy("g").agg(F.count("*").alias("parsed"))
    found = good.select("g", "ordinal", "pos", F.inline("items"))
    keys = found.groupBy("g", "key").agg(F.count("*").alias("have"), F.countDistinct("value").alias("values"), F.max(F.col("value") != "null").alias("some"))
    differ = keys.join(parsed, "g").where("parsed > 1 AND (values > 1 OR (have < parsed AND some))").select("g", "key")
    cells = good.drop("items").join(differ, "g").join(found, ["g", "ordinal", "pos", "key"], "left").fillna("null", ["value"])
    counts = cells.groupBy("g", "key", "value").agg(F.count("*").alias("value_count_in_group"))
    rows = cells.join(counts, ["g", "key", "value"])
    place = ["o_group", "o_part", "o_key", "o_label", "o_path", "o_pos"]

    def shaped(df: DataFrame, part: int, key, value, digest, count, status: str, reason: str, message) -> DataFrame:
        return df.select(
            "group_id", key.alias("json_key"), F.lit(status).alias("status"), "primary_source_path", F.col("path").alias("source_path"), value.alias("json_value"), digest.alias("value_sha256"),
            count.alias("value_count_in_group"), F.col("json_sidecar_count").cast("long").alias("json_sidecar_count"), F.lit(reason).alias("reason"), message.alias("message"),
            F.col("g").alias(place[0]), F.lit(part).alias(place[1]), key.alias(place[2]), F.col("o_label").alias(place[3]), F.col("o_path").alias(place[4]), F.col("pos").alias(place[5]),
        )

    empty = F.lit("")
    bad = shaped(errors, 0, empty, empty, empty, F.lit(None).cast("long"), "error", "json_parse_error", F.col("error"))
    return bad.unionByName(shaped(rows, 1, F.col("key"), F.col("value"), F.sha2(F.col("value"), 256), F.col("value_count_in_group"), "differing", "json_key_differs", empty))
