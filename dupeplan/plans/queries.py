"""Queries over the inventory adapter, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupeplan.functions import paths
from dupeplan.operators import analysis, execution, inventory, planning, verification
from dupeplan.operators.ordering import positioned
from dupeplan.plans import adapter
from dupeplan.plans.oracle import SQL
from dupeplan.sources import files as disk
from dupeplan.sources import manifests
from dupeplan.sources.scratch import local_folder, stored

PLAN_COLUMNS = ["disposition", "event", "status", "reason", "file_role", "source_path", "destination_path", "duplicate_output_path", "keeper_path", "primary_source_path", "group_id", "message", "size_bytes", "xxh128", "input_root"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory without contents, stored: sizes and digests are taken from the contents once."""
    return stored(adapter.inventory(spark, sf_dir).drop("content"), "inventory")


def _plan(files: DataFrame, ignore_json: bool = False) -> DataFrame:
    return planning.plan(*adapter.split(files), adapter.OUTPUT, ignore_json)


def _stored_plan(files: DataFrame) -> DataFrame:
    """The plan as the commands after it read it: a table whose lines are numbered."""
    return stored(positioned(_plan(files), *planning.ORDER, name="_line"), "plan")


def _groups(files: DataFrame, ignore_json: bool = False) -> tuple[DataFrame, DataFrame]:
    entries, sidecars, _ = adapter.split(files)
    return planning.duplicate_groups(entries, sidecars, ignore_json)


def snapshot(files: DataFrame) -> DataFrame:
    """File system state after a deterministic disturbance by ordinal."""
    turn = F.col("ordinal") % 10
    to = paths.destination(adapter.OUTPUT, "label", "relative_path")
    here = files.where(~turn.isin(0, 3)).select("path", F.lit(True).alias("is_file"), (F.col("size_bytes") + F.when(turn == 2, 1).otherwise(0)).alias("size_bytes"), F.when(turn == 4, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    there = files.where(turn.isin(0, 1)).select(to.alias("path"), F.lit(True).alias("is_file"), "size_bytes", "digest")
    extra = files.where("file_role <> 'sidecar' AND ordinal % 50 = 7").select(F.concat(F.lit(f"{adapter.OUTPUT}/extra/"), "ordinal", F.lit(".tmp")).alias("path"), F.lit(True).alias("is_file"), F.lit(1).cast("long").alias("size_bytes"), F.lit("").alias("digest"))
    return here.unionByName(there).unionByName(extra)


@query
def inventory_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.inventory(spark, sf_dir).select("ordinal", "file_role", "label", "path", "relative_path", F.coalesce("primary_path", F.lit("")).alias("primary_path"), "size_bytes", "digest")


@query
def file_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.inventory(spark, sf_dir).groupBy("file_role").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query
def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = {"name": paths.name("path"), "suffix": paths.suffix("path"), "stem": paths.stem("path"), "parent": paths.parent("path"), "path_class": paths.path_class("path").cast("long"), "date_score": paths.date_score("path").cast("long"), "is_primary": paths.is_primary("path")}
    return adapter.inventory(spark, sf_dir).select("path", *[v.alias(k) for k, v in features.items()])


@query
def primary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(_files(spark, sf_dir))[0].select("group_id", F.col("g").alias("first_ordinal"), "ordinal", "path", "n")


@query
def primary_uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.unique_files(adapter.split(_files(spark, sf_dir))[0]).select("path", "size_bytes", "digest")


@query
def sidecar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.sidecar_members(adapter.split(_files(spark, sf_dir))[1]).select("group_id", "path", "n")


@query
def uncategorized_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.duplicate_members(adapter.split(_files(spark, sf_dir))[2], "u").select("group_id", "path", "n")


@query
def entry_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, sidecars, _ = adapter.split(_files(spark, sf_dir))
    own = sidecars.groupBy("ordinal").agg(F.count("*").alias("c"), F.sum("size_bytes").alias("b"))
    return entries.join(own, "ordinal", "left").select("ordinal", "path", F.coalesce("c", F.lit(0)).cast("long").alias("sidecars"), (F.col("size_bytes") + F.coalesce("b", F.lit(0))).alias("bytes"))


@query
def collapse_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = adapter.split(_files(spark, sf_dir))[0]
    again = entries.withColumn("ordinal", F.col("ordinal") + 10**9)
    return inventory.collapsed(entries.unionByName(again), ["size_bytes", "digest", "label", "relative_path", "nas_root"]).select("path", "ordinal", "size_bytes", "digest")


@query
def sidecar_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of made-up names in the directories of the inventory."""
    return inventory.classified(_names(spark, sf_dir)).select("dir", "name", "file_role", "reason", F.coalesce("primary_name", F.lit("")).alias("primary_name"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    base = F.concat(F.lit("img"), (F.col("doc_id") % 40).cast("string"))
    made = F.expr("element_at(array('.jpg', '.JPG', '.heic', '.mov', '.jpg.json', '.JPG.json', '.json', '.jpg.mp4', '.bin', '.png'), cast(doc_id % 10 + 1 as int))")
    return d.select(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 97).cast("string")).alias("dir"), F.concat(F.when(F.col("doc_id") % 3 == 0, F.upper(base)).otherwise(base), made).alias("name")).distinct()


@query
def sidecar_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.multisets(_groups(_files(spark, sf_dir))[1])


@query
def superset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.superset_entries(planning.multisets(_groups(_files(spark, sf_dir))[1]))


@query
def class_merge_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.class_merge_groups(_groups(_files(spark, sf_dir))[1])


@query
def required_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.required_keys(_groups(_files(spark, sf_dir))[1])


@query
def merge_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, grouped = _groups(_files(spark, sf_dir))
    return planning.merge_needs(grouped, planning.primary_keepers(members, grouped))


@query
def keeper_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.primary_keepers(*_groups(_files(spark, sf_dir)))


@query
def keeper_primary_ignore_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.primary_keepers(*_groups(_files(spark, sf_dir), True))


@query
def keeper_uncategorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.other_keepers(planning.duplicate_members(adapter.split(_files(spark, sf_dir))[2], "u"))


@query
def merge_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, grouped = _groups(_files(spark, sf_dir))
    return planning.allocated(members, grouped, planning.primary_keepers(members, grouped)).select("g", "ordinal", "pos", "path", "merge")


@query
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(_files(spark, sf_dir)).select(*PLAN_COLUMNS)


@query
def move_plan_ignore_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(_files(spark, sf_dir), True).select(*PLAN_COLUMNS)


@query
def plan_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.totals(_plan(_files(spark, sf_dir)))


@query
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.plan_totals(_plan(_files(spark, sf_dir)))


@query
def plan_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.plan_breakdown(_plan(_files(spark, sf_dir)))


@query
def plan_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.plan_skipped(_plan(_files(spark, sf_dir)))


@query
def destination_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.destination_conflicts(_plan(_files(spark, sf_dir)))


@query
def json_conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON sidecars in groups without a keeper; every file has a sidecar of its own, so that no group has one."""
    return analysis.json_conflict_groups(*adapter.split(adapter.json_files(spark, sf_dir))[:2]).select("g", "group_id", "ordinal", "path", "primary_source_path")


@query
def json_key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that differ, are missing or cannot be read, in made-up sidecars."""
    files = stored(adapter.json_files(spark, sf_dir), "inventory")
    found = analysis.json_conflict_groups(*adapter.split(files)[:2])
    contents = files.select("path", "content").join(found.select("path"), "path", "left_semi")
    return analysis.json_differences(found, analysis.json_items(contents)).drop("o_group", "o_part", "o_key", "o_label", "o_path", "o_pos")


@query
def plan_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return execution.bundles(_stored_plan(files)).select("group_id", "bundle", F.col("kind").cast("long").alias("kind"), "disposition", "source_path", "destination_path", "duplicate_output_path", F.col("k_source_path").alias("keeper"))


@query
def orphan_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar rows of a plan from which every second primary row is gone."""
    files = _files(spark, sf_dir)
    number = F.regexp_extract("source_path", "IMG_([0-9]+)", 1).cast("int")
    cut = _stored_plan(files).where(~((F.col("disposition") == "planned_duplicate_primary") & (number % 2 == 0)))
    return execution.orphans(cut).select("group_id", "disposition", "source_path")


@query
def row_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return execution.row_states(execution.bundles(_stored_plan(files)), snapshot(files)).select("source_path", "disposition", "state")


def _verdict(spark: SparkSession, sf_dir: str, verify: bool) -> DataFrame:
    files = _files(spark, sf_dir)
    rows = execution.verdicts(_stored_plan(files), snapshot(files), verify)
    return rows.groupBy("group_id", "bundle").agg(F.count("*").alias("files"), F.coalesce(F.max("verdict"), F.lit("validated")).alias("verdict"))


@query
def bundle_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict(spark, sf_dir, False)


@query
def bundle_verdict_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict(spark, sf_dir, True)


@query
def merge_row_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States, look-ups of hashes and actions of the merges; every plan row but the sidecars is moved as a merge, beside the merges of the plan."""
    files = _files(spark, sf_dir)
    rows = execution.bundles(_stored_plan(files)).withColumn("duplicate_output_path", F.when(F.col("duplicate_output_path") == "", F.concat("destination_path", F.lit(".again"))).otherwise(F.col("duplicate_output_path")))
    merges = rows.withColumn("disposition", F.lit("planned_sidecar_merge"))
    again = snapshot(files).where(F.startswith("path", F.lit(adapter.OUTPUT))).withColumn("path", F.concat("path", F.lit(".again"))).withColumn("digest", F.when(F.col("size_bytes") % 2 == 0, "other").otherwise(F.col("digest")))
    return execution.row_states(merges, snapshot(files).unionByName(again)).select("source_path", "state", "hash_check", "observed_hash", F.coalesce("action_destination", F.lit("")).alias("action_destination"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a plan from which a tenth of the primary rows is gone."""
    files = _files(spark, sf_dir)
    plan = _stored_plan(files)
    cut = plan.where(~((F.col("disposition") == "planned_duplicate_primary") & (F.regexp_extract("source_path", "IMG_([0-9]+)", 1).cast("int") % 10 == 6)))
    return execution.log_rows(cut, snapshot(files), True)


@query
def execution_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).drop(*[c for c in execution.LOG_ORDER if c != "source_path"])


@query
def execution_log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, path and kind of every row of the log."""
    return positioned(_log(spark, sf_dir), *execution.LOG_ORDER).select("position", "event", "source_path")


@query
def plan_log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every row in the plan's log."""
    return positioned(_plan(_files(spark, sf_dir)), *planning.ORDER).select("position", "disposition", "source_path")


@query
def verify_move_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every check in the log of verified moves."""
    files = _files(spark, sf_dir)
    return positioned(verification.move_log(_plan(files), snapshot(files)), *planning.VERIFY_ORDER, "o_at").select("position", "event", "source_path", "destination_path")


@query
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group numbers of made-up names in the directories of the inventory."""
    return inventory.with_group_ids(inventory.classified(_names(spark, sf_dir))).select("dir", "name", "file_role", "group_id")


@query
def manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a manifest in their order."""
    names = _names(spark, sf_dir).withColumns({"size_bytes": F.length("name").cast("long"), "digest": F.sha2("name", 256)})
    rows = positioned(inventory.manifest_rows(names, "/nas/batch/", "/local/batch", "2020-01-01T00:00:00"), *inventory.MANIFEST_ORDER, "relative_path")
    return rows.select("position", "file_role", "status", "reason", "group_id", "relative_path", "primary_relative_path", "nas_path", "primary_nas_path", "nas_root_label", "nas_root", "batch_root", "size_bytes", "xxh128")


@query
def manifest_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written as CSV, read back and checked: the files of the three roles."""
    names = _names(spark, sf_dir).withColumns({"size_bytes": F.length("name").cast("long"), "digest": F.sha2("name", 256)})
    folder = local_folder(spark, "manifest")
    written = manifests.write_csv(inventory.manifest_rows(names, "/nas/batch/", "/local/batch", "2020-01-01T00:00:00"), f"{folder}/m.csv", "manifest", inventory.MANIFEST_ORDER)
    roles = zip(("primary", "sidecar", "uncategorized"), manifests.load(spark, [written]))
    parts = [df.select(F.lit(role).alias("file_role"), "label", "path", "relative_path", "size_bytes", "digest") for role, df in roles]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def plan_analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan written as a CSV log, read back and totalled."""
    from dupeplan.schema import ANALYSIS_REQUIRED

    rows = positioned(_plan(_files(spark, sf_dir)), *planning.ORDER).drop(*planning.ORDER, *planning.VERIFY_ORDER)
    written = manifests.write_csv(rows, f"{local_folder(spark, 'plan')}/p.csv", "plan log", ["position"])
    return analysis.plan_totals(manifests.read_csv(spark, written, ANALYSIS_REQUIRED, "plan"))


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for every supplier, below its region and nation; what a task writes again is the same."""
    folder = local_folder(spark, "tree")
    s, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    rows = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    disk.write_files(rows.select(F.concat(F.lit(f"{folder}/"), "r_name", F.lit("/"), "n_name", F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("path"), F.col("n_name").cast("binary").alias("content")))
    return folder


@query
def filetree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below a folder of suppliers' files."""
    return disk.tree(spark, _tree(spark, sf_dir)).select("dir", "name", "is_file", "is_dir", "is_link", "size_bytes")


@query
def tree_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its directories down to depth 1, and how many regular files lie in each of the others."""
    folder = _tree(spark, sf_dir)
    regular = disk.regular_files(spark, folder).groupBy("dir").agg(F.count("*").alias("files"))
    return disk.directories(spark, folder, 1).select("dir", F.lit(0).cast("long").alias("files")).unionByName(regular)


@query
def file_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at the places of the files, and at places beside them; files of equal bytes have equal digests."""
    folder = _tree(spark, sf_dir)
    found = disk.regular_files(spark, folder)
    asked = found.select("path").unionByName(found.select(F.concat("path", F.lit("x")).alias("path"))).unionByName(found.select(paths.parent("path").alias("path")))
    seen = stored(disk.snapshot(spark, asked).where("is_file"), "seen")
    alike = seen.groupBy("digest").agg(F.count("*").alias("alike"))
    return seen.join(alike, "digest").select(F.substring("path", len(folder) + 2, 10_000).alias("path"), "size_bytes", "alike")


@query
def equal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file against the first of its region, byte by byte."""
    folder = _tree(spark, sf_dir)
    found = disk.regular_files(spark, folder).withColumn("region", F.substring_index("dir", "/", 1))
    first = found.groupBy("region").agg(F.min("path").alias("left"))
    pairs = disk.equal_files(found.join(first, "region").select("left", F.col("path").alias("right")))
    cut = lambda c: F.substring(c, len(folder) + 2, 10_000).alias(c)
    return pairs.select(cut("left"), cut("right"), "equal")


@query
def byte_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a digest of one hex character, so that buckets hold unequal bytes."""
    files = _files(spark, sf_dir)
    weak = files.withColumn("digest", F.substring("digest", 1, 1))
    return verification.byte_log(verification.byte_groups(*adapter.split(weak)), files.select("path", F.col("digest").alias("content")))


@query
def verify_move_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return verification.move_log(_stored_plan(files), snapshot(files)).drop(*planning.VERIFY_ORDER, "o_at")


@query
def unexpected_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    below = snapshot(files).where(F.startswith("path", F.lit(f"{adapter.OUTPUT}/")))
    return verification.unexpected_outputs(_stored_plan(files), below)


@query
def dir_structure_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = adapter.inventory(spark, sf_dir).select("label", paths.parent("relative_path").alias("dir"))
    return inventory.structure_difference(dirs.where("label = 'src0'").select("dir"), dirs.where("label = 'src1'").select("dir"))


@query
def xxh128_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XXH3-128 of every file's content."""
    return disk.content_digests(adapter.inventory(spark, sf_dir).select("path", F.col("content").cast("binary").alias("content")))


@query
def xxh128_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every file, and the first path and number of the files with its XXH3-128."""
    found = stored(xxh128_fingerprint(spark, sf_dir), "digests")
    return found.join(found.groupBy("digest").agg(F.min("path").alias("first_path"), F.count("*").alias("n")), "digest").select("path", "size_bytes", "first_path", "n")


@query
def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical values of the event properties."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return analysis.json_items(events.select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("content"))).select("path", F.inline("items"))


_NAMES = """WITH n AS (SELECT DISTINCT 'd' || CAST(floor(doc_id / 97) AS BIGINT) AS dir,
  CASE WHEN doc_id % 3 = 0 THEN upper('img' || (doc_id % 40)) ELSE 'img' || (doc_id % 40) END || ['.jpg', '.JPG', '.heic', '.mov', '.jpg.json', '.JPG.json', '.json', '.jpg.mp4', '.bin', '.png'][doc_id % 10 + 1] AS name FROM documents),
p AS (SELECT dir, name, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM n WHERE lower(regexp_extract(name, '\\.[^.]*$')) IN ('.jpg', '.heic', '.png')),
c AS (SELECT dir, name, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM n ANTI JOIN p USING (dir, name)),
j AS (SELECT c.dir, c.name, count(p.name) AS k, any_value(p.name) AS primary_name FROM c LEFT JOIN p ON p.dir = c.dir AND (p.stem = c.stem OR starts_with(lower(c.name), lower(p.name) || '.')) GROUP BY ALL),
r AS (SELECT dir, name, 'primary' AS file_role, '' AS reason, '' AS primary_name FROM p
UNION ALL SELECT dir, name, CASE WHEN k = 1 THEN 'sidecar' ELSE 'uncategorized' END, CASE k WHEN 1 THEN '' WHEN 0 THEN 'unrecognized_non_primary' ELSE 'ambiguous_sidecar_multiple_primaries' END, CASE WHEN k = 1 THEN primary_name ELSE '' END FROM j),
f AS (SELECT dir, name AS anchor, 'f' || lpad(CAST(row_number() OVER (ORDER BY dir, lower(name), name) AS VARCHAR), 6, '0') AS group_id FROM p),
i AS (SELECT r.*, coalesce(f.group_id, '') AS group_id, CASE file_role WHEN 'sidecar' THEN primary_name ELSE name END AS anchor, r.dir || '/' || name AS relative_path, CASE file_role WHEN 'sidecar' THEN r.dir || '/' || primary_name ELSE '' END AS primary_relative_path
  FROM r LEFT JOIN f ON f.dir = r.dir AND f.anchor = CASE file_role WHEN 'primary' THEN name WHEN 'sidecar' THEN primary_name END)"""
_TREE = """WITH t AS (SELECT r_name, n_name, s_suppkey || '.txt' AS name, r_name || '/' || n_name || '/' || s_suppkey || '.txt' AS path, CAST(strlen(n_name) AS BIGINT) AS size_bytes
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ORACLE_SQL = SQL | {
    "json_canonical": "SELECT CAST(event_id AS VARCHAR) AS path, regexp_extract(props, '\"([^\"]*)\"', 1) AS key, regexp_extract(props, ':\\s*([^}\\s]*)', 1) AS value FROM events",
    "sidecar_match": f"{_NAMES} SELECT dir, name, file_role, reason, primary_name FROM r",
    "group_ids": f"{_NAMES} SELECT dir, name, file_role, group_id FROM i",
    "manifest_order": f"""{_NAMES} SELECT row_number() OVER (ORDER BY dir, lower(anchor), anchor, CASE file_role WHEN 'sidecar' THEN 1 ELSE 0 END, lower(name), relative_path) - 1 AS position, file_role, CASE reason WHEN '' THEN 'included' ELSE 'skipped' END AS status, reason, group_id,
  relative_path, primary_relative_path, '/nas/batch/' || relative_path AS nas_path, CASE file_role WHEN 'sidecar' THEN '/nas/batch/' || primary_relative_path ELSE '' END AS primary_nas_path, 'batch' AS nas_root_label, '/nas/batch' AS nas_root, '/local/batch' AS batch_root, CAST(strlen(name) AS BIGINT) AS size_bytes, sha256(name) AS xxh128 FROM i""",
    "manifest_loaded": f"{_NAMES} SELECT file_role, 'batch' AS label, '/nas/batch/' || relative_path AS path, relative_path, CAST(strlen(name) AS BIGINT) AS size_bytes, sha256(name) AS digest FROM i",
    "plan_analyzed": SQL["plan_totals"],
    "filetree_scan": f"""{_TREE} SELECT r_name || '/' || n_name AS dir, name, true AS is_file, false AS is_dir, false AS is_link, size_bytes FROM t
UNION ALL SELECT DISTINCT r_name, n_name, false, true, false, CAST(0 AS BIGINT) FROM t UNION ALL SELECT DISTINCT '.', r_name, false, true, false, CAST(0 AS BIGINT) FROM t""",
    "tree_directories": f"{_TREE} SELECT DISTINCT r_name AS dir, CAST(0 AS BIGINT) AS files FROM t UNION ALL SELECT r_name || '/' || n_name, count(*) FROM t GROUP BY 1",
    "file_snapshot": f"{_TREE} SELECT path, size_bytes, count(*) OVER (PARTITION BY n_name) AS alike FROM t",
    "equal_files": f"{_TREE} SELECT x.path AS left, t.path AS right, x.n_name = t.n_name AS equal FROM t JOIN (SELECT r_name, path, n_name FROM t QUALIFY row_number() OVER (PARTITION BY r_name ORDER BY path) = 1) x USING (r_name)",
}
