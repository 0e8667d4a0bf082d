"""Exact-duplicate buckets, sidecar multisets, keepers and the move plan.

Tables: ``entries`` (primary files) and ``others`` (uncategorized files) have
ordinal, label, path, relative_path, size_bytes and digest; ``sidecars`` has the
ordinal of its primary, pos (its place among that primary's sidecars), path,
relative_path, size_bytes and digest. Ordinals are distinct and give the order of
reading. Groups are formed by grouping and equi-joins, never by windows over a
whole bucket, so that a bucket with very many copies can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dupeplan.functions import paths
from dupeplan.schema import LOG_FIELDS
from dupeplan.sources.scratch import stored

BUCKET = ["size_bytes", "digest"]
FILE = ["ordinal", "label", "path", "relative_path", "size_bytes", "digest"]


def numbered(groups: DataFrame, prefix: str, *then: str) -> DataFrame:
    """Adds group_id, the number of a group by its first ordinal ``g`` (and what comes then); counts go range by range, not through one task."""
    ranged = groups.withColumn("_range", F.shiftright("g", 20))
    before = ranged.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    placed = ranged.withColumn("_rank", F.row_number().over(W.partitionBy("_range").orderBy("g", *then))).join(before, "_range")
    return placed.withColumn("group_id", F.format_string(f"{prefix}%06d", F.col("_before") + F.col("_rank"))).drop("_range", "_before", "_rank")


def buckets(files: DataFrame) -> DataFrame:
    """(size_bytes, digest, n, g) of every bucket; g is the first ordinal."""
    return files.groupBy(*BUCKET).agg(F.count("*").alias("n"), F.min("ordinal").alias("g"))


def duplicate_members(files: DataFrame, prefix: str) -> DataFrame:
    """The files of buckets with several, with g, n and group_id."""
    return files.join(numbered(buckets(files).where("n > 1"), prefix), BUCKET)


def unique_files(files: DataFrame) -> DataFrame:
    return files.join(buckets(files).where("n = 1").select(*BUCKET), BUCKET, "left_semi")


def sidecar_members(sidecars: DataFrame) -> DataFrame:
    """Sidecars in buckets of their own, over all primaries, with g and g_pos of the first; the order is that of primaries, then of places."""
    first = F.min(F.struct("ordinal", "pos"))
    groups = sidecars.groupBy(*BUCKET).agg(F.count("*").alias("n"), first.alias("_first")).where("n > 1").select(*BUCKET, "n", F.col("_first.ordinal").alias("g"), F.col("_first.pos").alias("g_pos"))
    return sidecars.join(numbered(groups, "s", "g_pos"), BUCKET)


def group_sidecars(members: DataFrame, sidecars: DataFrame, ignore_json: bool = False) -> DataFrame:
    """(g, ordinal, pos, class, key, ...) of the sidecars of duplicates."""
    found = sidecars.join(members.select("ordinal", "g"), "ordinal")
    return found.withColumns({"class": paths.sidecar_class("path"), "key": paths.sidecar_key("path", "digest", ignore_json)})


def duplicate_groups(entries: DataFrame, sidecars: DataFrame, ignore_json: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members of groups, their sidecars), stored: all decisions are made from these two."""
    members = stored(duplicate_members(entries.select(*FILE), "m"), "members")
    return members, stored(group_sidecars(members, sidecars.select(*FILE, "pos"), ignore_json), "grouped")


def multisets(grouped: DataFrame, *by: str) -> DataFrame:
    """(g, by, ordinal, key, n)."""
    return grouped.groupBy("g", *by, "ordinal", "key").agg(F.count("*").alias("n"))


def superset_entries(counts: DataFrame, *by: str) -> DataFrame:
    """(g, by, ordinal) of entries whose multiset holds every other one of the group."""
    keys = ["g", *by]
    most = counts.groupBy(*keys, "key").agg(F.max("n").alias("n"))
    wanted = most.groupBy(*keys).agg(F.count("*").alias("wanted"))
    met = counts.join(most, [*keys, "key", "n"]).groupBy(*keys, "ordinal").agg(F.count("*").alias("met"))
    return met.join(wanted, keys).where("met = wanted").select(*keys, "ordinal")


def unclassified_groups(grouped: DataFrame) -> DataFrame:
    return grouped.where("class IS NULL").select("g").distinct()


def class_merge_groups(grouped: DataFrame) -> DataFrame:
    """Groups without unclassified sidecars in which every class has a superset entry."""
    counts = multisets(grouped.where("class IS NOT NULL"), "class")
    have = superset_entries(counts, "class").select("g", "class").distinct().groupBy("g").agg(F.count("*").alias("have"))
    classes = counts.groupBy("g").agg(F.countDistinct("class").alias("classes"))
    return classes.join(have, "g").where("classes = have").select("g").join(unclassified_groups(grouped), "g", "left_anti")


def required_keys(grouped: DataFrame) -> DataFrame:
    """(g, key, required): for each class the multiset of the entry with most sidecars of it, the first of equals; none with unclassified sidecars."""
    counts = multisets(grouped.where("class IS NOT NULL"), "class")
    totals = counts.groupBy("g", "class", "ordinal").agg(F.sum("n").alias("total"))
    best = totals.groupBy("g", "class").agg(F.max(F.struct("total", (-F.col("ordinal")).alias("o"))).alias("best")).select("g", "class", (-F.col("best.o")).alias("ordinal"))
    needed = counts.join(best, ["g", "class", "ordinal"]).groupBy("g", "key").agg(F.sum("n").alias("required"))
    return needed.join(unclassified_groups(grouped), "g", "left_anti")


def keeper_key(no_sidecars: Column | None = None) -> Column:
    """Order of preference; the least is kept."""
    first = [no_sidecars.alias("k0")] if no_sidecars is not None else []
    return F.struct(*first, paths.path_class("path").alias("k1"), paths.date_score("path").alias("k2"), F.lower("label").alias("k3"), F.lower("relative_path").alias("k4"), F.col("ordinal").alias("ordinal"), F.col("path").alias("path"))


def primary_keepers(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """(g, keeper_ordinal, keeper_path); groups in conflict have no row."""
    counts = multisets(grouped)
    supersets = superset_entries(counts).withColumn("superset", F.lit(True))
    with_sidecars = grouped.select("g", "ordinal").distinct().withColumn("has", F.lit(True))
    groups = (
        with_sidecars.groupBy("g").agg(F.lit(True).alias("any_has"))
        .join(supersets.groupBy("g").agg(F.lit(True).alias("any_superset")), "g", "left")
        .join(class_merge_groups(grouped).withColumn("compatible", F.lit(True)), "g", "left")
    )
    found = members.join(groups, "g", "left").join(supersets, ["g", "ordinal"], "left").join(with_sidecars, ["g", "ordinal"], "left")
    may = F.when(F.col("any_superset"), F.coalesce("superset", F.lit(False))).otherwise(F.coalesce("compatible", F.lit(False)) | F.col("any_has").isNull())
    no_sidecars = F.when(F.col("has"), 0).otherwise(1)
    return _kept(found.where(may), keeper_key(no_sidecars))


def other_keepers(members: DataFrame) -> DataFrame:
    return _kept(members, keeper_key())


def _kept(candidates: DataFrame, key: Column) -> DataFrame:
    return candidates.groupBy("g").agg(F.min(key).alias("k")).select("g", F.col("k.ordinal").alias("keeper_ordinal"), F.col("k.path").alias("keeper_path"))


def merge_needs(grouped: DataFrame, keepers: DataFrame) -> DataFrame:
    """(g, key, need): required copies that the keeper lacks."""
    own = multisets(grouped).join(keepers.select("g", F.col("keeper_ordinal").alias("ordinal")), ["g", "ordinal"]).select("g", "key", F.col("n").alias("own"))
    need = required_keys(grouped).join(keepers.select("g"), "g").join(own, ["g", "key"], "left")
    return need.withColumn("need", F.col("required") - F.coalesce("own", F.lit(0))).where("need > 0").select("g", "key", "need")


#: Parts into which the candidates for a merge are dealt before the first of them are chosen.
PARTS = 256


def allocated(members: DataFrame, grouped: DataFrame, keepers: DataFrame) -> DataFrame:
    """Sidecars of duplicates (g, ordinal, pos, ..., merge): the first of each needed key, by the duplicates' order, are merged.

    Only the first of each part of a key's candidates can be among the first of
    all, so that no task ranks more than a part of a large bucket.
    """
    moved = grouped.join(keepers, "g").where("ordinal <> keeper_ordinal")
    needs = merge_needs(grouped, keepers)
    order = members.select("g", "ordinal", F.lower("label").alias("_l"), F.lower("relative_path").alias("_r"))
    ranked = moved.join(needs, ["g", "key"]).join(order, ["g", "ordinal"]).withColumn("_part", F.pmod(F.xxhash64("ordinal", "pos"), F.lit(PARTS)))
    for parts in (["_part"], []):
        ranked = ranked.withColumn("_rank", F.row_number().over(W.partitionBy("g", "key", *parts).orderBy("_l", "_r", "ordinal", "pos"))).where("_rank <= need")
    merged = ranked.select("ordinal", "pos", F.lit(True).alias("merge"))
    return moved.join(merged, ["ordinal", "pos"], "left").withColumn("merge", F.coalesce("merge", F.lit(False)))


def decided(files: DataFrame, prefix: str, keepers: DataFrame) -> DataFrame:
    """All files with their bucket (n, g, group_id), its keeper, and fate: unique, conflict, keeper or duplicate."""
    every = buckets(files)
    named = every.join(numbered(every.where("n > 1").select("g"), prefix), "g", "left").join(keepers, "g", "left")
    fate = F.when(F.col("n") == 1, "unique").when(F.col("keeper_ordinal").isNull(), "conflict").when(F.col("keeper_ordinal") == F.col("ordinal"), "keeper").otherwise("duplicate")
    return files.join(named, BUCKET).withColumn("fate", fate)


def _by_fate(column: str, values: dict[str, Column | str]) -> Column:
    out = F.lit("")
    for fate, value in values.items():
        out = F.when(F.col(column) == fate, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def _file_rows(files: DataFrame, role: str, output_root: str, words: dict[str, tuple[str, str, str, str]], message: str, sections: tuple[int, int]) -> DataFrame:
    """Log rows of primary or uncategorized files; ``words`` has disposition, event, status and reason by fate."""
    grouped = F.col("fate") != "unique"
    ranked = F.col("fate").isin("unique", "duplicate")
    pick = lambda i: _by_fate("fate", {k: v[i] for k, v in words.items()})
    return files.select(
        pick(0).alias("disposition"), pick(1).alias("event"), pick(2).alias("status"), pick(3).alias("reason"), F.lit(role).alias("file_role"), F.col("path").alias("source_path"),
        _by_fate("fate", {"duplicate": paths.destination(output_root, "label", "relative_path")}).alias("destination_path"), F.lit("").alias("duplicate_output_path"),
        _by_fate("fate", {"keeper": F.col("keeper_path"), "duplicate": F.col("keeper_path")}).alias("keeper_path"), F.lit("").alias("primary_source_path"), F.coalesce("group_id", F.lit("")).alias("group_id"),
        _by_fate("fate", {"unique": message}).alias("message"), F.col("size_bytes").cast("long").alias("size_bytes"), F.col("digest").alias("xxh128"), F.col("label").alias("input_root"),
        F.when(grouped, sections[1]).otherwise(sections[0]).alias("o_section"), F.when(grouped, F.col("g")).otherwise(0).cast("long").alias("o_group"), (F.col("fate") == "duplicate").cast("int").alias("o_part"),
        F.when(ranked, F.lower("label")).otherwise("").alias("o_label"), F.when(ranked, F.lower("relative_path")).otherwise("").alias("o_path"), F.when(F.col("fate") == "keeper", 0).otherwise(F.col("ordinal")).cast("long").alias("o_ordinal"), F.lit(0).cast("long").alias("o_pos"),
        F.lower("label").alias("v_label"), F.lower("relative_path").alias("v_path"),
    )


def _sidecar_rows(sidecars: DataFrame, output_root: str) -> DataFrame:
    """Log rows of sidecars that carry their primary's columns (p_*) and merge."""
    words = {
        "unique": ("kept_unique_sidecar", "unique_sidecar", "unique", "primary_is_unique"),
        "conflict": ("kept_sidecar_conflict_sidecar", "sidecar_kept_due_to_sidecar_conflict", "skipped", "unresolved_sidecar_conflict"),
        "keeper": ("kept_duplicate_keeper_sidecar", "keeper_sidecar", "kept", "selected_with_keeper"),
        "duplicate": ("planned_duplicate_sidecar", "sidecar_move", "planned", "duplicate_of_keeper"),
        "merge": ("planned_sidecar_merge", "sidecar_merge", "planned", "merge_into_keeper"),
    }
    rows = sidecars.withColumn("fate", F.when(F.col("merge"), "merge").otherwise(F.col("fate")))
    pick = lambda i: _by_fate("fate", {k: v[i] for k, v in words.items()})
    moved = F.col("fate").isin("duplicate", "merge")
    ranked = F.col("fate").isin("unique", "duplicate", "merge")
    to, merged = paths.destination(output_root, "p_label", "relative_path"), paths.merged_sidecar("path", "p_path", "keeper_path")
    return rows.select(
        pick(0).alias("disposition"), pick(1).alias("event"), pick(2).alias("status"), pick(3).alias("reason"), F.lit("sidecar").alias("file_role"), F.col("path").alias("source_path"),
        _by_fate("fate", {"duplicate": to, "merge": merged}).alias("destination_path"), _by_fate("fate", {"merge": to}).alias("duplicate_output_path"),
        _by_fate("fate", dict.fromkeys(("keeper", "duplicate", "merge"), F.col("keeper_path"))).alias("keeper_path"), F.col("p_path").alias("primary_source_path"), F.coalesce("group_id", F.lit("")).alias("group_id"),
        F.lit("").alias("message"), F.col("size_bytes").cast("long").alias("size_bytes"), F.col("digest").alias("xxh128"), F.col("p_label").alias("input_root"),
        F.when(F.col("fate") == "unique", 0).otherwise(2).alias("o_section"), F.when(F.col("fate") == "unique", 0).otherwise(F.col("g")).cast("long").alias("o_group"), moved.cast("int").alias("o_part"),
        F.when(ranked, F.lower("p_label")).otherwise("").alias("o_label"), F.when(ranked, F.lower("p_relative")).otherwise("").alias("o_path"), F.when(F.col("fate") == "keeper", 0).otherwise(F.col("ordinal")).cast("long").alias("o_ordinal"), (F.col("pos") + 1).cast("long").alias("o_pos"),
        F.lower("p_label").alias("v_label"), F.lower("p_relative").alias("v_path"),
    )


def plan(entries: DataFrame, sidecars: DataFrame, others: DataFrame, output_root: str, ignore_json: bool = False) -> DataFrame:
    """Every file with what becomes of it: the log columns (but mode and timestamp), o_* columns that give the rows' order, and v_* that give it within conflicts when moves are verified.

    Only the small tables of decisions (members of groups, keepers, merges) are
    stored on the way; every file is then read once more and judged in place.
    """
    files = FILE
    members, grouped = duplicate_groups(entries, sidecars, ignore_json)
    keepers = stored(primary_keepers(members, grouped), "keepers")
    merged = stored(allocated(members, grouped, keepers).where("merge").select("ordinal", "pos", "merge"), "merged")
    primaries = decided(entries.select(*files), "m", keepers)
    owners = primaries.select("ordinal", F.col("path").alias("p_path"), F.col("label").alias("p_label"), F.col("relative_path").alias("p_relative"), "g", "group_id", "keeper_path", "fate")
    owned = sidecars.select("ordinal", "pos", "path", "relative_path", "size_bytes", "digest").join(owners, "ordinal").join(merged, ["ordinal", "pos"], "left").withColumn("merge", F.coalesce("merge", F.lit(False)))
    rest = decided(others.select(*files), "u", other_keepers(duplicate_members(others.select(*files), "u")))
    primary_words = {
        "unique": ("kept_unique_primary", "unique_primary", "unique", ""),
        "conflict": ("kept_sidecar_conflict", "duplicate_primary_kept_due_to_sidecar_conflict", "skipped", "unresolved_sidecar_conflict"),
        "keeper": ("kept_duplicate_keeper", "keeper_primary", "kept", "selected_by_manifest_priority"),
        "duplicate": ("planned_duplicate_primary", "duplicate_primary_move", "planned", "duplicate_of_keeper"),
    }
    other_words = {
        "unique": ("kept_unique_uncategorized", "unique_uncategorized", "unique", ""),
        "keeper": ("kept_duplicate_uncategorized", "keeper_uncategorized", "kept", "selected_by_manifest_priority"),
        "duplicate": ("planned_duplicate_uncategorized", "duplicate_uncategorized_move", "planned", "duplicate_of_keeper"),
    }
    return (
        _file_rows(primaries, "primary", output_root, primary_words, "no equal primary image found in manifests", (0, 2))
        .unionByName(_sidecar_rows(owned, output_root))
        .unionByName(_file_rows(rest, "uncategorized", output_root, other_words, "no equal uncategorized file found in manifests", (1, 3)))
    )


#: Order of a plan's log, and of the log of verified moves.
ORDER = ["o_section", "o_group", "o_part", "o_label", "o_path", "o_ordinal", "o_pos"]
VERIFY_ORDER = ["o_section", "o_group", "o_part", "v_label", "v_path", "o_ordinal", "o_pos"]


def as_log(rows: DataFrame, mode: str) -> DataFrame:
    """All log columns in their order, rows sorted."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    full = rows.withColumns({c: F.lit("") for c in LOG_FIELDS if c not in rows.columns} | {"mode": F.lit(mode), "timestamp": stamp})
    return full.orderBy(*[c for c in ORDER if c in rows.columns]).select(*LOG_FIELDS)


def totals(plan_rows: DataFrame) -> DataFrame:
    """One row: duplicate_groups, duplicate_files and skipped_groups."""
    groups = F.when(F.col("group_id") != "", F.col("group_id"))
    files = F.col("disposition").isin("planned_duplicate_primary", "planned_duplicate_uncategorized")
    skipped = F.when(F.col("disposition") == "kept_sidecar_conflict", F.col("group_id"))
    return plan_rows.agg(F.countDistinct(groups).alias("duplicate_groups"), F.count_if(files).alias("duplicate_files"), F.countDistinct(skipped).alias("skipped_groups"))
