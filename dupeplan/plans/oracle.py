"""DuckDB SQL for the queries over the inventory adapter."""

from __future__ import annotations

from dupeplan.plans.adapter import INVENTORY_SQL

DATE = "(?:^|[^0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{4})(?:[^0-9]|$)"
CLASS = "CASE WHEN lower(path) LIKE '%takeout%' THEN 0 WHEN lower(path) LIKE '%mobilebackup%' THEN 2 ELSE 1 END"
SCORE = f"len(list_filter(string_split(path, '/')[1:-2], lambda c: regexp_matches(c, '{DATE}')))"


def planner(ignore_json: bool = False) -> str:
    """Common tables up to ``plan``; the multiset rules are written over lists and counts of each group."""
    key = "CASE WHEN lower(s.path) LIKE '%.json' THEN '__json_sidecar__' ELSE s.digest END" if ignore_json else "s.digest"
    return f"""WITH {INVENTORY_SQL},
e AS (SELECT *, count(*) OVER b AS n, min(ordinal) OVER b AS g FROM inv WHERE file_role = 'primary' WINDOW b AS (PARTITION BY size_bytes, digest)),
u AS (SELECT *, count(*) OVER b AS n, min(ordinal) OVER b AS g FROM inv WHERE file_role = 'uncategorized' WINDOW b AS (PARTITION BY size_bytes, digest)),
s AS (SELECT * FROM inv WHERE file_role = 'sidecar'),
mid AS (SELECT g, 'm' || lpad(CAST(row_number() OVER (ORDER BY g) AS VARCHAR), 6, '0') AS group_id FROM (SELECT DISTINCT g FROM e WHERE n > 1)),
uid AS (SELECT g, 'u' || lpad(CAST(row_number() OVER (ORDER BY g) AS VARCHAR), 6, '0') AS group_id FROM (SELECT DISTINCT g FROM u WHERE n > 1)),
m AS (SELECT e.*, group_id, {CLASS} AS k1, {SCORE} AS k2 FROM e JOIN mid USING (g) WHERE n > 1),
um AS (SELECT u.*, group_id, {CLASS} AS k1, {SCORE} AS k2 FROM u JOIN uid USING (g) WHERE n > 1),
sc AS (SELECT m.g, s.*, {key} AS key, CASE WHEN lower(s.path) LIKE '%.json' THEN 'json' WHEN lower(s.path) LIKE '%.mov' OR lower(s.path) LIKE '%.mp4' THEN 'video' END AS class FROM s JOIN m USING (ordinal)),
ek AS (SELECT g, ordinal, key, count(*) AS n FROM sc GROUP BY ALL),
sup AS (SELECT DISTINCT a.g, a.ordinal FROM ek a WHERE NOT EXISTS (
  SELECT 1 FROM ek o WHERE o.g = a.g AND o.n > coalesce((SELECT x.n FROM ek x WHERE x.g = a.g AND x.ordinal = a.ordinal AND x.key = o.key), 0))),
unc AS (SELECT DISTINCT g FROM sc WHERE class IS NULL),
eck AS (SELECT g, class, ordinal, key, count(*) AS n FROM sc WHERE class IS NOT NULL GROUP BY ALL),
csup AS (SELECT DISTINCT a.g, a.class FROM eck a WHERE NOT EXISTS (
  SELECT 1 FROM eck o WHERE o.g = a.g AND o.class = a.class AND o.n > coalesce((SELECT x.n FROM eck x WHERE x.g = a.g AND x.class = a.class AND x.ordinal = a.ordinal AND x.key = o.key), 0))),
compat AS (SELECT g FROM (SELECT DISTINCT g, class FROM eck) LEFT JOIN (SELECT g, class, true AS ok FROM csup) USING (g, class) GROUP BY g HAVING bool_and(coalesce(ok, false)) AND g NOT IN (SELECT g FROM unc)),
cand AS (SELECT m.*, CASE WHEN ordinal IN (SELECT ordinal FROM sc) THEN 0 ELSE 1 END AS k0 FROM m
  WHERE CASE WHEN g IN (SELECT g FROM sup) THEN ordinal IN (SELECT ordinal FROM sup) ELSE g IN (SELECT g FROM compat) OR g NOT IN (SELECT g FROM sc) END),
keep AS (SELECT g, ordinal AS keeper_ordinal, path AS keeper_path FROM cand QUALIFY row_number() OVER (PARTITION BY g ORDER BY k0, k1, k2, lower(label), lower(relative_path), ordinal) = 1),
ukeep AS (SELECT g, ordinal AS keeper_ordinal, path AS keeper_path FROM um QUALIFY row_number() OVER (PARTITION BY g ORDER BY k1, k2, lower(label), lower(relative_path), ordinal) = 1),
best AS (SELECT g, class, ordinal FROM (SELECT g, class, ordinal, sum(n) AS total FROM eck GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY g, class ORDER BY total DESC, ordinal) = 1),
req AS (SELECT g, key, CAST(sum(n) AS BIGINT) AS required FROM eck JOIN best USING (g, class, ordinal) WHERE g NOT IN (SELECT g FROM unc) GROUP BY ALL),
need AS (SELECT req.g, req.key, CAST(required - coalesce(ek.n, 0) AS BIGINT) AS need FROM req JOIN keep USING (g) LEFT JOIN ek ON ek.g = req.g AND ek.key = req.key AND ek.ordinal = keeper_ordinal WHERE required > coalesce(ek.n, 0)),
moved AS (SELECT sc.*, m.label AS p_label, m.path AS p_path, m.relative_path AS p_rel, m.group_id, keeper_path,
    coalesce(row_number() OVER (PARTITION BY sc.g, sc.key ORDER BY lower(m.label), lower(m.relative_path), m.ordinal, sc.pos) <= need, false) AS merge
  FROM sc JOIN keep USING (g) JOIN m USING (ordinal) LEFT JOIN need ON need.g = sc.g AND need.key = sc.key WHERE sc.ordinal <> keeper_ordinal),
plan AS (
  SELECT 'kept_unique_primary' AS disposition, 'unique_primary' AS event, 'unique' AS status, '' AS reason, 'primary' AS file_role, path AS source_path, '' AS destination_path, '' AS duplicate_output_path, '' AS keeper_path, '' AS primary_source_path, '' AS group_id, 'no equal primary image found in manifests' AS message, size_bytes, digest AS xxh128, label AS input_root FROM e WHERE n = 1
  UNION ALL SELECT 'kept_unique_sidecar', 'unique_sidecar', 'unique', 'primary_is_unique', 'sidecar', s.path, '', '', '', e.path, '', '', s.size_bytes, s.digest, e.label FROM s JOIN e USING (ordinal) WHERE n = 1
  UNION ALL SELECT 'kept_unique_uncategorized', 'unique_uncategorized', 'unique', '', 'uncategorized', path, '', '', '', '', '', 'no equal uncategorized file found in manifests', size_bytes, digest, label FROM u WHERE n = 1
  UNION ALL SELECT 'kept_sidecar_conflict', 'duplicate_primary_kept_due_to_sidecar_conflict', 'skipped', 'unresolved_sidecar_conflict', 'primary', path, '', '', '', '', group_id, '', size_bytes, digest, label FROM m WHERE g NOT IN (SELECT g FROM keep)
  UNION ALL SELECT 'kept_sidecar_conflict_sidecar', 'sidecar_kept_due_to_sidecar_conflict', 'skipped', 'unresolved_sidecar_conflict', 'sidecar', s.path, '', '', '', m.path, group_id, '', s.size_bytes, s.digest, m.label FROM s JOIN m USING (ordinal) WHERE m.g NOT IN (SELECT g FROM keep)
  UNION ALL SELECT 'kept_duplicate_keeper', 'keeper_primary', 'kept', 'selected_by_manifest_priority', 'primary', path, '', '', path, '', group_id, '', size_bytes, digest, label FROM m JOIN keep USING (g) WHERE ordinal = keeper_ordinal
  UNION ALL SELECT 'kept_duplicate_keeper_sidecar', 'keeper_sidecar', 'kept', 'selected_with_keeper', 'sidecar', s.path, '', '', m.path, m.path, group_id, '', s.size_bytes, s.digest, m.label FROM s JOIN m USING (ordinal) JOIN keep ON keep.g = m.g AND ordinal = keeper_ordinal
  UNION ALL SELECT 'planned_duplicate_primary', 'duplicate_primary_move', 'planned', 'duplicate_of_keeper', 'primary', path, '/dupes/' || label || '/' || relative_path, '', keeper_path, '', group_id, '', size_bytes, digest, label FROM m JOIN keep USING (g) WHERE ordinal <> keeper_ordinal
  UNION ALL SELECT 'planned_sidecar_merge', 'sidecar_merge', 'planned', 'merge_into_keeper', 'sidecar', path, regexp_replace(keeper_path, '\\.jpg$', '') || regexp_extract(path, 'IMG_[0-9]+(\\..*)$', 1), '/dupes/' || p_label || '/' || relative_path, keeper_path, p_path, group_id, '', size_bytes, digest, p_label FROM moved WHERE merge
  UNION ALL SELECT 'planned_duplicate_sidecar', 'sidecar_move', 'planned', 'duplicate_of_keeper', 'sidecar', path, '/dupes/' || p_label || '/' || relative_path, '', keeper_path, p_path, group_id, '', size_bytes, digest, p_label FROM moved WHERE NOT merge
  UNION ALL SELECT 'kept_duplicate_uncategorized', 'keeper_uncategorized', 'kept', 'selected_by_manifest_priority', 'uncategorized', path, '', '', path, '', group_id, '', size_bytes, digest, label FROM um JOIN ukeep USING (g) WHERE ordinal = keeper_ordinal
  UNION ALL SELECT 'planned_duplicate_uncategorized', 'duplicate_uncategorized_move', 'planned', 'duplicate_of_keeper', 'uncategorized', path, '/dupes/' || label || '/' || relative_path, '', keeper_path, '', group_id, '', size_bytes, digest, label FROM um JOIN ukeep USING (g) WHERE ordinal <> keeper_ordinal),
fs AS (
  SELECT path, true AS is_file, CAST(size_bytes + CASE WHEN ordinal % 10 = 2 THEN 1 ELSE 0 END AS BIGINT) AS size_bytes, CASE WHEN ordinal % 10 = 4 THEN sha256(digest) ELSE digest END AS digest FROM inv WHERE ordinal % 10 NOT IN (0, 3)
  UNION ALL SELECT '/dupes/' || label || '/' || relative_path, true, size_bytes, digest FROM inv WHERE ordinal % 10 IN (0, 1)
  UNION ALL SELECT '/dupes/extra/' || ordinal || '.tmp', true, 1, '' FROM inv WHERE file_role <> 'sidecar' AND ordinal % 50 = 7)
"""


P, PJ = planner(), planner(True)
_VERDICT = """,
pr AS (SELECT *, source_path AS bundle, 0 AS kind FROM plan WHERE disposition IN ('planned_duplicate_primary', 'planned_duplicate_uncategorized')),
br AS (SELECT * FROM pr UNION ALL SELECT q.*, q.primary_source_path, CASE WHEN q.disposition = 'planned_sidecar_merge' THEN 2 ELSE 1 END FROM plan q JOIN pr ON pr.group_id = q.group_id AND pr.source_path = q.primary_source_path WHERE q.disposition IN ('planned_duplicate_sidecar', 'planned_sidecar_merge')),
kp AS (SELECT group_id, source_path AS k_path, size_bytes AS k_size, xxh128 AS k_digest FROM plan WHERE disposition IN ('kept_duplicate_keeper', 'kept_duplicate_uncategorized')),
twice AS (SELECT p FROM (SELECT destination_path AS p FROM br UNION ALL SELECT duplicate_output_path FROM br WHERE duplicate_output_path <> '') GROUP BY p HAVING count(*) > 1),
st AS (SELECT br.*, kp.*  EXCLUDE (group_id), s.path IS NOT NULL AS se, d.path IS NOT NULL AS de, o.path IS NOT NULL AS oe, s.digest AS sd, d.digest AS dd, kf.path IS NOT NULL AS ke, kf.size_bytes AS kfs, kf.digest AS kfd,
  (br.destination_path IN (SELECT p FROM twice) OR br.duplicate_output_path IN (SELECT p FROM twice)) AS shared,
  CASE WHEN disposition = 'planned_sidecar_merge' THEN
    CASE WHEN d.path IS NOT NULL AND (d.size_bytes <> br.size_bytes OR d.digest <> br.xxh128) THEN 'merge_destination_hash_mismatch'
      WHEN d.path IS NOT NULL AND s.path IS NOT NULL THEN CASE WHEN o.path IS NOT NULL THEN 'destination_exists' WHEN s.size_bytes <> br.size_bytes THEN 'source_size_mismatch' ELSE 'ready' END
      WHEN d.path IS NOT NULL THEN CASE WHEN o.path IS NOT NULL AND (o.size_bytes <> br.size_bytes OR o.digest <> br.xxh128) THEN 'destination_exists' ELSE 'already_moved' END
      WHEN s.path IS NOT NULL THEN CASE WHEN s.size_bytes <> br.size_bytes THEN 'source_size_mismatch' ELSE 'ready' END
      ELSE 'source_missing' END
  ELSE CASE WHEN s.path IS NOT NULL AND d.path IS NOT NULL THEN 'destination_exists'
      WHEN s.path IS NOT NULL THEN CASE WHEN s.size_bytes <> br.size_bytes THEN 'source_size_mismatch' ELSE 'ready' END
      WHEN d.path IS NOT NULL THEN CASE WHEN d.size_bytes <> br.size_bytes THEN 'destination_exists' ELSE 'already_moved' END
      ELSE 'source_missing' END END AS state
  FROM br LEFT JOIN kp ON kp.group_id = br.group_id LEFT JOIN fs s ON s.path = br.source_path LEFT JOIN fs d ON d.path = br.destination_path LEFT JOIN fs o ON o.path = br.duplicate_output_path LEFT JOIN fs kf ON kf.path = kp.k_path)
"""


def verdict(verify: bool) -> str:
    v = "true" if verify else "false"
    return f"""{P}{_VERDICT}
SELECT group_id, bundle, count(*) AS files, CASE
  WHEN any_value(k_path) IS NULL THEN 'keeper_missing_from_plan' WHEN NOT bool_or(ke) THEN 'keeper_missing' WHEN any_value(kfs) <> any_value(k_size) THEN 'keeper_size_mismatch'
  WHEN {v} AND any_value(kfd) <> any_value(k_digest) THEN 'keeper_hash_mismatch' WHEN bool_or(source_path = k_path) THEN 'duplicate_source_is_keeper' WHEN bool_or(shared) THEN 'duplicate_destination_in_plan'
  WHEN bool_and(state = 'already_moved') THEN CASE WHEN {v} AND bool_or(coalesce(dd <> xxh128, true)) THEN 'destination_hash_mismatch' ELSE 'already_moved' END
  WHEN bool_or(state = 'merge_destination_hash_mismatch') THEN 'merge_destination_hash_mismatch' WHEN bool_or(state = 'destination_exists') THEN 'destination_exists' WHEN bool_or(state = 'source_size_mismatch') THEN 'source_size_mismatch'
  WHEN bool_or(state = 'source_missing') THEN CASE WHEN bool_or(state IN ('ready', 'already_moved')) THEN 'partial_bundle_state' ELSE 'source_missing' END
  WHEN bool_or(state = 'already_moved') THEN 'partial_bundle_state' WHEN {v} AND bool_or(coalesce(sd <> xxh128, true)) THEN 'source_hash_mismatch' ELSE 'validated' END AS verdict
FROM st GROUP BY group_id, bundle"""


_OUT = "disposition IN ('planned_duplicate_primary', 'planned_duplicate_sidecar', 'planned_duplicate_uncategorized')"
_MERGE = "disposition = 'planned_sidecar_merge'"
_INV = f"WITH {INVENTORY_SQL}"
_MOVE_CHECKS = """
checks AS (
  SELECT disposition AS d, 'source' AS side, source_path AS path, 'present' AS expect, * FROM plan WHERE status <> 'planned'
  UNION ALL SELECT disposition, 'source', source_path, 'absent', * FROM plan WHERE status = 'planned'
  UNION ALL SELECT disposition, 'destination', destination_path, 'present', * FROM plan WHERE status = 'planned')
SELECT CASE WHEN trouble IS NOT NULL THEN 'verify_move_failed' WHEN d LIKE 'kept_unique_unc%' THEN 'verify_move_unique_uncategorized_intact' WHEN d LIKE 'kept_unique%' THEN 'verify_move_unique_intact' WHEN d LIKE 'kept_sidecar_conf%' THEN 'verify_move_skipped_conflict_intact' ELSE 'verify_move_matched' END AS disposition,
  CASE WHEN d LIKE 'kept_unique_unc%' THEN 'verify_move_unique_uncategorized' WHEN d LIKE 'kept_unique%' THEN 'verify_move_unique' WHEN d LIKE 'kept_sidecar_conf%' THEN 'verify_move_sidecar_conflict' WHEN d LIKE 'kept_duplicate_unc%' THEN 'verify_move_uncategorized_keeper' WHEN d LIKE 'kept%' THEN 'verify_move_keeper'
    WHEN side = 'source' THEN 'verify_move_duplicate_source' WHEN d = 'planned_sidecar_merge' THEN 'verify_move_sidecar_merge' ELSE 'verify_move_duplicate_destination' END AS event,
  CASE WHEN trouble IS NOT NULL THEN 'error' WHEN d LIKE 'planned%' THEN 'moved' ELSE 'kept' END AS status, group_id, file_role, input_root, CASE WHEN side = 'source' THEN path ELSE '' END AS source_path, CASE WHEN side = 'destination' THEN path ELSE '' END AS destination_path,
  CASE WHEN d LIKE 'kept_unique%' OR d LIKE 'kept_sidecar_conf%' THEN '' ELSE keeper_path END AS keeper_path, size_bytes, xxh128,
  coalesce(trouble, CASE WHEN d LIKE 'kept_unique%' THEN 'unique_source_intact' WHEN d LIKE 'kept_sidecar_conf%' THEN 'sidecar_conflict_source_intact' WHEN d LIKE 'kept%' THEN 'keeper_source_intact' WHEN side = 'source' THEN 'duplicate_source_missing' WHEN d = 'planned_sidecar_merge' THEN 'merged_sidecar_present' ELSE 'duplicate_destination_present' END) AS reason
FROM (SELECT checks.*, CASE WHEN expect = 'absent' THEN CASE WHEN fs.path IS NOT NULL THEN 'duplicate_source_still_exists' END WHEN fs.path IS NULL THEN 'expected_file_missing' WHEN fs.size_bytes <> checks.size_bytes THEN 'expected_file_size_mismatch' END AS trouble FROM checks LEFT JOIN fs ON fs.path = checks.path)"""

#: Plan rows with their places in the log of the plan, and what orders them.
_LINES = """,
pn AS (SELECT plan.*, inv.ordinal, inv.pos, coalesce(e.g, u.g) AS g0, lower(coalesce(e.label, u.label)) AS vl, lower(coalesce(e.relative_path, u.relative_path)) AS vp,
    CASE WHEN disposition LIKE 'kept_unique%' THEN 'unique' WHEN disposition LIKE 'kept_sidecar_conflict%' THEN 'conflict' WHEN disposition LIKE 'kept%' THEN 'keeper' ELSE 'duplicate' END AS fate
  FROM plan JOIN inv ON inv.path = plan.source_path LEFT JOIN e ON inv.file_role <> 'uncategorized' AND e.ordinal = inv.ordinal LEFT JOIN u ON inv.file_role = 'uncategorized' AND u.ordinal = inv.ordinal),
po AS (SELECT *, CASE file_role WHEN 'uncategorized' THEN 1 ELSE 0 END + CASE fate WHEN 'unique' THEN 0 ELSE 2 END AS o1, CASE fate WHEN 'unique' THEN 0 ELSE g0 END AS o2, CASE fate WHEN 'duplicate' THEN 1 ELSE 0 END AS o3,
    CASE WHEN fate IN ('unique', 'duplicate') THEN vl ELSE '' END AS o4, CASE WHEN fate IN ('unique', 'duplicate') THEN vp ELSE '' END AS o5, CASE fate WHEN 'keeper' THEN 0 ELSE ordinal END AS o6, CASE file_role WHEN 'sidecar' THEN pos + 1 ELSE 0 END AS o7 FROM pn),
lines AS (SELECT *, row_number() OVER (ORDER BY o1, o2, o3, o4, o5, o6, o7) - 1 AS line FROM po)"""
#: States of merges, and the log of a dry run with hashes.
_LOOKED = """SELECT x.*, s.path IS NOT NULL AS se, d.path IS NOT NULL AS de, o.path IS NOT NULL AS oe, s.size_bytes AS sz, d.size_bytes AS dz, o.size_bytes AS oz, s.digest AS sd, d.digest AS dd, o.digest AS od,
    CASE WHEN d.size_bytes <> x.size_bytes THEN 'not_applicable' WHEN d.digest = x.xxh128 THEN 'matched' ELSE 'mismatched' END AS dc, CASE WHEN o.size_bytes <> x.size_bytes THEN 'not_applicable' WHEN o.digest = x.xxh128 THEN 'matched' ELSE 'mismatched' END AS oc,
    x.disposition = 'planned_sidecar_merge' AS mg
  FROM {rows} x LEFT JOIN {at} s ON s.path = x.source_path LEFT JOIN {at} d ON d.path = x.destination_path LEFT JOIN {at} o ON o.path = x.duplicate_output_path"""
_STATED = """SELECT *, CASE WHEN mg THEN
      CASE WHEN de AND dc <> 'matched' THEN 'merge_destination_hash_mismatch' WHEN de AND se AND oe THEN 'destination_exists' WHEN se AND sz <> size_bytes THEN 'source_size_mismatch' WHEN se THEN 'ready'
        WHEN de AND oe AND oc <> 'matched' THEN 'destination_exists' WHEN de THEN 'already_moved' ELSE 'source_missing' END
    WHEN se AND de THEN 'destination_exists' WHEN se THEN CASE WHEN sz <> size_bytes THEN 'source_size_mismatch' ELSE 'ready' END WHEN de THEN CASE WHEN dz <> size_bytes THEN 'destination_exists' ELSE 'already_moved' END ELSE 'source_missing' END AS state,
    CASE WHEN mg AND de AND dc <> 'matched' THEN dc WHEN mg AND de AND NOT se AND oe AND oc <> 'matched' THEN oc ELSE 'not_checked' END AS looked,
    CASE WHEN mg AND de AND dc = 'mismatched' THEN dd WHEN mg AND de AND dc = 'matched' AND NOT se AND oe AND oc = 'mismatched' THEN od ELSE '' END AS seen
  FROM {looked}"""
_ACTION = "CASE WHEN state = 'ready' AND mg AND de THEN duplicate_output_path WHEN state IN ('ready', 'already_moved') THEN destination_path END"
_LOG = f"""{_LINES},
cut AS (SELECT * FROM lines WHERE NOT (disposition = 'planned_duplicate_primary' AND CAST(regexp_extract(source_path, 'IMG_([0-9]+)', 1) AS INT) % 10 = 6)),
prim AS (SELECT group_id, source_path AS bundle, line AS bat FROM cut WHERE disposition IN ('planned_duplicate_primary', 'planned_duplicate_uncategorized')),
bund AS (SELECT cut.*, bat, 1 AS part FROM cut JOIN prim ON bat = line
  UNION ALL SELECT cut.*, bat, CASE cut.disposition WHEN 'planned_sidecar_merge' THEN 3 ELSE 2 END FROM cut JOIN prim ON prim.group_id = cut.group_id AND bundle = primary_source_path WHERE cut.disposition IN ('planned_duplicate_sidecar', 'planned_sidecar_merge')),
kept AS (SELECT group_id, source_path AS k_path, cut.size_bytes AS k_size, xxh128 AS k_digest, file_role AS k_role, input_root AS k_root, f.path IS NOT NULL AS ke, f.size_bytes AS kfs, f.digest AS kfd FROM cut LEFT JOIN fs f ON f.path = source_path WHERE disposition IN ('kept_duplicate_keeper', 'kept_duplicate_uncategorized')),
look AS ({_LOOKED.format(rows="bund", at="fs")}), stat AS ({_STATED.format(looked="look")}),
twice AS (SELECT p FROM (SELECT destination_path AS p FROM bund UNION ALL SELECT duplicate_output_path FROM bund WHERE duplicate_output_path <> '') GROUP BY p HAVING count(*) > 1),
full_rows AS (SELECT stat.*, kept.* EXCLUDE (group_id), {_ACTION} AS action, destination_path IN (SELECT p FROM twice) OR duplicate_output_path IN (SELECT p FROM twice) AS shared,
    CASE WHEN dd = xxh128 THEN 'matched' ELSE 'mismatched' END AS wd, CASE WHEN sd = xxh128 THEN 'matched' ELSE 'mismatched' END AS ws FROM stat LEFT JOIN kept USING (group_id)),
said AS (SELECT bat, CASE WHEN any_value(k_path) IS NULL THEN 'keeper_missing_from_plan' WHEN NOT bool_or(ke) THEN 'keeper_missing' WHEN any_value(kfs) <> any_value(k_size) THEN 'keeper_size_mismatch' WHEN any_value(kfd) <> any_value(k_digest) THEN 'keeper_hash_mismatch'
    WHEN bool_or(source_path = k_path) THEN 'duplicate_source_is_keeper' WHEN bool_or(shared) THEN 'duplicate_destination_in_plan' WHEN bool_and(state = 'already_moved') THEN CASE WHEN bool_or(wd <> 'matched') THEN 'destination_hash_mismatch' ELSE 'already_moved' END
    WHEN bool_or(state = 'merge_destination_hash_mismatch') THEN 'merge_destination_hash_mismatch' WHEN bool_or(state = 'destination_exists') THEN 'destination_exists' WHEN bool_or(state = 'source_size_mismatch') THEN 'source_size_mismatch'
    WHEN bool_or(state = 'source_missing') THEN CASE WHEN bool_or(state IN ('ready', 'already_moved')) THEN 'partial_bundle_state' ELSE 'source_missing' END WHEN bool_or(state = 'already_moved') THEN 'partial_bundle_state' WHEN bool_or(ws <> 'matched') THEN 'source_hash_mismatch' ELSE '' END AS verdict FROM full_rows GROUP BY bat),
v AS (SELECT *, coalesce(bool_or(wd <> 'matched') OVER before, false) AS after_d, coalesce(bool_or(ws <> 'matched') OVER before, false) AS after_s FROM full_rows JOIN said USING (bat) WINDOW before AS (PARTITION BY bat ORDER BY part, source_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, verdict IN ('already_moved', 'destination_hash_mismatch') AND NOT after_d AS hd, verdict IN ('', 'source_hash_mismatch') AND NOT after_s AS hs, verdict LIKE 'keeper_%' OR verdict = 'duplicate_source_is_keeper' AS early,
    (verdict = 'source_size_mismatch' AND state = 'source_size_mismatch') OR (verdict IN ('partial_bundle_state', 'source_missing') AND state IN ('source_missing', 'already_moved')) AS failed FROM v),
body AS (SELECT bat, part, CAST(0 AS BIGINT) AS o_line, group_id,
    CASE verdict WHEN '' THEN disposition WHEN 'already_moved' THEN CASE file_role WHEN 'uncategorized' THEN 'already_moved_duplicate_uncategorized' WHEN 'primary' THEN 'already_moved_duplicate_primary' ELSE CASE WHEN mg THEN 'already_merged_sidecar' ELSE 'already_moved_sidecar' END END ELSE 'skipped_error_' || file_role END AS disposition,
    CASE file_role WHEN 'uncategorized' THEN 'execute_plan_uncategorized_move' WHEN 'primary' THEN 'execute_plan_move' ELSE CASE WHEN mg THEN 'execute_plan_sidecar_merge' ELSE 'execute_plan_sidecar_move' END END AS event,
    CASE verdict WHEN '' THEN 'planned' WHEN 'already_moved' THEN 'kept' ELSE 'error' END AS status, file_role, source_path,
    CASE WHEN early OR verdict = 'duplicate_destination_in_plan' OR failed OR hd THEN destination_path ELSE coalesce(action, destination_path) END AS destination_path, duplicate_output_path, keeper_path, primary_source_path,
    CASE verdict WHEN '' THEN 'validated' ELSE verdict END AS reason, size_bytes, xxh128,
    CASE WHEN early OR verdict = 'duplicate_destination_in_plan' THEN verdict WHEN hd THEN CASE wd WHEN 'matched' THEN 'already_moved' ELSE 'destination_hash_mismatch' END WHEN hs THEN CASE ws WHEN 'matched' THEN 'validated' ELSE 'source_hash_mismatch' END
      WHEN verdict IN ('merge_destination_hash_mismatch', 'destination_exists') AND state IN ('destination_exists', 'merge_destination_hash_mismatch') THEN state WHEN failed THEN verdict WHEN state = 'ready' THEN 'validated' WHEN mg AND state = 'destination_exists' AND looked <> 'not_checked' THEN 'destination_hash_mismatch' ELSE state END AS validation_result,
    CASE verdict WHEN '' THEN 'planned' WHEN 'already_moved' THEN 'already_moved' ELSE 'skipped' END AS action_taken,
    CASE WHEN (verdict = 'duplicate_destination_in_plan' AND shared) OR failed THEN 'not_applicable' WHEN early OR verdict = 'duplicate_destination_in_plan' THEN 'not_checked' WHEN hd THEN wd WHEN hs THEN ws ELSE looked END AS hash_check,
    coalesce(CASE WHEN early OR verdict = 'duplicate_destination_in_plan' OR failed THEN '' WHEN hd THEN dd WHEN hs THEN sd ELSE seen END, '') AS observed_hash, input_root, '' AS message FROM h),
keepers AS (SELECT bat, 0 AS part, CAST(0 AS BIGINT) AS o_line, group_id, CASE k_role WHEN 'uncategorized' THEN CASE WHEN bad THEN 'uncategorized_keeper_error' ELSE 'verified_uncategorized_keeper' END ELSE CASE WHEN bad THEN 'keeper_error' ELSE 'verified_keeper' END END AS disposition,
    'execute_plan_keeper' AS event, CASE WHEN bad THEN 'error' ELSE 'kept' END AS status, CASE k_role WHEN 'uncategorized' THEN 'uncategorized' ELSE 'keeper' END AS file_role, k_path AS source_path, '' AS destination_path, '' AS duplicate_output_path, k_path AS keeper_path, '' AS primary_source_path,
    CASE WHEN bad THEN verdict ELSE 'keeper_verified' END AS reason, k_size AS size_bytes, k_digest AS xxh128, CASE WHEN bad THEN verdict ELSE 'validated' END AS validation_result, CASE WHEN bad THEN 'skipped' ELSE 'keeper_verified' END AS action_taken,
    CASE verdict WHEN 'keeper_missing' THEN 'not_applicable' WHEN 'keeper_size_mismatch' THEN 'not_applicable' WHEN 'keeper_hash_mismatch' THEN 'mismatched' ELSE 'matched' END AS hash_check, CASE WHEN verdict IN ('keeper_missing', 'keeper_size_mismatch') THEN '' ELSE kfd END AS observed_hash, k_root AS input_root, '' AS message
  FROM (SELECT *, verdict IN ('keeper_missing', 'keeper_size_mismatch', 'keeper_hash_mismatch') AS bad FROM h WHERE part = 1 AND k_path IS NOT NULL)),
lost AS (SELECT CAST(-1 AS BIGINT) AS bat, CASE disposition WHEN 'planned_sidecar_merge' THEN 1 ELSE 0 END AS part, line AS o_line, group_id, 'orphan_plan_sidecar' AS disposition, 'execute_plan_orphan_sidecar' AS event, 'error' AS status, 'sidecar' AS file_role, source_path, destination_path, '' AS duplicate_output_path, keeper_path, primary_source_path,
    'orphan_plan_sidecar' AS reason, size_bytes, '' AS xxh128, 'orphan_plan_sidecar' AS validation_result, 'skipped' AS action_taken, 'not_applicable' AS hash_check, '' AS observed_hash, input_root, 'planned sidecar row has no matching planned primary row' AS message
  FROM cut WHERE disposition IN ('planned_duplicate_sidecar', 'planned_sidecar_merge') AND NOT EXISTS (SELECT 1 FROM prim WHERE prim.group_id = cut.group_id AND bundle = cut.primary_source_path)),
log AS (FROM lost UNION ALL FROM keepers UNION ALL FROM body)"""

SQL: dict[str, str] = {
    "inventory_manifest": f"{_INV} SELECT ordinal, file_role, label, path, relative_path, coalesce(primary_path, '') AS primary_path, size_bytes, digest FROM inv",
    "file_role_counts": f"{_INV} SELECT file_role, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM inv GROUP BY 1",
    "path_features": f"{_INV} SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '[^/](\\.[^./]+)$', 1) AS suffix, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '') AS stem, regexp_replace(path, '/[^/]*$', '') AS parent, CAST({CLASS} AS BIGINT) AS path_class, CAST({SCORE} AS BIGINT) AS date_score, file_role = 'primary' AS is_primary FROM inv",
    "primary_groups": f"{P} SELECT group_id, g AS first_ordinal, ordinal, path, CAST(n AS BIGINT) AS n FROM m",
    "primary_uniques": f"{P} SELECT path, size_bytes, digest FROM e WHERE n = 1",
    "sidecar_groups": f"{P}, sr AS (SELECT *, row_number() OVER (ORDER BY ordinal, pos) AS o FROM s), so AS (SELECT *, count(*) OVER b AS n, min(o) OVER b AS g FROM sr WINDOW b AS (PARTITION BY size_bytes, digest)) SELECT 's' || lpad(CAST(dense_rank() OVER (ORDER BY g) AS VARCHAR), 6, '0') AS group_id, path, CAST(n AS BIGINT) AS n FROM so WHERE n > 1",
    "uncategorized_groups": f"{P} SELECT group_id, path, CAST(n AS BIGINT) AS n FROM um",
    "entry_bundles": f"{P} SELECT e.ordinal, e.path, count(s.path) AS sidecars, CAST(e.size_bytes + coalesce(sum(s.size_bytes), 0) AS BIGINT) AS bytes FROM e LEFT JOIN s USING (ordinal) GROUP BY e.ordinal, e.path, e.size_bytes",
    "collapse_paths": f"{_INV} SELECT path, ordinal, size_bytes, digest FROM inv WHERE file_role = 'primary'",
    "sidecar_multiset": f"{P} SELECT g, ordinal, key, CAST(n AS BIGINT) AS n FROM ek",
    "superset_candidates": f"{P} SELECT g, ordinal FROM sup",
    "class_merge_compat": f"{P} SELECT g FROM compat",
    "required_multiset": f"{P} SELECT g, key, required FROM req",
    "merge_need": f"{P} SELECT g, key, need FROM need",
    "keeper_primary": f"{P} SELECT g, keeper_ordinal, keeper_path FROM keep",
    "keeper_primary_ignore_json": f"{PJ} SELECT g, keeper_ordinal, keeper_path FROM keep",
    "keeper_uncategorized": f"{P} SELECT g, keeper_ordinal, keeper_path FROM ukeep",
    "merge_allocation": f"{P} SELECT g, ordinal, pos, path, merge FROM moved",
    "move_plan": f"{P} SELECT * FROM plan",
    "move_plan_ignore_json": f"{PJ} SELECT * FROM plan",
    "plan_result": f"{P} SELECT count(DISTINCT CASE WHEN group_id <> '' THEN group_id END) AS duplicate_groups, count(*) FILTER (WHERE disposition IN ('planned_duplicate_primary', 'planned_duplicate_uncategorized')) AS duplicate_files, count(DISTINCT CASE WHEN disposition = 'kept_sidecar_conflict' THEN group_id END) AS skipped_groups FROM plan",
    "plan_totals": f"{P} SELECT count(*) FILTER (WHERE {_OUT}) AS duplicate_output_files, CAST(coalesce(sum(size_bytes) FILTER (WHERE {_OUT}), 0) AS BIGINT) AS duplicate_output_bytes, count(DISTINCT group_id) FILTER (WHERE {_OUT}) AS duplicate_output_groups, count(*) FILTER (WHERE {_MERGE}) AS sidecar_merge_files, CAST(coalesce(sum(size_bytes) FILTER (WHERE {_MERGE}), 0) AS BIGINT) AS sidecar_merge_bytes, count(DISTINCT group_id) FILTER (WHERE {_MERGE}) AS sidecar_merge_groups, count(*) FILTER (WHERE status IN ('skipped', 'error')) AS skipped_rows, CAST(0 AS BIGINT) AS invalid_size_rows FROM plan",
    "plan_breakdown": f"{P} SELECT kind, key, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT 'file_role' AS kind, file_role AS key, size_bytes FROM plan WHERE {_OUT} UNION ALL SELECT 'disposition', disposition, size_bytes FROM plan WHERE {_OUT} UNION ALL SELECT 'input_root', input_root, size_bytes FROM plan WHERE {_OUT}) GROUP BY 1, 2",
    "plan_skipped": f"{P} SELECT disposition, count(*) AS rows FROM plan WHERE status IN ('skipped', 'error') GROUP BY 1",
    "destination_conflicts": f"{P} SELECT 'move' AS kind, (SELECT count(*) FROM (SELECT destination_path FROM plan WHERE {_OUT} GROUP BY 1 HAVING count(*) > 1)) AS conflicts UNION ALL SELECT 'merge', (SELECT count(*) FROM (SELECT destination_path FROM plan WHERE {_MERGE} GROUP BY 1 HAVING count(*) > 1))",
    "json_conflict_groups": f"{P} SELECT g, group_id, ordinal, path || '.json' AS path, path AS primary_source_path FROM m",
    "json_key_diff": f"""{P},
jf AS (SELECT g, group_id, ordinal, path AS primary_source_path, path || '.json' AS path, count(*) OVER (PARTITION BY g) AS total FROM m),
jv AS (SELECT jf.*, k AS json_key, CASE k WHEN 'id' THEN CAST(ordinal AS VARCHAR) WHEN 'same' THEN '"x"' WHEN 'some' THEN CASE WHEN ordinal % 2 = 0 THEN 'null' ELSE '1' END WHEN 'deep' THEN CASE WHEN ordinal % 3 = 0 THEN 'null' ELSE '{{"a":"é","b":[1,2]}}' END END AS json_value
  FROM jf, (VALUES ('id'), ('same'), ('some'), ('deep')) t(k) WHERE ordinal % 7 < 5)
SELECT group_id, json_key, 'differing' AS status, primary_source_path, path AS source_path, json_value, sha256(json_value) AS value_sha256, count(*) OVER (PARTITION BY g, json_key, json_value) AS value_count_in_group, total AS json_sidecar_count, 'json_key_differs' AS reason, '' AS message
FROM jv JOIN (SELECT g, json_key FROM jv GROUP BY ALL HAVING count(DISTINCT json_value) > 1) USING (g, json_key)
UNION ALL SELECT group_id, '', 'error', primary_source_path, path, '', '', NULL, total, 'json_parse_error', CASE ordinal % 7 WHEN 5 THEN 'Expecting value: line 1 column 1 (char 0)' ELSE 'JSON sidecar root is not an object' END FROM jf WHERE ordinal % 7 > 4""",
    "plan_bundles": f"{P}{_VERDICT} SELECT group_id, bundle, CAST(kind AS BIGINT) AS kind, disposition, source_path, destination_path, duplicate_output_path, k_path AS keeper FROM st",
    "orphan_sidecars": f"{P}, cut AS (SELECT * FROM plan WHERE NOT (disposition = 'planned_duplicate_primary' AND CAST(regexp_extract(source_path, 'IMG_([0-9]+)', 1) AS INT) % 2 = 0)) SELECT c.group_id, c.disposition, c.source_path FROM cut c WHERE c.disposition IN ('planned_duplicate_sidecar', 'planned_sidecar_merge') AND NOT EXISTS (SELECT 1 FROM cut p WHERE p.disposition LIKE 'planned_duplicate_prim%' AND p.group_id = c.group_id AND p.source_path = c.primary_source_path)",
    "row_state": f"{P}{_VERDICT} SELECT source_path, disposition, state FROM st",
    "merge_row_state": f"""{P}{_VERDICT},
again AS (SELECT * FROM fs UNION ALL SELECT path || '.again', is_file, size_bytes, CASE WHEN size_bytes % 2 = 0 THEN 'other' ELSE digest END FROM fs WHERE path LIKE '/dupes%'),
merges AS (SELECT * REPLACE ('planned_sidecar_merge' AS disposition, CASE duplicate_output_path WHEN '' THEN destination_path || '.again' ELSE duplicate_output_path END AS duplicate_output_path) FROM br),
look AS ({_LOOKED.format(rows="merges", at="again")}), stat AS ({_STATED.format(looked="look")})
SELECT source_path, state, looked AS hash_check, seen AS observed_hash, coalesce({_ACTION}, '') AS action_destination FROM stat""",
    "execution_log": f"{P}{_LOG} SELECT * EXCLUDE (bat, part, o_line) FROM log",
    "execution_log_order": f"{P}{_LOG} SELECT row_number() OVER (ORDER BY bat, part, o_line, source_path) - 1 AS position, event, source_path FROM log",
    "plan_log_order": f"{P}{_LINES} SELECT line AS position, disposition, source_path FROM lines",
    "verify_move_order": f"""{P}{_LINES}, checks AS (SELECT o1, o2, o3, vl, vp, o6, o7, false AS there, source_path, disposition, file_role FROM lines UNION ALL SELECT o1, o2, o3, vl, vp, o6, o7, true, destination_path, disposition, file_role FROM lines WHERE status = 'planned')
SELECT row_number() OVER (ORDER BY o1, o2, o3, vl, vp, o6, o7, there) - 1 AS position, CASE WHEN disposition LIKE 'kept_unique_unc%' THEN 'verify_move_unique_uncategorized' WHEN disposition LIKE 'kept_unique%' THEN 'verify_move_unique' WHEN disposition LIKE 'kept_sidecar_conf%' THEN 'verify_move_sidecar_conflict'
    WHEN disposition LIKE 'kept_duplicate_unc%' THEN 'verify_move_uncategorized_keeper' WHEN disposition LIKE 'kept%' THEN 'verify_move_keeper' WHEN NOT there THEN 'verify_move_duplicate_source' WHEN disposition = 'planned_sidecar_merge' THEN 'verify_move_sidecar_merge' ELSE 'verify_move_duplicate_destination' END AS event,
  CASE WHEN there THEN '' ELSE source_path END AS source_path, CASE WHEN there THEN source_path ELSE '' END AS destination_path FROM checks""",
    "xxh128_groups": f"{_INV} SELECT path, size_bytes, min(path) OVER (PARTITION BY content) AS first_path, count(*) OVER (PARTITION BY content) AS n FROM inv",
    "bundle_verdict": verdict(False),
    "bundle_verdict_hashed": verdict(True),
    "byte_verify": f"""WITH {INVENTORY_SQL},
w AS (SELECT *, row_number() OVER (ORDER BY ordinal, pos) AS o, substr(digest, 1, 1) AS weak FROM inv),
b AS (SELECT *, count(*) OVER q AS n, min(o) OVER q AS g, first_value(content) OVER (q ORDER BY o) AS head FROM w WINDOW q AS (PARTITION BY file_role, size_bytes, weak)),
i AS (SELECT file_role, g, substr(CASE file_role WHEN 'primary' THEN 'm' WHEN 'sidecar' THEN 's' ELSE 'u' END, 1, 1) || lpad(CAST(row_number() OVER (PARTITION BY file_role ORDER BY g) AS VARCHAR), 6, '0') AS group_id FROM (SELECT DISTINCT file_role, g FROM b WHERE n > 1)),
c AS (SELECT b.*, group_id, content <> head AS differs FROM b JOIN i USING (file_role, g) WHERE n > 1)
SELECT 'verify_failed' AS disposition, 'verify_manifest_' || file_role AS event, 'error' AS status, group_id, file_role, label AS input_root, path AS source_path, size_bytes, weak AS xxh128, 'same_manifest_hash_but_bytes_differ' AS reason FROM c WHERE differs
UNION ALL SELECT 'verify_matched', 'verify_manifest_' || file_role || '_group', 'kept', group_id, file_role, '', '', size_bytes, weak, 'all_manifest_hash_matches_are_byte_equal' FROM c GROUP BY file_role, group_id, size_bytes, weak HAVING NOT bool_or(differs)""",
    "verify_move_checks": f"{P},{_MOVE_CHECKS}",
    "unexpected_outputs": f"{P} SELECT 'verify_move_unexpected_output' AS disposition, 'verify_move_output_scan' AS event, 'error' AS status, path AS source_path, size_bytes, 'unexpected_output_file' AS reason, 'output file is not an expected moved duplicate or sidecar' AS message FROM fs WHERE path LIKE '/dupes/%' AND path NOT IN (SELECT destination_path FROM plan WHERE disposition LIKE 'planned_duplicate%')",
    "dir_structure_diff": f"{_INV}, d AS (SELECT DISTINCT label, regexp_replace(relative_path, '/[^/]*$', '') AS dir FROM inv) SELECT dir, 'missing' AS side FROM d WHERE label = 'src0' AND dir NOT IN (SELECT dir FROM d WHERE label = 'src1') UNION ALL SELECT dir, 'extra' FROM d WHERE label = 'src1' AND dir NOT IN (SELECT dir FROM d WHERE label = 'src0')",
}
