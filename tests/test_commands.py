"""The commands over small trees of real files."""

import csv

import pytest
import xxhash

from dupeplan import cli, commands
from dupeplan.schema import LOG_FIELDS, MANIFEST_FIELDS


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())


def rows_of(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def manifest(spark, tmp_path, name, files):
    """A batch whose local and NAS roots are the same directory."""
    root = tmp_path / name
    root.mkdir(parents=True, exist_ok=True)
    write(root, files)
    return commands.generate_manifest(spark, str(root), str(root), str(tmp_path / f"{name}.csv"))


def quick_manifest(tmp_path, name, files):
    """The same rows without a scan: images are primaries, others with an image's stem its sidecars."""
    root = tmp_path / name
    write(root, files)
    images = sorted(f for f in files if f.endswith(".jpg"))
    owner = lambda f: f if f in images else next((i for i in images if i.rsplit(".", 1)[0] == f.split(".")[0]), None)
    order = sorted(files, key=lambda f: ((owner(f) or f).lower(), f not in images, f.lower()))
    with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, MANIFEST_FIELDS, restval="")
        writer.writeheader()
        for f in order:
            role = "primary" if f in images else "sidecar" if owner(f) else "uncategorized"
            row = {"relative_path": f, "file_role": role, "status": "skipped" if role == "uncategorized" else "included", "reason": "unrecognized_non_primary" if role == "uncategorized" else "", "size_bytes": len(files[f].encode())}
            row |= {"xxh128": xxhash.xxh3_128_hexdigest(files[f].encode()), "nas_path": f"{root}/{f}", "manifest_version": "2", "created_at": "2020-01-01T00:00:00", "nas_root_label": name, "batch_root": str(root), "nas_root": str(root)}
            if role != "uncategorized":
                row["group_id"] = f"f{images.index(owner(f)) + 1:06d}"
            if role == "sidecar":
                row |= {"primary_relative_path": owner(f), "primary_nas_path": f"{root}/{owner(f)}"}
            writer.writerow(row)
    return str(tmp_path / f"{name}.csv")


def test_quick_manifest_is_the_scans(spark, tmp_path):
    files = {"a.jpg": "first", "a.mov": "live", "b.jpg": "second", "m.bin": "other"}
    made = quick_manifest(tmp_path, "one", files)
    scanned = commands.generate_manifest(spark, str(tmp_path / "one"), str(tmp_path / "one"), str(tmp_path / "scan.csv"))
    plain = lambda path: [{k: v for k, v in r.items() if k != "created_at"} for r in rows_of(path)]
    assert plain(made) == plain(scanned)


@pytest.fixture
def merge_case(spark, tmp_path):
    """Equal primaries with different kinds of sidecars."""
    return [
        manifest(spark, tmp_path, "one", {"foo.jpg": "same", "foo.mov": "video"}),
        manifest(spark, tmp_path, "two", {"bar.jpg": "same", "bar.jpg.json": "metadata"}),
    ]


def test_manifest_roles_order_and_digest(spark, tmp_path):
    path = manifest(spark, tmp_path, "batch", {"2024/photo.HEIC": "image", "2024/photo.MOV": "video", "2024/photo.HEIC.json": "metadata", "2024/photo.supplemental-metadata.json": "not yet", "2024/.hidden": "x", "2024/a, \"b\".txt": "q"})
    rows = rows_of(path)
    assert list(rows[0]) == MANIFEST_FIELDS
    by = {r["relative_path"]: r for r in rows}
    assert by["2024/photo.HEIC"]["file_role"] == "primary" and by["2024/photo.HEIC"]["group_id"] == "f000001"
    assert by["2024/photo.HEIC"]["xxh128"] == xxhash.xxh3_128_hexdigest(b"image")
    assert {k for k, r in by.items() if r["file_role"] == "sidecar"} == {"2024/photo.MOV", "2024/photo.HEIC.json"}
    assert by["2024/photo.supplemental-metadata.json"]["reason"] == "unrecognized_non_primary"
    assert by["2024/.hidden"]["file_role"] == "uncategorized" and '2024/a, "b".txt' in by


def test_manifest_row_order_and_links(spark, tmp_path):
    root = tmp_path / "batch"
    write(root, {"2024/a-unrelated.json": "1", "2024/b.jpg": "2", "2024/b.MOV": "3", "2024/c-unrelated.json": "4", "2024/d.jpg": "5"})
    (root / "2024/link.jpg").symlink_to(root / "2024/d.jpg")
    (root / "linked").symlink_to(root / "2024")
    path = commands.generate_manifest(spark, str(root), str(root), str(tmp_path / "m.csv"))
    assert [r["relative_path"].split("/")[1] for r in rows_of(path)] == ["a-unrelated.json", "b.jpg", "b.MOV", "c-unrelated.json", "d.jpg"]
    with pytest.raises(ValueError, match="already exists"):
        commands.generate_manifest(spark, str(root), str(root), str(tmp_path / "m.csv"))


def test_ambiguous_sidecar(spark, tmp_path):
    rows = rows_of(manifest(spark, tmp_path, "batch", {"photo.jpg": "1", "photo.jpg.png": "2", "photo.jpg.json": "3"}))
    assert {r["relative_path"]: r["reason"] for r in rows}["photo.jpg.json"] == "ambiguous_sidecar_multiple_primaries"


def test_structure_check(spark, tmp_path):
    write(tmp_path / "a/batch", {"2024/May/x.jpg": "1"})
    write(tmp_path / "b/batch", {"2024/x.jpg": "1", "2025/y.jpg": "1"})
    with pytest.raises(ValueError, match="missing local directories within depth 2: 2024/May"):
        commands.generate_manifest(spark, str(tmp_path / "a/batch"), str(tmp_path / "b/batch"), str(tmp_path / "m.csv"))


def test_plan_merge_move_verify(spark, tmp_path, merge_case):
    out = tmp_path / "dupes"
    result = commands.plan_from_manifests(spark, merge_case, str(out), str(tmp_path / "plan.csv"))
    assert (result["duplicate_groups"], result["duplicate_files"], result["skipped_groups"]) == (1, 1, 0)
    rows = rows_of(tmp_path / "plan.csv")
    assert list(rows[0]) == LOG_FIELDS
    assert [r["disposition"] for r in rows] == ["kept_duplicate_keeper", "kept_duplicate_keeper_sidecar", "planned_duplicate_primary", "planned_sidecar_merge"]
    assert rows[3]["destination_path"] == str(tmp_path / "one/foo.jpg.json") and rows[3]["duplicate_output_path"] == str(out / "two/bar.jpg.json")
    found = commands.analyze_plan(spark, str(tmp_path / "plan.csv"))
    assert (found["duplicate_output_files"], found["duplicate_output_bytes"], found["sidecar_merge_files"]) == (1, 4, 1)
    dry = commands.execute_plan(spark, str(tmp_path / "plan.csv"), str(tmp_path / "dry.csv"))
    assert dry["planned_bundles"] == 1 and {r["hash_check"] for r in rows_of(tmp_path / "dry.csv")} == {"not_checked"}
    moved = commands.execute_plan(spark, str(tmp_path / "plan.csv"), str(tmp_path / "move.csv"), move=True)
    assert moved["moved_bundles"] == 1 and (tmp_path / "one/foo.jpg.json").read_text() == "metadata" and not (tmp_path / "two/bar.jpg").exists()
    assert {r["disposition"] for r in rows_of(tmp_path / "move.csv")} == {"verified_keeper", "moved_duplicate_primary", "merged_sidecar"}
    again = commands.execute_plan(spark, str(tmp_path / "plan.csv"), str(tmp_path / "again.csv"), move=True)
    assert again["already_moved_bundles"] == 1
    checked = commands.verify_move(spark, merge_case, str(out), str(tmp_path / "verify.csv"))
    assert checked["failed_paths"] == checked["unexpected_outputs"] == 0 and checked["checked_paths"] == 6
    write(out, {"extra.txt": "?"})
    assert commands.verify_move(spark, merge_case, str(out), str(tmp_path / "v2.csv"))["unexpected_outputs"] == 1


def test_conflict_is_kept_and_json_keys_compared(spark, tmp_path):
    paths = [quick_manifest(tmp_path, n, {"photo.jpg": "live", "photo.json": f'{{"a": 1, "b": {v}}}'}) for n, v in (("one", 1), ("two", 1.0))]
    result = commands.plan_from_manifests(spark, paths, str(tmp_path / "d"), str(tmp_path / "p.csv"))
    assert (result["skipped_groups"], result["duplicate_files"]) == (1, 0)
    assert [r["disposition"] for r in rows_of(tmp_path / "p.csv")] == ["kept_sidecar_conflict", "kept_sidecar_conflict_sidecar"] * 2
    found = commands.analyze_json_sidecars(spark, paths, str(tmp_path / "j.csv"))
    assert (found["differing_keys"], found["parse_errors"]) == (1, 0)
    assert [(r["json_key"], r["json_value"]) for r in rows_of(tmp_path / "j.csv")] == [("b", "1"), ("b", "1.0")]
    ignored = commands.plan_from_manifests(spark, paths, str(tmp_path / "d"), str(tmp_path / "p2.csv"), ignore_json=True)
    assert ignored["skipped_groups"] == 0


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        (lambda t: (t / "one/photo.jpg").unlink(), "keeper_missing"),
        (lambda t: write(t, {"one/photo.jpg": "longer"}), "keeper_size_mismatch"),
        (lambda t: write(t, {"one/photo.jpg": "emas"}), "keeper_hash_mismatch"),
        (lambda t: write(t, {"two/photo.jpg": "emas"}), "source_hash_mismatch"),
        (lambda t: write(t, {"two/photo.jpg": "longer"}), "source_size_mismatch"),
        (lambda t: (t / "two/photo.jpg").unlink(), "source_missing"),
        (lambda t: write(t, {"dupes/two/photo.jpg": "same"}), "destination_exists"),
    ],
)
def test_refused_moves(spark, tmp_path, change, reason):
    paths = [quick_manifest(tmp_path, n, {"photo.jpg": "same"}) for n in ("one", "two")]
    commands.plan_from_manifests(spark, paths, str(tmp_path / "dupes"), str(tmp_path / "p.csv"))
    change(tmp_path)
    result = commands.execute_plan(spark, str(tmp_path / "p.csv"), str(tmp_path / "x.csv"), move=True)
    assert result["skipped_bundles"] == 1
    assert [r["reason"] for r in rows_of(tmp_path / "x.csv")][-1] == reason


@pytest.mark.parametrize(
    ("change", "reason", "verify"),
    [
        (lambda t: (t / "one/b.jpg").unlink(), "keeper_missing", False),
        (lambda t: write(t, {"one/b.jpg": "much longer"}), "keeper_size_mismatch", False),
        (lambda t: write(t, {"one/b.jpg": "dnoces"}), "keeper_hash_mismatch", True),
        (lambda t: write(t, {"two/b.jpg": "dnoces"}), "source_hash_mismatch", True),
        (lambda t: write(t, {"two/b.jpg": "dnoces"}), "", False),
        (lambda t: write(t, {"two/b.mov": "much longer"}), "source_size_mismatch", False),
        (lambda t: (t / "two/b.mov").unlink(), "partial_bundle_state", False),
        (lambda t: write(t, {"dupes/two/b.jpg": "second"}), "destination_exists", False),
    ],
)
def test_changes_after_validation(spark, tmp_path, change, reason, verify):
    """What changes between the validation of all bundles and a bundle's own turn is noticed."""
    from dupeplan.operators import moving
    from dupeplan.sources import manifests

    paths = [quick_manifest(tmp_path, n, {"a.jpg": "first", "b.jpg": "second", "b.mov": "live"}) for n in ("one", "two")]
    commands.plan_from_manifests(spark, paths, str(tmp_path / "dupes"), str(tmp_path / "p.csv"))
    plan = manifests.read_csv(spark, str(tmp_path / "p.csv"), ["disposition"], "plan")
    rows = moving.move_bundles(spark, plan, verify)
    done = [next(rows), next(rows)]
    assert [r["status"] for r in done] == ["kept", "moved"] and done[1]["source_path"].endswith("a.jpg")
    change(tmp_path)
    rest = list(rows)
    if reason:
        assert {r["reason"] for r in rest if r["status"] == "error"} == {reason} and not [r for r in rest if r["status"] == "moved"]
        assert reason == "destination_exists" or not (tmp_path / "dupes/two/b.jpg").exists()
    else:
        assert [r["status"] for r in rest] == ["kept", "moved", "moved"]


def test_log_goes_bundle_by_bundle(spark, tmp_path):
    """Dry run and move log orphans, then each bundle's keeper, primary, sidecars and merges, in the order of the plan."""
    names = {"z.jpg": "first", "z.mov": "live", "a.jpg": "second", "m.bin": "other"}
    paths = [quick_manifest(tmp_path, n, names) for n in ("one", "two", "Three")]
    commands.plan_from_manifests(spark, paths, str(tmp_path / "dupes"), str(tmp_path / "p.csv"))
    commands.execute_plan(spark, str(tmp_path / "p.csv"), str(tmp_path / "dry.csv"))
    commands.execute_plan(spark, str(tmp_path / "p.csv"), str(tmp_path / "move.csv"), move=True)
    planned = [r["source_path"] for r in rows_of(tmp_path / "p.csv") if r["disposition"] in ("planned_duplicate_primary", "planned_duplicate_uncategorized")]
    for log in ("dry.csv", "move.csv"):
        rows = rows_of(tmp_path / log)
        assert [r["source_path"] for r in rows if r["event"] in ("execute_plan_move", "execute_plan_uncategorized_move")] == planned
        events = [r["event"] for r in rows]
        assert events == [e for p in planned for e in ["execute_plan_keeper", "execute_plan_uncategorized_move" if p.endswith("bin") else "execute_plan_move", *["execute_plan_sidecar_move"] * p.endswith("z.jpg")]]


def test_two_primaries_of_one_key_are_two_bundles(spark, tmp_path):
    paths = [quick_manifest(tmp_path, n, {"a.jpg": "first", "a.mov": "live"}) for n in ("one", "two")]
    commands.plan_from_manifests(spark, paths, str(tmp_path / "dupes"), str(tmp_path / "p.csv"))
    rows = rows_of(tmp_path / "p.csv")
    twice = next(r for r in rows if r["disposition"] == "planned_duplicate_primary")
    with open(tmp_path / "p2.csv", "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, LOG_FIELDS)
        writer.writeheader()
        writer.writerows([*rows, twice])
    result = commands.execute_plan(spark, str(tmp_path / "p2.csv"), str(tmp_path / "x.csv"))
    assert result["bundles"] == result["skipped_bundles"] == 2
    assert [r["event"] for r in rows_of(tmp_path / "x.csv")] == ["execute_plan_keeper", "execute_plan_move", "execute_plan_sidecar_move"] * 2
    assert {r["reason"] for r in rows_of(tmp_path / "x.csv") if r["status"] == "error"} == {"duplicate_destination_in_plan"}


def test_more_than_a_thousand_sidecars(spark):
    """Places of a primary's sidecars beyond 1,000 are told from those of the next primary."""
    from dupeplan.operators import planning, verification

    rows = [(1, p, f"/1/{p}", "l", p, "same" if p in (5, 1000) else f"x{p}") for p in range(1, 1201)] + [(2, p, f"/2/{p}", "l", p, f"x{p + 1000}" if p < 3 else f"y{p}") for p in range(1, 1100)]
    sized = [(o, p, path, path[1:], label, 7, digest) for o, p, path, label, _, digest in rows]
    sidecars = spark.createDataFrame(sized, "ordinal long, pos long, path string, relative_path string, label string, size_bytes long, digest string")
    got = sorted((r["group_id"], r["path"]) for r in planning.sidecar_members(sidecars).collect())
    assert got == [("s000001", "/1/1000"), ("s000001", "/1/5"), ("s000002", "/1/1001"), ("s000002", "/2/1"), ("s000003", "/1/1002"), ("s000003", "/2/2")]
    none = sidecars.where("false").drop("pos")
    groups = verification.byte_groups(none, sidecars, none)
    assert sorted(r["path"] for r in groups.where("first").collect()) == ["/1/1001", "/1/1002", "/1/5"]


def test_merges_are_chosen_by_order_however_they_are_dealt(spark, monkeypatch):
    from dupeplan.operators import planning

    members = spark.createDataFrame([(o, 1, f"l{o % 3}", f"p{o}") for o in range(1, 200)], "ordinal long, g long, label string, relative_path string")
    grouped = spark.createDataFrame([(1, o, p, f"/{o}/{p}.mov", "video", "k") for o in range(1, 200) for p in range(1, 1 + (o > 1) + 2 * (o == 150))], "g long, ordinal long, pos long, path string, class string, key string")
    keepers = spark.createDataFrame([(1, 1, "/1")], "g long, keeper_ordinal long, keeper_path string")
    want = sorted((f"l{o % 3}", f"p{o}", o, p) for o, p in ((r["ordinal"], r["pos"]) for r in grouped.collect()) if o > 1)[:3]
    for parts in (1, 7, 256):
        monkeypatch.setattr(planning, "PARTS", parts)
        got = planning.allocated(members, grouped, keepers).where("merge").collect()
        assert sorted((f"l{r['ordinal'] % 3}", f"p{r['ordinal']}", r["ordinal"], r["pos"]) for r in got) == want


def test_progress_lines(spark, tmp_path, merge_case, capsys):
    assert cli.main(["plan", *merge_case, "--output", str(tmp_path / "d"), "--log", str(tmp_path / "p.csv")], spark) == 0
    assert cli.main(["execute-plan", str(tmp_path / "p.csv"), "--log", str(tmp_path / "x.csv"), "--move"], spark) == 0
    said = capsys.readouterr().err
    assert "plan: load manifests ..." in said and "execute-plan: move bundles: done in" in said and "2 moved files" in said


def test_hash_bench(tmp_path, capsys):
    from dupeplan import hash_bench

    write(tmp_path, {"a/x.bin": "x" * 5000, "b.bin": "y" * 77})
    rows = hash_bench.measured(str(tmp_path), rounds=2, chunk=1024)
    assert {r["variant"]: r["digest_bits"] for r in rows} == {"read_only": 0, "xxh32": 32, "xxh64": 64, "xxh3_64": 64, "xxh3_128": 128, "xxh128": 128}
    assert all(r["bytes"] == 5077 and r["files"] == 2 and r["min_ms"] <= r["median_ms"] for r in rows)
    assert hash_bench.main([str(tmp_path), "--rounds", "1"]) == 0 and "xxh3_128" in capsys.readouterr().out


def test_failed_move_is_rolled_back(spark, tmp_path, monkeypatch):
    from dupeplan.operators import moving

    paths = [quick_manifest(tmp_path, n, {"photo.jpg": "same", "photo.mov": "live"}) for n in ("one", "two")]
    commands.plan_from_manifests(spark, paths, str(tmp_path / "dupes"), str(tmp_path / "p.csv"))
    real = moving.shutil.move

    def broken(source, destination):
        if source.endswith(".mov"):
            raise OSError("disk full")
        return real(source, destination)

    monkeypatch.setattr(moving.shutil, "move", broken)
    result = commands.execute_plan(spark, str(tmp_path / "p.csv"), str(tmp_path / "x.csv"), move=True)
    assert result["skipped_bundles"] == 1 and (tmp_path / "two/photo.jpg").exists() and not (tmp_path / "dupes/two/photo.jpg").exists()
    assert {r["reason"] for r in rows_of(tmp_path / "x.csv") if r["status"] == "error"} == {"move_failed"}


def test_verify_bytes_finds_tampering(spark, tmp_path):
    paths = [quick_manifest(tmp_path, n, {"photo.jpg": "same", "x.bin": "b"}) for n in ("one", "two")]
    good = commands.verify_bytes(spark, paths, str(tmp_path / "a.csv"))
    assert (good["checked_groups"], good["failed_groups"]) == (2, 0)
    write(tmp_path, {"two/photo.jpg": "emas"})
    assert commands.verify_bytes(spark, paths, str(tmp_path / "b.csv"))["failed_groups"] == 1


def _edit(path, change):
    rows = rows_of(path)
    change(rows)
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, MANIFEST_FIELDS)
        writer.writeheader()
        writer.writerows(rows)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda r: r[0].update(manifest_version="999"), "unsupported manifest version"),
        (lambda r: r[0].update(file_role="unknown"), "unsupported manifest file_role"),
        (lambda r: r[0].update(status="unknown"), "unsupported manifest status"),
        (lambda r: r[0].update(size_bytes="not-an-int"), "invalid manifest size_bytes"),
        (lambda r: r[1].update(primary_nas_path=""), "sidecar manifest row missing primary path fields"),
        (lambda r: r[1].update(group_id="f000009"), "no primary"),
        (lambda r: r[1].update(primary_nas_path="/elsewhere"), "points at a different primary"),
        (lambda r: r.append(dict(r[0])), "multiple primary rows"),
    ],
)
def test_malformed_manifests(spark, tmp_path, change, message):
    path = quick_manifest(tmp_path, "one", {"photo.jpg": "same", "photo.mov": "v"})
    _edit(path, change)
    with pytest.raises(ValueError, match=message):
        commands.plan_from_manifests(spark, [path], str(tmp_path / "d"), str(tmp_path / "p.csv"))
    assert not (tmp_path / "p.csv").exists()


def test_first_error_of_several(spark, tmp_path):
    """The first manifest's errors come first: lines in their order, then owners; one with bad lines only later does not."""
    from dupeplan.sources import manifests

    good = quick_manifest(tmp_path, "one", {"photo.jpg": "same", "photo.mov": "v", "x.jpg": "x", "y.jpg": "y"})
    cases = [
        (lambda r: (r[3].update(size_bytes="?"), r[1].update(group_id="f000009"), r.append(dict(r[0]))), "invalid manifest size_bytes"),
        (lambda r: (r.insert(2, dict(r[0])), r[4].update(status="?")), "multiple primary rows"),
        (lambda r: (r[1].update(primary_nas_path="/elsewhere"), r.append(dict(r[1], group_id="f000009"))), "no primary"),
    ]
    for i, (change, message) in enumerate(cases):
        path = tmp_path / f"bad{i}.csv"
        path.write_text(open(good, encoding="utf-8").read())
        _edit(path, change)
        later = tmp_path / f"later{i}.csv"
        later.write_text(open(good, encoding="utf-8").read())
        _edit(later, lambda r: r[0].update(manifest_version="999"))
        with pytest.raises(ValueError, match=message):
            manifests.load(spark, [good, str(path), str(later)])


def test_empty_manifest_and_repeated_manifest(spark, tmp_path):
    path = quick_manifest(tmp_path, "one", {"photo.jpg": "same"})
    twice = commands.plan_from_manifests(spark, [path, path], str(tmp_path / "d"), str(tmp_path / "p.csv"))
    assert twice["duplicate_groups"] == 0 and len(rows_of(tmp_path / "p.csv")) == 1
    _edit(path, lambda r: r.clear())
    empty = commands.plan_from_manifests(spark, [path], str(tmp_path / "d"), str(tmp_path / "q.csv"))
    assert empty["duplicate_groups"] == empty["duplicate_files"] == 0


def test_plan_analysis_golden(spark, tmp_path):
    fields = ["disposition", "status", "file_role", "group_id", "input_root", "destination_path", "size_bytes"]
    lines = [
        ["planned_duplicate_primary", "planned", "primary", "m000001", "takeout", "/dupes/takeout/a.jpg", "100"],
        ["planned_duplicate_sidecar", "planned", "sidecar", "m000001", "takeout", "/dupes/takeout/a.mov", "40"],
        ["planned_duplicate_uncategorized", "planned", "uncategorized", "u000001", "mobilebackup", "/dupes/mobilebackup/video.mov", "200"],
        ["planned_duplicate_primary", "planned", "primary", "m000002", "takeout", "/dupes/takeout/a.jpg", "25"],
        ["planned_duplicate_primary", "planned", "primary", "m000003", "takeout", "/dupes/takeout/b.jpg", "not-an-int"],
        ["planned_sidecar_merge", "planned", "sidecar", "m000004", "mobilebackup", "/keepers/photo.mov", "50"],
        ["planned_sidecar_merge", "planned", "sidecar", "m000005", "mobilebackup", "/keepers/photo.mov", "60"],
        ["kept_sidecar_conflict", "skipped", "primary", "m000006", "mobilebackup", "", "10"],
    ]
    with open(tmp_path / "p.csv", "w", newline="") as f:
        csv.writer(f).writerows([fields, *lines])
    found = commands.analyze_plan(spark, str(tmp_path / "p.csv"))
    assert [found[k] for k in ("duplicate_output_files", "duplicate_output_bytes", "duplicate_output_groups", "sidecar_merge_files", "sidecar_merge_bytes", "sidecar_merge_groups", "skipped_rows", "invalid_size_rows")] == [5, 365, 4, 2, 110, 2, 1, 1]
    assert found["duplicate_output_destination_conflicts"] == found["sidecar_merge_target_conflicts"] == 1
    assert found["by_file_role"] == {"primary": 3, "sidecar": 1, "uncategorized": 1} and found["bytes_by_input_root"]["takeout"] == 165
    assert cli.main(["analyze-plan", str(tmp_path / "p.csv")], spark) == 0


def test_cli_exit_codes(spark, tmp_path, merge_case, capsys):
    assert cli.main(["plan", *merge_case, "--output", str(tmp_path / "d"), "--log", str(tmp_path / "p.csv")], spark) == 0
    assert cli.main(["plan", *merge_case, "--output", str(tmp_path / "d"), "--log", str(tmp_path / "p.csv")], spark) == 2
    assert "plan log already exists" in capsys.readouterr().err
    assert cli.main(["verify-move", *merge_case, "--output", str(tmp_path / "d"), "--log", str(tmp_path / "v.csv")], spark) == 1
