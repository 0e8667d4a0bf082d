"""Command line: ``python -m dupeplan.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from dupeplan import commands
from dupeplan.progress import Progress
from dupeplan.sources import manifests


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="dupeplan")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("manifest")
    p.add_argument("root")
    p.add_argument("--nas-root", required=True)
    p.add_argument("--manifest")
    p.add_argument("--structure-depth", type=int, default=2)
    p = sub.add_parser("plan")
    p.add_argument("manifests", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--log")
    p.add_argument("--ignore-json-sidecar-fields", action="store_true")
    p = sub.add_parser("analyze-plan")
    p.add_argument("plan")
    for name in ("analyze-json-sidecars", "verify-bytes"):
        p = sub.add_parser(name)
        p.add_argument("manifests", nargs="+")
        p.add_argument("--log")
    p = sub.add_parser("execute-plan")
    p.add_argument("plan")
    p.add_argument("--log")
    p.add_argument("--move", action="store_true")
    p.add_argument("--no-verify-source-hashes", action="store_true")
    p = sub.add_parser("verify-move")
    p.add_argument("manifests", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--log")
    p.add_argument("--ignore-json-sidecar-fields", action="store_true")
    return top


def size_text(n: int) -> str:
    return f"{n} bytes ({n / 1024**3:.2f} GiB, {n / 1000**3:.2f} GB)"


def report(found: dict) -> str:
    """The analysis of a plan as text."""
    lines = [f"duplicate output files: {found['duplicate_output_files']}", f"duplicate output size: {size_text(found['duplicate_output_bytes'])}", f"duplicate output groups: {found['duplicate_output_groups']}"]
    lines += [f"sidecar merges: {found['sidecar_merge_files']}", f"sidecar merge size: {size_text(found['sidecar_merge_bytes'])}", f"sidecar merge groups: {found['sidecar_merge_groups']}"]
    lines += [f"skipped rows: {found['skipped_rows']}", f"duplicate output destination conflicts: {found['duplicate_output_destination_conflicts']}", f"sidecar merge target conflicts: {found['sidecar_merge_target_conflicts']}", f"invalid size rows: {found['invalid_size_rows']}"]
    for kind in ("file_role", "disposition", "input_root"):
        counts = found[f"by_{kind}"]
        lines += [f"by {kind}:", *[f"  {k}: {counts[k]} files, {size_text(found[f'bytes_by_{kind}'][k])}" for k in sorted(counts)]] + ["  (none)"] * (not counts)
    skipped = found["skipped_by_disposition"]
    lines += ["skipped by disposition:", *[f"  {k}: {skipped[k]}" for k in sorted(skipped)]] + ["  (none)"] * (not skipped)
    return "\n".join(lines)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all is well, 1 if the command found something wrong, 2 for bad input."""
    top = parser()
    a = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("dupeplan").getOrCreate()
    progress = Progress(a.command)
    try:
        if a.command == "manifest":
            print(commands.generate_manifest(spark, a.root, a.nas_root, a.manifest or manifests.manifest_beside(a.root), a.structure_depth, progress))
            return 0
        if a.command == "plan":
            print(commands.plan_from_manifests(spark, a.manifests, a.output, a.log, a.ignore_json_sidecar_fields, progress))
            return 0
        if a.command == "analyze-plan":
            print(report(commands.analyze_plan(spark, a.plan)))
            return 0
        if a.command == "analyze-json-sidecars":
            result = commands.analyze_json_sidecars(spark, a.manifests, a.log, progress)
            bad = result["parse_errors"]
        elif a.command == "verify-bytes":
            result = commands.verify_bytes(spark, a.manifests, a.log, progress)
            bad = result["failed_groups"]
        elif a.command == "execute-plan":
            result = commands.execute_plan(spark, a.plan, a.log, a.move, False if a.no_verify_source_hashes else None, progress)
            bad = result["skipped_bundles"] or result["orphan_sidecars"]
        else:
            result = commands.verify_move(spark, a.manifests, a.output, a.log, a.ignore_json_sidecar_fields, progress)
            bad = result["failed_paths"] or result["unexpected_outputs"]
    except ValueError as error:
        print(f"{top.prog}: error: {error}", file=sys.stderr)
        return 2
    print(result)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
