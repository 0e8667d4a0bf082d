"""Expressions over POSIX paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dupeplan.schema import JSON_KEY, PRIMARY_SUFFIXES

DATE = r"(?U)(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{4})(?!\d)"


def _col(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent(path: Column | str) -> Column:
    """What stands before the last slash; ``.`` without one."""
    p = _col(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def suffix(path: Column | str) -> Column:
    """The last dotted part of the name; empty for names that only begin or end with the dot."""
    return F.regexp_extract(name(path), r"(?s)^.+(\.[^.]+)$", 1)


def stem(path: Column | str) -> Column:
    n = name(path)
    return F.substr(n, F.lit(1), F.length(n) - F.length(suffix(path)))


def is_primary(path: Column | str) -> Column:
    return F.lower(suffix(path)).isin(PRIMARY_SUFFIXES)


def path_class(path: Column | str) -> Column:
    """0 takeout, 2 mobile backup, 1 any other."""
    low = F.lower(_col(path))
    return F.when(F.contains(low, F.lit("takeout")), 0).when(F.contains(low, F.lit("mobilebackup")), 2).otherwise(1)


def date_score(path: Column | str) -> Column:
    """Number of parent directories whose name holds a date or a year."""
    parts = F.split(_col(path), "/")
    return F.size(F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda c: F.rlike(c, F.lit(DATE))))


def sidecar_class(path: Column | str) -> Column:
    """video, json or null."""
    low = F.lower(suffix(path))
    return F.when(low.isin(".mov", ".mp4"), "video").when(low == ".json", "json")


def sidecar_key(path: Column | str, digest: Column | str, ignore_json: bool) -> Column:
    d = _col(digest)
    return F.when(F.lower(suffix(path)) == ".json", JSON_KEY).otherwise(d) if ignore_json else d


def joined(root: Column | str, relative: Column | str) -> Column:
    """A path below a root; an absolute one stays as it is."""
    r, p = _col(root), _col(relative)
    return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.regexp_replace(r, "/+$", ""), F.lit("/"), p))


def destination(output_root: str, label: Column | str, relative: Column | str) -> Column:
    return joined(joined(F.lit(output_root), label), relative)


def normalized(path: Column | str) -> Column:
    """Without repeated slashes, single dots and a slash at the end; ``.`` if nothing is left."""
    p = F.regexp_replace(_col(path), r"(?<!^)/+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"(?:(?<=/)|^)\./", ""), r"/\.?$", "")
    p = F.regexp_replace(p, r"/(?:\./)+", "/")
    return F.when(_col(path).rlike("^/+$"), "/").when(p.isin("", "."), ".").otherwise(p)


def dotted_prefixes(file_name: Column | str) -> Column:
    """Of a.b.c: a.b and a."""
    parts = F.split(_col(file_name), r"\.")
    each = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return F.when(F.size(parts) > 1, each).otherwise(F.array().cast("array<string>"))


def merged_sidecar(sidecar: Column | str, duplicate: Column | str, keeper: Column | str) -> Column:
    """Where a duplicate's sidecar goes when it joins the keeper: the keeper's name with the sidecar's ending."""
    n, dup, dup_stem = name(sidecar), name(duplicate), stem(duplicate)
    low = F.lower(n)
    new = (
        F.when(F.startswith(low, F.lower(dup)), F.concat(name(keeper), F.substr(n, F.length(dup) + 1)))
        .when(F.startswith(low, F.lower(dup_stem)), F.concat(stem(keeper), F.substr(n, F.length(dup_stem) + 1)))
        .otherwise(F.concat(stem(keeper), suffix(sidecar)))
    )
    return joined(parent(keeper), new)
