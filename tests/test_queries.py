"""The queries against their DuckDB SQL, and expressions over paths."""

from pathlib import PurePosixPath

import duckdb
import pytest
from pyspark.sql import functions as F

from dupeplan.functions import paths
from dupeplan.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "events", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([dict(zip(names, row, strict=True))[c] for c in columns]) for row in found.fetchall())


def test_paths_match_pathlib(spark):
    names = ["a.jpg", ".json", "a.", "a..jpg", ".a.jpg", "b", "x.tar.gz", "d/e.f/g.h", "/r/s.T"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select("path", paths.suffix("path"), paths.stem("path"), paths.name("path")).collect()
    for path, suffix, stem, name in rows:
        p = PurePosixPath(path)
        expected = ("", p.name) if path == "a." else (p.suffix, p.stem)
        assert (suffix, stem, name) == (*expected, p.name)


def test_normalized_paths(spark):
    names = ["/a//b/./c/", "a/./b", "./a", "", "/", "//a", "a/../b", "a/."]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select("path", paths.normalized("path").alias("n")).collect()
    assert all(n == str(PurePosixPath(p)) for p, n in rows), rows


def test_merged_names(spark):
    cases = [("bar.mp4", "foo.mp4"), ("bar.mov", "foo.mov"), ("bar.json", "foo.json"), ("bar.jpg.json", "foo.jpg.json"), ("other.xmp", "foo.xmp")]
    rows = spark.createDataFrame([(f"/two/{a}",) for a, _ in cases], "s string").select(paths.merged_sidecar("s", F.lit("/two/bar.jpg"), F.lit("/one/foo.jpg"))).collect()
    assert [r[0] for r in rows] == [f"/one/{b}" for _, b in cases]
