"""Directory trees as tables, and digests of files."""

from __future__ import annotations

import contextlib
import itertools
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupeplan.sources.scratch import stored

CHUNK = 1 << 20
TREE = "dir string, name string, path string, is_file boolean, is_dir boolean, is_link boolean, size_bytes long"


def tree(spark: SparkSession, root: str) -> DataFrame:
    """All entries below a root, hidden ones too; linked directories are listed but not entered.

    One step for each level of directories, each listed where a task runs and
    stored: neither the driver nor a task ever holds more than one directory.
    The root must be mounted on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for relative, folder in zip(*(c.to_pylist() for c in batch.columns)):
                with contextlib.suppress(NotADirectoryError), os.scandir(folder) as entries:
                    while part := list(itertools.islice(entries, 10_000)):
                        rows = []
                        for e in part:
                            is_file = e.is_file()
                            rows.append((relative, e.name, e.path, is_file, e.is_dir(), e.is_symlink(), e.stat().st_size if is_file else 0))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = [x.split()[0] for x in TREE.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64()]
    start = [(".", root)] if os.path.isdir(root) else []
    level, parts = spark.createDataFrame(start, "dir string, folder string"), None
    while True:
        found = stored(level.mapInArrow(run, TREE), "tree")
        parts = found if parts is None else parts.unionByName(found)
        below = F.when(F.col("dir") == ".", F.col("name")).otherwise(F.concat("dir", F.lit("/"), "name"))
        level = found.where("is_dir AND NOT is_link").select(below.alias("dir"), F.col("path").alias("folder"))
        count = level.count()
        if not count:
            return parts
        level = level.repartition(min(count, 16 * spark.sparkContext.defaultParallelism))


def regular_files(spark: SparkSession, root: str) -> DataFrame:
    """(dir, name, path, size_bytes) of regular files that are not links."""
    return tree(spark, root).where("is_file AND NOT is_link").select("dir", "name", "path", "size_bytes")


def directories(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """(dir) of directories down to a depth below the root, without links; the root itself is not among them."""
    relative = F.when(F.col("dir") == ".", F.col("name")).otherwise(F.concat("dir", F.lit("/"), "name"))
    return tree(spark, root).where("is_dir AND NOT is_link").select(relative.alias("dir")).where(F.size(F.split("dir", "/")) <= depth)


def file_digest(path: str) -> tuple[str | None, str | None]:
    state = xxhash.xxh3_128()
    try:
        with open(path, "rb", buffering=0) as f:
            while part := f.read(CHUNK):
                state.update(part)
    except OSError as error:
        return None, str(error)
    return state.hexdigest(), None


def with_digests(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds digest, the XXH3-128 of a file in hex, and digest_error; files are read in pieces where the task runs."""
    names = files.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", digest string, digest_error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, None) if p is None else file_digest(p) for p in batch.column(names.index(path)).to_pylist()]
            columns = [*batch.columns, pa.array([d for d, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "digest", "digest_error"])

    return files.mapInArrow(run, schema)


def content_digests(contents: DataFrame) -> DataFrame:
    """(path, size_bytes, digest) of (path, content) with contents in the table; the XXH3-128 in hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            sizes = pa.array([None if v is None else len(v) for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([None if v is None else xxhash.xxh3_128_hexdigest(v) for v in values], pa.string())], names=["path", "size_bytes", "digest"])

    return contents.select("path", "content").mapInArrow(run, "path string, size_bytes long, digest string")


def snapshot(spark: SparkSession, paths: DataFrame, with_digest: bool = True) -> DataFrame:
    """(path, is_file, size_bytes, digest) of those of the paths (column path) that exist; digests of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                if p and os.path.exists(p):
                    is_file = os.path.isfile(p)
                    rows.append({"path": p, "is_file": is_file, "size_bytes": os.stat(p).st_size, "digest": file_digest(p)[0] if is_file and with_digest else None})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("path", pa.string()), ("is_file", pa.bool_()), ("size_bytes", pa.int64()), ("digest", pa.string())])
    return paths.select("path").distinct().mapInArrow(run, "path string, is_file boolean, size_bytes long, digest string")


def write_files(contents: DataFrame) -> int:
    """Writes (path, content) as files where tasks run, each renamed into place when whole; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                made = f"{path}.{uuid.uuid4().hex}"
                with open(made, "wb") as f:
                    f.write(content)
                os.replace(made, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return contents.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def equal_files(pairs: DataFrame) -> DataFrame:
    """Adds equal to pairs (left, right): sizes first, then bytes piece by piece until they differ."""
    names = pairs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", equal boolean"

    def same(a: str, b: str) -> bool:
        if os.stat(a).st_size != os.stat(b).st_size:
            return False
        with open(a, "rb", buffering=0) as x, open(b, "rb", buffering=0) as y:
            while True:
                p, q = x.read(CHUNK), y.read(CHUNK)
                if p != q:
                    return False
                if not p:
                    return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [same(a, b) for a, b in zip(batch.column(names.index("left")).to_pylist(), batch.column(names.index("right")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], names=[*names, "equal"])

    return pairs.mapInArrow(run, schema)
