"""Shared pieces: scratch tables, text chunks and routed look-ups."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one chunk of documents holds; one longer document is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Rows that one chunk holds, however short their texts.
CHUNK_ROWS = 1 << 16
#: Bytes of an Arrow batch on its way to Python: long texts must not pile up by the thousand.
BATCH_BYTES = 4 << 20
#: Bytes of a row group of stored replies.
BLOCK_BYTES = 8 << 20
#: Bytes of requests that one shard of a routed look-up should hold.
SHARD_BYTES = 16 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names, else one inside the warehouse (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared scratch folder; it goes when the driver exits."""
    path = f"{scratch_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark, "_jvm", None)
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended: its owner clears the folder
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's size of Arrow batches, if it is larger, to ``BATCH_BYTES``."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def fixed_splits(spark: SparkSession) -> None:
    """Pins the number from which Spark derives the splits of a scan, so that passes before and after executors come or go meet the same ones."""
    name = "spark.sql.leafNodeDefaultParallelism"
    if not spark.conf.get(name, None):
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def hashed_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hashed keys.

    Of a large table only those rows are sorted whose hash lies below a bound
    that leaves about four times as many, so that what tasks send on does not
    grow with their number.
    """
    count, hashed = df.count(), F.xxhash64(key, F.lit(11))
    if count > 16 * n:
        df = df.where(F.pmod(hashed, F.lit(1 << 30)) < -(-(1 << 32) * n // count))
    return df.orderBy(hashed, key).limit(n)


def hot_joined(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined to ``table`` on the key; ``table`` has each key once, with the number of its rows in ``count``; ``total`` is at least that of all rows.

    Keys of more than a 50,000th of all rows (and of 256 rows) are fewer than
    50,000: their part of the table is broadcast, so that their rows stay where
    they are. The others are shuffled; none of them is a large share of a task.
    """
    bound = max(256, -(-total // 50_000))
    hot, cold = F.broadcast(table.where(F.col(count) > bound)), table.where(F.col(count) <= bound)
    stay = rows.join(hot, key)
    return stay.unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def shard_count(spark: SparkSession, request_bytes: int) -> int:
    """Shards of a routed look-up; their number follows the input, so that each stays of one size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-request_bytes // SHARD_BYTES), 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, nulls as empty texts."""
    column = pa.compute.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, most: int = CHUNK_ROWS) -> Iterator[tuple[int, pa.Table]]:
    """Numbered runs of at most ``most`` rows with at most ``limit`` text bytes (or one row). The same input gives the same chunks."""
    held: list[pa.RecordBatch] = []
    size, rows, number = 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(buffers(batch.column(text))[0]))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = min(int(np.searchsorted(ends, base + limit - size, "right")), start + most - rows)
            if stop <= start and not held:
                stop = start + 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size, rows = size + int(ends[stop - 1]) - base, rows + stop - start
                base, start = int(ends[stop - 1]), stop
            if start < batch.num_rows:
                yield number, pa.Table.from_batches(held)
                held, size, rows, number = [], 0, 0, number + 1
                give_back()
    if held:
        yield number, pa.Table.from_batches(held)
    held = []
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: executors share what a worker would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def stamp(table: pa.Table, key: str, text: str = "text") -> int:
    """A checksum of a chunk's rows; a later pass that meets other rows must not use its look-ups."""
    offsets, _ = buffers(table.column(text))
    ids = pa.compute.fill_null(table.column(key).cast(pa.string()), "")
    return zlib.crc32("\n".join(ids.to_pylist()).encode(), zlib.crc32(offsets.tobytes()))


def file_system(uri: str):
    """(file system, path) for Python code on an executor."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


def answered(requests: DataFrame, group: Column, groups: int, answer: Callable[[pa.Table], pa.Table], reply: str) -> DataFrame:
    """``answer`` applied to every group of requests; ``group``, below ``groups``, is the number of a request's partition, so no two groups share a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from answer(pa.Table.from_batches(held)).to_batches()
            give_back()

    return requests.repartitionById(groups, group.cast("int")).mapInArrow(run, reply)


def write_replies(replies: DataFrame, tag: str, size: int) -> str:
    """Stores look-up results for ``read_replies``, about one file for each ``SHARD_BYTES`` of ``size`` (what they are expected to hold); those to a task lie in one file, sorted."""
    spark = replies.sparkSession
    parts = max(1, -(-size // SHARD_BYTES))
    path = scratch_path(spark, f"{tag}-{parts}")
    dealt = replies.repartitionById(parts, F.pmod("task", F.lit(parts)).cast("int")).sortWithinPartitions("task", "seq", "shard")
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # what was shuffled goes once the table is whole
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        dealt.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return path


def read_replies(path: str, task: int, columns: list[str]) -> Replies:
    """The replies to a task, for chunks in ascending order; only a row group is held."""
    from pyarrow import fs

    system, place = file_system(path)
    own = f"part-{task % int(path.rsplit('/', 1)[1].split('-')[1]):05d}-"  # the number of the partition that wrote it
    found = [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.base_name.startswith(own)]
    return Replies(row for p in sorted(found) for row in _replies_in(system, p, task, columns))


def _replies_in(system, path: str, task: int, columns: list[str]) -> Iterator[dict]:
    """A task's rows of a file that is sorted by tasks, chunks and shards."""
    import pyarrow.parquet as pq

    with system.open_input_file(path) as raw:
        file = pq.ParquetFile(raw)
        at = file.schema_arrow.get_field_index("task")
        for group in range(file.num_row_groups):
            held = file.metadata.row_group(group).column(at).statistics
            if held is not None and held.has_min_max and not held.min <= task <= held.max:
                continue
            for batch in file.iter_batches(64, row_groups=[group], columns=["task", "seq", "shard", *columns]):
                yield from batch.filter(pa.compute.equal(batch.column("task"), task)).to_pylist()


class Replies:
    """The replies to a task, read as its chunks come up."""

    def __init__(self, rows: Iterator[dict]):
        self.rows = rows
        self.next = next(rows, None)

    def of(self, seq: int, mark: int) -> list[dict]:
        """The replies to a chunk; they must have been made for these rows."""
        own = []
        while self.next is not None and self.next["seq"] <= seq:
            if self.next["seq"] == seq:
                own.append(self.next)
            self.next = next(self.rows, None)
        if any(r["stamp"] != mark for r in own):
            raise RuntimeError("a chunk of documents has changed between two passes; read the documents from a stored table")
        return own


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Byte tables: A-Z lower-cased; and besides, with ASCII bytes other than letters and digits made spaces.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTERS = bytes(LOWERED[b] if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(column: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word numbers of all texts in a row, where each text's words begin): texts cut at ASCII white space."""
    offsets, data = buffers(column)
    return words_in(offsets, data.tobytes().translate(table))


def words_in(offsets: np.ndarray, data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As ``words_of``, for texts that lie between offsets of UTF-8 bytes."""
    pc = pa.compute
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(texts)
    found = lists.flatten()
    full = pc.greater(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    if not full.all():
        found = found.filter(pa.array(full))
    coded = found.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at.astype(np.int64)


def worker_state(name: str, make: Callable[[], object]) -> object:
    """Something that a Python worker keeps from task to task."""
    held = sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hashed key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def squeezed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, all first bytes together, then all second ones: the high bytes are zeros that shuffles compress away."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unsqueezed(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)
