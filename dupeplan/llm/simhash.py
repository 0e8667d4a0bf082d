"""SimHash near-duplicates found by covering locality-sensitive hashing.

Every bit position of the fingerprint carries a non-zero vector of
``radius + 1`` bits. The mask of table ``v`` keeps the positions whose vector
has an odd product with ``v``. Two fingerprints that differ in at most
``radius`` positions span fewer than ``radius + 1`` dimensions, so some
non-zero ``v`` is orthogonal to all of them and the pair shares the bucket of
that table: no pair within the radius is missed.

Nulls and texts without a word have fingerprint zero and link like any other.
Repeated rows keep their rows. An empty table gives an empty result. Other
columns of the input are ignored. Rows whose id is null take part; a component
of such rows alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupeplan.llm.common import bound_batches, buffers, hot_joined, materialize
from dupeplan.llm.components import connected_components

#: Distinct fingerprints of a bucket that one task compares; larger buckets go by midpoints.
BUCKET = 16_384


def fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    """Majority bits of the shingles' hashes; 0 without words."""
    n = len(words)
    if not n:
        return 0
    k = min(shingle, n)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    m, digest = n - k + 1, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, m)
    counts = np.zeros(64, np.int64)
    for i in range(0, m, 8192):
        part = hashes[i : i + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int((np.packbits(2 * counts > m, bitorder="little").view("<u8"))[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp): the 64-bit fingerprint, as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            low = data.tobytes().lower()
            at = offsets.tolist()
            found = np.fromiter((fingerprint(low[a:b].split(), shingle, seed) for a, b in zip(at, at[1:])), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector; signed, for Spark's longs."""
    dims = radius + 1
    vectors = [i % ((1 << dims) - 1) + 1 for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, 1 << dims)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _spanning(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the smallest of its component within one bucket."""
    left, fro, to = np.sort(fps), [], []  # signed, as the smallest is
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= radius  # of a signed number it counts the absolute value
            if near.any():
                queue.extend(left[near])
                fro.append(left[near])
                to.append(np.full(int(near.sum()), root))
                left = left[~near]
    return (np.concatenate(fro), np.concatenate(to)) if fro else (np.zeros(0, fps.dtype), np.zeros(0, fps.dtype))


def near_links(distinct: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp, distinct) linked by chains within the radius."""
    masks = covering_masks(radius)
    tables = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("v", "key"))
    sizes = tables.groupBy("v", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = materialize(sizes, "buckets")
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    members = tables.join(sizes.where("n > 2").select("v", "key", "n"), ["v", "key"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fps in batch.column(0):
                fro, to = _spanning(np.array(fps.values.to_numpy(zero_copy_only=False), np.int64), radius)
                if len(fro):
                    yield pa.RecordBatch.from_arrays([pa.array(fro), pa.array(to)], names=["a", "b"])

    small = members.where(F.col("n") <= bucket).groupBy("v", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    edges = pairs.unionByName(small.mapInArrow(within, "a long, b long"))
    if sizes.where(F.col("n") > bucket).isEmpty():
        return edges

    # Members of a larger bucket link if and only if they share a midpoint that one of them is within radius // 2 of and the other within the rest of the radius.
    # Such an inner member is within the radius of all members of the midpoint; without one, the midpoint links none.
    half, unsigned = radius // 2, [m & ((1 << 64) - 1) for m in masks]

    def midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for table in np.unique(v):
                flips = [0]
                free = [1 << i for i in range(64) if not unsigned[table] >> i & 1]
                for _ in range(half + radius % 2):
                    flips = sorted({x ^ y for x in flips for y in [0, *free]})
                own = fp[v == table]
                for flip in np.array(flips, np.uint64).view(np.int64):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), table, np.int32)), pa.array(own ^ flip), pa.array(own)], names=["v", "mid", "fp"])

    spread = members.where(F.col("n") > bucket).select("v", "key", "fp").mapInArrow(midpoints, "v int, mid long, fp long")
    inner = F.bit_count(F.col("fp").bitwiseXOR(F.col("mid"))) <= half
    least = spread.groupBy("v", "mid").agg(F.min(F.when(inner, F.col("fp"))).alias("b"))
    return edges.unionByName(spread.join(least, ["v", "mid"]).where("fp != b").select(F.col("fp").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(key, fp, component_id) for every row; component_id is the smallest key among the rows reachable by links."""
    bound_batches(docs.sparkSession)
    prints = materialize(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n_rows")), "distinct")
    n_rows, n_prints = prints.count(), distinct.count()
    roots = materialize(connected_components(near_links(distinct.select("fp"), radius)), "roots").withColumnRenamed("node", "fp")
    linked = materialize(distinct.join(roots, "fp"), "linked")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_prints"))
    named = hot_joined(linked.select("fp", "root"), smallest, "root", "n_prints", n_prints).select("fp", "component_id")
    labels = materialize(distinct.join(named, "fp", "left").select("fp", "n_rows", F.coalesce("component_id", "least").alias("component_id")), "labels")
    return hot_joined(prints, labels, "fp", "n_rows", n_rows).select(key, "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    """Sixteen lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
