"""Benchmark decontamination through a stored positional inverted index.

``build_index`` stores, for every chunk of documents, the distinct words with
the ascending positions of each: a document-partitioned index, so that no
posting is ever shuffled. Positions of neighbouring documents lie so far apart
that no phrase reaches across. ``search`` takes the windows of the test items,
ordered by how rare their words are in the whole index, and intersects the
offset-adjusted positions from the rarest word on. With a slop, words may stand
that far from their places (proximity).

Test items are taken in blocks of bounded size, each against the whole index,
so that neither the driver nor an executor ever holds more than a block (and
the text of one item); long items are cut into several blocks.

Null and empty texts have no words; an item without words has no window.
Repeated rows, and rows with equal or null keys, are judged row by row. An
empty table of items finds nothing; an empty table of documents gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupeplan.llm.common import LETTERS, bound_batches, chunks, materialize, words_of

#: Words of test items that one pass over the index takes.
BLOCK_WORDS = 1_000_000
#: Text bytes of a chunk of documents, one row of the index.
CHUNK = 4 << 20
#: Empty positions between documents.
GAP = 64
INDEX = "task int, seq int, keys {kind}, at binary, terms binary, lengths binary, starts binary, positions binary"
FOUND = "task int, seq int, row int, {key} {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>, near array<string>"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the index; one row for each chunk of documents."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for seq, table in chunks(batches, text, CHUNK):
            words, ids, at = words_of(table.column(1), LETTERS)
            places = np.arange(len(ids)) + GAP * np.repeat(np.arange(len(at) - 1), np.diff(at))
            by = np.argsort(ids, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(words)))])
            lengths = pa.compute.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
            terms = b"".join(words.cast(pa.large_binary()).to_pylist())
            row = {"task": task, "seq": seq, "keys": table.column(0).to_pylist(), "at": at.tobytes(), "terms": terms, "lengths": lengths.tobytes(), "starts": starts.astype(np.int32).tobytes(), "positions": places[by].astype(np.int32).tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = INDEX.format(kind=f"array<{kind}>")
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return materialize(docs.select(key, text).mapInArrow(run, ddl), "postings")


def _terms(row: dict) -> pa.Array:
    lengths = np.frombuffer(row["lengths"], np.int32)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(row["terms"])])


class Block:
    """Windows of some test items: word numbers, and the items of each distinct window."""

    def __init__(self, size: int):
        self.size = size
        self.words: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[str]] = {}
        self.n = 0

    def add(self, item: str, words: list[bytes]) -> None:
        """Adds the windows of an item, or of a part of one."""
        ids = [self.words.setdefault(w, len(self.words)) for w in words]
        self.n += len(ids)
        for i in range(max(1, len(ids) - self.size + 1) if ids else 0):
            self.windows.setdefault(tuple(ids[i : i + self.size]), set()).add(item)


def blocks_of(items: DataFrame, key: str, text: str, size: int, most: int) -> Iterator[Block]:
    """Blocks of items with about ``most`` words each; rows come to the driver partition by partition.

    An item that is longer than the rest of a block goes on in the next one,
    from the first window that is not in a block yet.
    """
    block = Block(size)
    for item, body in items.select(F.coalesce(F.col(key).cast("string"), F.lit("")), text).toLocalIterator():
        words = (body or "").encode().translate(LETTERS).split()
        start = 0
        while start < max(1, len(words) - size + 1):
            part = words[start : start + max(size, most - block.n)]
            block.add(item, part)
            start += max(1, len(part) - size + 1)
            if block.n >= most:
                yield block
                block = Block(size)
    if block.n:
        yield block


class Postings:
    """Positions of a chunk's words by number of the block's words."""

    def __init__(self, row: dict, words: pa.Array):
        own = pa.compute.index_in(words, value_set=_terms(row))
        self.number = pa.compute.fill_null(own, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.frombuffer(row["starts"], np.int32)
        self.positions = np.frombuffer(row["positions"], np.int32)

    def of(self, word: int) -> np.ndarray:
        n = self.number[word]
        return self.positions[self.starts[n] : self.starts[n + 1]]

    def match(self, window: tuple[int, ...], rank: np.ndarray, slop: int) -> np.ndarray:
        """Starts of the window, from its rarest word: every other word stands within ``slop`` of its place."""
        order = sorted(range(len(window)), key=lambda i: (rank[window[i]], i))
        found = self.of(window[order[0]]).astype(np.int64) - order[0]
        for i in order[1:]:
            if not len(found):
                break
            own = self.of(window[i])
            at = np.searchsorted(own, found + (i - slop))
            near = at < len(own)
            near[near] = own[at[near]] <= found[near] + (i + slop)
            found = found[near]
        return found


def search(index: DataFrame, block: Block | None, key: str = "doc_id", slop: int = 4) -> DataFrame:
    """For every document: spans of words in occurring windows, items that occur, and items near (within the slop); None finds nothing."""
    kind = index.schema["keys"].dataType.elementType.simpleString()
    ddl = FOUND.format(key=f"`{key}`", kind=kind)
    words = list(block.words) if block else []
    sc = index.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(len(words), np.int64), pa.array(words, pa.large_binary())
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Postings(row | {"positions": b""}, own)
                sizes = np.append(np.diff(chunk.starts), 0)
                total += sizes[chunk.number]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    rank = np.zeros(len(words), np.int64)
    if words:
        for word, n in index.select("terms", "lengths", "starts").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
            rank[word] = n
    shared = sc.broadcast((words, sorted((w, sorted(items)) for w, items in block.windows.items()) if block else [], rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, rank = shared.value
        own = pa.array(words, pa.large_binary())
        longest = max((len(w) for w, _ in windows), default=1)
        grid = np.array([[*w, *[w[0]] * (longest - len(w))] for w, _ in windows], np.int64).reshape(len(windows), longest)
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["at"], np.int64)
                bases = at[:-1] + GAP * np.arange(len(at) - 1)
                chunk = Postings(row, own)
                live = np.flatnonzero((chunk.number[grid] >= 0).all(axis=1)) if len(windows) else []
                steps = np.zeros(int(at[-1]) + GAP * len(at) + 1, np.int32)
                exact, near = set(), set()
                for w in live:
                    window, items = windows[w]
                    loose = chunk.match(window, rank, slop)
                    if not len(loose):
                        continue
                    near.update((d, i) for d in np.unique(np.searchsorted(bases, loose + len(window) // 2, "right") - 1).tolist() for i in items)
                    found = chunk.match(window, rank, 0)
                    if len(found):
                        np.add.at(steps, found, 1)
                        np.add.at(steps, found + len(window), -1)
                        exact.update((d, i) for d in np.unique(np.searchsorted(bases, found, "right") - 1).tolist() for i in items)
                turns = np.flatnonzero(np.diff((np.cumsum(steps) > 0).astype(np.int8), prepend=0)).tolist()
                spans: dict[int, list] = {}
                for a, b in zip(turns[::2], turns[1::2]):
                    d = int(np.searchsorted(bases, a, "right")) - 1
                    spans.setdefault(d, []).append({"start": a - int(bases[d]), "end": b - int(bases[d])})
                held: dict[int, list[set]] = {}
                for place, pairs in enumerate((exact, near)):
                    for d, i in pairs:
                        held.setdefault(d, [set(), set()])[place].add(i)
                rows = [{"task": row["task"], "seq": row["seq"], "row": d, key: k, "n_words": int(at[d + 1] - at[d]), "spans": spans.get(d, []), "items": sorted(held.get(d, [(), ()])[0]), "near": sorted(held.get(d, [(), ()])[1])} for d, k in enumerate(row["keys"])]
                yield from pa.Table.from_pylist(rows, schema).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return index.mapInArrow(run, ddl)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 13, slop: int = 4, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: key, n_words, spans of hit words, n_hit, items, near."""
    index = build_index(docs.select(F.col(key).alias("_key"), text), "_key", text)
    parts = [search(index, block, "_key", slop) for block in blocks_of(items, item_key, item_text, size, block_words)] or [search(index, None, "_key", slop)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part.where("size(near) > 0"))
    if len(parts) > 1:
        merged = found.groupBy("task", "seq", "row").agg(
            F.first("_key").alias("_key"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
        )
        joined = "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) -> CASE WHEN size(a) > 0 AND get(a, size(a) - 1).end >= x.start THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', get(a, size(a) - 1).start, 'end', greatest(get(a, size(a) - 1).end, x.end)))) ELSE concat(a, array(x)) END)"
        found = merged.withColumn("spans", F.expr(joined))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(F.col("_key").alias(key), "n_words", "spans", hit.alias("n_hit"), "items", "near")


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least a twentieth of the words is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
