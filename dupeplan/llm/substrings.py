"""Removal of every byte that an earlier copy of a long string already holds.

A byte goes if some string of ``length`` bytes that covers it also starts
earlier: in a row with a smaller key, or earlier in the same row. The input's
strings decide, not what earlier removals leave.

Suffix arrays of shards decide. Every window of ``length`` bytes picks the least
hashed 32-byte string inside it, so equal windows pick equal strings wherever
they stand. Maximal runs of neighbouring windows with one pick are about a third
of a window long.

1. Picks are counted: a window whose pick stands in one run alone occurs once.
2. The bytes of all other runs go to the shard of their pick. Of runs that are
   equal as wholes the earliest stands for all. A shard sorts the suffixes of
   its runs by external induced sorting (``suffixes``); windows that follow each
   other there with a common prefix of ``length`` bytes are equal, and all but
   the earliest are copies.
3. Chunks of documents take out what the shards report.

Hashes choose candidates and shards only; what goes has been compared byte by
byte. A chunk sends one of its runs that are equal; the others are copies of
that one. A pick that stands in very many runs, as at the edges of a passage
that very many documents hold, would fill its shard: windows of such a pick are
dealt by the place of the pick in the window, in ranges that double from both
ends, and by all bytes that the windows of a range are sure to share. So a
passage costs a shard one entry for each chunk, and windows that reach beyond it
are spread by what they reach.

Nulls are empty texts. Keys are integers (others raise an error); null ones come
last, rows with equal keys in the order in which they are read. Texts may be of
any length. An empty table gives an empty result; other columns are ignored
unless they are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from dupeplan.llm.common import answered, bound_batches, buffers, chunks, fixed_splits, mixed, read_replies, scratch_path, shard_count, shards_of, squeezed, stamp, text_bytes, unsqueezed, write_replies
from dupeplan.llm.suffixes import Disk, descending

PICK = 32
BLOCK = 1 << 17
#: Text bytes of a chunk.
CHUNK = 4 << 20
#: Text bytes of the corpus for each shard that sorts suffixes; it receives about as many bytes of runs.
SORTED = 4 << 20
#: Runs of a pick beyond which its windows are dealt by the place of the pick.
HOT = 4096
#: Base of a polynomial hash modulo 2**64.
BASE = 0x9E3779B97F4A7C15
ONCE, SEVERAL, MANY = 0, 1, 2
PICKS = "shard int, task int, seq int, stamp long, keys binary, counts binary"
PICK_REPLY = "task int, seq int, shard int, stamp long, kinds binary"
RUNS = "shard int, task int, seq int, stamp long, bytes binary, sizes binary, starts binary, ids binary, deals binary, copies binary"
RUN_REPLY = "task int, seq int, shard int, stamp long, spans binary"


#: By size, what ``_powers`` has computed in this process.
_KNOWN: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, and a random number for each byte value."""
    if n in _KNOWN:
        return _KNOWN[n]
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]))
        table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    _KNOWN.clear()
    _KNOWN[n] = up, down, table
    return _KNOWN[n]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


class Scan:
    """Runs of a chunk of documents: first and last window start, pick, place of the pick, whether the pick repeats inside."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, length: int):
        self.offsets, self.data, self.length = offsets, data, length
        self.parts: list[tuple] = []
        total = len(data)
        for s in range(0, total - length + 1, BLOCK):
            self._block(s, min(s + BLOCK, total - length + 1))
        empty = np.zeros(0, np.int64)
        self.first, self.last, self.pick, self.place, self.repeats = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (empty, empty, empty.astype(np.uint64), empty, empty.astype(bool))
        self.doc = np.searchsorted(offsets, self.first, "right") - 1

    def _block(self, s: int, e: int) -> None:
        length, n = self.length, e - s
        up, down, table = _powers(BLOCK + length)
        with np.errstate(over="ignore"):
            m = n + length - 1
            sums = np.zeros(m + 1, np.uint64)
            np.cumsum(table[self.data[s : s + m]] * down[:m], out=sums[1:])
            grams = mixed((sums[PICK:] - sums[:-PICK]) * up[: len(sums) - PICK])
            width = length - PICK + 1
            least = _least(grams, width)
            ends = self.offsets[np.searchsorted(self.offsets, s, "right") : np.searchsorted(self.offsets, e + length, "left")]
            bad = np.zeros(n + 1, np.int32)
            np.add.at(bad, np.clip(ends - length + 1 - s, 0, n), 1)
            np.add.at(bad, np.clip(ends - s, 0, n), -1)
            valid = np.cumsum(bad[:n]) == 0
            cut = np.ones(n + 1, bool)
            cut[1:n] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
            edges = np.flatnonzero(cut)
            first, last = edges[:-1], edges[1:] - 1
            live = valid[first]
            first, last = first[live], last[live]
            if not len(first):
                return
            pick = least[first]
            around = np.arange(width)
            left = grams[first[:, None] + around] == pick[:, None]
            right = grams[last[:, None] + around] == pick[:, None]
            place = left.argmax(1) + first
            same = (place == right.argmax(1) + last) & (left.sum(1) == 1) & (right.sum(1) == 1)
            pick = mixed(pick)  # minima lie low; shards split the whole range
        self.parts.append((first + s, last + s, pick, place + s, ~same))


def ranges(length: int) -> list[tuple[int, int]]:
    """Parts of the places that a pick can have in a window; they double from both ends."""
    most = length - PICK
    cuts = {0, most + 1, most // 2}
    step = 1
    while step < most // 2:
        cuts |= {step, most + 1 - step}
        step *= 2
    found = sorted(cuts)
    return list(zip(found, found[1:]))


def firsts_of(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which strings are the first of their bytes, and which are copies of one before; a hash finds them, the bytes decide."""
    digest, seen, first, copy = xxhash.xxh3_128_digest, {}, [], []
    starts, ends = starts.tolist(), ends.tolist()
    for i, (a, b) in enumerate(zip(starts, ends)):
        own = raw[a:b]
        held = seen.setdefault(digest(own), i)
        (copy if held != i and raw[starts[held] : ends[held]] == own else first).append(i)
    return np.array(first, np.int64), np.array(copy, np.int64)


class Chunk:
    """A chunk's scan, the order of its rows, and what it asks."""

    def __init__(self, table: pa.Table, length: int):
        self.offsets, self.data = buffers(table.column(1))
        self.length, self.scan = length, Scan(self.offsets, self.data, length)
        self.raw = self.data.tobytes()
        keys = table.column(0).combine_chunks()
        self.ids = np.where(keys.is_valid().to_numpy(zero_copy_only=False), pa.compute.fill_null(keys, 0).to_numpy(zero_copy_only=False), np.iinfo(np.int64).max).astype(np.int64)
        rank = np.empty(len(self.ids), np.int64)
        rank[np.argsort(self.ids, kind="stable")] = np.arange(len(self.ids))
        s = self.scan
        order = np.argsort((rank[s.doc] << np.int64(40)) + s.first - self.offsets[s.doc], kind="stable")
        for name in ("first", "last", "pick", "place", "repeats", "doc"):
            setattr(s, name, getattr(s, name)[order])
        self.distinct, self.copy = firsts_of(self.raw, s.first, s.last + length)

    def picks(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ascending picks, in how many distinct runs each stands (two if it repeats in one), the shard of each, and the pick's number of every distinct run."""
        s = self.scan
        keys, group = np.unique(s.pick[self.distinct], return_inverse=True)
        counts = np.bincount(group, minlength=len(keys))
        counts[group[s.repeats[self.distinct]]] += 1
        return keys, counts, shards_of(keys, shards), group

    def candidates(self, kinds: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(first and last window start, hash that deals them, row, whether the pick repeats inside) of the strings to sort, in the order of rows, and the copies (first and last window start) found here."""
        s, of = self.scan, kinds[group]
        plain = self.distinct[of == SEVERAL]
        first, last, deal, inner = [s.first[plain]], [s.last[plain]], [s.pick[plain]], [s.repeats[plain]]
        doc, copies = [s.doc[plain]], [(s.first[self.copy], s.last[self.copy])]
        hot = self.distinct[of == MANY]
        if len(hot):
            a, b, key, row = self._dealt(hot)
            new, again = firsts_of(self.raw, a, b + self.length)
            copies.append((a[again], b[again]))
            first, last, deal, doc, inner = [*first, a[new]], [*last, b[new]], [*deal, key[new]], [*doc, row[new]], [*inner, np.ones(len(new), bool)]
        first, last, deal, doc, inner = (np.concatenate(x) for x in (first, last, deal, doc, inner))
        by = np.lexsort((first, doc, self.ids[doc]))
        return first[by], last[by], deal[by], doc[by], inner[by], tuple(np.concatenate(x) for x in zip(*copies))

    def _dealt(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parts of runs whose windows have their pick in one range of places: first and last start, a hash of the bytes that all windows of the range share, row."""
        s, out = self.scan, []
        whole = ranges(self.length)
        starts = np.array([a for a, _ in whole])
        for r in runs.tolist():
            a, b, place = int(s.first[r]), int(s.last[r]), int(s.place[r])
            at = np.arange(a, b + 1)
            if s.repeats[r]:  # the leftmost place of the pick in each window
                own, i, held = self.raw[place : place + PICK], place, []
                while i != -1 and i <= b + self.length - PICK:
                    held.append(i)
                    i = self.raw.find(own, i + 1, b + self.length)
                held = np.array(held)
                where = held[np.searchsorted(held, at)]
            else:
                where = np.full(len(at), place)
            part = np.searchsorted(starts, where - at, "right") - 1
            turns = np.flatnonzero(np.diff(part, prepend=-1) | np.diff(where, prepend=-1))
            for x, y in zip(turns.tolist(), [*turns[1:].tolist(), len(at)]):
                lo, hi = whole[part[x]]
                p = int(where[x])
                shared = self.raw[p - lo : p - (hi - 1) + self.length]
                out.append((a + x, a + y - 1, xxhash.xxh3_64_intdigest(shared, int(part[x])), int(s.doc[r])))
        first, last, key, row = zip(*out)
        return np.array(first), np.array(last), np.array(key, np.uint64), np.array(row)


def _edges(values: np.ndarray) -> list[int]:
    return [*np.flatnonzero(np.diff(values, prepend=-1)).tolist(), len(values)] if len(values) else []


def _counted(table: pa.Table) -> pa.Table:
    """One shard: whether a pick stands in one run, in several or in very many."""
    keys = [unsqueezed(x) for x in table.column("keys").to_pylist()]
    sizes = [len(x) for x in keys]
    keys = np.concatenate(keys)
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    by = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[by][1:] != keys[by][:-1]]))
    total = np.add.reduceat(counts[by], starts)
    kind = np.where(total > HOT, MANY, np.where(total > 1, SEVERAL, ONCE)).astype(np.uint8)
    out = np.empty(len(keys), np.uint8)
    out[by] = np.repeat(kind, np.diff(np.append(starts, len(keys))))
    reply = table.select(["task", "seq", "shard", "stamp"])
    return reply.append_column("kinds", pa.array([x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])], pa.binary()))


def copied_windows(text: np.ndarray, length: int, disk: Disk) -> np.ndarray:
    """Marks of the places of a text at which a string of ``length`` symbols stands that also stands at a smaller place; see ``suffixes.descending``."""
    again = np.zeros(len(text), bool)
    least = before = -1  # of the group that the last block ended in
    for places, shared in descending(text, length, disk):
        joined = shared >= length
        if not joined.any():
            if least >= 0:
                again[least] = False
            least = before = int(places[-1])
            continue
        again[places[joined]] = True
        ahead = np.flatnonzero(joined) - 1
        again[places[ahead[ahead >= 0]]] = True
        if joined[0]:
            again[before] = True
        heads = np.flatnonzero(~joined)
        if len(heads) and heads[0] == 0 or not joined[0]:
            if least >= 0:
                again[least] = False
            least = -1
        edges = heads if not joined[0] else np.concatenate([[0], heads])
        mins = np.minimum.reduceat(places, edges)
        if joined[0]:
            mins[0] = min(least, int(mins[0]))
        again[mins[:-1]] = False
        least, before = int(mins[-1]), int(places[-1])
    if least >= 0:
        again[least] = False
    return again


def _sorted(table: pa.Table, length: int, folder: str) -> pa.Table:
    """One shard: for every chunk, the windows of its runs that stand earlier too, as pairs of first and last start, after the copies that it found itself."""
    table = table.sort_by([("task", "ascending"), ("seq", "ascending")])
    columns = {c: table.column(c).to_pylist() for c in ("bytes", "sizes", "starts", "ids", "deals", "copies")}
    sizes = np.concatenate([np.frombuffer(x, np.int32) for x in columns["sizes"]]).astype(np.int64)
    starts = np.concatenate([np.frombuffer(x, np.int32) for x in columns["starts"]]).astype(np.int64)
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in columns["ids"]])
    deals = np.concatenate([np.frombuffer(x, np.uint64) for x in columns["deals"]])
    inner, sizes = sizes < 0, abs(sizes)
    row = np.repeat(np.arange(table.num_rows), [len(x) // 4 for x in columns["sizes"]])
    spans = [[np.frombuffer(x, np.int32)] for x in columns["copies"]]
    if len(sizes):
        raw = b"".join(columns["bytes"])
        by = np.argsort(ids, kind="stable")  # of equal ids, in the order of reading
        taken = (np.cumsum(sizes) - sizes)[by]
        sizes, starts, row = sizes[by], starts[by], row[by]
        first, copy = firsts_of(raw, taken, taken + sizes)
        for i in copy.tolist():
            spans[int(row[i])].append(np.array([starts[i], starts[i] + sizes[i] - length], np.int32))
        # A run whose pick stands in no other one, and but once in it, has no equal windows.
        _, same, runs = np.unique(deals[by][first], return_inverse=True, return_counts=True)
        first = first[(runs[same] > 1) | inner[by][first]]
        taken, sizes, starts, row = taken[first], sizes[first], starts[first], row[first]
    if len(sizes):
        data = np.frombuffer(raw, np.uint8)
        kind = np.uint8 if data.max() < 254 else np.uint16  # bytes of UTF-8 leave room for a separator and an end
        at = np.cumsum(sizes + 1) - sizes - 1  # a separator follows each string
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text = np.ones(int(at[-1] + sizes[-1]) + 2, kind)
        text[np.repeat(at, sizes) + inside] = data[np.repeat(taken, sizes) + inside].astype(kind) + kind(2)
        text[-1] = 0
        del raw, data, inside
        disk = Disk(folder)
        again = copied_windows(text, length, disk)
        disk.clear()
        reach = np.zeros(len(text) + 1, np.int32)
        reach[at] += 1
        reach[at + sizes - length + 1] -= 1
        again &= np.cumsum(reach[:-1]) > 0
        turns = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
        first, last = turns[::2], turns[1::2] - 1
        own = np.searchsorted(at, first, "right") - 1
        pairs = np.stack([first - at[own] + starts[own], last - at[own] + starts[own]], axis=1).astype(np.int32)
        to = row[own]
        order = np.argsort(to, kind="stable")
        pairs, to = pairs[order], to[order]
        for a, b in zip(_edges(to), _edges(to)[1:]):
            spans[int(to[a])].append(pairs[a:b].ravel())
    reply = table.select(["task", "seq", "shard", "stamp"])
    return reply.append_column("spans", pa.array([np.concatenate(x).tobytes() for x in spans], pa.binary()))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, keep: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, n_bytes, n_removed, spans (start and end of each removed run of bytes), kept_sha256, and the columns to ``carry``.

    With ``keep`` there is also kept, the remaining text, without the bytes of
    characters that a removal has cut in two.

    ``docs`` must be a stored table, read the same way each time; a pass that
    meets other rows than the one before it fails.
    """
    if not 2 * PICK <= length < 256:
        raise ValueError(f"length must be at least {2 * PICK} and below 256")
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"keys must be integers: {key}")
    spark = docs.sparkSession
    bound_batches(spark)
    fixed_splits(spark)
    plain = docs.select(key, text)
    total = text_bytes(docs, text)
    shards, sorters = shard_count(spark, total), max(shard_count(spark, total), -(-total // SORTED))
    folder = scratch_path(spark, "queues")

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for seq, table in chunks(batches, text, CHUNK):
            mark = stamp(table, key, text)
            keys, counts, shard, _ = Chunk(table, length).picks(shards)
            rows = [{"shard": int(shard[a]), "task": task, "seq": seq, "stamp": mark, "keys": squeezed(keys[a:b]), "counts": counts[a:b].astype(np.int32).tobytes()} for a, b in zip(_edges(shard), _edges(shard)[1:])]
            yield from pa.Table.from_pylist(rows, pick_schema).to_batches()

    def sends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        replies = read_replies(counted, task, ["stamp", "kinds"])
        for seq, table in chunks(batches, text, CHUNK):
            chunk, mark = Chunk(table, length), stamp(table, key, text)
            keys, _, _, group = chunk.picks(shards)
            kinds = np.frombuffer(b"".join(r["kinds"] for r in replies.of(seq, mark)), np.uint8)
            if len(kinds) != len(keys):
                raise RuntimeError("a chunk of documents has changed between two passes; read the documents from a stored table")
            first, last, deal, doc, inner, (a, b) = chunk.candidates(kinds, group)
            shard = shards_of(mixed(deal), sorters)
            by = np.argsort(shard, kind="stable")
            first, last, deal, doc, inner, shard = first[by], last[by], deal[by], doc[by], inner[by], shard[by]
            raw, ids, sizes = chunk.raw, chunk.ids[doc], last - first + length
            signed = np.where(inner, -sizes, sizes).astype(np.int32)  # negative where windows of one run may be equal
            cuts = list(zip(_edges(shard), _edges(shard)[1:]))
            rows = [{"shard": int(shard[x]), "task": task, "seq": seq, "stamp": mark, "bytes": b"".join([raw[p:q] for p, q in zip(first[x:y].tolist(), (first + sizes)[x:y].tolist())]), "sizes": signed[x:y].tobytes(), "starts": first[x:y].astype(np.int32).tobytes(), "ids": ids[x:y].tobytes(), "deals": deal[x:y].tobytes(), "copies": b""} for x, y in cuts]
            rows = rows or [{"shard": seq % sorters, "task": task, "seq": seq, "stamp": mark, "bytes": b"", "sizes": b"", "starts": b"", "ids": b"", "deals": b"", "copies": b""}]
            rows[0]["copies"] = np.stack([a, b], axis=1).astype(np.int32).tobytes()
            yield from pa.Table.from_pylist(rows, run_schema).to_batches()

    def removes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        replies = read_replies(found, task, ["stamp", "spans"])
        for seq, table in chunks(batches, text, CHUNK):
            offsets, data = buffers(table.column(1))
            own = replies.of(seq, stamp(table, key, text))
            if not own:
                raise RuntimeError("a chunk of documents has changed between two passes; read the documents from a stored table")
            spans = np.frombuffer(b"".join(r["spans"] for r in own), np.int32).reshape(-1, 2)
            steps = np.zeros(len(data) + 1, np.int32)
            np.add.at(steps, spans[:, 0], 1)
            np.add.at(steps, spans[:, 1] + length, -1)
            yield from _results(table, offsets, data, np.cumsum(steps[:-1]) > 0)

    def _results(table: pa.Table, offsets: np.ndarray, data: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes, at = np.diff(offsets), offsets.tolist()
        removed, spans, digests, left = [], [], [], []
        for a, b in zip(at, at[1:]):
            mask = gone[a:b]
            n = int(mask.sum())
            rest = data[a:b] if not n else data[a:b][~mask]
            turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist() if n else []
            removed.append(n)
            spans.append([{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2])])
            digests.append(hashlib.sha256(rest.tobytes()).hexdigest())
            left.append(rest.tobytes().decode("utf-8", "ignore") if keep else None)
        arrays = [table.column(0).combine_chunks(), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span_type), pa.array(digests)]
        names = [key, "n_bytes", "n_removed", "spans", "kept_sha256"]
        if keep:
            arrays, names = [*arrays, pa.array(left)], [*names, "kept"]
        arrays, names = [*arrays, *[table.column(c).combine_chunks() for c in carry]], [*names, *carry]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    pick_schema = pa.schema([("shard", pa.int32()), ("task", pa.int32()), ("seq", pa.int32()), ("stamp", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    run_schema = pa.schema([("shard", pa.int32()), ("task", pa.int32()), ("seq", pa.int32()), ("stamp", pa.int64()), *[(c, pa.binary()) for c in ("bytes", "sizes", "starts", "ids", "deals", "copies")]])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    counted = write_replies(answered(plain.mapInArrow(asks, PICKS), F.col("shard"), shards, _counted, PICK_REPLY), "picks", total // 16)
    found = write_replies(answered(plain.mapInArrow(sends, RUNS), F.col("shard"), sorters, lambda table: _sorted(table, length, folder), RUN_REPLY), "spans", total // 16)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept string" * keep
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(key, text, *carry).mapInArrow(removes, schema)
