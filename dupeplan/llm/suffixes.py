"""Suffix order with common prefixes by external induced sorting.

A suffix is of type L if it is larger than the one after it and of type S if it
is smaller; an S suffix after an L suffix is a star. The pieces between stars
are sorted and named, and the string of names, at most half as long, is sorted
by recursion: its order is that of the stars. From the stars all L suffixes are
induced in ascending order, and from these all S suffixes in descending order.

Induction goes through queues, one for each first symbol: a suffix that is
taken from a queue puts the one before it into the queue of its own symbol.
Queues are taken block by block, so that the work on a block is done by array
operations. On the top level tuples carry their common prefix with the tuple
before them (up to ``width`` symbols); an induced one follows as one more than
the least on the way between the two that induce it. On the levels below, whose
symbols are many, neighbouring queues are taken together, and suffixes that
induce each other inside such a group are ordered by doubling along their
chains.

Queues, and the L suffixes between the two passes, lie on disk beyond ``held``
tuples. In memory are the text itself, the types and the names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: Tuples that are taken from a queue at once, and that a group of small queues holds.
BLOCK = 1 << 17
#: Tuples that all queues together may hold in memory.
HELD = 8 << 20
#: Length below which a string is sorted by doubling at once.
SMALL = 1 << 11


class Disk:
    """Counts the tuples that queues hold and takes them to files in a folder of its own below ``folder`` when they are too many."""

    def __init__(self, folder: str | None = None, held: int = HELD):
        self.folder = folder and f"{folder}/{uuid.uuid4().hex}"
        self.most, self.held, self.spilled = held, 0, 0
        self.queues: list[Queue] = []

    def room(self) -> None:
        if self.folder is None or self.held <= self.most:
            return
        for queue in sorted(self.queues, key=lambda q: -q.waiting):
            queue.spill()
            if self.held <= self.most // 2:
                break

    def write(self, data: bytes) -> str:
        from dupeplan.llm.common import file_system

        system, place = file_system(self.folder)
        system.create_dir(place, recursive=True)
        path = f"{place}/{uuid.uuid4().hex}"
        with system.open_output_stream(path, compression=None) as f:
            f.write(data)
        self.spilled += len(data)
        return path

    def read(self, path: str, start: int, size: int) -> bytes:
        from dupeplan.llm.common import file_system

        with file_system(self.folder)[0].open_input_file(path) as f:
            return f.read_at(size, start)

    def clear(self) -> None:
        if self.spilled:
            from dupeplan.llm.common import file_system

            system, place = file_system(self.folder)
            system.delete_dir(place)


class Queue:
    """Tuples (position, common prefix) in their order, as parts in memory or on disk."""

    def __init__(self, disk: Disk):
        self.disk, self.parts, self.waiting = disk, [], 0
        disk.queues.append(self)

    def put(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        if len(positions):
            self.parts.append((positions, prefixes))
            self.waiting += len(positions)
            self.disk.held += len(positions)

    def spill(self) -> None:
        """Takes the parts that are in memory to one file, in runs that keep their places."""
        out, run = [], []
        for part in [*self.parts, None]:
            if part is not None and len(part) == 2:
                run.append(part)
                continue
            if run:
                positions, prefixes = (np.concatenate(x) for x in zip(*run))
                path = self.disk.write(positions.astype("<i4").tobytes() + prefixes.tobytes())
                out += [(path, s, min(s + BLOCK, len(positions)), len(positions)) for s in range(0, len(positions), BLOCK)]
                run = []
            if part is not None:
                out.append(part)
        self.disk.held -= self.waiting
        self.parts, self.waiting = out, 0

    def _load(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(part) == 2:
            self.waiting -= len(part[0])
            self.disk.held -= len(part[0])
            return part
        path, a, b, n = part
        return np.frombuffer(self.disk.read(path, 4 * a, 4 * (b - a)), "<i4"), np.frombuffer(self.disk.read(path, 4 * n + a, b - a), np.uint8)

    def blocks(self, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes the tuples in blocks; more may be put at the end meanwhile. Backwards, each prefix is still that with the tuple which was put before."""
        self.parts.reverse()  # the next one is the last: it is taken off cheaply
        ahead, self.parts = self.parts, []
        while ahead or self.parts:
            if not ahead:
                ahead, self.parts = self.parts[::-1], []
            run, size = [], 0
            while ahead and size < BLOCK:
                part = ahead.pop(0 if backwards else -1)
                run.append(self._load(part))
                size += len(run[-1][0])
            if backwards:
                run.reverse()
            positions, prefixes = run[0] if len(run) == 1 else tuple(np.concatenate(x) for x in zip(*run))
            for s in range(0, len(positions), BLOCK)[:: -1 if backwards else 1]:
                yield positions[s : s + BLOCK], prefixes[s : s + BLOCK]


def types(text: np.ndarray) -> np.ndarray:
    """True for suffixes of type S; the last symbol is the least and occurs once."""
    n = len(text)
    if n == 1:
        return np.ones(1, bool)
    differs = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=np.int32), np.int32(n - 2))
    turn = np.minimum.accumulate(differs[::-1])[::-1]
    return np.append((text[:-1] < text[1:])[turn], True)


def stars_of(small: np.ndarray) -> np.ndarray:
    return (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)


def named(text: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the pieces from each star to the next, by their order, and how many there are; a piece that goes on is smaller than one that ends."""
    lengths = np.append(np.diff(stars) + 1, 1)
    bits = int(text.max()).bit_length() + 1
    each, end = 63 // bits, (1 << bits) - 1
    padded = np.append(text, np.zeros(each, text.dtype)).astype(np.int32)

    def packed(which: np.ndarray, start: int) -> np.ndarray:
        at, left = stars[which].astype(np.int64) + start, lengths[which] - start
        key = np.zeros(len(which), np.int64)
        for k in range(each):
            key = (key << bits) | np.where(left > k, padded[np.minimum(at + k, len(padded) - 1)], end)
        return key

    n = len(stars)
    key = packed(np.arange(n), 0)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    heads = np.flatnonzero(new)
    rank = np.empty(n, np.int64)  # the place of the first piece that is alike
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    open_ = order[np.repeat(np.diff(np.append(heads, n)) > 1, np.diff(np.append(heads, n)))]
    open_ = open_[lengths[open_] > each]
    start = each
    while len(open_):
        key = packed(open_, start)
        by = np.lexsort((key, rank[open_]))
        open_, key = open_[by], key[by]
        old = rank[open_]
        fresh = np.concatenate([[True], old[1:] != old[:-1]])
        new = fresh | np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(open_)))
        within = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        rank[open_] = old + np.repeat(heads, sizes) - within
        start += each
        open_ = open_[np.repeat(sizes > 1, sizes)]
        open_ = open_[lengths[open_] > start]
    seen = np.zeros(n + 1, bool)
    seen[rank] = True
    return (np.cumsum(seen) - 1)[rank].astype(np.int32), int(seen.sum())


def star_order(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """The stars in the order of their suffixes."""
    names, distinct = named(text, stars)
    if distinct == len(stars):
        out = np.empty_like(stars)
        out[names] = stars
        return out
    return stars[suffix_order(names)]


def doubled(text: np.ndarray) -> np.ndarray:
    """The order of a short string's suffixes by doubling."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while rank.max() < n - 1:
        after = np.append(rank[step:], np.full(min(step, n), -1))[:n]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1]
        step *= 2
    return np.argsort(rank).astype(np.int32)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of a string of names in the order of their suffixes."""
    if len(text) <= SMALL:
        return doubled(text)
    small = types(text)
    large = induced(text, ~small, star_order(text, stars_of(small)))
    own = small.copy()
    own[-1] = False  # the end follows from nothing
    falling = induced(text.max() - text, own, large[::-1])
    both = np.concatenate([[len(text) - 1], large, falling[::-1]]).astype(np.int32)
    return both[np.argsort(text[both], kind="stable")]


def _by(values: np.ndarray, low: int, high: int) -> np.ndarray:
    """Stable order of values from ``low`` to ``high``; few values are sorted by their digits."""
    return np.argsort((values - low).astype(np.uint16) if high - low < 1 << 16 else values, kind="stable")


def induced(symbols: np.ndarray, kind: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The suffixes of a kind in their order, from those of ``start`` (ascending by symbol); others come after them in a queue of one symbol."""
    entity = kind.copy()
    entity[start] = True
    counts = np.bincount(symbols[entity], minlength=int(symbols.max()) + 1)
    group = ((np.cumsum(counts) - 1) // BLOCK).astype(np.int32)
    group = np.unique(group, return_inverse=True)[1].astype(np.int32)
    groups = int(group[-1]) + 1
    edges = np.searchsorted(group, np.arange(groups + 1))  # first symbol of each group
    begins = np.searchsorted(group[symbols[start]], np.arange(groups + 1))
    own = group[symbols]
    link = np.append(kind[:-1] & (own[:-1] == own[1:]), False)
    chained = np.flatnonzero(link).astype(np.int32)
    chained = chained[np.argsort(own[chained], kind="stable")]
    chains = np.searchsorted(own[chained], np.arange(groups + 1))
    where, after = np.empty(len(symbols), np.int32), np.arange(1, len(symbols) + 1, dtype=np.int32)
    waiting: list[list[np.ndarray]] = [[] for _ in range(groups)]
    out = []
    for g in range(groups):
        low, high = int(edges[g]), int(edges[g + 1])
        known = np.concatenate(waiting[g]) if waiting[g] else np.zeros(0, np.int32)
        waiting[g] = []
        inside = chained[chains[g] : chains[g + 1]]
        every = np.concatenate([known, inside, start[begins[g] : begins[g + 1]]])
        order = _by(symbols[every], low, high)
        row = every[order]
        if len(inside):
            where[row] = np.arange(len(row))
            linked = link[row]
            place = np.flatnonzero(linked)
            same = symbols[row[place]]
            head = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
            sizes = np.diff(np.append(head, len(place)))
            rank = np.repeat(place[head], sizes)
            who = row[place]
            where[who] = rank
            left = np.repeat(sizes > 1, sizes)
            while left.any():
                some = np.flatnonzero(left)
                key = where[after[who[some]]]
                by = np.lexsort((key, rank[some]))
                old, key, moved = rank[some][by], key[by], who[some][by]
                fresh = np.concatenate([[True], old[1:] != old[:-1]])
                new = fresh | np.concatenate([[True], key[1:] != key[:-1]])
                head = np.flatnonzero(new)
                sizes = np.diff(np.append(head, len(some)))
                within = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                who[some], rank[some] = moved, old + np.repeat(head, sizes) - within
                left = left.copy()
                left[some] = np.repeat(sizes > 1, sizes)
                where[who] = rank
                ahead = after[who]
                after[who] = np.where(link[ahead], after[ahead], ahead)
            final = np.empty(len(row), np.int32)
            final[where[row]] = row
            row = final
        out.append(row[kind[row]])
        before = row - 1
        before = before[(row > 0) & kind[before]]
        to = own[before]
        before, to = before[to > g], to[to > g]
        by = np.argsort(to.astype(np.uint16) if groups < 1 << 16 else to, kind="stable")
        before, to = before[by], to[by]
        cuts = np.flatnonzero(np.diff(to)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            waiting[int(own[part[0]])].append(part)
    return np.concatenate(out)


class Words:
    """Common prefixes of the suffixes of a string of 8- or 16-bit symbols, up to ``width`` symbols; eight bytes are compared at once."""

    def __init__(self, text: np.ndarray, width: int):
        self.n, self.width, self.size = len(text), width, text.dtype.itemsize
        self.words = np.ndarray(self.n, "<u8", np.concatenate([text, np.zeros(8, text.dtype)]), strides=(self.size,))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), self.width, np.int64)
        each, end = 8 // self.size, self.n - 1
        live, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        x, y = a, b
        for k in range(0, self.width, each):
            differs = self.words[np.minimum(x, end)] ^ self.words[np.minimum(y, end)]
            found = (differs != 0) | (np.maximum(x, y) > end)
            low = differs[found]
            out[live[found]] = k + np.bitwise_count((low & -low) - np.uint64(1)) // (8 * self.size) % each
            left = ~found
            live, x, y = live[left], x[left] + each, y[left] + each
            if not len(live):
                break
        return np.minimum(np.minimum(out, self.width), self.n - np.maximum(a, b)).astype(np.uint8)  # nothing is shared beyond the end


_LOG = np.zeros(BLOCK + 2, np.uint8)
for _i in range(1, 18):
    _LOG[1 << _i :] = _i


class Pass:
    """One pass of induction on the top level, with common prefixes."""

    def __init__(self, words: Words, symbols: np.ndarray, kind: np.ndarray, disk: Disk):
        self.words, self.symbols, self.kind, self.width, self.disk = words, symbols, kind, words.width, disk
        self.queues = [Queue(disk) for _ in range(int(symbols.max()) + 1)]
        self.bucket = np.full(len(self.queues), -1)
        self.since = np.zeros(len(self.queues), np.uint8)

    def take(self, c: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Puts what comes before a block of queue ``c``; each prefix is that with the tuple taken before."""
        prefixes = prefixes.copy()
        before = positions - 1
        at = np.flatnonzero((positions > 0) & self.kind[before])
        least = prefixes.min() if len(prefixes) else 255
        open_ = self.bucket == c
        if not len(at):
            self.since[open_] = np.minimum(self.since[open_], least)
            return
        to = self.symbols[before[at]]
        by = np.argsort(to, kind="stable")
        at, to = at[by], to[by]
        head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        own = np.empty(len(at), np.uint8)
        # Between two tuples of this block: the least prefix on the way.
        depth = int(_LOG[max(1, len(prefixes))]) + 1
        table = np.empty((depth, len(prefixes)), np.uint8)
        table[0] = prefixes
        for k in range(1, depth):
            half = 1 << (k - 1)
            table[k] = table[k - 1]
            table[k, :-half] = np.minimum(table[k - 1, :-half], table[k - 1, half:])
        lo, hi = at[:-1] + 1, at[1:]
        inner = np.ones(len(at) - 1, bool)
        inner[head[1:] - 1] = False
        lo, hi = lo[inner], hi[inner]
        k = _LOG[hi - lo + 1]
        tail = np.ones(len(at), bool)
        tail[head] = False
        own[tail] = np.minimum(table[k, lo], table[k, hi - (1 << k.astype(np.int64)) + 1])
        # The first of a queue: from the tuple of this queue that last put one there.
        first = to[head]
        run = np.minimum.accumulate(prefixes)
        own[head] = np.where(open_[first], np.minimum(self.since[first], run[at[head]]), 0)
        own = np.minimum(own, self.width - 1) + 1
        known = self.bucket[first] >= 0
        own[head[~known]] = 0
        last = at[np.append(head[1:], len(at)) - 1]
        rest = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], 255)
        self.since[open_] = np.minimum(self.since[open_], least)
        self.since[first], self.bucket[first] = rest[last + 1], c
        moved = before[at]
        cuts = np.append(head, len(at)).tolist()
        for symbol, a, b in zip(first.tolist(), cuts, cuts[1:]):
            self.queues[symbol].put(moved[a:b], own[a:b])
        self.disk.room()

    def seam(self, a: int, b: int) -> int:
        return int(self.words.common(np.array([a]), np.array([b]))[0])


def descending(text: np.ndarray, width: int, disk: Disk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all suffixes but the last symbol's, from the largest to the smallest, each with its common prefix (up to ``width``) with the one before it.

    ``text`` has 8- or 16-bit symbols and ends in a 0, the only one.
    """
    symbols, words = text, Words(text, width)
    small = types(symbols)
    stars = star_order(symbols, stars_of(small))
    shared = np.concatenate([np.zeros(1, np.uint8), words.common(stars[:-1], stars[1:])])
    begins = np.searchsorted(symbols[stars], np.arange(int(symbols.max()) + 2))
    rising = Pass(words, symbols, ~small, disk)
    kept = [Queue(disk) for _ in rising.queues]
    ends = {}
    for c, queue in enumerate(rising.queues):
        last = -1
        for positions, prefixes in queue.blocks():
            kept[c].put(positions, prefixes)
            rising.take(c, positions, prefixes)
            last = int(positions[-1])
        ends[c] = last
        for s in range(int(begins[c]), int(begins[c + 1]), BLOCK):
            e = min(s + BLOCK, int(begins[c + 1]))
            prefixes = shared[s:e].copy()
            if s == begins[c]:
                prefixes[0] = rising.seam(last, int(stars[s])) if last >= 0 else 0
            rising.take(c, stars[s:e], prefixes)
    top = len(rising.queues) - 1
    own = small.copy()
    own[-1] = False
    falling = Pass(words, (top - symbols).astype(symbols.dtype), own, disk)
    for c, queue in enumerate(falling.queues):
        last = -1
        for positions, prefixes in queue.blocks():
            falling.take(c, positions, prefixes)
            yield positions, prefixes
            last = int(positions[-1])
        held = None  # the prefix of a tuple with the next larger one is that of the larger one with it
        for positions, prefixes in kept[top - c].blocks(backwards=True):
            positions, prefixes = positions[::-1], prefixes[::-1]
            lead = held if held is not None else (falling.seam(last, int(positions[0])) if last >= 0 else 0)
            held = prefixes[-1]
            down = np.concatenate([np.array([lead], np.uint8), prefixes[:-1]])
            falling.take(c, positions, down)
            yield positions, down
